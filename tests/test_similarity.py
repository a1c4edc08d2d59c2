from hypothesis import given, settings
from hypothesis import strategies as st

from glosstream.functions.similarity import alike, combined, cosmetic_pair, coverage, lcs_length, partial_ratio, ratio, real_difference

texts = st.text("abcا ", max_size=14)


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(texts, texts)
def test_ratio(a, b):
    assert lcs_length(a, b) == slow_lcs(a, b)
    assert ratio(a, b) == ratio(b, a)
    assert (ratio(a, b) == 100) == (a == b)


@settings(max_examples=200, deadline=None)
@given(texts, texts)
def test_partial_ratio_is_the_best_window(a, b):
    short, long = sorted((a, b), key=len)
    if not short:
        return
    n = len(short)
    windows = {long[max(0, e - n) : e] for e in range(1, len(long) + n)} - {""}
    assert abs(partial_ratio(a, b) - max(ratio(short, w) for w in windows)) < 1e-9 or len(a) == len(b)
    if short in long:
        assert partial_ratio(a, b) == 100


@settings(max_examples=300, deadline=None)
@given(texts, texts)
def test_bounds_change_nothing(a, b):
    assert alike(a, b, 80) == (ratio(a, b) >= 80)
    query, words = " ".join(a.split()), b.split()
    full = combined(query, [b], words)
    assert combined(query, [b], words, enough=0.6) == (full if full >= 0.6 else 0.0)


def test_cosmetic_pairs():
    for pair in ("مستهزءون,مستهزيون", "مستهزءون,مستهزون", "ءانذرتهم,اانذرتهم", "بياياته,باياته"):
        assert cosmetic_pair(*pair.split(","))
    for pair in ("قال,قل", "الصالحين,الصابرين", "تعملون,يعملون", "فيه,فه"):
        assert not cosmetic_pair(*pair.split(","))


def test_difference_and_coverage():
    assert real_difference(["مستهزءون", "قال"], ["مستهزيون"]) == (["قال"], [])
    assert coverage(["abcd", "zzzz"], ["abcx"]) == 0.0 and coverage(["abcde", "zz"], ["abcdx"]) == 0.5
    assert combined("ab cd", ["ab cd ef"], ["ab", "cd", "ef"]) == 1.0
    assert combined("ab cd ef gh", ["ab cd"], ["ab", "cd"]) == ratio("ab cd ef gh", "ab cd") / 100
