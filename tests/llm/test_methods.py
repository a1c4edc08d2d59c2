"""The operators against brute force, and the parts that their methods are made of."""

import hashlib
import mmap
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from glosstream.llm import decontaminate as D
from glosstream.llm import elias_fano as E
from glosstream.llm import language_id as L
from glosstream.llm import lm_score as S
from glosstream.llm import mixing as X
from glosstream.llm import quality_rank as Q
from glosstream.llm.components import components
from glosstream.llm.exact_dedup import heavy_digests, misra_gries
from glosstream.llm.hashing import Words, gram_starts, grams, text_buffer, words_of
from glosstream.llm.html_extract import main_text
from glosstream.llm.jaccard_join import Region, Rule, jaccard_components, rings, signatures
from glosstream.llm.line_dedup import LineRuns
from glosstream.llm.substring_dedup import factors, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def random_docs(seed, n=120, vocabulary=40):
    """Texts over few words: near copies, shared passages, short texts and repeats."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passage = [rng.choice(words) for _ in range(30)]
    base, out = [], []
    for i in range(n):
        kind = rng.random()
        if base and kind < 0.4:
            text = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(words)
        elif kind < 0.6:
            text = [rng.choice(words) for _ in range(rng.randint(0, 20))] + passage + [rng.choice(words) for _ in range(rng.randint(0, 20))]
        else:
            text = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 5, 20, 60, 200]))]
        base.append(text)
        out.append((i, " ".join(text)))
    return out


def test_words_are_those_of_the_pattern():
    samples = ["Ab c\td", None, "", "\n x \x0b\x0c y\r", "é ü", "a" * 3000 + " b"]
    w = words_of(pa.array(samples))
    spans = [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end)]
    assert spans == [x for s in samples for x in WORD.findall(s or "")]
    assert len(set(w.hash.tolist())) == len(set(spans))
    low = Words(*text_buffer(pa.array(["AB ab Ab"])), True)
    assert len(set(low.hash.tolist())) == 1
    sliced = words_of(pa.array(["x", "a b", "c"]).slice(1, 2))
    assert sliced.counts.tolist() == [2, 1]
    assert (gram_starts(w, 2) >= 0).all() and len(grams(w.hash, 99)) == 0


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (1, 50)])
def test_jaccard_against_all_pairs(spark, seed, k, num):
    rows = random_docs(seed)
    sets = {}
    for d, t in rows:
        w = WORD.findall(t.translate(LOWER))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), Rule(k, num, 100)).collect()}
    assert got == {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("seed", range(6))
def test_voronoi_cells_lose_no_link(seed):
    rng = np.random.default_rng(seed)
    rule, sets = Rule(3, 80, 100), []
    for _ in range(12):
        base = rng.choice(400, 60, replace=False)
        for _ in range(25):
            s = base.copy()
            s[rng.integers(0, 60, rng.integers(0, 12))] = rng.integers(400, 600)
            sets.append(np.unique(s).astype(np.uint64))
    region = Region(sets, rule, seed)
    region.join()
    plain = Region(sets, rule)
    plain.leaf(np.arange(len(sets)))
    root = lambda r: [r.forest.root(i) for i in range(len(sets))]
    assert root(region) == root(plain)


def test_cells_of_linked_sets_agree():
    rng = np.random.default_rng(3)
    for num in (90, 80, 50):
        rule = Rule(3, num, 100)
        bounds = rings(rule, 2000)
        for _ in range(200):
            n = int(rng.integers(1, 300))
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            t = int(rule.absent(n))
            b = np.concatenate([a[: n - int(rng.integers(0, t + 1))], rng.integers(0, 2**63, int(rng.integers(0, t + 1))).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if 100 * both < num * (len(a) + len(b) - both):
                continue
            ra, rb = (int(np.searchsorted(bounds, len(x), "right")) - 1 for x in (a, b))
            assert abs(ra - rb) <= 1
            shared = [r for r in {ra - 1, ra} & {rb - 1, rb} if r >= 0]
            assert any(np.intersect1d(signatures(a, r, bounds, rule), signatures(b, r, bounds, rule)).size for r in shared)


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 10), (5, 5)] + [(100, i) for i in range(101, 160)] + [(i, i + 1) for i in range(200, 260)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in (1, 2, 3)} == {1} and {got[i] for i in (10, 11, 12, 13)} == {10} and {got[i] for i in range(100, 160)} == {100} and {got[i] for i in range(200, 261)} == {200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", [4, 5])
def test_substrings_against_brute_force(spark, seed):
    rows = random_docs(seed, 150, 12)
    rows = [(d * 7 % 151, t) for d, t in rows]
    got = {r["doc_id"]: r for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    first, words = {}, {d: WORD.findall(t) for d, t in rows}
    for d in sorted(words):
        for i in range(len(words[d]) - 12):
            first.setdefault(tuple(words[d][i : i + 13]), d)
    for d, w in words.items():
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["kept_text"]) == (len(w), len(gone), kept)
        assert {j for s in got[d]["spans"] for j in range(s["start"], s["stop"])} == gone and got[d]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def test_factors():
    # Two texts: windows of three words at 1, 2 (source 7 from 5 on), 4 (source 8, straddling), and 9, 10 in the second text, whose sources differ.
    at, of = np.array([1, 2, 4, 9, 10]), np.array([0, 0, 0, 1, 1])
    found = factors(at, of, np.array([7, 7, 8, 7, 9]), np.array([5, 6, 0, 2, 3], np.uint32), 3)
    assert list(zip(*(x.tolist() for x in found))) == [(0, 1, 5, 7, 5), (0, 5, 7, 8, 1), (1, 9, 12, 7, 2), (1, 12, 13, 9, 5)]
    assert all(len(x) == 0 for x in factors(*[np.zeros(0, np.int64)] * 4, 3))


def test_factors_lead_to_their_sources(spark):
    rows = [(d * 7 % 151, t) for d, t in random_docs(6, 150, 12)]
    words = {d: WORD.findall(t) for d, t in rows}
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = [(r["doc_id"], s) for r in got for s in r["spans"]]
    assert spans and all(s["source"] < d and words[d][s["start"] : s["stop"]] == words[s["source"]][s["source_start"] : s["source_start"] + s["stop"] - s["start"]] for d, s in spans)
    with pytest.raises(TypeError):
        substring_dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_heavy_hitters(spark):
    def batches(values):
        return [pa.RecordBatch.from_arrays([pa.array(values[i : i + 50], pa.binary())], names=["digest"]) for i in range(0, len(values), 50)]

    rng = random.Random(0)
    values = [b"hot"] * 400 + [b"warm"] * 150 + [str(i).encode() for i in range(900)]
    rng.shuffle(values)
    summary = {d: n for b in misra_gries(10)(batches(values)) for d, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    assert len(summary) <= 10 and 400 - len(values) / 11 <= summary[b"hot"] <= 400
    df = spark.createDataFrame([(bytearray(v),) for v in values], "digest binary").repartition(7)
    heavy = {bytes(r["digest"]) for r in heavy_digests(df, len(values), 10).collect()}
    assert b"hot" in heavy and len(heavy) <= 10


def test_line_runs(spark):
    runs = LineRuns(fanout=2, partitions=2)
    make = lambda rows: spark.createDataFrame(rows, "owner long, h1 long, h2 long")
    for owner in range(5):
        runs.add(make([(owner, 1, 1), (owner, owner + 10, 0)]))
    assert {k: len(v) for k, v in runs.levels.items() if v} == {0: 1, 2: 1}
    # Each line is in one run, and later sightings are kept apart.
    assert sorted(r["h1"] for run in runs.runs() for r in run.collect()) == [1, 10, 11, 12, 13, 14]
    assert sorted((r["h1"], r["n_docs"], r["owner"]) for part in runs.again for r in part.collect()) == [(1, 1, owner) for owner in range(1, 5)]
    assert [r["h1"] for r in runs.unseen(make([(9, 1, 1), (9, 77, 0)])).collect()] == [77]
    # Merging a batch in shuffles none of the runs, nor the batch.
    plan = runs.unseen(runs.runs()[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == len(runs.runs()) and "Exchange" not in plan
    got = {r["h1"]: (r["n_docs"], r["owner"]) for r in runs.lines(1).collect()}
    assert got[1] == (5, 4) and got[12] == (1, 2) and len(got) == 6


def test_spaced_seeds_find_substituted_passages(spark):
    rng = random.Random(1)
    vocabulary = [f"t{i}" for i in range(3000)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(14, 60))] for _ in range(30)]
    docs, truth = [], set()
    for d in range(300):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 200))]
        if d % 3 == 0:
            item = rng.randrange(30)
            passage = list(items[item])
            for j in rng.sample(range(len(passage)), len(passage) // 10):
                passage[j] = "changed"
            at = rng.randint(0, len(text))
            text[at:at] = passage
            truth.add((d, item))
        docs.append((d, ", ".join(text).title() if d % 2 else " ".join(text)))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    # Brute force: every item along every place of every text.
    want = set()
    for d, t in docs:
        w = re.findall("[a-z0-9]+", t.lower())
        for i, item in enumerate(items):
            for shift in range(-len(item) + 12, len(w) - 11):
                same = np.array([0 <= shift + j < len(w) and w[shift + j] == x for j, x in enumerate(item)])
                lo, hi = max(0, -shift), min(len(item), len(w) - shift)
                if same.sum() >= 9 and D.best_overlap(same[lo:hi], 12, 0.8):
                    want.add((d, i))
    assert truth <= got == want


def plain_best(same, least, identity):
    """All stretches from match to match."""
    hits, best = np.flatnonzero(same), None
    for i, s in enumerate(hits):
        for j in range(i, len(hits)):
            size, matched = hits[j] + 1 - s, j - i + 1
            if size >= least and matched >= identity * size - 1e-9 and (best is None or matched > best[2]):
                best = (int(s), int(hits[j] + 1), matched)
    return best


def test_best_overlap_against_all_stretches():
    rng = np.random.default_rng(8)
    for _ in range(400):
        same = rng.random(rng.integers(0, 60)) < rng.choice([0.3, 0.7, 0.85])
        got, want = D.best_overlap(same, 12, 0.8), plain_best(same, 12, 0.8)
        assert (got is None) == (want is None) and (got is None or got[2] == want[2])


@pytest.mark.parametrize("kinds", [2, 4, 12])
def test_diagonals_follow_one_rule_however_often_seeds_repeat(kinds):
    """Best overlaps are those of all diagonals on which a seed lies, for texts of few and of many kinds of words."""
    rnd = random.Random(kinds)
    some = lambda n: [f"w{rnd.randrange(kinds)}" for _ in range(n)]
    items, texts = [some(rnd.randrange(3, 40)) for _ in range(6)], [some(rnd.randrange(0, 120)) for _ in range(8)]
    # Each text also holds an item with some of its words changed.
    texts = [x + [w if rnd.random() < 0.9 else "changed" for w in items[t % 6]] + some(5) for t, x in enumerate(texts)]
    want = []
    for t, text in enumerate(texts):
        for i, item in enumerate(items):
            least, best = min(12, len(item)), None
            for shift in range(1 - len(item), len(text)):
                a, b = max(0, -shift), min(len(item), len(text) - shift)
                same = np.array([item[k] == text[k + shift] for k in range(a, b)], bool)
                seeded = any(all(same[s + j] for j, bit in enumerate(m) if bit == "1") for m in D.MASKS for s in range(len(same) - len(m) + 1))
                span = D.best_overlap(same, least, 0.8) if seeded else None
                if span and (best is None or span[2] > best[4]):
                    best = (t, i, a + shift + span[0], span[1] - span[0], span[2])
            want += [best] if best else []
    index = D.SeedIndex(list(range(len(items))), [" ".join(x) for x in items])
    assert want and sorted(index.overlaps(Words(*text_buffer(pa.array([" ".join(x) for x in texts])), True, D.TOKENS), 12, 0.8)) == want


def test_repeated_seeds_take_bounded_work():
    import time

    item, text = "word " * 200, "word " * 5000
    mixed = " ".join(("a b c" if i % 7 else "x") for i in range(3000))
    index = D.SeedIndex([1, 2, 3], [item, mixed, "the quick brown fox jumps over the lazy dog and runs far away"])
    began = time.perf_counter()
    got = index.overlaps(Words(*text_buffer(pa.array([text, mixed, "start " + item])), True, D.TOKENS), 12, 0.8)
    assert time.perf_counter() - began < 10
    assert {(t, i): rest for t, i, *rest in got} == {(0, 0): [0, 200, 200], (1, 1): [0, 8142, 8142], (2, 0): [1, 200, 200]}


def test_best_overlap():
    same = lambda s: np.array([c == "1" for c in s])
    assert D.best_overlap(same("111101111011110000000"), 12, 0.8) == (0, 14, 12)
    assert D.best_overlap(same("1111111"), 12, 0.8) is None
    assert D.best_overlap(same("0" * 30), 12, 0.8) is None


def test_pfair_stays_within_a_block():
    rng = random.Random(2)
    for _ in range(20):
        n = rng.randint(1, 9)
        shares = X.whole_shares([rng.random() + 0.01 for _ in range(n)], 512)
        slots = X.edf_period(shares, 512)
        assert sum(shares) == 512 and sorted(t for s in slots for t in s) == list(range(512))
        for k, mine in zip(shares, slots):
            counts = np.cumsum(np.isin(np.arange(512), mine))
            assert (np.abs(counts - np.arange(1, 513) * k / 512) < 1).all()


def test_phases_place_every_block_once():
    blocks = {"a": 100, "b": 7, "c": 31}
    plan = X.phases(blocks, {"a": 1, "b": 2, "c": 1}, 64)
    seen = []
    for p in plan:
        later = [q["base"] for q in plan if q["source"] == p["source"] and q["base"] > p["base"]]
        for b in range(p["base"], min(later, default=blocks[p["source"]])):
            i = b - p["base"]
            seen.append(p["start"] + i // p["share"] * p["period"] + p["slots"][i % p["share"]])
    assert sorted(seen) == list(range(138))


def test_mix_follows_weights(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else "cold", "t") for i in range(900)], "doc_id long, source string, text string")
    got = X.mix(df, {"hot": 1, "cold": 1}, block_rows=10, period=64).collect()
    order = sorted((r["mix_slot"], r["mix_place"], r["source"]) for r in got)
    assert Counter(s for _, _, s in order[:600]) == {"hot": 300, "cold": 300}
    assert sorted({r["mix_slot"] for r in got}) == list(range(90))


def test_mix_against_a_plain_schedule(spark):
    """Earliest deadline first worked out slot by slot with fractions, on the rows in the order of their places."""
    from fractions import Fraction
    from math import ceil

    rng = random.Random(9)
    rows = [(i, rng.choice("aaaabbc"), "t") for i in range(3000)]
    weights = {"a": 5, "b": 2, "c": 1}
    got = X.mix(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5), weights, block_rows=10).collect()
    assert len({r["doc_id"] for r in got}) == 3000
    blocks = {s: -(-sum(x == s for _, x, _ in rows) // 10) for s in weights}
    # Slots in which the ideal, which flows by weight among those not used up, reaches j blocks.
    ideal = {s: [Fraction(0)] for s in weights}
    at, level, left = Fraction(0), dict.fromkeys(weights, Fraction(0)), set(weights)
    while left:
        share = sum(weights[s] for s in left)
        s, step = min(((s, (len(ideal[s]) - level[s]) / Fraction(weights[s], share)) for s in left), key=lambda x: (x[1], x[0]))
        at += step
        for o in left:
            level[o] += step * Fraction(weights[o], share)
        for o in sorted(left):
            if level[o] == len(ideal[o]):
                ideal[o].append(at)
        left = {o for o in left if len(ideal[o]) <= blocks[o]}
    done, want = dict.fromkeys(weights, 0), []
    for t in range(sum(blocks.values())):
        ready = [(ceil(ideal[s][done[s] + 1]), s) for s in sorted(weights) if done[s] < blocks[s] and ideal[s][done[s]] < t + 1]
        s = min(ready)[1]
        want.append((s, done[s]))
        done[s] += 1
    have = {r["mix_slot"]: (r["source"], r["mix_block"]) for r in got}
    assert [have[t] for t in range(len(want))] == want


def test_a_bounded_plan_grows_its_blocks(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "if(id % 3 = 0, 'x', 'y') as source", "'t' as text")
    got = X.mix(df, plan_limit=50).collect()
    assert len(got) == 5000 and len({r["mix_slot"] for r in got}) <= 52 and max(r["mix_place"] for r in got) == 99
    assert len({(r["mix_slot"], r["mix_place"]) for r in got}) == 5000


def test_elias_fano():
    rng = np.random.default_rng(1)
    for values in (rng.integers(0, 10**7, 5000), rng.integers(0, 30, 500), [0], [], [5, 5, 5], [0, 2**60]):
        values = np.sort(np.array(values, np.uint64))
        coded = E.EliasFano.open(E.EliasFano.of(values).to_bytes())[0]
        assert (coded[np.arange(len(values))] == values).all()
        asked = np.concatenate([rng.integers(0, 2 * 10**7, 500).astype(np.uint64), values, values + np.uint64(1)])
        assert (coded.successor(asked) == np.searchsorted(values, asked)).all()
    dense = E.EliasFano.of(np.arange(0, 10**6, 7, dtype=np.uint64))
    assert 8 * (len(dense.lows) + len(dense.highs)) < 6 * dense.n


def test_trie_from_a_memory_map(tmp_path):
    rng = np.random.default_rng(2)
    contexts = np.sort(rng.choice(2**60, 300, replace=False)).astype(np.uint64)
    keys = np.repeat(contexts, rng.integers(1, 40, 300))
    ids = np.concatenate([np.sort(rng.choice(2**40, n, replace=False)) for n in np.unique(keys, return_counts=True)[1]]).astype(np.uint64)
    codes = rng.integers(1, 255, len(keys)).astype(np.uint8)
    backs = codes[np.searchsorted(keys, keys)]
    (tmp_path / "t").write_bytes(E.Trie.of(keys, ids, codes, backs).to_bytes())
    with (tmp_path / "t").open("rb") as f:
        trie = E.Trie.open(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        got = trie.find(keys, ids)
        assert (got[:, 0] == codes).all() and (got[:, 1] == backs).all()
        assert (trie.find(keys, ids + np.uint64(1))[:, 0] == np.where(np.append((keys[1:] == keys[:-1]) & (ids[1:] == ids[:-1] + 1), False), np.append(codes[1:], 0), 0)).all()
        assert not trie.find(contexts + np.uint64(1), np.zeros(300, np.uint64)).any()
        shuffled = rng.permutation(len(keys))
        assert (trie.find(keys[shuffled], ids[shuffled])[:, 0] == codes[shuffled]).all()
        # No array of its own: every level lies in the map.
        assert all(not a.flags.owndata for e in (trie.contexts, trie.pointers, trie.successors) for a in (e.lows, e.highs, e.ones))


def test_lm_against_brute_force(spark, docs, texts, monkeypatch):
    from glosstream.llm import exchange

    small = lambda d: exchange.dealt(d, 60_000, 60_000)  # noqa: E731  many batches and shards
    monkeypatch.setattr(S, "dealt", small)
    got = {r["doc_id"]: r for r in S.lm_score(docs).collect()}
    tokens = {d: WORD.findall(t.translate(LOWER)) + ["</s>"] for d, t in texts.items()}
    c, pairs, after = Counter(), Counter(), Counter()
    for d, t in tokens.items():
        if zlib.crc32(str(d).encode()) % 7 != 2:
            before = ["<s>", *t[:-1]]
            c.update(t)
            pairs.update(zip(before, t))
            after.update(before)
    n, v = sum(c.values()), len(c)
    for d, t in tokens.items():
        p1 = [(c[w] + 1) / (n + v + 1) for w in t]
        mass = [S.MASS + S.SHARE * after[x] for x in ["<s>", *t[:-1]]]
        p = [(pairs[a, b] + m * q) / (after[a] + m) for a, b, m, q in zip(["<s>", *t[:-1]], t, mass, p1)]
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(c[w] > 0 for w in t), n, zlib.crc32(str(d).encode()) % 7 == 2)
        assert abs(r["base_score"] - sum(np.log10(p1))) < 1e-6
        assert abs(r["score"] - sum(np.log10(p))) < 0.02 * len(t)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_pieces_of_frequent_contexts_change_nothing(spark, docs):
    from pyspark.sql import functions as F

    held = F.col("doc_id") % 5 == 0
    whole = {r["doc_id"]: r["score"] for r in S.lm_scores(docs, held).collect()}
    cut = {r["doc_id"]: r["score"] for r in S.lm_scores(docs, held, piece=50).collect()}
    assert whole == pytest.approx(cut, rel=1e-12)


def test_lm_takes_any_doc_id(spark):
    rows = spark.createDataFrame([("a", "x y"), (None, "x z")], "doc_id string, text string")
    assert {r["doc_id"] for r in S.lm_score(rows).collect()} == {"a", None}
    assert S.lm_score(rows.selectExpr("cast(1.5 as decimal(9, 2)) doc_id", "text")).count() == 2


def test_model_shards(spark, docs):
    shards = S.model_shards(docs).collect()
    assert shards and sum(len(E.Trie.open(bytes(r["trie"])).codes) for r in shards) > 1000


def test_languages_on_held_out_texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in rows.select("doc_id", "lang").collect()}
    got = [r for r in L.language_id(rows).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) / len(got) > 0.99
    assert sum(r["rejected"] for r in got) / len(got) < 0.05


def test_kneser_ney_sums_to_one():
    models = L.train({"x": pa.array(["abca bcab cabc abab baba caca"] * 3), "y": pa.array(["zzz zyz"] * 3)}, order=3)
    letters = "abc"
    for prefix in ("", "a", "ab", "ca"):
        words = pa.array([prefix + c for c in letters])
        flat, starts = L._codes(words)
        p = np.full((len(flat) - 1, 2), models.floor)
        for n in range(1, 4):
            g, h = L._grams(flat, starts, n)
            p = L._row(models.gram_keys[n - 1], models.gram_parts[n - 1], g, 0.0) + L._row(models.history_keys[n - 1], models.history_weights[n - 1], h, 1.0) * p
        last = p[starts[1:] - 2, 0]
        end, es = L._codes(pa.array([prefix]))
        total = last.sum()
        assert 0.5 < total <= 1.0 + 1e-9  # the rest is the end of the word and characters never seen


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = {r["doc_id"]: r for r in Q.quality_scores(docs, labels).collect()}
    held = [d for d in truth if got[d]["held_out"]]
    good, poor = ([got[d]["score"] for d in held if truth[d] == q] for q in (1, 0))
    assert np.mean([g > p for g in good for p in poor]) > 0.98
    assert np.mean([g >= 0.3 for g in good]) > 0.995 and np.mean([p < 0.3 for p in poor]) >= 0.9
    assert np.median(good) > 0.95 and np.median(poor) < 0.05


def test_bradley_terry_prefers_what_pairs_prefer():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] - 2 * x[:, 1] > 0.5).astype(float)
    ranker = Q.fit_ranker(x, y)
    s = ranker.score(x)
    assert (s[y == 1].min() > s[y == 0].max() - 0.2) and ranker.weights[0] > 0 > ranker.weights[1]
    assert abs(np.mean(s < ranker.threshold(0.25)) - 0.25) < 0.01


def test_articles():
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav>
    <div class="with-sidebar"><main><article><header><h2>Head &amp; line</h2></header><p>First paragraph, with commas, and enough words to count as prose here.
    <p>Second   one,\n with <b>bold</b> and <a href=y>a link</a>, goes on for a while longer.<ul><li>point one<li>point two</ul><script>var a="</p>"</script><form><input>Send</form><aside>Box</aside></article>
    <div class="ad-box">Buy</div><section id="comments"><p>Reader says, well, many things, at length, again and again.</p></section></main><div class="sidebar"><p>Side, text, here, with, commas.</p></div></div>
    <div class="cookie-notice">We use cookies</div><footer>&copy; 2020</footer></body></html>"""
    assert main_text(page).split("\n") == ["Head & line", "First paragraph, with commas, and enough words to count as prose here.", "Second one, with bold and a link, goes on for a while longer.", "point one", "point two"]
    plain = "<body><div id=nav><a href=1>One</a> <a href=2>Two</a></div><div id=content><p>Some words, here.</p><p>More words, there, and there.</p></div><div class=footer>end</div>"
    assert main_text(plain) == "Some words, here.\nMore words, there, and there."


def test_points_and_links_decide_inside_an_article():
    prose = "A sentence of the article, long enough, with commas, to read like prose."
    page = f"""<body><main><article><h1>Title</h1><p class='legal'>{prose}</p><div class='search-results'><p>{prose}</p></div>
    <div class='toolbar'><a href=1>Print this page now</a> <a href=2>Send this page to a friend</a></div><div class='comments'><p>{prose}</p></div><p class='notice'>Short.</p></article>
    <article><h2><a href=3>Another story, teased</a></h2><p>Its first words.</p></article></main><p class='legal'>{prose}</p></body>"""
    assert main_text(page).split("\n") == ["Title", prose, prose]


def test_pages_without_article_or_main():
    p = "Some words of prose, with commas, that go on for long enough to earn points."
    links = "<ul>" + "".join(f"<li><a href={i}>Link number {i}, with words</a></li>" for i in range(30)) + "</ul>"
    page = f"<body><div>{links}</div><div><div><h1>Head</h1><p>{p}</p><p>{p}</p></div><div><p>{p}</p></div></div><div>{links}</div></body>"
    assert main_text(page).split("\n") == ["Head", p, p, p]
    assert main_text(f"<table><tr><td>{links}</td><td><p>{p}</p><p>{p}</p></td></tr></table>").split("\n") == [p, p]
    assert main_text("just text, no markup") == "just text, no markup" and main_text("<p>" + "x " * 300_000 + "</p>").count("x") == 300_000


def test_pages_against_their_articles(spark):
    import html

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in rows:
        inside = re.search("<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>?", "", b)).split()) for b in re.split("<p>|</p>|</h1>", inside)]
        assert main_text(r["html"]) == "\n".join(b for b in blocks if b)


def test_pipeline_against_brute_force(spark, docs):
    """Each stage's decisions, worked out plainly on the stage's own input."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] or "" for r in frame.collect()}
        out = stage(spark, frame, folder)
        after = {r["doc_id"] for r in out.collect()}
        if name == "exact_dedup":
            groups = defaultdict(list)
            for d, t in before.items():
                groups[t].append(d)
            assert after == {max(g) for g in groups.values()}
        elif name == "near_dedup":
            sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w := WORD.findall(t.translate(LOWER))) >= 5 else ({tuple(w)} if w else set()) for d, t in before.items()}
            linked = {b for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
            assert after == set(before) - linked
        elif name == "decontaminate":
            items = [WORD.findall(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            whole = {d for d, t in before.items() if any(" ".join(i) in " ".join(WORD.findall(t)) for i in items)}
            assert whole <= set(before) - after and len(set(before) - after) <= len(before) // 10
        elif name == "quality":
            assert len(after) >= 0.7 * len(before)
        else:
            assert after == set(before)
        frame = out.select(*docs.columns)


def slots_of(plan, blocks):
    """By source the slots of all its blocks, as mix looks them up."""
    out = {}
    for s, n in blocks.items():
        mine = [p for p in plan if p["source"] == s]
        ends = [*(p["base"] for p in mine[1:]), n]
        out[s] = [p["start"] + i // p["share"] * p["period"] + p["slots"][i % p["share"]] for p, end in zip(mine, ends) for i in range(end - p["base"])]
    return out


@pytest.mark.parametrize("sources", [1, 2, 20, 100, 1000])
def test_plan_stays_within_a_block_of_the_target_weights(sources):
    rng = random.Random(sources)
    for drift in (False, True):
        # A hot third against equal rest, long enough that no source runs dry first; then sizes by chance, so that they do.
        weights = {f"s{i}": (rng.random() + 0.01 if drift else (sources - 1) / 2 or 1.0 if i == 0 else 1.0) for i in range(sources)}
        blocks = {f"s{i}": rng.randint(1, 60_000 // sources) if drift else (20_000 if i == 0 else 40_000 // sources) for i in range(sources)}
        plan = slots_of(X.phases(blocks, weights), blocks)
        assert sorted(t for mine in plan.values() for t in mine) == list(range(sum(blocks.values())))
        # The ideal: all sources flow by weight; the number of slots at virtual time v is the sum of min(n, w v).
        n, w = (np.array([m[s] for s in plan], float) for m in (blocks, weights))
        at = np.sort(np.concatenate([[0], n / w]))
        slots = np.array([np.minimum(n, w * v).sum() for v in at])
        for k, mine in enumerate(map(np.array, plan.values())):
            ideal = lambda t, k=k: np.minimum(n[k], w[k] * np.interp(t, slots, at))
            count = np.arange(len(mine))
            assert (ideal(mine + 1) - count > -1e-6).all() and (count + 1 - ideal(mine + 1) < 1 + 1e-6).all() and (ideal(mine) - count < 1 + 1e-6).all()


def test_sources_without_weight_go_last():
    blocks = {"a": 5000, "b": 3, "c": 5}
    plan = slots_of(X.phases(blocks, {"a": 0.5, "b": 0.0}), blocks)
    assert sorted(plan["a"]) == list(range(5000)) and sorted(plan["b"] + plan["c"]) == list(range(5000, 5008))


def test_long_texts_do_not_end_the_teaching_list(spark):
    from pyspark.sql import functions as F

    rows = [(i, "x", f"short text number{'abcdefghij'[i % 10]} of many") for i in range(40)] + [(i, "x", "longish words " * 350_000) for i in range(40, 43)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = L.teaching_texts(docs, F.col("doc_id") < 0)
    assert got.count() == 43 and got.filter("teaches").count() == 38 and got.filter("calibrates").count() == 5
    models = L.learned(got)
    whole = L.train({"x": pa.array([t for _, _, t in rows])})
    assert models.langs == ["x"] and all((a == b).all() for a, b in zip(models.gram_keys, whole.gram_keys))
    assert all(np.allclose(a, b) for a, b in zip(models.gram_parts, whole.gram_parts)) and np.allclose(models.limits, whole.limits)


def test_a_language_of_one_id_is_learned(spark):
    from pyspark.sql import functions as F

    rows = [(5000, "fr", f"le chat numéro {i} est parti") for i in range(3000)] + [(i, "en", f"the cat number {i} has left") for i in range(200)] + [(7, None, "nothing"), (8, "en", None)] + [(9, "de", "die Katze ist weg")] * 50
    got = Counter(r["lang"] for r in L.teaching_texts(spark.createDataFrame(rows, "doc_id long, lang string, text string"), F.lit(False), 100).collect())
    assert got == {"fr": 100, "en": 100, "de": 1}


def test_marks_without_letters_are_no_language(spark):
    rows = [(1, "en", "some plain words"), (3, "fr", "quelques mots simples"), (4, None, "\u0301\u0301 \u0301"), (5, None, "e\u0301 mots"), (None, "en", "more words")]
    got = {r["doc_id"]: r for r in L.language_id(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    assert (got[4]["lang_pred"], got[4]["score"]) == ("und", 0) and got[5]["lang_pred"] in ("en", "fr") and got[None]["held_out"] is False


def test_kneser_ney_against_brute_force():
    """Counts in dictionaries, one n-gram at a time."""
    text, order = "abca bcab cabc abab baba caca bac", 4
    models = L.train({"x": pa.array([text])}, order)
    words = [["^", *w, "$"] for w in text.split()]
    full = Counter(tuple(w[max(0, i - order + 1) : i + 1]) for w in words for i in range(1, len(w)))
    levels = [full]
    for _ in range(order - 1):  # continuation counts: how many longer n-grams end so
        kinds = defaultdict(set)
        n = order - len(levels)
        for w in words:
            for i in range(1, len(w)):
                kinds[tuple(w[max(0, i - n + 1) : i + 1])].add(tuple(w[max(0, i - n) : i + 1]))
        levels.append(Counter({g: len(k) for g, k in kinds.items()}))

    def probability(history, c):
        p = models.floor
        for n in range(1, order + 1):
            counts = levels[order - n]
            ones, twos = (sum(v == k for v in counts.values()) for k in (1, 2))
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            h = tuple(history[-(n - 1) :]) if n > 1 else ()
            mine = {g: v for g, v in counts.items() if g[:-1] == h}
            if mine:
                total = sum(mine.values())
                p = max(mine.get((*h, c), 0) - d, 0) / total + d * len(mine) / total * p
        return p

    asked = ["abca", "cab", "zab", "b"]
    costs, size = models.word_costs(pa.array(asked))
    for word, cost, n in zip(asked, costs[:, 0], size):
        chars = ["^", *word, "$"]
        want = -sum(np.log(probability(chars[max(0, i - order + 1) : i], chars[i])) for i in range(1, len(chars)))
        assert n == len(word) + 1 and abs(cost - want) < 1e-9
