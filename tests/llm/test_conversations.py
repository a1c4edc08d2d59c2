"""Conversation repair against a plain search for the cheapest edits."""

import functools
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from glosstream.llm import conversation_repair as R

SCHEMA = "conv_id long, turn long, role string, text string, seq string, copies_of string"


def search(rows):
    """(cost, edits, repaired text) of (role, text, fault) rows, by recursion over what is left and the pattern so far."""

    @functools.cache
    def best(t, state, inserted=0):
        found = []
        moves = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "ua"}, "ua": {"u": "u"}}[state]
        if t == len(rows):
            if state in ("", "ua"):
                found.append((0, "", ()))
        else:
            role, text, fault = rows[t]
            cost, edits, lines = best(t + 1, state)
            found.append((cost + 2, "D" + edits, lines))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if role[:1] in moves:
                    cost, edits, lines = best(t + 1, moves[role[:1]])
                    found.append((cost + extra, "K" + edits, (f"{role}:{text}", *lines)))
                for other in ("user", "assistant"):
                    if other[0] in moves:
                        cost, edits, lines = best(t + 1, moves[other[0]])
                        found.append((cost + extra + 1, "R" + edits, (f"{other}:{text}", *lines)))
        if inserted < 4:
            for other in ("user", "assistant"):
                if other[0] in moves:
                    cost, edits, lines = best(t, moves[other[0]], inserted + 1)
                    found.append((cost + 5, "I" + edits, (f"{other}:", *lines)))
        return min(found, default=(10**9, "", ()))

    cost, edits, lines = best(0, "")
    return cost, edits, "\n".join(lines)


def expected(table):
    """The whole query on (conv_id, turn, role, text) rows."""
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        convs[conv]
        role, text = role if role is not None else " ", text if text is not None else " "
        said = lambda v: " " if v is None else str(v)
        fate = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        convs[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, marked = set(), []
        for _, role, text in rows:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            marked.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        count = lambda f: sum(m[2] == f for m in marked)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, edits, text = search(tuple(marked))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, edits, hashlib.sha256(text.encode()).hexdigest())
    return out


def run(df):
    return {r["conv_id"]: tuple(r)[1:] for r in R.repair_damaged(df).collect()}


def some(seed, convs=60, longest=14):
    rng = random.Random(seed)
    texts = ["yes.", "yes", "no!", "", " \n", "why? because.", "a\tb", "Ünï.", "end. ", None]
    rows = []
    for conv in [None, *range(convs)]:
        for t in range(rng.randint(1, longest)):
            turn = rng.choice([t, t, t, rng.randint(0, 20), None])
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]), rng.choice([*texts, f"text {t}.", f"text {t}."])))
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_search(spark, seed):
    rows = some(seed)
    assert run(frame(spark, rows)) == expected(rows)


def test_blocks_give_the_same(spark):
    """Conversations that are cut into blocks of a few rows, in every partition: same results as solved whole."""
    rows = some(3, convs=12, longest=40) + [(99, t, r, x) for t, (_, _, r, x) in enumerate(some(4, convs=20))]
    df = R.damaged(frame(spark, rows))
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = expected(rows)
    for most in (4096, 5):
        got = {r["conv_id"]: tuple(r[c] for c in columns) for r in R.repaired(df, block_rows=most).collect()}
        assert got == {c: v for c, v in want.items() if c in got} and len(got) > 12


def test_matrices_compose():
    """Costs of two halves by their matrices are those of the whole."""
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = int(rng.integers(2, 30))
        initial, fault = rng.integers(0, 4, (n, 1)), rng.integers(0, 4, (n, 1))
        whole = R.backward(initial, fault, np.array([n]), R.END[None])[0, 0]
        end = R.END
        for lo, hi in ((n // 2, n), (0, n // 2)):
            four = lambda x: np.repeat(x[lo:hi], 4, 1)
            matrix = R.backward(four(initial), four(fault), np.full(4, hi - lo), np.where(np.eye(4, dtype=bool), 0, R.NEVER))[0].T
            end = np.minimum((matrix + end).min(1), R.NEVER)
        assert (end == whole).all()


def test_edges(spark):
    long = "word " * 200_000 + "."
    lost = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "gone."), (1, None, None, None), (2, 1, "user", long), (2, 2, "assistant", long), (2, 2, "assistant", long), (None, None, "user", "a."), (3, 5, "system", ""), (4, 0, "system", "s."), (4, 1, "user", "u."), (4, 2, "assistant", "a.")]
    got = run(frame(spark, rows))
    assert got == expected(rows)
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert R.repair_damaged(spark.createDataFrame([], SCHEMA)).count() == 0


def test_text_and_rows_that_repeat(spark):
    """Undamaged rows with the repaired text; a row that repeats very often is one kept and the others deleted."""
    rows = spark.createDataFrame([(1, 0, "user", "hello.", 3), (1, 1, "assistant", "cut", 1), (2, 0, "assistant", "alone.", 1)], "conv_id int, turn int, role string, text string, copies int")
    got = {r["conv_id"]: r for r in R.repaired(rows, with_text=True).collect()}
    assert (got[1]["audit"], got[1]["cost"], got[1]["duplicate"], got[1]["truncated"]) == ("DDDD", 8, 2, 1)
    assert (got[2]["audit"], got[2]["cost"], got[2]["repaired"]) == ("D", 2, "")
    hot = spark.createDataFrame([(7, 0, "user", "same.", 9000), (7, 1, "assistant", "fine.", 1)], "conv_id int, turn int, role string, text string, copies int")
    row = R.repaired(hot, with_text=True).first()
    assert row["duplicate"] == 8999 and row["cost"] == 17998 and row["audit"].count("K") == 2 and row["repaired"] == "user:same.\nassistant:fine."
