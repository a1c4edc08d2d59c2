"""Repair of the turn structure of conversations by a time-major tensor DP.

The repaired roles are to read ``(s?(ua)+)?`` by their initials.  Four states
say how far that pattern has come; costs are held as a tensor (turn,
conversation, state).  Conversations are bucketed by length, and each turn's
costs of all conversations of a bucket come from those of the next turn in a
few array operations; the stored costs are then traced forwards, again for all
conversations at once.

Rows are put in order by a range partitioning, so that a long conversation lies
in several partitions.  Conversations that lie inside one partition are solved
there.  The others are cut into blocks of rows: a block becomes the matrix of
its costs from state to state, matrices are folded backwards along the
conversation, blocks are traced from every state, and the states are followed
forwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

#: What role and text edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: A block of a long conversation has at most so many rows or so many bytes of text (or one text).
BLOCK_ROWS, BLOCK_BYTES = 4096, 8 << 20
#: Conversations of so many rows in all are solved together.
TOGETHER = 1 << 15
SPACES = " \t\n\x0b\x0c\r"

NEVER = np.int64(1) << 60
#: States: nothing yet, after s, after u, after ua.  Where an inserted or reroled turn leads from each.
NEXT = np.array([2, 2, 3, 2])
#: Where keeping a turn leads by state and initial (s, u, a, other).
KEEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: What is left to pay after the last row: a user and an assistant after s, an assistant after u.
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
END_INSERTS = np.array([0, 2, 1, 0])
LETTERS = "DKR"
#: su, ua and au may follow each other.
LEGAL = np.zeros((4, 4), bool)
LEGAL[[0, 1, 2], [1, 2, 1]] = True
FINE, BLANK, DUPLICATE, CUT = range(4)


def _steps(initial: np.ndarray, fault: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of deleting, keeping and reroling one turn, (conversations, states) each, from the costs ``after`` it."""
    gone = ((fault == BLANK) | (fault == DUPLICATE))[:, None]
    extra = np.where(fault == CUT, TRUNCATED, 0)[:, None]
    to = KEEP[:, initial].T
    kept = np.where((to < 0) | gone, NEVER, np.take_along_axis(after, np.maximum(to, 0), 1) + extra)
    return after + DELETE, kept, np.where(gone, NEVER, after[:, NEXT] + REROLE + extra)


def backward(initial: np.ndarray, fault: np.ndarray, lengths: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs (turns + 1, conversations, 4) of all that comes from each turn on; ``end`` are those after the last one."""
    costs = np.empty((len(initial) + 1, *end.shape), np.int64)
    costs[-1] = end
    for t in range(len(initial) - 1, -1, -1):
        least = np.minimum.reduce(_steps(initial[t], fault[t], costs[t + 1]))
        for _ in range(2):
            least = np.minimum(least, least[:, NEXT] + INSERT)
        costs[t] = np.where((t < lengths)[:, None], np.minimum(least, NEVER), costs[t + 1])
    return costs


def trace(initial: np.ndarray, fault: np.ndarray, lengths: np.ndarray, costs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest edits, ASCII-least of equal ones: (turns, conversations) of 3 * inserts before + place in LETTERS; and the states after the last."""
    every, out = np.arange(initial.shape[1]), np.zeros(initial.shape, np.uint8)
    for t in range(len(initial)):
        here = t < lengths
        delete, keep, _ = _steps(initial[t], fault[t], costs[t + 1])
        inserts = np.zeros(len(every), np.uint8)
        for _ in range(2):
            now = costs[t][every, state]
            into = here & (now < NEVER) & (delete[every, state] != now) & (costs[t][every, NEXT[state]] + INSERT == now)
            inserts += into
            state = np.where(into, NEXT[state], state)
        now = costs[t][every, state]
        deleted, kept = delete[every, state] == now, keep[every, state] == now
        letter = np.where(deleted, 0, np.where(kept, 1, 2))
        out[t] = 3 * inserts + letter
        to = np.where(deleted, state, np.where(kept, KEEP[state, initial[t]], NEXT[state]))
        state = np.where(here, to, state)
    return out, state


class Rows:
    """Rows of whole conversations or blocks in order, told apart by ``first`` (where each begins, and the end)."""

    def __init__(self, table: pa.Table, first: np.ndarray):
        self.table, self.first = table, first
        self.initial, self.fault = (table[c].to_numpy().astype(np.int64) for c in ("initial", "fault"))
        self.lengths = np.diff(first)
        self.of = np.repeat(np.arange(len(self.lengths)), self.lengths)

    def keys(self) -> list[str]:
        return [f"{d}{r}" for d, r in zip(self.table["digest"].to_pylist(), self.table["role"].to_pylist())]

    def mark_duplicates(self) -> None:
        """Rows that are not blank and have role and text of an earlier one of their conversation."""
        table = pd.DataFrame({"of": self.of, "role": self.table["role"].to_pylist(), "digest": self.table["digest"].to_pylist()})
        self.fault[table.duplicated().to_numpy() & (self.fault != BLANK)] = DUPLICATE

    def buckets(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By length: which ones, and their initials and faults time-major."""
        yield from buckets(self.initial, self.fault, self.first)

    def gaps(self) -> np.ndarray:
        """Turns missing between the smallest and the largest; turns are in order, nulls first."""
        turn = self.table["turn"]
        real = turn.is_valid().to_numpy(zero_copy_only=False) if isinstance(turn, pa.Array) else turn.combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        turn, of = turn.fill_null(0).to_numpy()[real], self.of[real]
        new = np.ones(len(turn), bool)
        new[1:] = (turn[1:] != turn[:-1]) | (of[1:] != of[:-1])
        distinct = np.bincount(of[new], minlength=len(self.lengths))
        out = np.zeros(len(self.lengths), np.int64)
        begin, end = np.searchsorted(of, np.arange(len(out))), np.searchsorted(of, np.arange(len(out)), "right")
        some = end > begin
        out[some] = turn[end[some] - 1] - turn[begin[some]] + 1 - distinct[some]
        return out

    def illegal(self) -> np.ndarray:
        wrong = ~LEGAL[self.initial[:-1], self.initial[1:]] & (self.of[:-1] == self.of[1:])
        return np.bincount(self.of[:-1][wrong], minlength=len(self.lengths))

    def count(self, fault: int) -> np.ndarray:
        return np.bincount(self.of[self.fault == fault], minlength=len(self.lengths))


def buckets(initial: np.ndarray, fault: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Which sequences are of about one length, and their initials and faults as (turn, sequence)."""
    lengths = np.diff(first)
    kinds = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for kind in np.unique(kinds):
        mine = np.flatnonzero(kinds == kind)
        at = first[mine] + np.minimum(np.arange(lengths[mine].max())[:, None], np.maximum(lengths[mine] - 1, 0))
        yield mine, initial[at], fault[at]


def audit_of(codes: np.ndarray, tail: int = 0) -> str:
    return "".join(["I" * (c // 3) + LETTERS[c % 3] for c in codes.tolist()]) + "I" * tail


def repaired_lines(codes: np.ndarray, tail: int, state: int, initial: np.ndarray, roles: list[str], texts: list[str]) -> list[str]:
    """``role:text`` of the rows as repaired, from a state on."""
    out, turn = [], ["user", "assistant"] if state != 2 else ["assistant", "user"]
    for code, i, role, text in zip(codes.tolist(), initial.tolist(), roles, texts):
        for _ in range(code // 3):
            out.append(turn[0] + ":")
            turn.reverse()
        if code % 3:
            out.append(f"{role if code % 3 == 1 else turn[0]}:{text}")
            if code % 3 == 2 or i:
                turn.reverse()
    for _ in range(tail):
        out.append(turn[0] + ":")
        turn.reverse()
    return out


_LOCAL = pa.schema(
    [("conv", pa.string()), ("open", pa.bool_()), ("seq", pa.int64())] + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired", pa.string()), ("repaired_sha256", pa.string())]
    + [("initial", pa.binary()), ("fault", pa.binary()), ("turn", pa.list_(pa.int64())), ("digest", pa.list_(pa.string())), ("role", pa.list_(pa.string())), ("text", pa.list_(pa.string()))]
)
_LOCAL_DDL = "conv string, open boolean, seq long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string, repaired_sha256 string, initial binary, fault binary, turn array<long>, digest array<string>, role array<string>, text array<string>"


def _solved(table: pa.Table, first: np.ndarray, with_text: bool) -> pa.RecordBatch:
    """Whole conversations."""
    rows = Rows(table, first)
    rows.mark_duplicates()
    n = len(rows.lengths)
    cost, audits, digests, kept = np.zeros(n, np.int64), [""] * n, [""] * n, [None] * n
    roles, texts = table["role"].to_pylist(), table["text"].to_pylist()
    for mine, initial, fault in rows.buckets():
        lengths = rows.lengths[mine]
        costs = backward(initial, fault, lengths, np.tile(END, (len(mine), 1)))
        codes, state = trace(initial, fault, lengths, costs, np.zeros(len(mine), np.int64))
        cost[mine] = costs[0, :, 0]
        for j, i in enumerate(mine.tolist()):
            lo, hi, mark, tail = first[i], first[i + 1], codes[: lengths[j], j], int(END_INSERTS[state[j]])
            audits[i] = audit_of(mark, tail)
            text = "\n".join(repaired_lines(mark, tail, 0, rows.initial[lo:hi], roles[lo:hi], texts[lo:hi]))
            digests[i], kept[i] = hashlib.sha256(text.encode()).hexdigest(), text if with_text else None
    columns = {"conv": table["conv"].take(pa.array(first[:-1])), "open": [False] * n, "gaps": rows.gaps(), "blank": rows.count(BLANK), "duplicate": rows.count(DUPLICATE), "truncated": rows.count(CUT), "illegal": rows.illegal(), "cost": cost, "audit": audits, "repaired": kept, "repaired_sha256": digests}
    return _batch(columns, n)


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    flat = {k: (v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays([pa.array(flat[f.name]).cast(f.type) if f.name in flat else pa.nulls(n, f.type) for f in _LOCAL], schema=_LOCAL)


def _blocks(table: pa.Table, part: int, number: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of one conversation as blocks of at most so many rows, numbered on."""
    sizes = np.cumsum(pa.compute.binary_length(table["text"]).to_numpy())
    lo = 0
    while lo < len(table):
        hi = max(lo + 1, min(lo + most, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + BLOCK_BYTES, "right"))))
        rows = table.slice(lo, hi - lo)
        columns = {"conv": [table["conv"][0].as_py()], "open": [True], "seq": [(part << 32) + number]}
        columns |= {c: [rows[c].to_numpy().astype(np.uint8).tobytes()] for c in ("initial", "fault")}
        columns |= {c: [rows[c].to_pylist()] for c in ("turn", "digest", "role", "text")}
        yield _batch(columns, 1)
        lo, number = hi, number + 1


def _local(with_text: bool, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order.  The first and the last conversation of a partition may go on elsewhere; those and long ones go into blocks."""
        part, number, waiting, is_open = TaskContext.get().partitionId(), 0, [], True
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table.take(pa.array(np.repeat(np.arange(len(table)), table["copies"].to_numpy())))
            table = pa.concat_tables([*waiting, table]).combine_chunks()
            conv = table["conv"].combine_chunks()
            new = np.flatnonzero(pa.compute.not_equal(conv[1:], conv[:-1]).to_numpy(zero_copy_only=False)) + 1 if len(conv) > 1 else np.zeros(0, np.int64)
            first = np.concatenate([[0], new])
            if is_open and len(new):
                for out in _blocks(table.slice(0, new[0]), part, number, most):
                    number += 1
                    yield out
                first, is_open = new, False
            if not is_open:
                for cuts in _together(first):
                    yield _solved(table.slice(cuts[0], cuts[-1] - cuts[0]), cuts - cuts[0], with_text)
            rest = table.slice(first[-1])
            if len(rest) >= most or rest.nbytes >= BLOCK_BYTES:
                is_open = True
                for out in _blocks(rest, part, number, most):
                    number += 1
                    yield out
                rest = rest.slice(len(rest))
            waiting = [rest] if len(rest) else []
        for rest in waiting:
            yield from _blocks(rest, part, number, most)

    return run


def _together(first: np.ndarray) -> Iterator[np.ndarray]:
    """The bounds of whole conversations, in portions of about TOGETHER rows; what follows the last bound is left out."""
    lo = 0
    while lo < len(first) - 1:
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + TOGETHER, "right")) - 1)
        hi = min(hi, len(first) - 1)
        yield first[lo : hi + 1]
        lo = hi


_STATE_DDL = "conv string, seq long, initial binary, fault binary, first int, last int, illegal long, blank long, duplicate long, truncated long, low long, high long, turns long, matrix array<long>"


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's faults, with duplicates of rows in earlier blocks, its counts and its matrix of costs."""
    for batch in batches:
        for r in batch.to_pylist():
            initial, fault = (np.frombuffer(r[c], np.uint8).astype(np.int64) for c in ("initial", "fault"))
            keys = [f"{d}{role}" for d, role in zip(r["digest"], r["role"])]
            again = pd.Series(keys).duplicated().to_numpy() | pd.Series(keys).isin(r["seen"] or []).to_numpy()
            fault[again & (fault != BLANK)] = DUPLICATE
            n, turns = len(initial), [t for t in r["turn"] if t is not None]
            ends = np.where(np.eye(4, dtype=bool), 0, NEVER)
            four = lambda x: np.repeat(x[:, None], 4, 1)
            matrix = backward(four(initial), four(fault), np.full(4, n), ends)[0].T
            row = {
                "conv": r["conv"], "seq": r["seq"], "initial": r["initial"], "fault": fault.astype(np.uint8).tobytes(), "first": int(initial[0]), "last": int(initial[-1]),
                "illegal": int((~LEGAL[initial[:-1], initial[1:]]).sum()), "blank": int((fault == BLANK).sum()), "duplicate": int((fault == DUPLICATE).sum()), "truncated": int((fault == CUT).sum()),
                "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(set(turns)), "matrix": matrix.ravel().tolist(),
            }
            yield pa.RecordBatch.from_pylist([row], schema=_STATES)


_STATES = pa.schema(
    [("conv", pa.string()), ("seq", pa.int64()), ("initial", pa.binary()), ("fault", pa.binary()), ("first", pa.int32()), ("last", pa.int32())] + [(c, pa.int64()) for c in ("illegal", "blank", "duplicate", "truncated", "low", "high", "turns")] + [("matrix", pa.list_(pa.int64()))]
)
_ENDS = pa.schema([("seq", pa.int64()), ("conv", pa.string()), ("end", pa.list_(pa.int64())), ("final", pa.bool_())] + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")])
_ENDS_DDL = "seq long, conv string, end array<long>, final boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _folded_back(table: pa.Table) -> pa.Table:
    """The costs after each block of a conversation, and in the last block's row what is known of the whole."""
    rows = table.sort_by("seq").to_pylist()
    end, ends = END, []
    for r in reversed(rows):
        ends.append(end.tolist())
        end = np.minimum((np.array(r["matrix"], np.int64).reshape(4, 4) + end).min(1), NEVER)
    ends.reverse()
    whole = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal")}
    whole["illegal"] += sum(not LEGAL[a["last"], b["first"]] for a, b in zip(rows, rows[1:]))
    timed = [r for r in rows if r["low"] is not None]
    whole["gaps"] = timed[-1]["high"] - timed[0]["low"] + 1 - sum(r["turns"] for r in timed) + sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:])) if timed else 0
    whole["cost"] = int(end[0])
    out = [{"seq": r["seq"], "conv": r["conv"], "end": e, "final": False} for r, e in zip(rows, ends)]
    out[-1] |= whole | {"final": True}
    return pa.Table.from_pylist(out, schema=_ENDS)


_TRACES = pa.schema([("conv", pa.string()), ("seq", pa.int64()), ("codes", pa.list_(pa.binary())), ("exits", pa.list_(pa.int32())), ("final", pa.bool_())])
_TRACES_DDL = "conv string, seq long, codes array<binary>, exits array<int>, final boolean"


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's edits from each of the four states."""
    for batch in batches:
        for r in batch.to_pylist():
            initial, fault = (np.repeat(np.frombuffer(r[c], np.uint8).astype(np.int64)[:, None], 4, 1) for c in ("initial", "fault"))
            lengths = np.full(4, len(initial))
            costs = backward(initial, fault, lengths, np.tile(np.array(r["end"], np.int64), (4, 1)))
            codes, exits = trace(initial, fault, lengths, costs, np.arange(4))
            yield pa.RecordBatch.from_pylist([{"conv": r["conv"], "seq": r["seq"], "codes": [codes[:, q].tobytes() for q in range(4)], "exits": exits.tolist(), "final": r["final"]}], schema=_TRACES)


_ENTRIES = pa.schema([("seq", pa.int64()), ("entry", pa.int32()), ("tail", pa.int32())])


def _followed(table: pa.Table) -> pa.Table:
    """The state in which each block of a conversation is entered."""
    out, state = [], 0
    for r in table.sort_by("seq").to_pylist():
        out.append({"seq": r["seq"], "entry": state, "tail": 0})
        state = r["exits"][state]
    out[-1]["tail"] = int(END_INSERTS[state])
    return pa.Table.from_pylist(out, schema=_ENTRIES)


_PIECES = pa.schema([("conv", pa.string()), ("seq", pa.int64()), ("audit", pa.string()), ("lines", pa.int64()), ("piece", pa.string())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's part of the audit and of the repaired text."""
    for batch in batches:
        for r in batch.to_pylist():
            codes = np.frombuffer(r["codes"], np.uint8)
            lines = repaired_lines(codes, r["tail"], r["entry"], np.frombuffer(r["initial"], np.uint8), r["role"], r["text"])
            yield pa.RecordBatch.from_pylist([{"conv": r["conv"], "seq": r["seq"], "audit": audit_of(codes, r["tail"]), "lines": len(lines), "piece": "\n".join(lines)}], schema=_PIECES)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each conversation, which come in order; one piece is held at a time."""
    at, digest = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([at]), pa.array([digest.hexdigest()])], names=["conv", "repaired_sha256"])
    for batch in batches:
        for conv, lines, piece in zip(*(batch.column(c).to_pylist() for c in ("conv", "lines", "piece"))):
            if conv != at:
                if at is not None:
                    yield row()
                at, digest, begun = conv, hashlib.sha256(), False
            if lines:
                digest.update(("\n" * begun + piece).encode())
                begun = True
    if at is not None:
        yield row()


def _across(blocks: DataFrame, with_text: bool) -> DataFrame:
    """Conversations that lie in blocks, solved along them."""
    keyed = blocks.select("conv", "seq", F.explode(F.arrays_zip("digest", "role")).alias("r"))
    keyed = keyed.select("conv", "seq", F.concat("r.digest", "r.role").alias("key")).groupBy("conv", "key", "seq").agg(F.lit(1).alias("one"))
    repeated = keyed.groupBy("conv", "key").agg(F.min("seq").alias("least"), F.count("one").alias("n")).filter("n > 1")
    seen = keyed.join(repeated, ["conv", "key"]).filter("seq > least").groupBy("seq").agg(F.collect_list("key").alias("seen"))
    states = stored(blocks.select("conv", "seq", "initial", "fault", "turn", "digest", "role").join(seen, "seq", "left").mapInArrow(_states, _STATE_DDL), "block-states")
    ends = stored(states.drop("initial", "fault").groupBy("conv").applyInArrow(_folded_back, _ENDS_DDL), "block-ends")
    traces = stored(states.select("conv", "seq", "initial", "fault").join(ends.select("seq", "end", "final"), "seq").mapInArrow(_traced, _TRACES_DDL), "block-traces")
    entries = traces.select("conv", "seq", "exits").groupBy("conv").applyInArrow(_followed, "seq long, entry int, tail int")
    edits = traces.join(entries, "seq").select("seq", F.get("codes", F.col("entry")).alias("codes"), "entry", "tail")
    pieces = stored(blocks.select("conv", "seq", "initial", "role", "text").join(edits, "seq").mapInArrow(_pieces, "conv string, seq long, audit string, lines long, piece string"), "repaired-pieces")
    digests = pieces.select("conv", "seq", "lines", "piece").repartition("conv").sortWithinPartitions("conv", "seq").mapInArrow(_hashed, "conv string, repaired_sha256 string")
    in_order = lambda c: F.array_sort(F.collect_list(F.struct("seq", c)))
    audits = pieces.groupBy("conv").agg(F.array_join(in_order("audit")["audit"], "").alias("audit"))
    if with_text:
        texts = pieces.filter("lines > 0").groupBy("conv").agg(F.array_join(in_order("piece")["piece"], "\n").alias("repaired"))
        audits = audits.join(texts, "conv", "left").withColumn("repaired", F.coalesce("repaired", F.lit("")))
    else:
        audits = audits.withColumn("repaired", F.lit(None).cast("string"))
    whole = ends.filter("final").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return whole.join(audits, "conv").join(digests, "conv").select(*COLUMNS)


COLUMNS = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired", "repaired_sha256"]


def _name(conv_id: Column) -> Column:
    """A conversation's id as a string that is never null."""
    return F.when(conv_id.isNull(), F.lit("n")).otherwise(F.concat(F.lit("k"), conv_id.cast("string")))


def repaired(rows: DataFrame, with_text: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text and, if wanted, copies: how often a row stands there).

    Columns are conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256, and the repaired text on request.  Defined cases: a
    null role or text is one space; null turns come first; rows of one turn are
    in order of role, then of the SHA-256 of the text; rows with a null conv_id
    are one conversation; a role counts by its first letter, and an empty one
    has none; an empty table gives an empty table; other columns are ignored.
    """
    copies = F.col("copies").cast("int") if "copies" in rows.columns else F.lit(1)
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    letter = F.substring("role", 1, 1)
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    ordered = rows.select(_name(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"), F.spark_partition_id().alias("task"))
    ordered = ordered.select(
        "conv", "turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "task", "text", "copies", F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3).alias("initial"),
        F.when(bare == "", BLANK).when(F.substring(bare, -1, 1).isin(".", "!", "?"), FINE).otherwise(CUT).alias("fault"),
    )
    # The task that read a row parts rows that repeat as a whole, so that no range holds all of them.
    by = ["conv", "turn", "role", "digest", "task"]
    local = stored(ordered.repartitionByRange(*by).sortWithinPartitions(*by).drop("task").mapInArrow(_local(with_text, block_rows), _LOCAL_DDL), "conversation-parts", "open")
    whole = local.filter(~F.col("open")).select(*COLUMNS).unionByName(_across(local.filter("open"), with_text))
    kind = rows.schema["conv_id"].dataType
    conv_id = F.when(F.col("conv") != "n", F.substring("conv", 2, 1 << 30)).cast(kind)
    return whole.select(conv_id.alias("conv_id"), *[c for c in COLUMNS[1:] if with_text or c != "repaired"])


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the damage that a row's crc32 decides on."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"), fate.alias("fate")).filter("fate != 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("fate") == 3, 2).otherwise(1).alias("copies"))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Every conversation of the table, damaged and repaired; those that lose all rows have zeros, an empty audit and the digest of nothing."""
    found = repaired(damaged(conversations)).withColumn("name", _name(F.col("conv_id"))).drop("conv_id")
    every = conversations.select("conv_id").distinct().withColumn("name", _name(F.col("conv_id")))
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COLUMNS[1:7]]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return every.join(found, "name", "left").select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
