"""Questions from batches of documents to shards of a corpus-wide index, and the answers.

Documents are dealt into batches by a hash.  A batch reduces what it wants to
know to sorted distinct keys and sends each shard its share as one packed row;
a shard answers each batch in the order of its keys, so that answers need no
keys.  However often a key occurs, a batch sends it once.  One dealing of the
documents serves all rounds of a plan (the exchange is reused), and tables of
texts are never joined.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import parts_for, text_bytes

BATCH_TEXT = 8 << 20
SHARD_TEXT = 12 << 20
PACKED = "batch long, shard int, blob binary"


def dealt(docs: DataFrame, batch_text: int = BATCH_TEXT, shard_text: int = SHARD_TEXT) -> tuple[DataFrame, int, int]:
    """(batch, doc_id, text) partitioned by batch, the number of batches, and that of shards that suits the texts.

    The hash covers doc_id, text and the task that reads the row: rows that
    repeat an id, or as a whole, spread too, and a task that runs again deals
    its rows as before.
    """
    size = text_bytes(docs)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    batches = parts_for(size, batch_text, least)
    at = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(batches))
    return docs.select(at.alias("batch"), "doc_id", "text").repartition(max(least, batches // 2), "batch"), batches, parts_for(size, shard_text, least)


def packed(batch: int, shard: np.ndarray, columns: list[np.ndarray], shards: int) -> tuple[pa.Table, np.ndarray]:
    """One row for each shard with its share of the columns; and the order in which the answers come.

    A blob is the number of rows, then each column as bytes.
    """
    order = np.argsort(shard.astype(np.uint32), kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
    ids = np.flatnonzero(np.diff(bounds))
    columns = [c[order] for c in columns]
    blobs = [np.array([bounds[s + 1] - bounds[s]], np.uint64).tobytes() + b"".join(c[bounds[s] : bounds[s + 1]].tobytes() for c in columns) for s in ids]
    return pa.table({"batch": pa.array(np.full(len(ids), batch, np.int64)), "shard": pa.array(ids, pa.int32()), "blob": pa.array(blobs, pa.binary())}), order


def unpacked(blob: bytes, kinds: list[np.dtype]) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(blob, np.uint64, 1)[0]), 8, []
    for kind in kinds:
        kind = np.dtype(kind)
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * kind.itemsize
    return out


def answers(requests: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Each shard's answers to its batches, as rows (batch, shard, blob)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("batch")
        return pa.table({"batch": table["batch"], "shard": table["shard"], "blob": pa.array(answer([b.as_py() for b in table["blob"]]), pa.binary())})

    return requests.groupBy("shard").applyInArrow(run, PACKED)


def gathered(replies: pa.Table, order: np.ndarray, kind: np.dtype) -> np.ndarray:
    """The answers to one batch, in the order of its keys."""
    replies = replies.sort_by("shard")
    parts = [np.frombuffer(b.as_py(), kind) for b in replies["blob"]]
    out = np.empty(len(order), kind)
    out[order] = np.concatenate(parts) if parts else np.zeros(0, kind)
    return out
