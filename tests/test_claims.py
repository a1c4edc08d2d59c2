"""Claims of a stream: once for each id, the same when a batch is replayed, again after a time-out."""

import shutil
import time
from pathlib import Path

from pyspark.sql import functions as F

from glosstream.streaming import claims as C

SCHEMA = "id int, at int, status string"
ROWS = [
    [(1, 1, "pending"), (2, 1, "pending"), (2, 1, "pending"), (3, 1, "done"), (None, 1, "pending")],
    [(1, 2, "pending"), (3, 2, "pending"), (4, 2, "pending"), (2, 2, "done"), (6, 3, "pending"), (6, 2, "approved")],
    [(2, 3, "pending"), (5, 3, "pending"), (4, 3, "done"), (7, 5, None)],
]


def feed(spark, folder, rows):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.01 * (i + 1))


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def read(spark, folder):
    return sorted((r["batch"], r["id"], r["attempt"]) for r in spark.read.option("basePath", str(folder)).parquet(f"{folder}/batch=*").collect())


def test_each_id_once_and_replayed(spark, tmp_path):
    source, target, mark = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    feed(spark, source, ROWS)
    C.queue(stream(spark, source), str(target), str(mark))
    got = read(spark, target)
    assert sorted(i for _, i, _ in got) == ["1", "2", "4", "5", "7"] and {a for *_, a in got} == {1}
    # The same as over the whole table.
    assert sorted(r["id"] for r in C.first_rows(spark.read.schema(SCHEMA).parquet(str(source))).collect()) == ["1", "2", "4", "5", "7"]
    # Nothing new: nothing is claimed.
    C.queue(stream(spark, source), str(target), str(mark))
    assert read(spark, target) == got
    # The last batch is replayed, as after a failure between its output and its commit.
    last = max(int(p.name) for p in Path(mark, "commits").iterdir() if p.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        Path(mark, "commits", name).unlink(missing_ok=True)
    shutil.rmtree(Path(target, f"batch={last}"))
    C.queue(stream(spark, source), str(target), str(mark))
    assert read(spark, target) == got
    # New rows go on where the state is.
    feed(spark, source, [[(1, 9, "pending"), (8, 9, "pending"), (5, 9, "done")]])
    C.queue(stream(spark, source), str(target), str(mark))
    assert sorted(i for _, i, _ in read(spark, target)) == ["1", "2", "4", "5", "7", "8"]


def test_time_out_offers_again(spark, tmp_path):
    source, mark = tmp_path / "in", tmp_path / "ck"
    feed(spark, source, [[(1, 1, "pending"), (2, 1, "done")]])
    got = []
    query = C.claims(stream(spark, source), "1 second", attempts=2).writeStream.foreachBatch(lambda df, n: got.extend((r["id"], r["attempt"]) for r in df.collect())).outputMode("append").option("checkpointLocation", str(mark)).trigger(processingTime="300 milliseconds").start()
    try:
        ends = time.time() + 60
        while len(got) < 2 and time.time() < ends:
            time.sleep(0.3)
        time.sleep(3)
    finally:
        query.stop()
    assert got == [("1", 1), ("1", 2)]


def test_resumable(spark):
    rows = spark.createDataFrame([(i,) for i in range(5)], "id int")
    results = spark.createDataFrame([(0, 1, "done"), (1, 1, "done"), (1, 2, "failed"), (2, 1, "failed"), (2, 2, "approved"), (3, 1, None)], SCHEMA)
    assert sorted(r["id"] for r in C.resumable(rows, results).collect()) == [1, 3, 4]
    assert C.first_rows(results.filter(F.lit(False))).count() == 0
