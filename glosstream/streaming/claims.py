"""Work that is queued once: a stream of rows claims each id, keeps what it claimed as keyed state, and offers it again if nobody finished it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a claim.
CLAIM = "id string, attempt int"
DONE = ("approved", "suggested", "done")
FINISHED = 0


def first_rows(rows: DataFrame, done: tuple[str, ...] = DONE) -> DataFrame:
    """(id, attempt) of a table rows(id, at, status): each id once, unless its first row says that it is done.

    What a stream over the same rows claims if nothing times out.  Rows are in
    order of ``at``; of rows at one time, one that is done comes first.
    """
    first = rows.filter("id is not null").groupBy(F.col("id").cast("string").alias("id")).agg(F.min(F.struct("at", F.coalesce(~F.col("status").isin(*done), F.lit(True)).alias("open"))).alias("f"))
    return first.filter("f.open").select("id", F.lit(1).alias("attempt"))


def claims(rows: DataFrame, timeout: str = "1 hour", attempts: int = 3, done: tuple[str, ...] = DONE) -> DataFrame:
    """(id, attempt) of a stream of rows(id, at, status), once for each id.

    The state of an id is the number of its attempts, or that it is finished.
    Its first row claims it, whichever files or batches it comes in again; a
    row that says it is done finishes it for good.  A claim that is not
    finished within ``timeout`` is offered again, ``attempts`` times in all.
    Rows without id claim nothing.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        claim = lambda n: pd.DataFrame({"id": [key[0]], "attempt": pd.array([n], dtype="int32")})
        if state.hasTimedOut:
            tried = state.get[0]
            if tried == FINISHED or tried >= attempts:
                return
            state.update((tried + 1,))
            state.setTimeoutDuration(milliseconds)
            yield claim(tried + 1)
            return
        table = pd.concat(list(frames))
        finished = table["status"].isin(done)
        if not state.exists:
            # The first row is the earliest; of rows at one time, one that is done.
            earliest = table.assign(open=~finished).sort_values(["at", "open"], na_position="first").iloc[0]
            if earliest["open"]:
                yield claim(1)
        if finished.any():
            state.update((FINISHED,))
        elif not state.exists:
            state.update((1,))
            state.setTimeoutDuration(milliseconds)

    milliseconds = int(pd.Timedelta(timeout).total_seconds() * 1000)
    named = rows.filter("id is not null").select(F.col("id").cast("string").alias("id"), "at", "status")
    return named.groupBy("id").applyInPandasWithState(update, CLAIM, "tried int", "append", "ProcessingTimeTimeout")


def queue(stream: DataFrame, target: str, checkpoint: str, timeout: str = "1 hour", attempts: int = 3) -> None:
    """Write the claims of a stream until its source is read, then stop.

    A batch is written under its own number with overwrite, and state is kept
    by batch: one that is run again after a failure claims the same ids, into
    the same place.
    """

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/batch={number}")

    # A state with time-outs asks for batches without data for ever: a run that is to end has none, and offers again what timed out when new rows come.
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        query = claims(stream, timeout, attempts).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        conf.set(name, before)


def resumable(rows: DataFrame, results: DataFrame, done: tuple[str, ...] = DONE) -> DataFrame:
    """rows(id, ...) that are still to do: those without a finished result(id, at, status), by the latest one of each.

    Running the same work twice does it once: results are looked up by id, and
    a failed or missing one leaves its row to do.
    """
    latest = Window.partitionBy("id").orderBy(F.desc("at"), F.col("status").isin(*done))
    finished = results.withColumn("__r", F.row_number().over(latest)).filter("__r = 1").filter(F.col("status").isin(*done)).select("id")
    return rows.join(finished, "id", "left_anti")
