"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Scans of up to so many bytes in fewer files than cores are dealt out again.
SMALL_BYTES = 64 << 20


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df on all cores, if it is a small scan of few files.

    A row group is not split, so that a small file is one task however many
    cores wait.  Larger scans, and those of many files, stay as they are: they
    have tasks enough, and their rows are not worth a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    if not 0 < files < cores or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL_BYTES:
        return df
    return df.repartition(cores)
