"""Tables that a job writes for itself in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only on one machine that names none."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="glosstream-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        have = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", have)
    return have.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet and read again, so that what depends on its partitions is settled and lost executors cost little."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
