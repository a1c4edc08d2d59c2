"""Tables and sizes that operators share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables of so few rows are joined plainly, whatever their keys.
FEW_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset (tests, one machine) a temporary one."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        have = "file://" + (own := tempfile.mkdtemp(prefix="glosstream-"))
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", have)
    return have.rstrip("/")


def stored(df: DataFrame, what: str, *by: str) -> DataFrame:
    """Write df as Parquet in the shared folder, in folders ``by`` columns, and read it again: later steps restart from there, whichever executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: all that was made from them is stored itself."""
    for df in frames:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if is_stored(path):
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def is_stored(path: str) -> bool:
    """Is this the folder of a stored table?"""
    return bool(re.fullmatch(r"[a-z-]+-[0-9a-f]{32}", path.rsplit("/", 1)[-1]))


def bucketed(df: DataFrame, what: str, buckets: int, *keys: str) -> DataFrame:
    """As :func:`stored`, in sorted buckets by the keys: joins of such tables with as many buckets shuffle neither.

    The catalogue has the table only until it is read.
    """
    spark = df.sparkSession
    name = f"{what.replace('-', '_')}_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.option("path", f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")  # its files stay: the table is external


def split_join(left: DataFrame, right: DataFrame, key: str | list[str], rows: int, share: int = 1000) -> DataFrame:
    """left joined with ``right``, which has one row for each key and in ``n`` how many rows of left have it.

    Keys with more than rows / share of the ``rows`` of left are no more than
    ``share``: these are broadcast, so that no task gets such a key whole.
    """
    keys = [key] if isinstance(key, str) else key
    if rows <= FEW_ROWS:
        return left.join(right, keys).drop("n")
    heavy = right.filter(F.col("n") * share > rows)
    rest = right.filter(F.col("n") * share <= rows)
    light = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(rest, keys)
    return left.join(F.broadcast(heavy), keys).unionByName(light).drop("n")


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, with 16 for each row."""
    row = docs.agg(F.sum(F.coalesce(F.octet_length(F.col(column).cast("string")), F.lit(0)) + F.lit(16)).alias("n")).first()
    return int(row["n"] or 0)


def parts_for(size: int, each: int, least: int = 1) -> int:
    return max(least, -(-size // each))
