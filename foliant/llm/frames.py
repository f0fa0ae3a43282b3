"""Small DataFrame helpers: cut lineage in the shared folder, bounded Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; only where it is unset and Spark is local (tests) is one made."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="foliant-"))
    return context.getCheckpointDir()


def cut(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it from there: executors may be lost afterwards.

    narrow is for rows of a few numbers, as links and labels: an eighth as many tasks and files.

    A table, not checkpoint(): a checkpoint's plan carries the constraints of all steps before it, and in
    loops they grow without end.
    """
    path = f"{folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    _written.setdefault(df.sparkSession.sparkContext.applicationId, set()).add(path)
    (df.coalesce(partitions(df.sparkSession) // 8 + 1) if narrow else df).write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._foliant_path = path
    return out


#: By application, the tables that cut() wrote and nobody has deleted.
_written: dict[str, set[str]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _written.get(spark.sparkContext.applicationId, set()).discard(path)


def drop(*frames: DataFrame | None) -> None:
    """Delete tables that cut() wrote and nothing reads any more."""
    for df in frames:
        if df is not None:
            _delete(df.sparkSession, df._foliant_path)


def sweep(spark: SparkSession) -> int:
    """Delete all tables that cut() wrote for this application, and say how many. For callers whose results are written: results read from them lazily."""
    paths = sorted(_written.get(spark.sparkContext.applicationId, set()))
    for path in paths:
        _delete(spark, path)
    return len(paths)


def bounded(spark: SparkSession, rows: int = 4096, size: str = "4m") -> None:
    """Bound the Arrow batches that Python gets, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(column: str, n: int):
    """crc32 of an id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def maybe_in(df: DataFrame, column: str, keys: DataFrame, most_bits: int = 1 << 27) -> DataFrame:
    """Rows of df whose column may be among keys (one column, already cut): a one-hash Bloom filter.

    The bitmap holds four bits or more for each key, 16 MB at most, and is broadcast. Keys may repeat. Beyond that it lets more
    rows through; what follows still has to join exactly.
    """
    key = keys.columns[0]
    bits = max(1 << 15, min(most_bits, 1 << max(0, 4 * keys.count() - 1).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits))
    maps = keys.groupBy(F.shiftright(place(key), 15).alias("_bucket")).agg(F.bitmap_construct_agg((place(key) % (1 << 15))).alias("_map"))
    at = place(column) % (1 << 15)
    byte = F.conv(F.hex(F.substring(F.col("_map"), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = df.withColumn("_bucket", F.shiftright(place(column), 15)).join(F.broadcast(maps), "_bucket")
    return found.where(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1).drop("_bucket", "_map")
