"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import ship as sending

__all__ = ["all_of", "among", "ascii_lower", "clear", "materialise", "partitions", "ranked", "run_folder", "settled", "shared_folder", "ship", "tables"]

#: Bytes of an Arrow batch, about. Whole texts in Spark's 10,000 rows or 64 MB are held several times over by the executor and its Python workers.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
#: Bits of the bitmap of ids, 8 MB, which is broadcast.
BITS = 1 << 26
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors; batches for Python are of BATCH bytes unless the session says otherwise."""
    sending.ship(spark)
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the cluster names none, and the session is a local one (as in tests), a temporary folder is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="wharfline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_folder(spark)}/wharfline/{spark.sparkContext.applicationId}"


def _system(spark: SparkSession):  # noqa: ANN202
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables that this application has written; results that still read them are lost."""
    system, path = _system(spark)
    system.delete(path, True)


def tables(spark: SparkSession) -> set[str]:
    """The names of this application's intermediate tables."""
    system, path = _system(spark)
    return {s.getPath().getName() for s in system.listStatus(path)} if system.exists(path) else set()


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` gives, as a table; the tables that it wrote on the way are deleted."""
    before = tables(spark)
    out = materialise(make(), name)
    system, path = _system(spark)
    for t in tables(spark) - before:
        if not t.startswith(f"{name}-"):
            system.delete(spark._jvm.org.apache.hadoop.fs.Path(path, t), True)
    return out


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{run_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Spark's lower() is the same, and faster, on texts without other characters."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def ranked(df: DataFrame, keys: list[str], order: list[str], bucket: Column, rank: str = "rank") -> DataFrame:
    """Add the gapless 0-based ``rank`` of each row within ``keys`` without gathering a group in one task.

    Rows of a key are dealt into the buckets of ``bucket`` (a fixed number, evenly filled), numbered there by
    ``order``, and moved by the number of rows in the key's earlier buckets. The table of counts has one row for
    each key and bucket, whatever the number of rows.
    """
    dealt = df.withColumn("_bucket", bucket)
    counts = dealt.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = dealt.withColumn("_local", F.row_number().over(local) - 1)
    joined = numbered.join(starts, all_of([F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_bucket") == F.col("_b")]))
    return joined.select(*df.columns, (F.col("_local") + F.col("_start")).cast("long").alias(rank))


def all_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (id, ...) whose id is in ``ids`` (one column of distinct ids); most others are left out by a bitmap before anything is moved."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS)) + 1
    name = ids.columns[0]
    bitmap = ids.groupBy(F.bitmap_bucket_number(at(name)).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at(name))).alias("_bits"))
    bit = F.bitmap_bit_position(at("id"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    near = rows.join(F.broadcast(bitmap), F.bitmap_bucket_number(at("id")) == F.col("_bucket"))  # BITS / 8 bytes at most
    near = near.where(F.pmod(F.floor(byte / F.pow(F.lit(2), bit % 8)), F.lit(2)) == 1).select(*rows.columns)
    return near.join(ids, F.col("id") == F.col(name)).drop(name)  # not a semi-join, which would be pushed below the bitmap
