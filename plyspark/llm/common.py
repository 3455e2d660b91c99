"""What the operators share: the shared folder, tables written in it, and a bounded row filter."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable

#: Bits of the filter in `may_contain`: 8 MB at most, whatever the number of keys.
FILTER_BITS = 1 << 26
#: Python workers stay from task to task; with these they give freed memory back instead of keeping it.  Arrays of
#: 4 MB and more are mapped one by one, at most 8 MB stay free in the heap, and Arrow's buffers come from the same heap.
LEAN = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}
_PAGE = 1 << 15  # bits of one bitmap of bitmap_construct_agg


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, so that a batch of very long texts fits a Python worker; one thread for each worker,
    as there is a worker for each core; workers that keep little memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
        spark.sparkContext.environment[name] = "1"
    spark.sparkContext.environment.update(LEAN)
    importable(spark)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors see.

    Where it is unset, a local session gets a folder of its own; a cluster has no folder that all see, which is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/plyspark/{name}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of df has, case aside."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: df as Parquet in the shared folder, read back."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def may_contain(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap filter of keys[key] in at most FILTER_BITS bits, to broadcast: rows (page, bits)."""
    slot = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    pages = (
        keys.select(slot.alias("slot"))
        .groupBy((F.col("slot") / _PAGE).cast("int").alias("page"))
        .agg(F.bitmap_construct_agg((F.col("slot") % _PAGE)).alias("bits"))
    )
    return F.broadcast(written(pages, "filter"))


def with_flag(df: DataFrame, key: str, pages: DataFrame, flag: str) -> DataFrame:
    """Adds whether key may be in the filter: never false for a key that is; sometimes true for others.  flag: a
    column name that df does not have; all of df's columns stay."""
    page, at, bits = (fresh(df, f"{flag}_{x}") for x in ("page", "at", "bits"))
    slot = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    byte = F.conv(F.hex(F.expr(f"substring({bits}, cast({at} / 8 as int) + 1, 1)")), 16, 10).cast("int")
    found = pages.toDF(page, bits)
    out = df.withColumn(page, (slot / _PAGE).cast("int")).withColumn(at, (slot % _PAGE).cast("int")).join(found, page, "left")
    hit = F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, {at} % 8)")) != 0, F.lit(False))
    return out.withColumn(flag, hit).drop(page, at, bits)


def split_by(df: DataFrame, key: str, keys: DataFrame, key_of: str) -> tuple[DataFrame, DataFrame]:
    """df in two: rows whose key may be among keys[key_of], and rows whose key is not; columns as they were."""
    flag = fresh(df, "_may")
    flagged = with_flag(df, key, may_contain(keys, key_of), flag)
    return flagged.where(flag).drop(flag), flagged.where(~F.col(flag)).drop(flag)


def without(df: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """df without the rows whose key is among ids[id_col]; only rows that the filter flags travel.  Null keys stay."""
    some, plain = split_by(df, key, ids, id_col)
    name = fresh(df, "_gone")
    gone = ids.select(F.col(id_col).alias(name)).distinct()
    return plain.unionByName(some.join(gone, F.col(key) == F.col(name), "left_anti"))
