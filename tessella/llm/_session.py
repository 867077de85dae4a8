"""Shared-folder tables, held-out folds and bounded labelled samples."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which every executor sees; a temporary one only where it is unset on a single machine, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        at = tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def table(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet into the shared folder and rereads it, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded(df: DataFrame) -> DataFrame:
    """The same; the session's Python workers get batches of at most BATCH_BYTES (or one row) from now on."""
    conf = df.sparkSession.conf
    if int(conf.get(BATCHES).rstrip("bB")) > BATCH_BYTES:
        conf.set(BATCHES, BATCH_BYTES)
    return df


def few(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its rows hold at most BROADCAST_BYTES; else joins shuffle it."""
    wide = {"array": lambda c: 16 * F.size(c), "string": F.octet_length, "binary": F.octet_length}
    size = sum((next((F.coalesce(f(F.col(c)), F.lit(0)) for kind, f in wide.items() if t.startswith(kind)), F.lit(0)) for c, t in df.dtypes), F.lit(16 * (1 + len(df.columns))))
    held = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def forget(*tables: DataFrame) -> None:
    """Deletes tables that :func:`table` has written and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/tessella/" in folder:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the broadcasts, and shuffle files that are left, of plans that a written table has replaced, which else stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Each query within deletes its shuffle files as it ends; with :func:`release` alone they may stay for some steps
    more, as Python, the driver's garbage collector and Spark's cleaner let go of them one after the other, each in a
    thread of its own.  For steps that end in a written table, whose plan nothing runs again."""
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, True)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SWEEP)
        else:
            spark.conf.set(SWEEP, before)


def drop_tables(spark: SparkSession) -> None:
    """Deletes every table that :func:`table` has written under this session's shared folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tessella")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def sample_ids(df: DataFrame, key: str, group: str, per_group: int, seed: int) -> DataFrame:
    """A uniform sample of at most ``per_group`` keys for each group value, in one partially aggregated shuffle.

    Each row hashes into one of ``per_group`` slots of its group and each slot keeps its smallest hash, so no group
    is ever collected and the result has at most groups x per_group rows.
    """
    h = F.xxhash64(F.col(key), F.lit(seed))
    return (
        df.select(F.col(group).alias("_g"), F.pmod(h, F.lit(per_group)).alias("_s"), F.struct(F.xxhash64(h).alias("h"), F.col(key).alias("k")).alias("_v"))
        .groupBy("_g", "_s").agg(F.min("_v").alias("_v"))
        .select(F.col("_v.k").alias(key), F.col("_g").alias(group))
    )


def extended(df: DataFrame, keep: tuple[str, ...], ddl: str) -> T.StructType:
    """The schema of the columns ``keep`` followed by those of ``ddl``."""
    return T.StructType([*df.select(*keep).schema.fields, *T.StructType.fromDDL(ddl).fields])
