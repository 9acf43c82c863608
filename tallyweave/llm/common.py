"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder in the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session; only a session in local
    mode may go without it (a folder of our own under /tmp takes its place).
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/tallyweave-scratch"
    return f"{base.rstrip('/')}/tallyweave/{uuid.uuid4().hex}"


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_once(spark: SparkSession):
    """Queries inside run once: Spark may delete their shuffle files as they end, not when the driver collects garbage."""
    before = spark.conf.get(CLEAN)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN, before)


_owner: ContextVar[list[str] | None] = ContextVar("owner", default=None)


@contextmanager
def owned(tables: list[str]):
    """Tables kept inside are noted in ``tables``, for whoever knows when nothing reads them any more."""
    token = _owner.set(tables)
    try:
        yield
    finally:
        _owner.reset(token)


def keep(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage, fixes anything evaluated at run time, and survives the loss
    of an executor because the files are on the shared store.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    with shuffles_once(spark):
        df.write.option("compression", codec).parquet(path)
    if _owner.get() is not None:
        _owner.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(kept: DataFrame) -> None:
    """Delete a kept table that nothing will read again."""
    for path in {f.rpartition("/")[0] for f in kept.inputFiles()}:
        _delete(kept.sparkSession, path)


def release(spark: SparkSession, tables: list[str]) -> None:
    """Delete the tables of an owner whose results have been written by now."""
    while tables:
        _delete(spark, tables.pop())


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: hand them to Python by the thousand, unless the session says otherwise."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(col: str | Column = "text") -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.cast("string"), F.lit(""))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def same_id(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
