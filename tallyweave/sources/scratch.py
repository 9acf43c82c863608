"""Tier boundaries are written tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a session in local mode may go without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/tallyweave-scratch"
    return base.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back: short plans, and nothing lost with an executor. The table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tallyweave-recon/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
