"""Tables written once to the folder that driver and executors share, so that what reads them twice computes them once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a run's shuffle files go when it ends, not only when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local master gets a temporary one, any other an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="simloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, what: str) -> DataFrame:
    """``df`` as Parquet in the shared folder; its lineage ends there, and its shuffle files go."""
    return saved_parts([df], what)


def saved_parts(parts: Iterable[DataFrame], what: str) -> DataFrame:
    """Tables of one schema as one, each computed and written when those before are and their shuffle files are gone."""
    path = None
    for df in parts:
        spark = df.sparkSession
        path = path or f"{folder(spark)}/simloom/{what}-{uuid.uuid4().hex}"
        was = spark.conf.get(CLEANUP, "false")
        spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("append").parquet(path)
        finally:
            spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete what ``saved`` wrote, once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as run at once, if its files are read by fewer; larger tables stay as they are."""
    most = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(most) if df.rdd.getNumPartitions() < most else df
