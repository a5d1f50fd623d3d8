"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a run's shuffle files go when it ends, not only when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's limit of a batch that goes to Python, and a lower one. A batch is held several times: as vectors that grow by
#: doubling, as a message and in the worker; what is freed there mostly stays with the process.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder; any other master is an error, since its
    executors would not share one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="simloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def save(df: DataFrame, what: str, small_batches: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, so that its lineage ends there.

    Its shuffle files are deleted once it is written, as nothing reads them again. ``small_batches``: what it hands
    to Python is bounded by ``BATCH_BYTES`` at once, or by the session's limit if that is lower.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/simloom/{what}-{uuid.uuid4().hex}"
    was, batch = spark.conf.get(CLEANUP, "false"), spark.conf.get(BATCH)
    spark.conf.set(CLEANUP, "true")
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(batch)
    if small_batches and (limit <= 0 or limit > BATCH_BYTES):
        spark.conf.set(BATCH, str(BATCH_BYTES))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
        spark.conf.set(BATCH, batch)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what ``save`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
