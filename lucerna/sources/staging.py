"""Tables written to the shared folder, so that what follows reads them instead of computing them again."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one of setCheckpointDir.

    Where neither is set, one of our own on a local master; on a cluster that is an error, as executors would write to
    their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = given.get() if given.isDefined() else None
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not hasattr(shared_folder, "own"):
        shared_folder.own = "file://" + tempfile.mkdtemp(prefix="lucerna-")
    return shared_folder.own


def release(spark: SparkSession) -> None:
    """Frees the shuffle files of plans that nothing refers to any more, now and not at the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def staged(df: DataFrame, tag: str, by: str | None = None, bucket: str | None = None) -> DataFrame:
    """df written and read back; the files go when the driver ends. by: a column of few values, each with files of its own.

    bucket: a column by whose hash the files are dealt, so that what groups, orders or joins by it moves no rows; the table
    has a name in the session's catalogue then.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lucerna-{tag}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    writer = df.write.option("compression", "zstd")
    if by:
        writer = writer.partitionBy(by)
    if bucket:
        name = f"lucerna_{tag}_{uuid.uuid4().hex}"
        writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), bucket).option("path", path).format("parquet").saveAsTable(name)
        return spark.table(name).select(*df.columns)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
