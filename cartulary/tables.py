"""Tables in the folder that all executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only in local mode where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="cartulary-")
        leave(spark, at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has yet; what is written there goes when the session's JVM ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    leave(spark, path)
    return path


def stored(df: DataFrame, label: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder, which cuts its lineage, and read it back: the table and its path."""
    path = fresh_path(df.sparkSession, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def kept(df: DataFrame, label: str) -> DataFrame:
    """df as a table of stored()."""
    return stored(df, label)[0]


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that later steps no longer read."""
    for path in paths:
        fs, p = _file_system(spark, path)
        fs.delete(p, True)


def leave(spark: SparkSession, path: str) -> None:
    """Have a path deleted when the session's JVM ends: a result may be read as long as that runs."""
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
