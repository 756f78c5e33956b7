"""The store of projects: a line of JSON for each, with its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

STORED = "id long, name string, ord int, files array<struct<file_id:string,name:string,path:string,ord:int>>"


def write_projects(projects: DataFrame, files: DataFrame, path: str) -> None:
    """projects: id, name, ord; files: project_id, file_id, name, path, ord. A whole new store replaces the one at path."""
    listed = files.groupBy(F.col("project_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("ord", "file_id", "name", "path"))).alias("f"))
    whole = projects.join(listed, "id", "left").select("id", "name", "ord", F.transform(F.coalesce("f", F.array()), lambda x: F.struct(x["file_id"].alias("file_id"), x["name"].alias("name"), x["path"].alias("path"), x["ord"].alias("ord"))).alias("files"))
    whole.write.mode("overwrite").json(path)


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """The projects of a store, and which is selected (the first by ord and id). No store, or lines that can't be read, give none."""
    try:
        rows = spark.read.schema(STORED).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        rows = spark.createDataFrame([], STORED)
    rows = rows.filter("id is not null")
    first = rows.agg(F.min_by("id", F.struct("ord", "id")).alias("first"))
    return rows.join(F.broadcast(first)).withColumn("selected", F.col("id") == F.col("first")).drop("first")
