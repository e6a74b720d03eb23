"""Where intermediate tables live, and how tables are read.

Everything that one job writes and another reads goes to the folder that the
session names in ``spark.checkpoint.dir``: every executor can reach it, so a
lost executor costs a re-read and nothing else.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(files: DataFrame) -> DataFrame:
    """Files (id, text) over all tasks: a small table comes as one partition, however long its texts take to read."""
    return files.select("id", "text").repartition("id")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local session that names none gets a local one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("the session must name a shared folder in spark.checkpoint.dir")
        configured = "file://" + tempfile.mkdtemp(prefix="spark-palimpsest-")
        spark.conf.set("spark.checkpoint.dir", configured)
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/palimpsest/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, *, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no later job reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._shared_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
