"""Tables in the folder that driver and executors share, to cut long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local master may leave it unset; it gets a new local folder."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """Where this application's scratch tables stand."""
    return f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"


def save(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as a table and read again, and the table's path."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def drop(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables, once its results have been written."""
    drop(spark, scratch_dir(spark))
