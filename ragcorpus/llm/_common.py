"""Helpers of the corpus operators: shared scratch tables, dense numbering and small-data rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may leave it unset."""
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


def save(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    Results are read lazily, so an operator cannot delete the tables that its result stands on; drop_scratch does,
    once the results of an application have been written.
    """
    path = path or new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application."""
    drop(spark, scratch_dir(spark))


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, key: str, order: list[Column], name: str, rows_per_part: int = 500_000) -> DataFrame:
    """Add `name`: gapless numbers from 0 within each value of `key`.

    A key may hold any share of the rows, so its rows are first dealt over salted parts; each part is numbered
    by a window of its own and shifted by the sizes of the parts before it. The table of part sizes has
    (number of keys x parts) rows, about one for each `rows_per_part` rows, and is joined, not collected.
    `order` only has to deal rows out: rows that are equal in it may swap numbers.
    """
    parts = max(1, -(-df.count() // rows_per_part))
    salted = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)) if parts > 1 else F.lit(0).cast("long"))
    sizes = salted.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(key).alias("_key"), F.col("_part").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)) - 1
    joined = salted.withColumn("_local", local).join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_at")))
    return joined.withColumn(name, (F.col("_start") + F.col("_local")).cast("long")).drop("_part", "_key", "_at", "_start", "_local")
