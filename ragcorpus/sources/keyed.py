"""Tables that stand in buckets of a key below a path, so that joins on the key leave them where they are."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from ragcorpus.sources.scratch import exists

#: Buckets of a table; all writers and readers of one must use the same number. Where a session has more shuffle partitions
#: than a table has buckets, Spark may shuffle it nevertheless, so a larger cluster takes more.
BUCKETS = 32


def _name(path: str) -> str:
    return "keyed_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def read_keyed(spark: SparkSession, path: str, key: str, buckets: int = BUCKETS, partitions: tuple[str, ...] = ()) -> DataFrame | None:
    """The table below path with its buckets, or None where there is none. Its name in the session's catalog follows from path."""
    name = _name(path)
    if not exists(spark, path):
        return None
    if not spark.catalog.tableExists(name):
        fields = spark.read.parquet(path).schema.fields
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        parts = f"PARTITIONED BY ({', '.join(f'`{p}`' for p in partitions)})" if partitions else ""
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {parts} CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    if partitions:
        spark.catalog.recoverPartitions(name)  # other sessions may have added some
    spark.catalog.refreshTable(name)
    return spark.table(name)


def append_keyed(df: DataFrame, path: str, key: str, buckets: int = BUCKETS, partitions: tuple[str, ...] = ()) -> None:
    """Add the rows of df to the table below path; each write adds a file to each bucket that it has rows of (and partition)."""
    spark = df.sparkSession
    known = read_keyed(spark, path, key, buckets, partitions)
    own = df.select(*known.columns) if known is not None else df
    writer = own.repartition(buckets, key).write.mode("append").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path)
    (writer.partitionBy(*partitions) if partitions else writer).saveAsTable(_name(path))
