"""Numbers in the order of a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragcorpus.sources.scratch import save

#: Rows that one task numbers.
NUMBERED_ROWS = 1_000_000


def numbered(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """df with `name`, 0 .. n - 1 in the order of the columns; rows that are equal in them are numbered in any order.

    Sorted ranges are written as a table of their own, numbered within, and shifted by the sizes of the ranges before.
    """
    parts = max(1, -(-df.count() // NUMBERED_ROWS))
    ranged = df.repartitionByRange(parts, *columns).sortWithinPartitions(*columns)
    rows, _ = save(ranged.withColumn("_m", F.monotonically_increasing_id()))
    rows = rows.withColumns({"_part": F.shiftright("_m", 33), "_at": F.col("_m").bitwiseAND((1 << 33) - 1)})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # one row a range
    return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start", "_m")
