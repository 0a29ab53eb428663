"""Connected components of an edge table by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragcorpus.llm._common import drop, new_path, save

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b) of longs; component is the smallest node reachable.

    Each round is two joins of the edges with the smallest neighbour of a node, an aggregate that combines
    before its shuffle, so a node with very many edges is never gathered; adaptive execution splits its part
    of the join. Rounds are cut by tables in the shared folder, and only a count and a checksum come to the
    driver. Self-loops, repeated edges and nulls in a or b add nothing; an empty table gives an empty table.
    """
    spark = edges.sparkSession
    path = new_path(spark)
    now = save(
        edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("a is not null and b is not null and u <> v").distinct(),
        path,
    )
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        # large-star: neighbours above u move to the smallest of u and its neighbours
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # small-star: u and its neighbours below it move to the smallest of them
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = new_path(spark)
        now = save(small.select("e.u", "e.v").where("u <> v").distinct(), new)
        drop(spark, path)
        path, before, state = new, state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """How many edges there are and a checksum that does not depend on their order."""
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(pmod(xxhash64(v, u), 1000003) as decimal(38,0)))")).first())
