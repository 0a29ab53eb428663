"""Shards by a K-d tree over metadata: every node splits at the weighted median of its widest dimension.

A dimension's values are placed on a scale of 31 bits in their own order (text by its first bytes behind what all begin with). Within a node a value
becomes its place in the node's range, followed by a hash of the row, so that a value with any share of the rows can
still be split. The medians of all nodes of a level are found together by counting the bytes of slices: once over the
whole ranges of the nodes, and once within the slices that hold the medians. Nodes are rows of tables, and every row
carries its node, so nothing but the number of shards comes to the driver, however many there are.
"""

from __future__ import annotations

import math
import os.path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragcorpus.llm._common import drop, new_path, numbered, save

#: A place is 20 bits of the value and 12 of the row's hash; each count looks at half of them.
VALUE_BITS, HASH_BITS = 20, 12
SLICE_BITS = (VALUE_BITS + HASH_BITS) // 2
#: Tables of nodes are broadcast up to this number of shards; beyond it they are joined by a shuffle.
BROADCAST_SHARDS = 100_000
_TOP = (1 << 31) - 1


#: Bytes of text that are looked at for what all values begin with.
PREFIX_BYTES = 4096


def _skips(df: DataFrame, dims: list[str]) -> dict[str, int]:
    """Of each dimension of text or bytes, how many bytes all its values begin with alike: the least and the greatest do so."""
    texts = [d for d in dims if dict(df.dtypes)[d] in ("string", "binary")]
    if not texts:
        return {}
    start = lambda d: F.substring(F.col(d).cast("binary"), 1, PREFIX_BYTES)
    ends = df.agg(*[f(start(d)).alias(f"{n}{i}") for i, d in enumerate(texts) for n, f in (("a", F.min), ("b", F.max))]).first()
    return {d: len(os.path.commonprefix([bytes(ends[f"a{i}"] or b""), bytes(ends[f"b{i}"] or b"")])) for i, d in enumerate(texts)}


def _number(df: DataFrame, name: str, skip: int = 0) -> Column:
    """A column as a double that keeps its order: text and bytes by six bytes behind those that are skipped."""
    kind = dict(df.dtypes)[name]
    if kind in ("string", "binary"):
        return F.conv(F.rpad(F.hex(F.substring(F.col(name).cast("binary"), skip + 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.col(name).cast("int").cast("double") if kind == "boolean" else F.col(name).cast("double")


def _scaled(df: DataFrame, dims: list[str]) -> list[Column]:
    """Each dimension as 0 .. 2^31 - 1; null and what is no number are 0."""
    skips = _skips(df, dims)
    number = lambda d: _number(df, d, skips.get(d, 0))
    ends = df.agg(*[f(number(d)).alias(f"{n}{i}") for i, d in enumerate(dims) for n, f in (("a", F.min), ("b", F.max))]).first()
    out = []
    for i, d in enumerate(dims):
        low, high = ends[f"a{i}"], ends[f"b{i}"]
        span = (high - low) if low is not None and high > low and math.isfinite(high - low) else 1.0
        value = (number(d) - F.lit(low if low is not None and math.isfinite(low) else 0.0)) / span * _TOP
        out.append(F.coalesce(F.when(~F.isnan(value), F.greatest(F.lit(0.0), F.least(F.lit(float(_TOP)), value))).cast("long"), F.lit(0).cast("long")))
    return out


def kd_shards(df: DataFrame, dims: list[str], weight: str, tie: list[str], target_bytes: int | None = None, shards: int | None = None) -> DataFrame:
    """df with a column _shard, 0 .. shards - 1, of nearly equal sums of `weight`.

    The number of shards is given or follows from target_bytes. A node of n shards gives the first n // 2 of them their
    share of its weight. Rows that are equal in all dims and in `tie` may be dealt to either side as a whole only. Nulls
    in dims come first; no rows give none.
    """
    spark = df.sparkSession
    named = [f"_c{i}" for i in range(len(dims))]
    hashed = F.shiftrightunsigned(F.xxhash64(*tie), 64 - HASH_BITS).alias("_h")
    path = new_path(spark)
    base = save(df.select(*df.columns, *[c.alias(n) for c, n in zip(_scaled(df, dims), named, strict=True)], hashed), path)
    total = base.agg(F.sum(F.col(weight))).first()[0] or 0
    n = shards or max(1, math.ceil(total / target_bytes))
    now = base.withColumns({"_shard": F.lit(0), "_k": F.lit(n)})
    for _ in range((n - 1).bit_length()):
        after = new_path(spark)
        split = save(_split(now, named, weight, n), after)
        drop(spark, path)
        now, path = split, after
    return now.drop(*named, "_h", "_k")


def _split(now: DataFrame, named: list[str], weight: str, n: int) -> DataFrame:
    """One level: each node (_shard, its first shard, and _k, how many it has) of two shards and more becomes two."""
    small = F.broadcast if n <= BROADCAST_SHARDS else lambda df: df
    extents = now.where("_k > 1").groupBy("_shard").agg(F.first("_k").alias("k"), F.sum(weight).alias("w"), *[f(c).alias(f"{p}{i}") for i, c in enumerate(named) for p, f in (("a", F.min), ("b", F.max))])
    wide = F.array(*[F.col(f"b{i}") - F.col(f"a{i}") for i in range(len(named))])
    dim = F.array_position(wide, F.array_max(wide)).cast("int")  # the first of the widest, from 1
    pick = lambda p: F.element_at(F.array(*[F.col(f"{p}{i}") for i in range(len(named))]), dim)
    nodes = extents.select(F.col("_shard").alias("_node"), dim.alias("_dim"), pick("a").alias("_low"), (pick("b") - pick("a") + 1).alias("_width"), (F.col("w") * F.floor(F.col("k") / 2) / F.col("k")).alias("_want"))
    value = F.element_at(F.array(*[F.col(c) for c in named]), F.col("_dim"))
    place = F.shiftleft(F.floor(F.shiftleft(value - F.col("_low"), VALUE_BITS) / F.col("_width")).cast("long"), HASH_BITS) + F.col("_h")
    placed = lambda table: now.join(small(table), F.col("_shard") == F.col("_node")).withColumn("_place", place)
    ahead = Window.partitionBy("_node").orderBy("_at")

    def holding(counted: DataFrame) -> DataFrame:
        """Of each node's counts (_at, _w) the first that reaches _want, and what is before it."""
        sums = counted.withColumn("_before", F.col("_from") + F.sum("_w").over(ahead) - F.col("_w"))
        rank = F.row_number().over(ahead)
        return sums.where(F.col("_before") + F.col("_w") >= F.col("_want")).withColumn("_n", rank).where("_n = 1").drop("_n")

    keys = ["_node", "_dim", "_low", "_width", "_want"]
    coarse = placed(nodes).groupBy(*keys, F.shiftright("_place", SLICE_BITS).alias("_at")).agg(F.sum(weight).alias("_w"))
    chosen = holding(coarse.withColumn("_from", F.lit(0))).select(*keys, F.col("_at").alias("_slice"), F.col("_before").alias("_from"))
    inside = placed(chosen).where(F.shiftright("_place", SLICE_BITS) == F.col("_slice"))
    fine = inside.groupBy(*keys, "_from", F.col("_place").alias("_at")).agg(F.sum(weight).alias("_w"))
    nearer = F.col("_want") - F.col("_before") < F.col("_before") + F.col("_w") - F.col("_want")
    cuts = holding(fine).select("_node", "_dim", "_low", "_width", F.when(nearer, F.col("_at")).otherwise(F.col("_at") + 1).alias("_cut"))
    upper = now.join(small(cuts), F.col("_shard") == F.col("_node"), "left").withColumn("_up", F.coalesce(place >= F.col("_cut"), F.lit(False)))
    half = F.floor(F.col("_k") / 2).cast("int")
    first = F.when(F.col("_up"), F.col("_shard") + half).otherwise(F.col("_shard"))
    left = F.when(F.col("_k") < 2, F.col("_k")).when(F.col("_up"), F.col("_k") - half).otherwise(half)
    return upper.withColumns({"_first": first.cast("int"), "_left": left.cast("int")}).drop("_shard", "_k", "_node", "_dim", "_low", "_width", "_cut", "_up").withColumnsRenamed({"_first": "_shard", "_left": "_k"})


def shard_documents(docs: DataFrame, shards: int = 24, dims: tuple[str, ...] = ("lang", "source", "n_chars", "doc_id"), id_col: str = "doc_id", text_col: str = "text", target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs, under the law `bytes`.

    size is the text's UTF-8 bytes plus 8 (null: 8). A null text has the checksum of the empty one. Dimensions that
    docs lacks are left out; null metadata is placed first. Rows that repeat each get a slot; no rows give none.
    grown_shard is null: a tree makes no promise about another number of shards. The texts are read once and
    never shuffled. Names of other columns do not matter.
    """
    used = [d for d in dims if d in docs.columns]
    meta = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        *[F.col(d).alias(f"_d{i}") for i, d in enumerate(used)],
    )
    # rows that are equal in all of these still differ in where they stand, which only has to deal them out
    path = new_path(docs.sparkSession)
    placed = save(meta.withColumn("_row", F.monotonically_increasing_id()), path)
    names = [f"_d{i}" for i in range(len(used))] or ["doc_id"]
    dealt = kd_shards(placed, names, "size", ["doc_id", "text_crc32", "_row"], target_bytes, None if target_bytes else shards)
    drop(docs.sparkSession, path)
    slots = numbered(dealt.select("doc_id", "size", "text_crc32", "_shard", "_row"), "_shard", [F.col("doc_id"), F.col("text_crc32"), F.col("_row")], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
