"""Bottom-k sketches of word shingles, in DataFrame functions only.

A text's sketch is the sorted k smallest distinct 32-bit hashes of its five-word shingles. Sketches of parts merge
into the sketch of the whole set of shingles; two sketches estimate resemblance and containment, one the number of
distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 128
WORDS = 5
_SPACE = 2.0**32
#: Documents of one range of ids, dealt over to find their next one, and ranges of one group, whose bounds are found together.
RANGE_ROWS, GROUP_RANGES = 32_768, 512


def word_hashes(text: Column) -> Column:
    """Hashes of the words of the lower-cased text; words are what white space (ASCII) separates."""
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\x0B\f\r]+"), ""), lambda w: F.xxhash64(w))


def sketch(hashes: Column, k: int = K, words: int = WORDS) -> Column:
    """The sketch of an array of word hashes; fewer words than a shingle has are one shingle, no words none."""
    n = F.size(hashes)
    shingles = F.when(n >= words, F.transform(F.sequence(F.lit(1), n - (words - 1)), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(hashes, i - 1 + j) for j in range(words)]), 32)))
    short = F.when(n > 0, F.array(F.shiftrightunsigned(F.xxhash64(hashes), 32))).otherwise(F.array().cast("array<bigint>"))
    return F.slice(F.sort_array(F.array_distinct(F.coalesce(shingles, short))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of both sets of shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two sketched sets; two empty sets are alike (1)."""
    union = merged(a, b, k)
    shared = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(shared / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * _SPACE / F.element_at(a, k))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; 1 for an empty a."""
    both = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def encoded(a: Column) -> Column:
    """A sketch as text: eight hexadecimal digits a hash."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 8, "0")), ""))


def _count(bounds: Column, value: Column, steps: int, equal: bool) -> Column:
    """How many of the ascending bounds are below the value, or at most it; `steps` halvings find that."""
    less = (lambda b: b <= value) if equal else (lambda b: b < value)
    sizes = F.array(*[F.lit(1 << i) for i in range(steps - 1, -1, -1)])
    return F.aggregate(sizes, F.lit(0), lambda at, step: F.when(less(F.get(bounds, at + step - 1)), at + step).otherwise(at))


def _bounds(keys: DataFrame, key: str, ranges: int) -> list[int]:
    """Ascending bounds between `ranges` ranges of nearly equal numbers of rows; a frequent key is bound more than once.

    Quantiles of groups of ranges come first, then quantiles within each group, so that no aggregate keeps a
    summary of all ranges. One number a range comes to the driver.
    """
    groups = -(-ranges // GROUP_RANGES)
    quantiles = lambda n: F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n) if n > 1 else F.array().cast("array<bigint>")
    coarse = keys.agg(quantiles(groups).alias("q")).first()["q"] or []
    each = -(-ranges // groups)
    group = _count(F.lit(coarse) if coarse else F.array().cast("array<bigint>"), F.col(key), len(coarse).bit_length(), False)
    fine = keys.groupBy(F.coalesce(group, F.lit(0)).alias("g")).agg(quantiles(each).alias("q")).collect()  # one row a group
    return sorted(coarse + [b for r in fine for b in r["q"] or []])


def with_next(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """docs(id_col, _hash, columns) and next_<column> of the next row by ascending (id, hash), after the last the first.

    Rows are dealt once, over ranges of ids with nearly equal numbers of rows; an id that fills more than a range is
    dealt on by its rows' hashes. The first row of a range is also sent to the range before it, so that no order
    over all rows is needed. A null id counts as the least long.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col), F.lit(-(1 << 63)))
    keys = docs.select(key.alias("_key"))
    ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // RANGE_ROWS))
    bounds = _bounds(keys, "_key", ranges)
    steps = len(bounds).bit_length()
    # eight bytes a range: at most a few megabytes for 10^10 documents
    known = F.broadcast(spark.createDataFrame([(bounds,)], "_bounds array<bigint>"))
    low, high = _count(F.col("_bounds"), F.col("_key"), steps, False), _count(F.col("_bounds"), F.col("_key"), steps, True)
    # 0 .. 2^31 - 1 in the order of the hashes
    part = F.shiftright("_hash", 33) + (1 << 30)
    number = low + F.shiftright(part * (high - low + 1), 31).cast("int")
    ranged = lambda df: df.withColumn("_key", key).crossJoin(known).withColumn("_range", number).drop("_bounds")  # noqa: E731 - one row of bounds
    placed = ranged(docs)
    firsts = ranged(docs.select(id_col, "_hash")).groupBy("_range").agg(F.min(F.struct("_key", "_hash")).alias("first"))  # one row a range
    order = Window.orderBy("_range")
    # the first row of each range goes to the one before it that has rows, that of the first range to the last
    before = firsts.select(F.coalesce(F.lag("_range").over(order), F.max("_range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_range"), F.col("first._key").alias("_k"), F.col("first._hash").alias("_h"))
    sent = docs.withColumn("_key", key).join(F.broadcast(before), (F.col("_key") == F.col("_k")) & (F.col("_hash") == F.col("_h"))).drop("_k", "_h")
    every = placed.withColumn("_sent", F.lit(False)).unionByName(sent.withColumn("_sent", F.lit(True))).repartition(ranges, "_range")
    order = Window.partitionBy("_range").orderBy("_sent", "_key", "_hash")
    return every.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where("not _sent").drop("_sent", "_range", "_key")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness; one row for each row of docs.

    The edited text has its last half (rounded down, code points) replaced by the first as many of the next
    document by ascending doc_id. Null texts count as empty; empty sketches are alike (1) and unlike any other (0).
    Rows of one doc_id follow one another by the hash of their text, so a repeated row's next is its copy; only rows
    that repeat both stay in one task. A null doc_id counts as the least long. Other columns are ignored; no rows
    give none.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.select("doc_id", F.xxhash64("text").alias("_hash"), "text", word_hashes(F.col("text")).alias("words"))
    own = own.select("doc_id", "_hash", "text", sketch(F.col("words"), k).alias("sketch"))
    paired = with_next(own, "doc_id", ["text", "sketch"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    rows = paired.withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.select("doc_id", "n_chars", "sketch", "next_sketch", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "sketch", "next_sketch", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), word_hashes(F.col("edited")).alias("words"))
    rows = rows.select("doc_id", "n_chars", "sketch", "next_sketch", "edited_sha256", sketch(F.col("words"), k).alias("edited_sketch"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        encoded(F.col("sketch")).alias("fingerprint"),
        encoded(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("n_shingles"),
    )
