"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits. For radius r, every bit position i gets a vector phi(i) of r + 1 bits, not zero; table
v (1 .. 2^(r+1) - 1) keeps the positions with <phi(i), v> = 1 (mod 2). For two fingerprints that differ in at most r
positions there are at most r linear conditions <phi(i), v> = 0 on r + 1 unknown bits, so some v that is not zero
meets them all: in that table the two agree on every kept bit. No pair within the radius is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragcorpus.llm._common import save
from ragcorpus.llm.components import connected_components

BITS = 64
#: Most fingerprints of one bucket that one task compares with as many others.
BLOCK = 2048
#: Fingerprints that one task sends to their buckets.
FINGERPRINTS_PER_TASK = 100_000


def simhash(text: str | None, words_per_shingle: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint: a bit is 1 if it is set in over half of the shingles' XXH64."""
    data = (text or "").encode("utf-8").lower()  # bytes: A-Z only
    words = data.split()  # bytes: space and \x09-\x0d only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= words_per_shingle:
        return digest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - words_per_shingle + 1
    hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[words_per_shingle - 1 :].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def covering_masks(radius: int) -> list[int]:
    """The 2^(radius+1) - 1 masks as signed longs; phi deals the positions evenly over the vectors that are not zero."""
    tables = 2 ** (radius + 1) - 1
    phi = [1 + (i * 11) % tables for i in range(BITS)]
    masks = []
    for v in range(1, tables + 1):
        mask = sum(1 << i for i in range(BITS) if bin(phi[i] & v).count("1") % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def fingerprint(text: Column, words_per_shingle: int = 4, seed: int = 42) -> Column:
    """The fingerprint's bits as a signed long; of a null text zero. Only texts go to Python, so ids stay as they are."""

    @F.pandas_udf("long")
    def bits(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(np.array([simhash(t, words_per_shingle, seed) for t in part], np.uint64).view(np.int64))

    return bits(text)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp long): one row for each row of docs."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text_col), words_per_shingle, seed).alias("fp"))


def fingerprint_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b) whose connected components are those of all pairs in fps(fp long, distinct) within the radius.

    Every fingerprint goes to one bucket of each table. Buckets of two are compared where they are counted.
    Larger ones are compared in blocks: a block gives one edge for each member of a group to the group's first
    member, never all pairs, and a bucket of more than BLOCK members is dealt over pairs of blocks.
    """
    masks = F.array(*[F.lit(m) for m in covering_masks(radius)])
    # the distinct fingerprints are few beside what they become here, one row for each table, so they are dealt first
    wide = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt_out = fps.select("fp").repartition(max(wide, -(-fps.count() // FINGERPRINTS_PER_TASK)), "fp")
    tables = dealt_out.select("fp", F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("t", "k"))
    buckets = tables.groupBy("t", "k").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = buckets.where((F.col("n") == 2) & near).select("a", "b")
    large = buckets.where("n > 2").select("t", "k", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    # Spark sizes the exploded tables as the fingerprints they come from and so would send them all through the driver
    dealt = tables.join(large.hint("merge"), ["t", "k"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    grouped = dealt.groupBy("t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list("fp").alias("fps"))

    def stars(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out_a, out_b = [], []
            for members in part["fps"]:
                fp = np.asarray(members, np.int64)
                label = group_labels(fp.view(np.uint64), radius)
                moved = np.flatnonzero(label != np.arange(len(fp)))
                out_a.append(fp[moved])
                out_b.append(fp[label[moved]])
            yield pd.DataFrame({"a": np.concatenate(out_a or [np.empty(0, np.int64)]), "b": np.concatenate(out_b or [np.empty(0, np.int64)])})

    return pairs.unionByName(grouped.select("fps").mapInPandas(stars, "a long, b long"))


def group_labels(fp: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the index of the first one of its group under links within the radius."""
    n = len(fp)
    near = np.empty((n, n), bool)
    for i in range(0, n, 512):
        near[i : i + 512] = np.bitwise_count(fp[i : i + 512, None] ^ fp[None, :]) <= radius
    label = np.full(n, -1)
    for i in range(n):
        if label[i] < 0:
            frontier = np.array([i])
            label[i] = i
            while len(frontier):
                found = near[frontier].any(axis=0) & (label < 0)
                frontier = np.flatnonzero(found)
                label[frontier] = i
    return label


def first_of_each_group(docs: DataFrame, radius: int = 4, words_per_shingle: int = 4, seed: int = 42) -> DataFrame:
    """The rows of docs(doc_id, text, ...) that stand for their group: smallest doc_id, then smallest digest of the text.

    Decided on fingerprints and SHA-256 digests of (doc_id, text) alone; the texts are read a second time and joined
    with the digests that stay, so a text is never shuffled by a group's key. Exact copies of a row that stands for its
    group leave one. Null, empty and blank texts have the fingerprint zero and so form one group; rows without a doc_id
    stay only where nobody in their group has one. No rows give none.
    """
    whole = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit(":"), F.col("text")), F.lit("")))
    own = docs.withColumn("_hash", F.sha2(whole.cast("binary"), 256))
    prints = save(own.select(F.col("doc_id").cast("long").alias("doc_id"), "_hash", fingerprint(F.col("text"), words_per_shingle, seed).alias("fp")))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_hash").alias("h"))).alias("best")
    fps = save(prints.groupBy("fp").agg(best))
    comps = connected_components(fingerprint_links(fps.select("fp"), radius))
    named = fps.join(comps, F.col("fp") == F.col("node"), "left").select("best", F.coalesce("component", "fp").alias("component"))
    kept = named.groupBy("component").agg(F.min("best").alias("best")).select(F.col("best.h").alias("_hash"))
    found = own.join(save(kept), "_hash", "left_semi")
    once = found.groupBy("_hash").agg(*[F.first(F.col(f"`{c}`")).alias(c) for c in docs.columns])
    return once.select(*docs.columns)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, words_per_shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    component_id is the smallest doc_id that links within the radius reach, the row's own included. Null and
    empty texts and texts of white space have the fingerprint zero and link like any other. Rows with a null
    doc_id take part in links but never name a component (null if no member has a doc_id). Repeated rows and
    equal texts share a fingerprint and so a component; other columns of docs are ignored. No rows give none.
    """
    prints = save(fingerprints(docs, id_col, text_col, words_per_shingle, seed))
    fps = save(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    comps = connected_components(fingerprint_links(fps.select("fp"), radius))
    named = fps.join(comps, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    members = save(named.join(least, "component").select("fp", "component_id"))
    return prints.join(members, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
