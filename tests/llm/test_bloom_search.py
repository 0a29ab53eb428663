import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ragcorpus.llm import _words, bloom_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]


def brute(docs, items, k=50):
    counts = [(d, Counter(w), len(w)) for d, t in docs if (w := terms(t))]
    big_n, big_l = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in asked.items():
        scores = []
        for d, c, n in counts:
            m = 100 - 50 + (50 * n * big_n) // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0:
                scores.append((-score, d is not None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def found(docs, items, k=50):
    return sorted((tuple(r) for r in bloom_search.search_documents(docs, items, k).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def zipf(rng, n):
    return " ".join(f"w{min(int(r), 400)}" for r in rng.zipf(1.3, n))


@pytest.mark.parametrize("slices", [1, 3])
@pytest.mark.parametrize("k", [1, 7, 50])
def test_against_brute_force(spark, monkeypatch, k, slices):
    rng = np.random.default_rng(8)
    docs = [(i, zipf(rng, int(rng.integers(1, 300)))) for i in range(700)]
    items = [(i, zipf(rng, 25)) for i in range(30)]
    if slices > 1:
        monkeypatch.setattr(bloom_search, "BROADCAST_TERMS", 120)
    got = found(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), k)
    assert got == brute(docs, items, k)


def test_nulls_ties_repeats_long_texts_and_clashing_columns(spark):
    docs = [(5, "Alpha beta"), (4, "alpha BETA"), (5, "Alpha beta"), (None, "alpha beta"), (9, None), (8, ""), (7, " .. "), (2**60, "gamma " * 300 + "beta"), (6, "delta " * 200_000 + "ÉÉ éé"), (3, "epsilon")]
    docs += [(100 + i, "copy of one text") for i in range(70)]
    items = [(1, "alpha beta"), (2, None), (3, "..."), (4, "not there"), (None, "gamma ÉÉ"), (5, "delta"), (6, "copy text"), (1, "epsilon alpha"), (6, "copy text")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("terms", F.lit("x")).repartition(3)
    assert found(df, spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0))) == brute(docs, items)


def test_empty_tables(spark):
    no_docs, no_items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert found(no_docs, no_items) == [] == found(no_docs, spark.createDataFrame([(1, "a")], "item_id long, text string"))
    assert found(spark.createDataFrame([(1, "a")], "doc_id long, text string"), no_items) == []


def test_bounds_hold_and_exclude_most(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/sf0.01/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    index = bloom_search.build_index(docs)
    whole = index.agg(F.sum("n_texts").alias("n"), F.sum("n_words").alias("l"), F.count("*").alias("blocks")).first()
    asked = bloom_search._items(items.collect(), index, whole)
    best = {}
    for r in bloom_search.search(index, items).collect():
        best[r["item_id"]] = min(r["score"], best.get(r["item_id"], 1 << 62))
    floors = np.array([best[i] for i in asked.ids])
    table = pa.Table.from_pandas(index.toPandas(), preserve_index=False)
    table = table.set_column(table.schema.get_field_index("terms"), "terms", table["terms"].cast(pa.list_(pa.string())))
    possible = pairs = 0
    for batch in table.combine_chunks().to_batches():
        for j in range(batch.num_rows):
            block = bloom_search.Block({c: batch.column(c)[j] for c in batch.schema.names}, asked)
            bounds = block.bounds()
            tf, place = block.counts(np.arange(len(block.lengths)))
            for i in range(len(asked.ids)):
                which, w = asked.own(i)
                at = place[which]
                exact = (w[at >= 0][:, None] * block.part(tf[at[at >= 0]], block.m)).sum(axis=0)
                assert (exact <= bounds[i]).all()
            possible += int((bounds >= floors[:, None]).sum())
            pairs += bounds.size
    assert possible < 0.2 * pairs


def test_lists_of_numbers_survive_packing():
    rng = np.random.default_rng(1)
    lists = [np.sort(rng.integers(0, 2 ** int(b), int(n))) for b, n in zip(rng.integers(1, 40, 60), rng.integers(0, 30, 60), strict=True)]
    starts = np.cumsum([0, *map(len, lists)])
    values = np.concatenate(lists)
    data, at = _words.packed(_words.gaps(values, starts), starts)
    deltas, last = _words.unpacked(data)
    assert (_words.summed(deltas, np.searchsorted(last, at)) == values).all()
    assert (_words.bytes_of(_words.binaries(data, at))[0] == data).all()
