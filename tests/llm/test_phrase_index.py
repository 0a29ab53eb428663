import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragcorpus.llm import phrase_index
from ragcorpus.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out = []
    cut = [(i, tuple(w[j : j + window])) for i, t in items if (w := words(t)) for j in range(max(1, len(w) - window + 1))]
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, g in cut:
            for j in range(len(w) - len(g) + 1):
                if tuple(w[j : j + len(g)]) == g:
                    hit |= set(range(j, j + len(g)))
                    found.add(item)
        out.append((doc_id, len(w), len(hit), tuple(sorted(str(i) for i in found if i is not None))))
    return sorted(out, key=repr)


def rows(df):
    for r in df.collect():
        assert sum(r["spans"][1::2]) - sum(r["spans"][0::2]) == r["n_hit"]
        assert r["spans"] == sorted(set(r["spans"]))
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in df.collect()), key=repr)


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven"),
    (2, "Kurz, und gut"),
    (12, "die die die die die die die die die die die"),
    (None, "no id here"),
    (3, None),
    (4, ""),
    (4, "... !"),
    (2, "Kurz, und gut"),
    (5, "é"),
    (6, "two three four five six seven eight nine ten eleven twelve"),
]
DOCS = [
    (10, "One two three four five six seven eight nine ten eleven twelve. kurz UND gut"),
    (11, "one two three four five six seven eight nine"),
    (11, "one two three four five six seven eight nine"),
    (None, "x two three four five six seven eight nine ten eleven"),
    (13, "die " * 25),
    (14, None),
    (15, ""),
    (16, "\t\n ..."),
    (2**60, "kurz"),
    (17, "und gut no id here é É"),
    (18, "w " * 60_000 + "kurz und gut " + "w " * 60_000),
]


@pytest.mark.parametrize("segment,slice_bytes,step", [(1 << 23, 1 << 24, 2_000_000), (40, 1 << 24, 3), (100, 60, 2_000_000)])
def test_words_in_windows_against_brute_force(spark, monkeypatch, segment, slice_bytes, step):
    monkeypatch.setattr(phrase_index, "BROADCAST_BYTES", slice_bytes)
    monkeypatch.setattr(phrase_index, "STEP_PLACES", step)
    cut, found = phrase_index.cut_batches, phrase_index.Segment.occurrences

    def small(batches, column, most):
        return cut(batches, column, segment)

    monkeypatch.setattr(phrase_index, "cut_batches", small)

    def stepped(self, own):
        phrase_index.STEP_PLACES = step
        return found(self, own)

    monkeypatch.setattr(phrase_index.Segment, "occurrences", stepped)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("term", F.lit(1)).withColumn("segment", F.lit("s")).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("term", F.lit("die"))
    assert rows(phrase_index.decontaminate(docs, items)) == brute(DOCS, ITEMS)


def test_random_texts_of_few_words(spark):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(rng.choice(list("abcd"), n))
    docs = [(i, text(rng.integers(0, 80))) for i in range(120)]
    items = [(i, text(rng.integers(1, 9))) for i in range(25)] + [(100, docs[5][1]), (101, docs[6][1][:60])]
    df = phrase_index.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=6)
    assert rows(df) == brute(docs, items, 6)


def test_whole_phrases_and_proximity(spark):
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(rng.choice(list("abcdefgh"), n))
    docs = [(i, text(rng.integers(0, 60))) for i in range(60)]
    queries = [(1, "a b"), (2, "c c"), (3, "a B c"), (4, ""), (5, "zz"), (6, "h a a"), (7, "d")]
    index = phrase_index.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    asked = spark.createDataFrame(queries, "item_id long, text string")
    want = [(q, d, j, len(p)) for q, t in queries if (p := words(t)) for d, text in docs for j in range(len(words(text))) if words(text)[j : j + len(p)] == p]
    assert sorted(map(tuple, phrase_index.phrase_matches(index, asked).collect())) == sorted(want)
    near = []
    for q, t in queries:
        terms = set(words(t))
        for d, text in docs:
            w = words(text)
            for j in range(len(w)):
                ends = [next((e for e in range(j, min(len(w), j + 5)) if w[e] == x), None) for x in terms]
                if terms and w[j] in terms and None not in ends:
                    near.append((q, d, j, max(ends)))
    assert sorted(map(tuple, phrase_index.proximity_matches(index, asked, within=5).collect())) == sorted(near)


def test_empty_tables(spark):
    no_docs, no_items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(DOCS[:5], "doc_id long, text string")
    assert phrase_index.decontaminate(no_docs, no_items).collect() == []
    assert rows(phrase_index.decontaminate(some, no_items)) == brute(DOCS[:5], [])
    assert phrase_index.decontaminate(no_docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == []


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_phrase_index"](spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["n_words"]) for r in got) == sorted((d, len(words(t))) for d, t in docs)
    assert all(r["contaminated"] == (r["n_hit"] > 0) == (r["n_items"] > 0) for r in got)
