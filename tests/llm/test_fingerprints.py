import hashlib

import pytest
from pyspark.sql import functions as F

from ragcorpus.llm import fingerprints
from ragcorpus.llm.queries import QUERIES


def shingles(text):
    w = [x for x in text.lower().replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, docs):
    """docs in order of doc_id."""
    errors = []
    for i, (r, (d, t)) in enumerate(zip(rows, docs, strict=True)):
        t, following = t or "", docs[(i + 1) % len(docs)][1] or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (d, len(t), hashlib.sha256(edited.encode()).hexdigest())
        errors += [abs(r["near_edited"] - jaccard(t, edited)), abs(r["near_next"] - jaccard(t, following))]
        assert (r["fingerprint"] == r["edited_fingerprint"]) <= (r["near_edited"] == 1.0)
    return errors


def test_query(spark, sf_dir):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    rows = sorted(QUERIES["op6_bottom_k_fingerprints"](spark, sf_dir).collect(), key=lambda r: r["doc_id"])
    errors = check(rows, docs)
    assert sum(errors) / len(errors) < 0.03 and max(errors) < 0.2
    prints = {}
    for r, (_, t) in zip(rows, docs, strict=True):
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]


def test_no_python_in_the_plan(spark, sf_dir):
    plan = QUERIES["op6_bottom_k_fingerprints"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_small_sets_are_exact(spark):
    docs = [(1, "a b c d e f g"), (2, "a b c d e f h"), (3, ""), (4, None), (5, "one"), (6, "日本 語 é ü x y z"), (7, " \t\n"), (8, "w " * 30_000), (20, "a b c d e f g")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("sketch", F.lit(1)).withColumn("words", F.lit("x"))
    rows = sorted(fingerprints.fingerprint_documents(df).collect(), key=lambda r: r["doc_id"])
    assert max(check(rows, docs)) < 1e-9


def test_one_row_repeats_null_ids_and_empty(spark):
    one = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert [r["near_next"] for r in fingerprints.fingerprint_documents(one).collect()] == [1.0]
    rows = fingerprints.fingerprint_documents(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c d")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["near_next"]) for r in rows) == [(False, 0.0), (False, 1.0), (True, 0.0)]
    assert fingerprints.fingerprint_documents(one.where("doc_id > 5")).collect() == []


def test_merge_containment_and_counts(spark):
    a, b = " ".join(f"a{i}" for i in range(600)), " ".join(f"a{i}" for i in range(300))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(*[fingerprints.sketch(fingerprints.word_hashes(F.col(c))).alias(c) for c in "ab"])
    r = df.select(fingerprints.containment(F.col("b"), F.col("a")).alias("c"), fingerprints.distinct_shingles(F.col("a")).alias("n"), (fingerprints.merged(F.col("a"), F.col("b")) == F.col("a")).alias("m")).first()
    assert r["c"] > 0.8 and 450 < r["n"] < 760 and r["m"]


@pytest.mark.parametrize("rows_per_range, group", [(3, 2), (2, 512)])
def test_hot_ids_and_many_ranges(spark, monkeypatch, rows_per_range, group):
    """A null id and one other id hold two thirds of the rows; each row is followed by the next in order of (id, hash)."""
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", rows_per_range)
    monkeypatch.setattr(fingerprints, "GROUP_RANGES", group)
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"text {i} of its own words {i * i}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_hash", F.xxhash64("text"))
    got = fingerprints.with_next(df, "doc_id", ["text"]).collect()
    order = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["_hash"], r["text"]) for r in df.collect()))
    want = {a[3]: b[3] for a, b in zip(order, [*order[1:], order[0]], strict=True)}
    assert {r["text"]: r["next_text"] for r in got} == want and len(got) == 90
    ranges = fingerprints._bounds(df.select(F.coalesce("doc_id", F.lit(-1)).alias("k")), "k", 90 // rows_per_range)
    assert ranges == sorted(ranges) and ranges.count(5) > 3
