import zlib

from pyspark.sql import functions as F

from ragcorpus.llm import sharding
from ragcorpus.llm.queries import QUERIES


def check_law(rows, shards, docs):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted((d is None, d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    sums, slots = [0] * shards, [[] for _ in range(shards)]
    for r in rows:
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    return sums


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op1_kd_tree_sharding"](spark, sf_dir).collect()
    sums = check_law(rows, 24, docs)
    largest = max(len(t.encode()) + 8 for _, t in docs)
    assert max(sums) - min(sums) <= 3 * largest
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}


def test_one_value_holds_a_third_of_all_rows(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', 50)").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).otherwise("hot").alias("source"), F.lit(50).alias("n_chars"))
    sums = check_law(sharding.shard_documents(df, 7).collect(), 7, [(r["doc_id"], r["text"]) for r in df.collect()])
    assert max(sums) - min(sums) <= 0.05 * max(sums)


def test_target_bytes_set_the_number_of_shards(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("y" * 92).alias("text"))
    rows = sharding.shard_documents(df, target_bytes=10_000).collect()
    assert len({r["shard"] for r in rows}) == 10


def test_nulls_repeats_clashes_and_empty(spark):
    rows = [(1, "a", None, None), (1, "a", None, None), (None, None, "en", float("nan")), (2, None, "en", 1.0), (3, "é" * 3000, "de", float("inf")), (4, "", "de", -1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars double").withColumn("slot", F.lit(1)).withColumn("_shard", F.lit("s")).withColumn("size", F.lit("x"))
    check_law(sharding.shard_documents(df, 3).collect(), 3, [(d, t) for d, t, _, _ in rows])
    assert sharding.shard_documents(df.where("doc_id > 99"), 3).collect() == []


def test_texts_that_begin_alike_are_told_apart(spark):
    rows = [(i, f"https://www.example.org/site/{chr(97 + i % 4)}/page", 1) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, url string, size long")
    got = sharding.kd_shards(df, ["url"], "size", ["doc_id"], shards=4).collect()
    assert {r["_shard"]: {x["url"] for x in got if x["_shard"] == r["_shard"]} for r in got} == {k: {f"https://www.example.org/site/{chr(97 + k)}/page"} for k in range(4)}
    same = spark.createDataFrame([(i, "x" * 5000, 1) for i in range(64)] + [(99, None, 1)], "doc_id long, url string, size long")
    assert sharding.kd_shards(same, ["url"], "size", ["doc_id"], shards=2).groupBy("_shard").count().count() == 2
