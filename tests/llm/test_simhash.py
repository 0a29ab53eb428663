import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ragcorpus.llm import simhash
from ragcorpus.llm.components import connected_components
from ragcorpus.llm.queries import QUERIES


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """doc_id -> component by comparing all pairs."""
    prints = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))]


def test_query_against_all_pairs(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op10_simhash_covering"](spark, sf_dir).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(got) == sorted(brute(rows))


def test_nulls_repeats_long_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(70_000))
    rows = [(3, None), (1, ""), (2, " \t\n"), (4, "A b c d e f"), (5, "a B c d e f"), (5, "a B c d e f"), (None, "a b c d e f"), (6, "x y"), (7, long), (8, long + " tail"), (9, "é b c d e"), (None, "only here with null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x")).withColumn("fingerprint", F.lit(2))
    got = [tuple(r) for r in simhash.simhash_components(df).collect()]
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_empty(spark):
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_pair_within_the_radius_meets():
    masks = [m % 2**64 for m in simhash.covering_masks(4)]
    assert len(masks) == 31
    rng = np.random.default_rng(1)
    for _ in range(2000):
        diff = sum(1 << int(b) for b in rng.choice(64, size=rng.integers(0, 5), replace=False))
        assert any(diff & m == 0 for m in masks)


@pytest.mark.parametrize("block", [3, 2048])
def test_dense_groups_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, 4)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in rng.choice(63, size=2, replace=False)) for c in centres for _ in range(15)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r["node"]: r["component"] for r in connected_components(simhash.fingerprint_links(df)).collect()}
    want = simhash.group_labels(np.array(fps, np.int64).view(np.uint64), 4)
    assert {f: fps[want[i]] for i, f in enumerate(fps)} == {f: got.get(f, f) for f in fps}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (None, 3), (500, 501), (501, 500)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100} | {200 + i: 100 for i in range(50)} | {500: 500, 501: 500}


def test_no_bucket_table_is_broadcast(spark):
    ids = spark.range(20_000)
    own = ids.select(F.xxhash64("id").alias("fp"))
    near = own.where("pmod(fp, 20) = 0").select(F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(b)) for b in (1, 2)])).alias("fp"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2m")  # more than the fingerprints, less than their 31 tables
    try:
        edges = simhash.fingerprint_links(own.unionByName(near), 4)
        linked = edges.collect()
        plan = edges._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(linked) >= 2 * near.count() // 2
    assert "Broadcast" not in plan
