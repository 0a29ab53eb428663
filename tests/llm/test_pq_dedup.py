import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragcorpus.llm import pq_dedup
from ragcorpus.llm.queries import QUERIES


def brute(rows, threshold=0.93):
    """vec_id -> (n_links, component, kept) by all pairs."""

    def usable(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if usable(v, label) else None for _, v, label in rows]
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, links[i], least.get(find(i)), d is not None and d == least[find(i)]) for i, (d, _, _) in enumerate(rows)]


def key(r):
    return tuple(str(x) for x in r)


def test_query_finds_every_link(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op2_pq_near_dedup"](spark, sf_dir).select("vec_id", "n_links", "component_id", "kept").collect()]
    assert sorted(got) == sorted(brute(rows))


@pytest.mark.parametrize("block, per_list", [(2048, 4096), (7, 20)])
def test_clusters_over_lists_and_blocks(spark, monkeypatch, block, per_list):
    monkeypatch.setattr(pq_dedup, "BLOCK", block)
    monkeypatch.setattr(pq_dedup, "VECTORS_PER_LIST", per_list)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(5, 12))
    rows = [(i, (centres[i % 5] + rng.normal(scale=0.33, size=12)).tolist(), int(i % 2)) for i in range(200)]
    got = [tuple(r) for r in pq_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, v, None), (4, None, 1), (5, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 2.0], 1), (7, [float("nan"), 1.0, 1.0], 1), (8, [float("inf"), 1.0, 1.0], 1), (9, [2.0, 4.0, 6.0], 1), (10, v, 2), (11, [1.0, 2.0], 1), (None, v, 1), (12, [], 1), (None, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("uid", F.lit("clash")).withColumn("n", F.lit(0))
    got = [tuple(r) for r in pq_dedup.near_vectors(df).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert pq_dedup.near_vectors(df.where("vec_id > 99")).collect() == []
    assert [tuple(r) for r in pq_dedup.near_vectors(df.where("vec_id = 4")).collect()] == [(4, 0, 4, True)]


@pytest.mark.parametrize("noise, most", [(0.02, 0.3), (0.05, 0.3)])
def test_clustered_vectors_probe_few_lists(noise, most):
    """The share of lists that the lossless bounds leave to a query, where vectors form clusters."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(60, 64)) / 8)[rng.integers(0, 60, 4000)] + rng.normal(scale=noise, size=(4000, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    model = pq_dedup.Quantiser.fit(unit, 64, 4)
    own, _, _, far, _ = model.encode(unit)
    model.reach = np.array([far[own == j].max(initial=-np.inf) for j in range(64)])
    radius = math.sqrt(2 - 2 * 0.93)
    probed = model.probes(unit, own, radius)
    assert probed.mean() < most
    near = unit @ unit.T >= 0.93
    assert all(probed[i, own[near[i]]].all() for i in range(0, 4000, 37))


def test_query_has_lists_to_choose_from(spark):
    from ragcorpus.llm.queries import table

    rows = table(spark, "/root/testdata/sf0.1", "embeddings").select(F.col("embedding").alias("v"), "label")
    most = rows.groupBy("label").count().agg(F.max("count")).first()[0]
    assert len(pq_dedup.fit_quantiser(rows, rows.count(), most, 64).centroids) >= 16


def test_rare_values_that_differ_are_never_one(spark):
    """Rows are told apart by value: two vectors of one label that differ in the last place are two."""
    rows = [(2**53 + 1, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (5, [1.0, np.nextafter(2.0, 3.0)], 1), (6, [1.0, 2.0], 2)]
    got = [tuple(r) for r in pq_dedup.near_vectors(spark.createDataFrame([(a, [float(x) for x in b], c) for a, b, c in rows], "vec_id long, embedding array<double>, label int")).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
