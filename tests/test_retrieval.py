"""Lexical and dense retrieval, fusion and selection against plain Python and worked examples."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragcorpus.operators import dense, evaluation, fusion
from ragcorpus.operators import bm25, dense, evaluation, fusion
from ragcorpus.operators.bm25 import append_to_bm25_index, bm25_topk, build_bm25_index, delete_from_bm25_index, read_bm25_index, store_bm25_index

TEXTS = ["GST registration guide", "GSTR-1 filing rules", "the the the rules of the guide", "", None, "the registration of a guide", "the the end"]


def plain_bm25(texts, query, k1=1.5, b=0.75):
    docs = [(t or "").lower().split() for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    out = []
    for d in docs:
        tf = Counter(d)
        out.append(round(sum(idf.get(w, 0) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(d) / avg)) for w in query.lower().split()), 9))
    return out


def chunks(spark, texts):
    return spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "chunk_id long, doc_order long, content string")


@pytest.mark.parametrize("k", [2, 20])
def test_bm25(spark, k):
    asked = ["GST registration", "the the guide", "nothing here", "rules rules", ""]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = {}
    for r in bm25_topk(build_bm25_index(chunks(spark, TEXTS)), queries, k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    for q, text in enumerate(asked):
        scores = plain_bm25(TEXTS, text)
        want = sorted(range(len(TEXTS)), key=lambda i: (-scores[i], i))[:k]
        assert [c for c, _ in got[q]] == want and np.allclose([s for _, s in got[q]], [scores[i] for i in want])


def test_pruned_queries_give_the_same_rows_from_few_postings(spark):
    rng = np.random.default_rng(11)
    # stop-words in most chunks, and 50 topics of eight words, of which a chunk has some; some chunks repeat one word very often
    texts = [" ".join(rng.permutation(["the"] * int(rng.integers(0, 4)) + ["of"] * int(rng.integers(0, 3)) + [f"t{i % 50}w{j}" for j in rng.integers(0, 8, int(rng.integers(2, 12)))] + [f"n{i}"])) for i in range(3000)]
    texts += ["the " * 200, "of " * 150, ""]
    asked = ["the t1w1 of t1w2 t1w3 t1w4", "of the t7w0 t7w1 t7w5 t7w6 t7w0", "t9w1 of the t9w2 t9w3 t9w7", "t2w2 t3w3 the", "the", "zzz the of", "t5w1 n77"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    index = build_bm25_index(chunks(spark, texts))
    for k in (1, 10):
        whole = bm25_topk(index, queries, k).orderBy("query_id", "rank").collect()
        assert bm25_topk(index, queries, k, pruned_from=0).orderBy("query_id", "rank").collect() == whole
    with_stop_words = queries.where("query_id in (0, 1, 2)")
    wanted = bm25._wanted(index, with_stop_words)
    bounded = bm25.save(bm25._bounded(index, wanted, 1.5, 0.75))[0]
    floor, first = bm25.first_floor(index, bounded, wanted, 10)
    block = ["query_id", "term", "class", "level", "df"]
    read = first.select(block).union(bm25.essential(bounded, floor).select(block)).distinct()
    assert read.agg(F.sum("df")).first()[0] < 0.3 * bounded.agg(F.sum("df")).first()[0]


def test_segments_are_the_index_of_what_is_left(spark, tmp_path):
    texts = [*TEXTS, "registration of rules", "a guide to filing", None]
    whole, path = chunks(spark, texts), f"{tmp_path}/index"
    store_bm25_index(whole.where("chunk_id < 5"), path)
    delete_from_bm25_index(whole.where("chunk_id in (1, 2)").union(spark.createDataFrame([(99, 99, "x")], "a long, b long, c string")), path)
    append_to_bm25_index(whole.where("chunk_id >= 5 or chunk_id = 2"), path)
    delete_from_bm25_index(whole.where("chunk_id = 8"), path)
    grown, new = read_bm25_index(spark, path), build_bm25_index(whole.where("chunk_id not in (1, 8)"))
    for name in ("postings", "terms", "chunks", "corpus"):
        columns = getattr(new, name).columns
        rows = lambda index: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in getattr(index, name).select(columns).collect()), key=str)  # noqa: B023, E731
        assert rows(grown) == rows(new)
    queries = spark.createDataFrame([(1, "registration guide"), (2, "the rules")], "query_id long, query string")
    top = lambda index, least: bm25_topk(index, queries, 4, pruned_from=least).orderBy("query_id", "rank").collect()
    assert top(grown, 0) == top(new, 0) == top(new, 10**9)


def test_pairs_are_summed_where_their_chunks_are_dealt(spark, tmp_path, monkeypatch):
    texts = [" ".join(f"t{(i * j) % 13}" for j in range(1, 2 + i % 9)) for i in range(300)]
    asked = ["t1 t2 t3 t0", "t5 t7", "t0 t1 t4 t9 t11", "nothing", "t12"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    path = str(tmp_path / "grown")
    store_bm25_index(chunks(spark, texts), path)
    delete_from_bm25_index(spark.range(0, 300, 3).toDF("chunk_id"), path)
    append_to_bm25_index(chunks(spark, texts).where("chunk_id % 6 = 0"), path)
    indexes = [build_bm25_index(chunks(spark, texts)), read_bm25_index(spark, path)]

    def rows(index):
        found = [bm25_topk(index, queries, 12, pruned_from=least).orderBy("query_id", "rank").collect() for least in (0, 10**9)]
        return [bm25.bm25_scores(index, queries).orderBy("query_id", "chunk_id").collect(), *found]

    want = [rows(index) for index in indexes]
    assert want[0][1] == want[0][2] and want[1][1] == want[1][2]
    monkeypatch.setattr(bm25, "PAIRS_PER_TASK", 40)
    scores = bm25.bm25_scores(indexes[0], queries)
    assert "hashpartitioning(query_id" not in scores._jdf.queryExecution().executedPlan().toString()
    assert scores.rdd.getNumPartitions() >= len(want[0][0]) // 40 > 4
    monkeypatch.setattr(bm25, "BROADCAST_ROWS", 0)  # queries and their chunks that are too many to broadcast
    assert [rows(index) for index in indexes] == want


def test_blocks_are_summed_in_parts_that_follow_them(spark, tmp_path, monkeypatch):
    texts = [" ".join(f"t{(i * j) % 97}" for j in range(1, 2 + i % 9)) for i in range(200)]
    queries = spark.createDataFrame([(1, "t1 t2 t3 t0"), (2, "nothing"), (3, "t5 t5")], "query_id long, query string")

    def grown(path):
        store_bm25_index(chunks(spark, texts), path)
        delete_from_bm25_index(spark.range(0, 200, 3).toDF("chunk_id"), path)
        append_to_bm25_index(chunks(spark, texts).where("chunk_id % 6 = 0"), path)
        return read_bm25_index(spark, path)

    def rows(index):
        found = [bm25_topk(index, queries, 12, pruned_from=least).orderBy("query_id", "rank").collect() for least in (0, 10**9)]
        return [sorted(index.terms.collect()), sorted(index.blocks.collect()), sorted(bm25._wanted(index, queries).collect()), *found]

    want = rows(grown(str(tmp_path / "whole")))
    settings = [spark.conf.get(f"spark.sql.{name}") for name in ("files.maxPartitionBytes", "shuffle.partitions")]
    monkeypatch.setattr(bm25, "WORDS_PER_TASK", 50)
    monkeypatch.setattr(bm25, "BLOCK_BYTES", 1 << 16)
    monkeypatch.setattr(bm25, "BLOCKS_PER_TASK", 40)
    path = str(tmp_path / "parts")
    index = grown(path)
    assert rows(index) == want
    # no task sums several files of postings, and the counts of terms are summed in more parts where there are more
    own = bm25._few_at_once(spark, f"{path}/postings/segment=0", 9)
    files = len(own.inputFiles())
    assert files > 12 and own.rdd.getNumPartitions() == files
    assert settings == [spark.conf.get(f"spark.sql.{name}") for name in ("files.maxPartitionBytes", "shuffle.partitions")]
    assert index.terms.rdd.getNumPartitions() >= index.stored["blocks"].count() // 40 > 4
    assert index.blocks.rdd.getNumPartitions() == index.terms.rdd.getNumPartitions()


def test_few_stored_bytes_are_dealt_at_once(spark, tmp_path, monkeypatch):
    """Tasks that deal postings or lists of words read few of them, also where these stand in one file, and callers keep their session."""
    texts = [" ".join(f"t{(i * j) % 997}" for j in range(1, 60)) for i in range(1500)]
    queries = spark.createDataFrame([(1, "t1 t2 t3 t0"), (2, "t5 t5 t996")], "query_id long, query string")
    own = chunks(spark, texts).coalesce(1)
    want = bm25_topk(store_bm25_index(own, str(tmp_path / "whole")), queries, 12).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(bm25, "WORDS_PER_TASK", 5_000)
    monkeypatch.setattr(bm25, "BLOCK_BYTES", 1 << 16)
    index = store_bm25_index(own, str(tmp_path / "few"))
    found = [bm25_topk(index, queries, 12, pruned_from=least).orderBy("query_id", "rank") for least in (0, 10**9)]
    assert [x.collect() for x in found] == [want, want]
    assert index.stored["postings"].rdd.getNumPartitions() == len(index.postings.inputFiles()) > 12
    stored = index.stored["forward"]
    assert len(stored.inputFiles()) == 1
    filled = stored.groupBy(F.spark_partition_id()).count()  # a task gets no less than a group of rows
    assert filled.count() > 2 and filled.agg(F.max("count")).first()[0] < 1000
    wanted = bm25._wanted(index, queries)
    for df in (*found, bm25._weights(index, wanted, bm25.K1, bm25.B, 9), bm25._exact(index, wanted.select("query_id", F.lit(3).cast("long").alias("chunk_id")), wanted, bm25.K1, bm25.B, 9)):
        assert df.sparkSession._jsparkSession.equals(spark._jsparkSession)


def test_only_blocks_of_wanted_terms_are_summed(spark):
    index = build_bm25_index(chunks(spark, ["a b c", "a b", "c d e f g"]))
    queries = spark.createDataFrame([(1, "a c zz")], "query_id long, query string")
    wanted = bm25._wanted(index, queries)
    for found in (wanted, bm25._bounded(index, wanted, bm25.K1, bm25.B)):
        plan = found._jdf.queryExecution().executedPlan().toString().split("\n")
        sums = next(i for i, line in enumerate(plan) if "partial_sum(df" in line)
        assert "LeftSemi" in plan[sums + 1]  # before they are summed
    assert sorted(r["term"] for r in wanted.collect()) == ["a", "c"]


def test_documents_are_not_shuffled_for_their_hits(spark, sf_dir):
    """The best of each query are a table before documents are read for them."""
    from ragcorpus.plans.queries import QUERIES

    for name in ("hit_contexts", "rrf_fusion"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "documents.parquet" not in plan and "scratch-" in plan


def test_bm25_ties_and_empty_corpus(spark):
    queries = spark.createDataFrame([(1, "GST registration")], "query_id long, query string")
    rows = bm25_topk(build_bm25_index(chunks(spark, TEXTS[:2])), queries, 2).collect()
    assert [(r["chunk_id"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"])] == [(0, 0.0), (1, 0.0)]
    assert bm25_topk(build_bm25_index(chunks(spark, TEXTS[:0] or ["x"]).where("chunk_id > 5")), queries, 2).collect() == []


def vectors(spark, x, name="chunk_id"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x)], f"{name} long, embedding array<float>")


def test_knn(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    own, asked = vectors(spark, [*x.tolist(), None]), vectors(spark, x[:7].tolist(), "query_id")
    want = {}
    for q in range(7):
        d = np.round(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1), 9)
        want[q] = [int(i) for i in np.lexsort((np.arange(60), d))[:4]]
    for block in (4096, 2):
        monkeypatch.setattr(dense, "QUERY_BLOCK", block)
        got = {}
        for r in dense.knn(own, asked, 4, with_score=True).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["chunk_id"])
            assert abs(r["score"] - (1 - r["distance"] / 2**0.5)) < 1e-6
        assert got == want
    assert all(r["score"] == r["distance"] for r in dense.knn_by_vector(own, asked).collect())


def test_vectors_that_are_no_neighbours(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [nan, 0.0]), (3, [inf, 1.0]), (4, None), (5, [0.0, 1.0]), (6, [0.5, None]), (7, [1.0]), (8, []), (9, [-inf, 0.0]), (10, [3e18, -3e18])]
    asked = [(1, [1.0, 0.0]), (2, [nan, 1.0]), (3, [2.0]), (4, [1.0, 2.0, 3.0]), (5, None), (6, [0.0, inf])]
    own, queries = spark.createDataFrame(rows, "chunk_id long, embedding array<float>"), spark.createDataFrame(asked, "query_id long, embedding array<float>")
    for block in (4096, 1):
        monkeypatch.setattr(dense, "QUERY_BLOCK", block)
        got = [(r["query_id"], r["chunk_id"]) for r in dense.knn(own, queries, 5).orderBy("query_id", "rank").collect()]
        assert got == [(1, 1), (1, 5), (1, 10), (3, 7)]


def test_an_index_gives_the_same_from_few_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dense, "CHUNK_BLOCK", 150)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 12)) * 4
    x = (centres[rng.integers(0, 40, 2500)] + rng.normal(size=(2500, 12)) * 0.4).astype(np.float32)
    x[:400] = x[0]  # a third of a list and more are one vector
    own = vectors(spark, [*x.tolist(), None, [float("nan")] * 12]).repartition(3)
    asked = vectors(spark, [*x[::100].tolist(), (centres[3] + 9).tolist(), [1.0, 2.0]], "query_id")
    index = dense.store_vector_index(own, f"{tmp_path}/index")
    for k in (1, 15, 2600):
        want = dense.knn(own, asked, k, True).orderBy("query_id", "rank").collect()
        assert dense.knn_by_index(index, asked, k, True).orderBy("query_id", "rank").collect() == want
    few = asked.where("query_id < 25")
    limits = dense.knn(own, few, 15).groupBy("query_id").agg(F.max("distance").alias("far"))
    read = dense.blocks_to_read(index, few.join(limits, "query_id"), None).union(dense.blocks_to_read(index, few, 15)).select("query_id", "block", "n").distinct()
    assert read.agg(F.sum("n")).first()[0] < 0.3 * 25 * 2500
    assert dense.knn_by_index(dense.store_vector_index(own.where("chunk_id < 0"), f"{tmp_path}/empty"), asked, 3).collect() == []
    with pytest.raises(ValueError):
        dense.store_vector_index(vectors(spark, [[1.0], [1.0, 2.0]]), f"{tmp_path}/bad")


def test_mmr(spark):
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(12, 6)), rng.normal(size=6)
    unit = lambda v: v / np.linalg.norm(v)
    chosen = []
    while len(chosen) < 5:
        score = [-9 if i in chosen else 0.7 * unit(x[i]) @ unit(q) - 0.3 * max((unit(x[i]) @ unit(x[j]) for j in chosen), default=0) if chosen else unit(x[i]) @ unit(q) for i in range(12)]
        chosen.append(int(np.argmax(score)))
    rows = [(1, i + 1, i, x[i].tolist(), q.tolist()) for i in range(12)]
    df = spark.createDataFrame(rows, "query_id long, rank int, chunk_id long, embedding array<double>, query_embedding array<double>")
    assert [r["chunk_id"] for r in dense.mmr(df).orderBy("pick").collect()] == chosen


def test_the_lists_of_words_are_a_map_and_postings_are_dealt_by_words(spark, tmp_path, monkeypatch):
    texts = ["b a B  c\tb", "", None, "x", " ".join(f"w{i % 7}" for i in range(50))]
    rows = [(i, i, t) for i, t in enumerate(texts)]
    forward = bm25._forward(spark.createDataFrame(rows, "chunk_id long, doc_order long, content string"), "content")
    assert "Exchange" not in forward._jdf.queryExecution().executedPlan().toString()
    got = {r["chunk_id"]: (r["dl"], {w["term"]: w["tf"] for w in r["words"]}, len(r["words"])) for r in forward.collect()}
    for i, t in enumerate(texts):
        count = Counter((t or "").lower().split())
        assert got[i] == (sum(count.values()), dict(count), len(count))
    monkeypatch.setattr(bm25, "WORDS_PER_TASK", 100)
    many = [(i, i, " ".join(f"t{(i + j) % 11}" for j in range(10))) for i in range(400)]
    store_bm25_index(spark.createDataFrame(many, "chunk_id long, doc_order long, content string").coalesce(1), str(tmp_path / "x"))
    assert len(list((tmp_path / "x" / "postings" / "segment=0").glob("*.parquet"))) > 20


def test_only_texts_without_words_have_no_direction(spark):
    texts = ["w38 w46", "", None, " \t\n", "\u00a0", "w1 w2 w3"]  # the signed counts of w38 and w46 cancel out
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, content string")
    got = {r["n"]: math.fsum(x * x for x in r["embedding"]) for r in dense.embed(rows).collect()}
    assert [round(got[n], 3) for n in range(6)] == [1, 0, 0, 0, 1, 1]


def test_embedding(spark):
    def failing():
        def encode(texts):
            if "bad" in texts:
                raise RuntimeError
            return np.ones((len(texts), 4))

        return encode

    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None)], "i int, content string").coalesce(1)
    assert {r["i"]: r["embedding"] for r in dense.embed(df, failing, batch=1).collect()} == {1: [0.5] * 4, 2: None, 3: [0.5] * 4}
    assert abs(sum(v * v for v in dense.embed(df).where("i = 1").first()["embedding"]) - 1) < 1e-6


HITS = "query_id long, rank int, chunk_id string, content string"


def test_rrf(spark):
    a = spark.createDataFrame([(1, 1, "a", "A"), (1, 2, "b", "B")], HITS)
    b = spark.createDataFrame([(1, 1, "b2", "B"), (1, 2, "c", "C")], HITS)
    got = [(r["content"], r["chunk_id"], round(r["score"], 6)) for r in fusion.rrf(a, b).orderBy("rank").collect()]
    assert got == [("B", "b", round(1 / 62 + 1 / 61, 6)), ("A", "a", round(1 / 61, 6)), ("C", "c", round(1 / 62, 6))]
    # repeats: the last dense rank counts, lexical parts add up
    a = spark.createDataFrame([(1, 1, "x1", "X"), (1, 3, "x3", "X")], HITS)
    b = spark.createDataFrame([(1, 1, "y1", "Y"), (1, 2, "y2", "Y")], HITS)
    got = [(r["content"], r["chunk_id"], round(r["score"], 6)) for r in fusion.rrf(a, b).orderBy("rank").collect()]
    assert got == [("Y", "y1", round(1 / 61 + 1 / 62, 6)), ("X", "x3", round(1 / 63, 6))]


CANDIDATES = "query_id long, rank int, source_type string, score double"


@pytest.mark.parametrize(
    "rows, options, want",
    [
        ([("faq", 0.95), ("rules", 0.949), ("help", 0.90)], {"top_k": 1}, ["rules"]),
        ([("faq", 0.9), ("rules", 0.8)], {"top_k": 1, "enabled": False}, ["faq"]),
        ([("help", 1.0), ("faq", 0.99), ("act", 0.95)], {"top_k": 1, "bonuses": {"act": 0.5}}, ["help"]),
        ([("help", 1.0), ("act", 0.99), ("faq", 0.95)], {"top_k": 1, "bonuses": {"act": 0.5}}, ["act"]),
        ([("faq", 0.5), ("act", 0.5)], {}, ["act", "faq"]),
    ],
)
def test_authority_selection(spark, rows, options, want):
    df = spark.createDataFrame([(1, i + 1, t, s) for i, (t, s) in enumerate(rows)], CANDIDATES)
    assert [r["source_type"] for r in fusion.select_with_authority(df, **options).orderBy("rank").collect()] == want


def test_raw_and_authority_score(spark):
    df = spark.createDataFrame([(1, 1, "act", 0.95), (1, 2, "faq", 1.0)], CANDIDATES)
    act = fusion.select_with_authority(df).where("source_type = 'act'").first()
    assert (act["score"], act["authority_score"]) == (0.95, 0.08)


def test_rerank(spark):
    df = spark.createDataFrame([(1, 1, "q", "low", 0.0), (1, 2, "q", "high", 0.0), (1, 3, "q", "low", 0.0)], "query_id long, rank int, query string, content string, score double")
    scorer = lambda qs, ts: [{"low": 0.3, "high": 0.9}[t] for t in ts]
    got = [(r["content"], r["score"], r["rank"], r["reranked"]) for r in fusion.rerank(df, scorer).orderBy("rank").collect()]
    assert got == [("high", 0.9, 1, True), ("low", 0.3, 2, True), ("low", 0.3, 3, True)]
    assert fusion.rerank(df, scorer, 1).count() == 1 and fusion.rerank(df.where("rank > 9"), scorer).count() == 0


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        fusion.retrieve(None, None, strategy="other")


def test_web_results(spark):
    rows = [(1, "yes", [("a",)]), (2, "", [("a",), ("",), ("b",), ("c",)]), (3, None, []), (4, None, None), (5, None, [("",)])]
    got = dict(map(tuple, fusion.combine_search_results(spark.createDataFrame(rows, "query_id int, answer string, results array<struct<content string>>")).collect()))
    assert got == {1: "yes", 2: "a\n\nb", 3: "No search results found.", 4: "No search results found.", 5: "No content found in search results."}


def metrics_of(spark, types):
    hits = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(types)], "query_id int, rank int, source_type string")
    return hits, spark.createDataFrame([(1,), (2,)], "query_id int")


def test_retrieval_metrics(spark):
    hits, queries = metrics_of(spark, ["rules", "act", "faq", "notification"])
    for k, want in ((10, 0.75), (1, 1.0), (2, 1.0), (3, 2 / 3)):
        got = dict(map(tuple, evaluation.authority_at_k(hits, queries, k).collect()))
        assert got[2] == 0.0 and abs(got[1] - want) < 1e-9
    hits, queries = metrics_of(spark, ["user_guide", "rules", "faq"])
    assert dict(map(tuple, evaluation.first_authoritative_rank(hits, queries).collect())) == {1: 2, 2: None}
    hits, queries = metrics_of(spark, ["rules", "faq", "notification"])
    r = evaluation.retrieval_metrics(hits, queries).where("query_id = 1").first()
    assert (r["n_authoritative"], r["n_retrieved"], r["first_rank"]) == (2, 3, 1) and abs(r["authority_at_top_k"] - 2 / 3) < 1e-9


def test_top_k_pushes_below_the_shuffle(spark, sf_dir):
    from ragcorpus.plans.queries import QUERIES

    plan = QUERIES["bm25_top20"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "Python" not in plan
    assert F is not None


def test_bm25_of_negative_scores_fills_up_with_the_first_zeros(spark):
    """Most terms are in over half of all chunks, so their scores are below the zeros, which stand last in the corpus."""
    texts = ["a b c"] * 100 + ["x"] * 5 + ["a b c"] * 3 + ["x a"]
    asked = ["a", "x", "nothing", "a b x"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = {}
    for r in bm25_topk(build_bm25_index(chunks(spark, texts)), queries, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    for q, text in enumerate(asked):
        scores = plain_bm25(texts, text)
        want = sorted(range(len(texts)), key=lambda i: (-scores[i], i))[:7]
        assert [c for c, _ in got[q]] == want and np.allclose([s for _, s in got[q]], [scores[i] for i in want])
    assert [c for c, _ in got[0]][:5] == [100, 101, 102, 103, 104]


def test_stored_index(spark, tmp_path):
    own = chunks(spark, TEXTS)
    queries = spark.createDataFrame([(0, "the rules of GST"), (1, "guide")], "query_id long, query string")
    store_bm25_index(own, f"{tmp_path}/index")
    stored = bm25_topk(read_bm25_index(spark, f"{tmp_path}/index"), queries, 4).orderBy("query_id", "rank").collect()
    assert stored == bm25_topk(build_bm25_index(own), queries, 4).orderBy("query_id", "rank").collect()


def test_knn_ids_of_any_type_and_rows_that_are_shuffled(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 6))
    own = spark.createDataFrame([(f"c{i}", v.tolist()) for i, v in enumerate(x)], "chunk_id string, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(f"q{i}", x[i].tolist()) for i in range(9)], "query_id string, embedding array<double>")
    want = {f"q{i}": [f"c{j}" for j in np.lexsort((np.array([f"c{j}" for j in range(500)]), np.round(((x - x[i]) ** 2).sum(axis=1), 9)))[:3]] for i in range(9)}
    few = dense._by_task(own.where("embedding is not null"), asked.toPandas(), 3, "query_id string, chunk_id string, distance double")
    assert few.count() <= 9 * 3 * own.rdd.getNumPartitions()  # k rows a query and task, not a batch
    for block in (4096, 4):
        monkeypatch.setattr(dense, "QUERY_BLOCK", block)
        monkeypatch.setattr(dense, "CHUNK_BLOCK", 100)
        got = {}
        for r in dense.knn(own, asked, 3).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["chunk_id"])
        assert got == want
    near = dense.knn(own, asked, 4).join(own, "chunk_id").join(asked.withColumnRenamed("embedding", "query_embedding"), "query_id")
    assert {r["query_id"] for r in dense.mmr(near, 2).collect()} == set(want)
