import pytest
from pyspark.sql import functions as F

from ragcorpus.llm import pii, simhash, toxicity
from tests.llm.test_packing import check_pieces, check_sequences
from tests.llm.test_simhash import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"  # the smallest tables have too few labels to learn from
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, now = docs.columns, docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in now.collect()]
        stage(spark, now, sf_dir).write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        after = [tuple(r) for r in now.collect()]
        if name == "toxicity":
            scores = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
            assert sorted(after) == sorted(r for r in before if not scores[r[0]]) and len(after) > 0.8 * len(before)
        elif name == "simhash_dedup":
            kept = {c for _, _, c in brute([r[:2] for r in before])}
            assert sorted(after) == sorted(r for r in before if r[0] in kept) and len(after) < len(before)
        elif name == "pii":
            trees, thresholds = pii.model()
            want = [(d, pii.redact(t, pii.find(t, trees, thresholds)[1]), lang, source) for d, t, lang, source, _ in before]
            assert sorted(r[:4] for r in after) == sorted(want) and all(r[4] == len(r[1]) for r in after)
        else:
            rows = now.collect()
            check_pieces(rows, [r[:2] for r in before])
            check_sequences(rows)
        if i < 3:
            assert now.columns == columns
    assert corpus_pipeline.run(spark, sf_dir).count() == len(after)


def test_odd_rows(spark, sf_dir):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c d e", None, "s", 9), (3, "a b c d e", None, "s", 9), (4, "a b c d e", "en", "s", 9), (None, "a b c d e", "en", None, 9), (None, "q r s t u v w", "en", None, 9)]
    now = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("best", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, sf_dir)
    assert sorted((str(r["doc_id"]), r["text"]) for r in now.collect()) == [("1", None), ("3", "a b c d e"), ("None", "q r s t u v w")]
    assert simhash.first_of_each_group(now.where("doc_id > 99")).collect() == []
