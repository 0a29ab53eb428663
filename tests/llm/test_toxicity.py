import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ragcorpus.llm import toxicity
from ragcorpus.llm._boost import Boosted, Calibrated, Isotonic
from ragcorpus.llm.queries import QUERIES


def auc(score, y):
    order = np.argsort(score)
    ranks = np.empty(len(score))
    for v in np.unique(score):
        ranks[score == v] = np.flatnonzero(score[order] == v).mean() + 1
    n1 = y.sum()
    return (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_query_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = QUERIES["op5_toxicity_trees"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["toxic"] is not None]
    y, s = np.array([r["toxic"] for r in held]), np.array([r["score"] for r in held])
    assert auc(s, y) > 0.97
    picked = s >= 0.3
    assert y[picked].mean() > 0.9 and picked[y == 1].mean() > 0.85 and np.mean((s - y) ** 2) < 0.03


def test_held_out_labels_change_nothing(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b = (sorted(map(tuple, toxicity.score_documents(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_obfuscated_words():
    own = toxicity.Lexicon()
    plain = own.vector("such a fine day with you all in the garden")
    for text in ("you are an id10t and", "you st*pid thing", "you are a M0R0N now", "what an s t u p i d idea", "you stuuupid man"):
        assert own.vector(text)[toxicity.FEATURES.index("obfuscated_hits")] >= 1 and plain[toxicity.FEATURES.index("obfuscated_hits")] == 0
    assert own.vector("you idiot")[toxicity.FEATURES.index("near_second")] > 0


def slow_features(text, lexicon):
    """Features of a text token by token, without codes or counts of kinds; those that need obfuscation are left out."""
    tokens = (text or "").split()
    n, chars = max(1, len(tokens)), max(1, len(text or ""))
    core = [re.sub(r"^\W+|[\W_]+$", "", t).lower() if not t.rstrip(".,;:!?").isalpha() else t.rstrip(".,;:!?").lower() for t in tokens]
    weight = [round(4 * lexicon.weights.get(w, 0.0)) / 4 for w in core]
    prefix = [round(4 * max(lexicon.weights.get(w[:k] + "~", 0.0) if len(w) > k else 0.0 for k in (4, 5, 6))) / 4 for w in core]
    fixed = [w in toxicity.INSULTS for w in core]
    person = [w in toxicity.SECOND_PERSON for w in core]
    hit = [f or w > 0 or p > 0 for f, w, p in zip(fixed, weight, prefix, strict=True)]
    near = sum(h and any(person[max(0, i - 5) : i + 6]) for i, h in enumerate(hit))
    letters = [sum(c.isalpha() for c in t) for t in tokens]
    return {
        "length": np.log1p(len(tokens)) if tokens else 0,
        "fixed_density": sum(fixed) / n,
        "fixed_count": np.log1p(sum(fixed)),
        "word_density": sum(w > 0 for w in weight) / n,
        "word_best": max(weight, default=0),
        "word_sum": sum(weight) / n**0.5,
        "prefix_density": sum(p > 0 for p in prefix) / n,
        "prefix_best": max(prefix, default=0),
        "near_second": near / (sum(hit) + 1),
        "second_density": sum(person) / n,
        "capital_words": sum(k >= 2 and sum(map(str.isupper, t)) == k for t, k in zip(tokens, letters, strict=True)) / n,
        "capital_letters": sum(c.isupper() for t in tokens for c in t) / chars,
        "exclamations": sum(t.count("!") for t in tokens) / n,
        "questions": sum(t.count("?") for t in tokens) / n,
        "digits": sum(c.isdigit() for t in tokens for c in t) / chars,
        "distinct_hits": len({t for t, h in zip(tokens, hit, strict=True) if h}),
    }


def test_features_and_scores_against_token_by_token(spark, sf_dir):
    lexicon = toxicity.Lexicon({"garden": 2.3, "gard~": 1.1, "fine": 0.9, "wretch~": 4.0})
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    texts += ["YOU fool! such a fine garden, gardens? WRETCHED wretches 12 of you.", "", None, "a A b B 5", "idiot, you. " * 50]
    for text in texts:
        got = dict(zip(toxicity.FEATURES, lexicon.vector(text), strict=True))
        for name, value in slow_features(text, lexicon).items():
            if not got["obfuscated"] and not got["elongated"] and not got["obfuscated_hits"]:
                assert abs(got[name] - value) < 1e-9, (name, text)
    # a score is the calibrated share of the trees' sum, whatever batch a text is in
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    score = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs.repartition(3), labels).collect()}
    for r in docs.select("doc_id", "text").limit(40).collect():
        x = np.array([toxicity.Lexicon(model[0].weights).vector(r["text"])])
        assert abs(score[r["doc_id"]] - (model[1](x)[0] if model[1] else 1 - np.exp(-20 * x[0, 1]))) < 1e-12


def test_what_a_worker_remembers_is_bounded(monkeypatch):
    rng = np.random.default_rng(1)
    lexicon, fresh = toxicity.Lexicon(), toxicity.Lexicon()
    noisy = ["".join(rng.choice(list("aB1!?*.,x"), 9)) for _ in range(60_000)]
    for i in range(0, len(noisy), 100):
        lexicon.vector(" ".join(noisy[i : i + 100]))
    assert len(lexicon.values) <= toxicity.MOST_CODES + 100 and len(lexicon.codes) == len(lexicon.values)
    assert lexicon.vector("you idiot moron of a garden") == fresh.vector("you idiot moron of a garden")
    monkeypatch.setattr(toxicity, "MOST_CODES", 1)
    assert [lexicon.vector(t) for t in noisy[:50]] == [toxicity.Lexicon().vector(t) for t in noisy[:50]]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "you idiot moron trash"), (3, "you idiot moron trash"), (None, "clean words here"), (4, "x " * 50_000), (5, "!!! ???")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("label", F.lit(7))
    labels = spark.createDataFrame([(3, 1), (3, 0), (1, 0), (2, 0), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    for some in (labels, labels.where("doc_id > 99"), labels.where("toxic = 1")):
        got = toxicity.score_documents(docs, some).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_documents(docs.where("doc_id > 99"), labels).collect() == []
    # without labels of both classes the fixed list decides
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(docs, labels.where("doc_id > 99")).collect() if r["doc_id"]} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0}


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0)).astype(int)
    model = Boosted(trees=60).fit(x[:1000], y[:1000])
    assert ((model.margin(x[1000:]) > 0) == y[1000:]).mean() > 0.95
    step = Isotonic().fit(np.array([1.0, 2, 3, 4]), np.array([0, 1, 0, 1]))
    assert (np.diff(step(np.linspace(0, 5, 50))) >= 0).all()
    noisy = rng.random(2000) < np.where(y == 1, 0.7, 0.2)
    p = Calibrated().fit(x, noisy.astype(int), np.arange(2000) % 2)(x)
    assert abs(p[y == 1].mean() - 0.7) < 0.08 and abs(p[y == 0].mean() - 0.2) < 0.08


def test_distinct_hits_of_a_whole_text():
    at = toxicity.FEATURES.index("distinct_hits")
    passage = "you moron loser scum"
    assert toxicity.Lexicon().vector("idiot " * 3000 + passage)[at] == toxicity.Lexicon().vector(passage + " idiot" * 3000)[at] == 4


@settings(max_examples=1000, deadline=None)
@given(st.text(alphabet="ab_.!é1-²", max_size=12))
def test_trimmed_is_what_the_expression_leaves(token):
    assert toxicity.trimmed(token) == re.sub(r"^\W+|[\W_]+$", "", token)


@pytest.mark.parametrize("token", ["a" + "." * 300_000 + "b", "_" * 300_000 + "a", "a" * 300_000, "!a" * 300_000])
def test_long_tokens_take_linear_time(token):
    start = time.process_time()
    assert len(toxicity.Lexicon().vector(token)) == len(toxicity.FEATURES) and toxicity.terms_of(token)
    assert time.process_time() - start < 5
