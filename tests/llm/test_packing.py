import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ragcorpus.llm import packing
from ragcorpus.llm.queries import QUERIES, vocabulary

RANKS = "byte_bpe_50k.tiktoken"


def library_ids(texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [0] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_pieces(rows, docs, capacity=2048):
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for (doc_id, _), ids in zip(docs, library_ids([t for _, t in docs]), strict=True):
        at = 0
        for i, r in enumerate(sorted(by_doc[doc_id], key=lambda r: r["piece"])):
            own = ids[at : at + r["length"]]
            assert (r["piece"], r["start"], len(own)) == (i, at, r["length"])
            assert i == 0 or r["length"] == capacity
            assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids) and (len(ids) > capacity or len(by_doc[doc_id]) == 1)


def check_sequences(rows, capacity=2048):
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_seq)


def test_query_against_the_tokenizers_library(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op7_best_fit_packing"](spark, sf_dir).collect()
    check_pieces(rows, docs)
    used = check_sequences(rows)
    assert used <= 1.02 * sum(r["length"] for r in rows) / 2048 + 2


def test_odd_texts(spark):
    texts = [None, "", " ", "  a", "a  b", "a \n b\t c", "it's <|endoftext|> x", "é ü   x", "日本 語", "x" * 30_000, "word " * 5_000, "a\x1c b\x85 c", "᠎ x ​"]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("rank", F.lit(0))
    rows = packing.pack_documents(df, vocabulary(RANKS)).collect()
    check_pieces(rows, docs)
    check_sequences(rows)


def test_added_tokens_have_their_ids(spark):
    end = "<|endoftext|>"
    texts = ["it's <|endoftext|> x", end, end * 3, f"a{end}", f"  {end}  b", f"<|{end}|> <|endoftext", f"x {end}\n{end} é" * 900, "<|ENDOFTEXT|>"]
    docs = list(enumerate(texts))
    rows = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), vocabulary(RANKS)).collect()
    assert library_ids(texts)[0] == [270, 338, 220, 50256, 2124, 0]
    check_pieces(rows, docs)
    check_sequences(rows)


def test_repeats_null_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    rows = packing.pack_documents(df, vocabulary(RANKS)).collect()
    assert sorted((r["doc_id"] is None, r["length"]) for r in rows) == [(False, 3), (False, 3), (True, 1), (True, 2)]
    assert check_sequences(rows) == 1
    assert packing.pack_documents(df.where("doc_id > 9"), vocabulary(RANKS)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), max_size=25), st.sampled_from([60, 64, 97]))
def test_plan_places_every_piece_once(counts, capacity):
    runs, sequences = packing.plan_runs(counts, capacity)
    places = defaultdict(list)
    ranks = defaultdict(list)
    for length, rank, n, first, offset in runs:
        ranks[length] += range(rank, rank + n)
        for s in range(first, first + n):
            places[s].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    assert set(places) == set(range(sequences))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    big = [k for k, n in counts.items() for _ in range(n)]
    # first-fit decreasing needs at most 11/9 of the least number; no worse than that here
    free = []
    for length in sorted(big, reverse=True):
        at = next((i for i, gap in enumerate(free) if gap >= length), None)
        if at is None:
            free.append(capacity - length)
        else:
            free[at] -= length
    assert sequences <= len(free) * 1.1 + 1


@pytest.mark.parametrize("counts, want", [({1024: 1, 1000: 1, 900: 1, 800: 1}, 2), ({1024: 3, 1000: 1}, 2), ({1000: 5, 700: 3, 690: 1}, 5), ({1024: 1}, 1), (dict.fromkeys(range(683, 1025), 1), 171)])
def test_odd_large_pieces_pair(counts, want):
    assert packing.plan_runs(counts, 2048)[1] == want


@pytest.mark.parametrize("n", [1, 2047, 2048, 2049, 4096, 5000])
def test_cuts(n):
    found = packing.cut_pieces(b"abcd" * n, 2048)
    assert sum(p[2] for p in found) == n and all(p[2] == 2048 for p in found[1:])
    assert [p[1] for p in found] == list(np.cumsum([0, *[p[2] for p in found[:-1]]]))
