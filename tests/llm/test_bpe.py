import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ragcorpus.llm import _pieces, bpe
from ragcorpus.llm.queries import QUERIES, vocabulary

PATH = vocabulary("byte_bpe_multi_50k.tiktoken")
WHOLE = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_pieces.read_ranks(PATH), special_tokens={})
TEXTS = [None, "", " ", "a", "  two  spaces ", "a\n b\n\n  c", "it's we'll <|endoftext|>", "日本語 テキスト", "é" * 3000, "x" * 20_000, "w " * 9_000, "a\x1c b\x85 c  d", "tab\t word \t x", "1 22 ½ ²", "repeat", "repeat"]


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op3_bpe_round_trip"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        ids = WHOLE.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


@pytest.mark.parametrize("block", [1, 100, 12_000_000])
def test_odd_texts_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", block)
    rows = [(None if i == 3 else i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("block", F.lit("b")).coalesce(2)
    want = [(d, np.array(WHOLE.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for d, t in rows]
    key = lambda r: (str(r[0]), r[1])
    for got in (bpe.round_trip(df, PATH), bpe.decode_documents(bpe.encode_documents(df, PATH), PATH)):
        found = [(r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got.collect()]
        assert sorted(found, key=key) == sorted(want, key=key)


def test_empty_and_repeats(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    assert len(bpe.encode_documents(df, PATH).collect()) == 2
    assert bpe.encode_documents(df.where("doc_id > 3"), PATH).collect() == []
    assert bpe.round_trip(df.where("doc_id > 3"), PATH).collect() == []


def test_decoding_joins_the_token_table(spark):
    flat = lambda *ids: np.array(ids, "<u4").tobytes()
    rows = [(2**53 + 1, flat(5, 5, 300)), (None, None), (7, b""), (7, flat(49_999))]
    df = spark.createDataFrame(rows, "doc_id long, ids binary").withColumn("bytes", F.lit("x")).withColumn("id", F.lit(9)).coalesce(1)
    got = bpe.decode_documents(df, PATH)
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()
    table = {i: token for token, i in _pieces.read_ranks(PATH).items()}
    want = [(d, len(x or b"") // 4, b"".join(table[i] for i in np.frombuffer(x or b"", "<u4"))) for d, x in rows]
    assert sorted(((r["doc_id"], r["n_tokens"], bytes(r["decoded"])) for r in got.collect()), key=str) == sorted(want, key=str)
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode_documents(spark.createDataFrame([(1, flat(3, 60_000))], "doc_id long, ids binary"), PATH).collect()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \t\n\r\x0b\x1c\x85  ​'stab1½²é日.,!<|>_-")), max_size=40))
def test_pieces_keep_the_ids(text):
    found = _pieces.pieces(text)
    assert "".join(found) == text
    assert [i for p in found for i in WHOLE.encode_ordinary(p)] == WHOLE.encode_ordinary(text)
