from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragcorpus.llm import _pieces, token_counts
from ragcorpus.llm.queries import QUERIES, vocabulary

PATH = vocabulary("byte_bpe_50k.tiktoken")


def test_query(spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = QUERIES["op8_token_counts"](spark, sf_dir).collect()
    encode = _pieces.encoding(PATH).encode_ordinary
    assert Counter(r["n_tokens"] for r in rows) == Counter(len(encode(t)) for t in texts)
    known = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {d: len(encode(t)) for d, t in known.items()}
    by_file = {}
    for r in sorted(rows, key=lambda r: (r["file"], r["doc_no"])):
        at, number = by_file.get(r["file"], (0, 0))
        assert (r["start"], r["doc_no"]) == (at, number)
        by_file[r["file"]] = (at + r["n_tokens"] + 1, number + 1)


@pytest.mark.parametrize("size", [1, 2, 3, 64])
def test_blocks_are_stitched(spark, size):
    end = token_counts.END_OF_DOCUMENT
    files = {"a": [1, 2, end, end, 3, 4, 5, 6, 7, end], "b": [end, 9, 9, 9], "c": [5], "d": [end]}
    rows = []
    for name, ids in files.items():
        rows += [(name, i // size, np.array(ids[i : i + size], ">u2").tobytes()) for i in range(0, len(ids), size)]
    got = sorted(tuple(r) for r in token_counts.scan_separators(spark.createDataFrame(rows, "file string, block int, ids binary").repartition(3)).collect())
    assert got == [("a", 0, 0, 2), ("a", 1, 3, 0), ("a", 2, 4, 5), ("b", 0, 0, 0), ("b", 1, 1, 3), ("c", 0, 0, 1), ("d", 0, 0, 0)]


def test_round_trip_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "FILE_DOCUMENTS", 3)
    texts = [None, "", "a", "Ā", "x" * 9000, "a  b\n", "a  b\n", "é 日本 "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(0)).coalesce(1)
    encode = _pieces.encoding(PATH).encode_ordinary
    got = sorted((r["file"], r["doc_no"], r["n_tokens"]) for r in token_counts.count_tokens(df, PATH).collect())
    assert [g[2] for g in got] == [len(encode(t or "")) for t in texts] and len({g[0] for g in got}) == 3
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, PATH).collect()} == {i: len(encode(t or "")) for i, t in enumerate(texts)}
    assert token_counts.count_tokens(df.where("doc_id > 99"), PATH).collect() == []


def test_files_are_bounded_by_tokens(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "FILE_TOKENS", 20)
    texts = ["w " * 5, "w " * 100, "", "x", "w " * 9, "w " * 9]
    encode = _pieces.encoding(PATH).encode_ordinary
    rows = [(None if i == 3 else i - 2, t) for i, t in enumerate(texts)]
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(d), len(encode(t))) for d, t in rows)
    sums = Counter()
    for r in got:
        sums[r["file"]] += r["n_tokens"]
    assert len(sums) >= 4 and sum(n > 20 for n in sums.values()) == 1


def test_whatever_the_names_of_the_files(spark, tmp_path):
    """The parts of the writer's file names that look like a file's number are not taken for it."""
    ids = np.array([1, token_counts.END_OF_DOCUMENT], ">u2").tobytes()
    for i in range(3):
        (tmp_path / f"part-00000-c1234567-c123-4abc-89ab-c12345678901-c{i:03d}.txt").write_bytes(ids)
    assert sorted(r["file"] for r in token_counts.read_token_blocks(spark, str(tmp_path)).collect()) == [f"part-00000-{i:03d}" for i in range(3)]
