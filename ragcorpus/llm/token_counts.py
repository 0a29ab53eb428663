"""Token counts of documents in flat token files that have no index, by a scan for separators.

A file is 16-bit big-endian ids, one document after another, each followed by the end-of-document id. Files are read
in blocks; the separators of a block are found at once, and a prefix scan over the blocks of a file stitches the
documents that reach over block boundaries. A file of ids cannot say whose they are, so the files of count_tokens begin
with a record that is no document: the doc_ids that follow, as text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragcorpus.llm import _pieces
from ragcorpus.llm._common import new_path

#: The end-of-document id: beyond the vocabulary, and as two big-endian bytes a character of UTF-8, so that Spark's
#: text writer, which ends each row with a line separator, writes flat token files.
END_OF_DOCUMENT = 0xC480
BLOCK_TOKENS = 1 << 16
#: A file is closed at so many ids or documents; one longer document is a file of its own. A task reads a file whole before
#: it is cut into blocks. The list of doc_ids is at most 21 bytes a document and so lies within the first block.
FILE_TOKENS, FILE_DOCUMENTS = 2_000_000, 2_000


def write_token_files(docs: DataFrame, path: str, ranks_path: str, text_col: str = "text", id_col: str | None = None) -> None:
    """Write the texts of docs as flat token files, which begin with a record of their doc_ids where id_col is given.

    Null and empty texts are a separator alone; no rows give no files.
    """

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, end = _pieces.cache(ranks_path, ">u2"), np.array([END_OF_DOCUMENT], ">u2").tobytes()
        held: list[bytes] = []
        names: list[str] = []
        size = 0

        def file() -> pd.DataFrame:
            listed = ",".join(names).encode()
            return pd.DataFrame({"ids": [end.join([listed + b"," * (len(listed) % 2), *held] if id_col else held)]})

        for part in parts:
            for name, text in zip(part["name"], part["text"], strict=True):
                ids = _pieces.encode_bytes(text, known)
                if held and (size + len(ids) // 2 > FILE_TOKENS or len(held) >= FILE_DOCUMENTS):
                    yield file()
                    held.clear()
                    names.clear()
                    size = 0
                held.append(ids)
                names.append(name if isinstance(name, str) else "n")
                size += len(ids) // 2
        if held:
            yield file()

    own = docs.select((F.col(id_col).cast("long").cast("string") if id_col else F.lit("")).alias("name"), F.col(text_col).alias("text"))
    # a row is all documents of a file but for the last separator, which the writer adds
    rows = own.mapInPandas(batches, "ids binary").select(F.col("ids").cast("string").alias("value"))
    rows.write.option("lineSep", chr(256)).option("maxRecordsPerFile", 1).text(path)


def read_token_blocks(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, ids): the files below path, each below 2 GB, in blocks of whole tokens."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    size = 2 * block_tokens
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size).cast("int")), lambda i: F.substring("content", i * size + 1, F.lit(size)))
    # the number of the task and the number of its file; what stands between differs from run to run
    name = F.concat_ws("-", F.regexp_extract("path", r"(part-\d+)[^/]*$", 1), F.regexp_extract("path", r"-c(\d+)(?:\.\w+)*$", 1))
    return files.where("length > 0").select(name.alias("file"), F.posexplode(blocks).alias("block", "ids"))


def scan_separators(blocks: DataFrame, end: int = END_OF_DOCUMENT) -> DataFrame:
    """(file, doc_no, start, n_tokens) of every document, from blocks(file, block, ids).

    start counts ids from the file's start, separators included; n_tokens leaves the separator out. Ids after a file's
    last separator are a document too, an unfinished one. Empty documents count 0. No blocks give no rows.
    """

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for ids in part["ids"]:
                found = np.frombuffer(ids, ">u2")
                rows.append((len(found), np.flatnonzero(found == end)))
            yield pd.DataFrame({"file": part["file"], "block": part["block"], "n": [r[0] for r in rows], "ends": [r[1] for r in rows]})

    found = blocks.select("file", "block", "ids").mapInPandas(batches, "file string, block int, n long, ends array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("file").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    at = found.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    at = at.withColumn("count", F.size("ends").cast("long")).withColumn("last", F.when(F.size("ends") > 0, F.col("first") + F.element_at("ends", -1)))
    at = at.select(
        *["file", "first", "ends", "n"],
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("end_before"),
        F.coalesce(F.sum("n").over(after), F.lit(0)).alias("n_after"),
    )
    # a file's last block ends at the file's end; it stands for a separator if it has none there
    closed = F.when((F.col("n_after") == 0) & (F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(-1)) < F.col("n") - 1), F.concat("ends", F.array(F.col("n")))).otherwise(F.col("ends"))
    at = at.withColumn("ends", closed)
    starts = F.concat(F.array(F.col("end_before") - F.col("first")), "ends")
    bounds = F.transform(F.arrays_zip(F.slice(starts, 1, F.size("ends")).alias("a"), F.col("ends").alias("b")), lambda x: F.struct((x["a"] + 1).alias("a"), x["b"].alias("b")))
    each = at.select("file", "first", "docs_before", F.posexplode(bounds).alias("i", "d"))
    return each.select("file", (F.col("docs_before") + F.col("i")).alias("doc_no"), (F.col("first") + F.col("d.a")).alias("start"), (F.col("d.b") - F.col("d.a")).alias("n_tokens"))


def count_tokens(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, file, doc_no, start, n_tokens): write docs as flat token files in the shared folder and count each
    document's tokens there. doc_no counts the documents of a file from 0, start its ids after the list of doc_ids.

    Null and empty texts count 0; a null doc_id stays null; repeated rows are documents of their own; other columns of
    docs are ignored; no rows give none.
    """
    path = new_path(docs.sparkSession)
    write_token_files(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), path, ranks_path, "text", "doc_id")
    blocks = read_token_blocks(docs.sparkSession, path)
    counted = scan_separators(blocks)
    # the list of doc_ids is the first record of a file; its length is known from the scan
    first = counted.where("doc_no = 0").select(F.col("file").alias("_file"), F.col("n_tokens").alias("_n"))
    listed = blocks.where("block = 0").join(first, F.col("file") == F.col("_file")).select("_file", "_n", F.split(F.substring("ids", F.lit(1), (2 * F.col("_n")).cast("int")).cast("string"), ",").alias("names"))
    each = listed.select("_file", "_n", F.posexplode("names").alias("_at", "name")).where("name <> ''")
    same = (F.col("file") == F.col("_file")) & (F.col("doc_no") - 1 == F.col("_at"))
    found = counted.where("doc_no > 0").join(each, same)
    return found.select(F.when(F.col("name") != "n", F.col("name")).cast("long").alias("doc_id"), "file", (F.col("doc_no") - 1).alias("doc_no"), (F.col("start") - F.col("_n") - 1).alias("start"), "n_tokens")
