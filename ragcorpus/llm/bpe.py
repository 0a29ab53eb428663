"""Byte-level BPE encoding by a global shuffle of distinct words, and decoding by a join with the token-byte table.

A word here is what stands between two single spaces, its space in front: one or a few whole matches of the
vocabulary's pattern. Documents of a task are gathered into blocks; a block's texts become positions in the list of its
distinct words. Words are dealt over buckets by their hash, all of one block and bucket as one row; where a bucket's rows
meet, each distinct word of the corpus is encoded once, whatever the number of blocks it occurs in. The ids go back to
the blocks, which put their documents together by position. Words and positions are made by two scans of docs; a
checksum of each block's words goes both ways, and a block that differs between the scans stops the job.

Decoding joins the distinct ids of each block of documents with the table of (id, bytes), which is broadcast, as it has
one row a token of the vocabulary; the documents of a block follow from the bytes of its ids. Nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from ragcorpus.llm import _pieces

#: A block is closed at so many characters; one longer document is a block of its own.
BLOCK_CHARS = 6_000_000
#: Characters of text for each bucket of words; a bucket's rows stream through their task, which keeps the bucket's
#: distinct words only, so MOST_BUCKETS bounds the rows that a block sends, not what a task holds.
BUCKET_CHARS, MOST_BUCKETS = 16_000_000, 16_384
#: Characters of text for each task that puts blocks together again.
GROUP_CHARS = 64_000_000
#: The token-byte table is broadcast, so larger vocabularies are refused.
MOST_TOKENS = 2_000_000
_ENCODED = "block long, parts long, doc_id string, n_tokens long, ids binary, distinct array<int>"


def _blocks(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[str], list[tuple]]]:
    """(block, distinct words by first occurrence, [(doc_id, positions)])."""
    context = TaskContext.get()
    base, seq = (context.partitionId() if context else 0) << 20, 0
    words: dict[str, int] = {}
    docs: list[tuple] = []
    chars = 0
    for part in parts:
        for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
            size = len(text) if text else 0
            if docs and chars + size > BLOCK_CHARS:
                yield base + seq, list(words), docs
                words, docs, chars, seq = {}, [], 0, seq + 1
            at = words.setdefault
            docs.append((doc_id, np.array([at(w, len(words)) for w in (_pieces.pieces(text) if text else ())], np.uint32)))
            chars += size
    if docs:
        yield base + seq, list(words), docs


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers as their bytes by place, packed."""
    return zlib.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _spread(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _buckets(words: list[str], n: int) -> tuple[np.ndarray, int]:
    """Each word's bucket, and a checksum of the words in their order."""
    hashes = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint32, len(words))
    return hashes % np.uint32(n), zlib.crc32(hashes.tobytes())


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) for each row of docs; ids are little-endian unsigned 32-bit integers, one after another.

    The ids are those of encoding every match of the pattern by itself, without special tokens. Null and empty
    texts have no ids. A null doc_id stays null, repeated rows repeat, other columns are ignored, no rows give none.
    docs must read the same rows in the same partitions each time, as files and written tables do.
    """
    whole = _encoded(docs, ranks_path, id_col, text_col)
    return whole.select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", "ids")


def round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): encode_documents, and the bytes of its ids by the token-byte table.

    Null and empty texts give no bytes (empty, not null); ids, repeats and no rows as in encode_documents.
    """
    own = _joined(_encoded(docs, ranks_path, id_col, text_col), ranks_path)
    return own.select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", "ids", "decoded")


def _encoded(docs: DataFrame, ranks_path: str, id_col: str, text_col: str) -> DataFrame:
    # as text, since pandas would make floats of nullable longs
    own = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    chars = own.agg(F.sum(F.char_length("text"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = max(4 * least, min(MOST_BUCKETS, chars // BUCKET_CHARS))
    n_groups = max(least, chars // GROUP_CHARS)
    n_ids = max(_pieces.read_ranks(ranks_path).values()) + 1
    kind = "<u2" if n_ids <= 1 << 16 else "<u4"

    def words_of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, words, _ in _blocks(parts):
            bucket, check = _buckets(words, n_buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            rows = []
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                some = [words[i] for i in order[cuts[k] : cuts[k + 1]].tolist()]
                rows.append((k, block, check, zlib.compress("".join(some).encode("utf-8", "surrogatepass"), 4), _squeezed(np.fromiter(map(len, some), np.uint32, len(some)))))
            yield pd.DataFrame(rows, columns=["bucket", "block", "check", "chars", "lengths"])

    def positions_of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, words, rows in _blocks(parts):
            bucket, check = _buckets(words, n_buckets)
            for at in range(0, len(rows), 2_000):
                some = rows[at : at + 2_000]
                head = [_squeezed(bucket) if at + i == 0 else None for i in range(len(some))]
                ids = pd.Series([d for d, _ in some], dtype=object)
                yield pd.DataFrame({"block": block, "check": check, "doc_id": ids, "places": [_squeezed(p) for _, p in some], "buckets": head})

    def encode_once(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _pieces.encoding(ranks_path).encode_ordinary
        last, known = None, {}
        for part in parts:
            rows = []
            for bucket, block, check, chars, lengths in part.itertuples(index=False):
                if bucket != last:
                    last, known = bucket, {}
                text = zlib.decompress(chars).decode("utf-8", "surrogatepass")
                ends = np.cumsum(_spread(lengths)).tolist()
                found = []
                for a, b in zip([0, *ends], ends, strict=False):
                    word = text[a:b]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.array(encode(word), kind).tobytes()
                    found.append(ids)
                sizes = np.fromiter(map(len, found), np.uint32, len(found))
                rows.append((block, bucket, check, _squeezed(sizes), zlib.compress(b"".join(found), 1)))
            yield pd.DataFrame(rows, columns=["block", "bucket", "check", "sizes", "ids"])

    def assemble(key: tuple, rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            raise RuntimeError("a block's documents are missing")
        bucket = _spread(next(b for b in rows["buckets"] if b is not None))
        words = np.empty(len(bucket), object)
        at, order = 0, np.argsort(bucket, kind="stable")
        for sizes, ids, check in found.sort_values("bucket")[["sizes", "ids", "check"]].itertuples(index=False):
            if check != rows["check"].iloc[0]:
                raise RuntimeError("documents came in other blocks when they were read again; write them to a table first")
            ends = np.cumsum(_spread(sizes)).tolist()
            ids = zlib.decompress(ids)
            own = order[at : at + len(ends)].tolist()
            at += len(ends)
            for i, a, b in zip(own, [0, *ends], ends, strict=False):
                words[i] = ids[a:b]
        if at != len(bucket):
            raise RuntimeError("words of a block are missing")
        listed = words.tolist()
        out = [np.frombuffer(b"".join(map(listed.__getitem__, _spread(p).tolist())), kind).astype("<u4") for p in rows["places"]]
        seen = np.zeros(n_ids, bool)
        for x in out:
            seen[x] = True
        return _block_rows(int(key[0]), rows["doc_id"].to_numpy(object), [x.tobytes() for x in out], np.flatnonzero(seen))

    dealt = own.mapInPandas(words_of, "bucket int, block long, check long, chars binary, lengths binary").repartition(n_buckets, "bucket").sortWithinPartitions("bucket")
    encoded = dealt.mapInPandas(encode_once, "block long, bucket int, check long, sizes binary, ids binary")
    positions = own.mapInPandas(positions_of, "block long, check long, doc_id string, places binary, buckets binary")
    left, right = positions.repartition(n_groups, "block"), encoded.repartition(n_groups, "block")
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(assemble, _ENCODED)


def _block_rows(block: int, doc_ids: np.ndarray, ids: list[bytes], distinct: np.ndarray) -> pd.DataFrame:
    """The documents of a block, the first with the block's distinct ids; parts counts both."""
    head = [distinct.astype(np.int32) if i == 0 else None for i in range(len(ids))]
    return pd.DataFrame({"block": block, "parts": len(ids) + len(distinct), "doc_id": doc_ids, "n_tokens": [len(x) // 4 for x in ids], "ids": ids, "distinct": head})


def token_table(spark: SparkSession, ranks_path: str) -> DataFrame:
    """(id, bytes) of each token of the vocabulary."""
    ranks = _pieces.read_ranks(ranks_path)
    if len(ranks) > MOST_TOKENS:
        raise ValueError(f"a vocabulary of {len(ranks)} tokens is not broadcast")
    return spark.createDataFrame(pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array(list(ranks), pa.binary())}))


def decode_documents(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for each row of encoded; ids as encode_documents gives them, decoded their bytes.

    Null ids are taken as none. A null doc_id stays null, repeated rows repeat, other columns are ignored, no rows give
    none. An id outside of the vocabulary stops the job.
    """

    def blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, part in enumerate(p for p in parts if len(p)):
            ids = [x or b"" for x in part["ids"]]
            distinct = np.unique(np.frombuffer(b"".join(ids), "<u4"))
            if len(distinct) and distinct[-1] >= 1 << 31:
                raise ValueError(f"id {distinct[-1]} is not in the vocabulary")
            yield _block_rows(block, part["doc_id"].to_numpy(object), ids, distinct)

    own = encoded.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(ids_col).alias("ids"))
    joined = _joined(own.mapInPandas(blocks, _ENCODED), ranks_path)
    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", "ids", "decoded")


def _joined(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the ids of each block find their bytes in the token-byte table.

    A block's documents and ids become rows of one partition; the join keeps them there, and a block is put together
    when all its parts have come, in whatever order.
    """

    def whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, tuple[list, dict[int, bytes]]] = {}
        for part in parts:
            for block, rows in part.groupby("block", sort=False):
                docs, table = waiting.setdefault(int(block), ([], {}))
                of_ids = rows["id"] >= 0
                found = rows[of_ids]
                if found["bytes"].isna().any():
                    raise ValueError(f"id {found['id'][found['bytes'].isna()].iloc[0]} is not in the vocabulary")
                table.update(zip(found["id"].tolist(), found["bytes"], strict=True))
                docs.append(rows.loc[~of_ids, ["doc_id", "ids"]])
                if sum(map(len, docs)) + len(table) == rows["parts"].iloc[0]:
                    del waiting[int(block)]
                    own = pd.concat(docs)
                    ids = own["ids"].tolist()
                    back = [b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in ids]
                    yield pd.DataFrame({"doc_id": own["doc_id"].to_numpy(object), "n_tokens": [len(x) // 4 for x in ids], "ids": ids, "decoded": back})
        if waiting:
            raise RuntimeError("parts of a block are missing")

    none = F.lit(None)
    doc = F.struct(F.lit(-1).alias("id"), "doc_id", "ids")
    of_id = lambda i: F.struct(i.alias("id"), none.cast("string").alias("doc_id"), none.cast("binary").alias("ids"))
    every = F.concat(F.array(doc), F.transform(F.coalesce("distinct", F.array().cast("array<int>")), of_id))
    rows = encoded.select("block", "parts", F.inline(every))
    table = F.broadcast(token_table(encoded.sparkSession, ranks_path))  # one row a token
    return rows.join(table, "id", "left").mapInPandas(whole, "doc_id string, n_tokens long, ids binary, decoded binary")
