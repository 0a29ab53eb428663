"""Best-fit packing of token pieces into sequences by large-item matching.

Only the counts of the at most `capacity` piece lengths decide the packing, so the plan is made on the driver from
a table whose size does not grow with the corpus, as runs: "the next n pieces of length l go into sequences
s .. s+n-1 at offset o". Pieces above one third of the capacity pair at most twice in a sequence: the longest is
matched with the longest that still fits. Smaller pieces follow, longest first, into the smallest gap that holds them.
Tasks then number the pieces of each length and look their run up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragcorpus.llm import _pieces
from ragcorpus.llm._common import numbered, save



def plan_runs(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, n, first sequence, offset) for pieces of 1 .. capacity, and how many sequences."""
    left = {k: n for k, n in counts.items() if n > 0}
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, how many)
    open_gaps = 0  # bit g is set if some sequence has the gap g
    sequences = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, rank[length], n, first, offset))
        rank[length] += n
        left[length] -= n

    def leave(gap: int, first: int, n: int) -> None:
        nonlocal open_gaps
        if gap:
            gaps.setdefault(gap, []).append((first, n))
            open_gaps |= 1 << gap

    # In ascending order, as bits, so that the longest one that fits is found at once.
    large = sum(1 << k for k in left if 3 * k > capacity)
    while large:
        a = large.bit_length() - 1
        fits = large & ((1 << (capacity - a + 1)) - 1)
        if left[a] == 1:  # it does not pair with itself
            fits &= ~(1 << a)
        b = fits.bit_length() - 1
        n = left[a] if not fits else left[a] // 2 if a == b else min(left[a], left[b])
        if fits and n:
            put(a, n, sequences, 0)
            put(b, n, sequences, a)
            leave(capacity - a - b, sequences, n)
        else:  # nothing fits beside it, or one is over
            n = left[a]
            put(a, n, sequences, 0)
            leave(capacity - a, sequences, n)
        sequences += n
        for k in {a, b} if fits else {a}:
            if not left[k]:
                large &= ~(1 << k)
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            holding = open_gaps >> length
            if holding:
                gap = length + (holding & -holding).bit_length() - 1
                first, n = gaps[gap].pop()
                take = min(n, left[length])
                if take < n:
                    gaps[gap].append((first + take, n - take))
                if not gaps[gap]:
                    open_gaps &= ~(1 << gap)
                put(length, take, first, capacity - gap)
                leave(gap - length, first, take)
            else:  # new sequences, filled with pieces of this length
                per = capacity // length
                n, each = (left[length] // per, per) if left[length] >= per else (1, left[length])
                for k in range(each):
                    put(length, n, sequences, k * length)
                leave(capacity - each * length, sequences, n)
                sequences += n
    return runs, sequences


def cut_pieces(ids: bytes, capacity: int, width: int = 4) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids; all pieces but the first have the full capacity."""
    n = len(ids) // width
    first = (n - 1) % capacity + 1
    bounds = [0, *range(first, n + 1, capacity)]
    return [(i, a, b - a, zlib.crc32(ids[a * width : b * width])) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]


def token_pieces(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, separator: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each text and the separator, cut into pieces.

    The ids are those of the tokenizer file beside the rank file: its added tokens have their ids in texts too.
    Null and empty texts are one piece, the separator. Repeated rows repeat, and no rows give none.
    """

    @F.pandas_udf("array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    def pieces(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, added = _pieces.cache(ranks_path, "<u4"), _pieces.added_tokens(ranks_path)
        end = np.array([separator], "<u4").tobytes()
        names = ("piece", "start", "length", "ids_crc32")
        for part in parts:
            found = ([dict(zip(names, p, strict=True)) for p in cut_pieces(_pieces.encode_with_added(t, known, added) + end, capacity)] for t in part)
            yield pd.Series(list(found), dtype=object)

    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(pieces(F.col(text_col))).alias("p"))
    return cut.select("doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32")


def pack_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Lengths lie between 1 and the capacity. Repeated rows are packed each on its own; an empty table gives none.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs, _ = plan_runs(counts, capacity)
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    most = int(max(counts.values(), default=0)) + 1
    keys = table[:, 0] * most + table[:, 1]

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for lengths, ranks in parts:
            rank = ranks.to_numpy()
            run = np.searchsorted(keys, lengths.to_numpy() * most + rank, "right") - 1
            yield pd.DataFrame({"sequence_id": table[run, 3] + rank - table[run, 1], "offset": table[run, 4]})

    ranked = numbered(pieces, "length", [F.col("doc_id"), F.col("piece"), F.col("start")], "rank")
    placed = ranked.withColumn("at", place("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def pack_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, separator: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the separator alone. A null doc_id stays null. Rows that repeat, equal texts and
    equal lengths are packed each on their own, in no defined order among themselves; other columns of docs are
    ignored; no rows give none.
    """
    return pack_pieces(save(token_pieces(docs, ranks_path, id_col, text_col, capacity, separator)), capacity)
