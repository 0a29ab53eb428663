"""Ranked lexical search by bit-sliced Bloom signatures.

The index is a table of blocks: up to 1,024 texts of nearly equal numbers of keys. A text's keys are its terms, and each
term again for every level that its occurrences reach. A block's signature is a matrix of bits whose rows are hash values
and whose columns are texts: a key sets its text's bit in three rows. The three rows of a key, and-ed, are the texts that
may have it, and some that have not. So the weights of a query's terms, summed over these bitmaps level by level, are upper
bounds of all the block's scores at once; texts whose bound is below a score that k texts are known to reach are excluded,
and all others are scored exactly from the block's list of terms and occurrences.

A score is the sum over the query's distinct terms of w * ((1000000000 * tf) div (1000 * tf + 20 * m)), where w is
floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and m is 100 - 50 + ((50 * n * N) div L). It grows with tf, so the level
below which a term's occurrences are shown to stay bounds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragcorpus.llm._common import save
from ragcorpus.llm._words import binaries, bytes_of, cut_batches, gaps, packed, ranges, split_words, summed, unpacked

#: Bytes of text whose words are counted at once, and most texts of a block.
PIECE_BYTES, BLOCK_TEXTS = 8 << 20, 1024
#: Occurrences at which a term has another key, rows of a signature for each key, and rows that a key sets.
LEVELS, ROWS_PER_KEY, PROBES = (1, 2, 3, 4, 6, 9, 14, 24, 48, 128), 8, 3
#: Distinct (item, term) pairs that go to every task at once; more are ranked in so many passes over the index.
BROADCAST_TERMS = 500_000
_LEAST = -(1 << 63)
INDEX_SCHEMA = "rows int, n_texts long, n_words long, terms array<string>, dfs array<int>, signature binary, doc_ids array<bigint>, lengths array<bigint>, codes array<binary>, counts array<binary>"


def _mixed(h: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit numbers of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashes(terms: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in terms), np.uint64, len(terms))


def _rows(hashes: np.ndarray, level: int, rows: int) -> list[np.ndarray]:
    """The rows of a signature that the keys (term, level) set."""
    h = _mixed(hashes + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
    return [((h >> np.uint64(21 * i)) & np.uint64((1 << 21) - 1)) * np.uint64(rows) >> np.uint64(21) for i in range(PROBES)]


def build_index(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The blocks of docs as a table of INDEX_SCHEMA, written to path or a scratch table. The texts are not shuffled.

    doc_ids may be null or repeat: every row is a text of its own. Texts without words, null ones too, are left out, as
    nothing finds or counts them. Other columns are ignored; no rows give none.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in cut_batches(batches, "text", PIECE_BYTES):
            codes, terms, n = split_words(part.column("text"))
            if not len(codes):
                continue
            pairs, tf = np.unique(np.repeat(np.arange(len(n)), n) << 32 | codes, return_counts=True)
            text, code = pairs >> 32, pairs & 0xFFFFFFFF
            level = np.searchsorted(LEVELS, tf, side="right")
            keys = np.bincount(text, level, len(n)).astype(np.int64)
            size = np.frexp(keys)[1]  # keys < 2 ** size
            hashes = _hashes(terms.to_pylist())
            start = np.searchsorted(text, np.arange(len(n) + 1))
            for s in np.unique(size[n > 0]):
                members = np.flatnonzero((size == s) & (n > 0))
                for at in range(0, len(members), BLOCK_TEXTS):
                    own = members[at : at + BLOCK_TEXTS]
                    yield _block(own, int(s), part.column("doc_id").take(pa.array(own)), n[own], start, code, tf, level, terms, hashes)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return save(own.mapInArrow(blocks, INDEX_SCHEMA), path)


def _block(own, size, doc_ids, lengths, start, code, tf, level, terms, hashes) -> pa.RecordBatch:
    sizes = start[own + 1] - start[own]
    picked = ranges(start[own], sizes)
    known, local, df = np.unique(code[picked], return_inverse=True, return_counts=True)
    tf, level, column = tf[picked], level[picked], np.repeat(np.arange(len(own)), sizes)
    rows = ROWS_PER_KEY << size
    bits = np.zeros((rows, len(own)), bool)
    for k in range(int(level.max())):
        have = level > k
        for row in _rows(hashes[known[local[have]]], k, rows):
            bits[row.astype(np.int64), column[have]] = True
    at = np.concatenate(([0], np.cumsum(sizes)))
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([rows], pa.int32()),
            pa.array([len(own)], pa.int64()),
            pa.array([int(lengths.sum())], pa.int64()),
            one(terms.take(pa.array(known)).cast(pa.string())),
            one(pa.array(df, pa.int32())),
            pa.array([np.packbits(bits, axis=1).tobytes()], pa.binary()),
            one(doc_ids),
            one(pa.array(lengths, pa.int64())),
            one(binaries(*packed(gaps(local, at), at))),
            one(binaries(*packed(tf, at))),
        ],
        names=["rows", "n_texts", "n_words", "terms", "dfs", "signature", "doc_ids", "lengths", "codes", "counts"],
    )


@dataclass
class Items:
    """Items' terms: numbers into terms, one item's after another's from starts[i], each with its term's weight."""

    ids: list
    terms: pa.Array
    hashes: np.ndarray
    starts: np.ndarray
    which: np.ndarray
    weights: np.ndarray  # of each term
    n_texts: int
    n_words: int

    def own(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        which = self.which[self.starts[i] : self.starts[i + 1]]
        return which, self.weights[which]


class Block:
    """One row of the index while items are looked up in it."""

    def __init__(self, row: dict, items: Items):
        self.row, self.items = row, items
        self.doc_ids = np.array([_LEAST if d is None else d for d in row["doc_ids"].as_py()], np.int64)
        self.lengths = row["lengths"].values.to_numpy(zero_copy_only=False)
        self.m = 100 - 50 + (50 * self.lengths * items.n_texts) // max(1, items.n_words)

    def part(self, tf: np.ndarray | int, m: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * tf) // (1000 * tf + 20 * m)

    def bounds(self) -> np.ndarray:
        """Upper bounds of the scores of all texts of the block, a row for each item."""
        items, texts, rows = self.items, len(self.lengths), self.row["rows"].as_py()
        bits = np.frombuffer(self.row["signature"].as_buffer(), np.uint8).reshape(rows, -1)
        out = np.zeros((len(items.ids), texts), np.int64)
        alive, before = np.arange(len(items.hashes)), np.zeros(texts, np.int64)
        place = np.full(len(items.hashes), -1)
        for k in range(len(LEVELS)):
            probes = [r.astype(np.int64) for r in _rows(items.hashes[alive], k, rows)]
            found = bits[probes[0]]
            for r in probes[1:]:
                found = found & bits[r]
            some = found.any(axis=1)
            alive, found = alive[some], np.unpackbits(found[some], axis=1, count=texts)
            if not len(alive):
                break
            # a text that is not shown to have more occurrences has fewer than the next level, or as many as words
            most = self.part(np.minimum(LEVELS[k + 1] - 1, self.lengths) if k + 1 < len(LEVELS) else self.lengths, self.m)
            step, before = most - before, most
            place[:] = -1
            place[alive] = np.arange(len(alive))
            for i in range(len(items.ids)):
                which, w = items.own(i)
                at = place[which]
                have = at >= 0
                if have.any():
                    out[i] += (w[have].astype(np.float64) @ found[at[have]]).astype(np.int64) * step
        return out

    def counts(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of the terms that the block has in the texts, a row for each term, and the rows' numbers by term."""
        known = pc.index_in(self.row["terms"].values, self.items.terms).to_numpy(zero_copy_only=False)
        known = np.where(np.isnan(known), -1, known).astype(np.int64)
        place = np.full(len(self.items.hashes), -1)
        place[known[known >= 0]] = np.arange((known >= 0).sum())
        pick = pa.array(texts)
        data, at = bytes_of(self.row["codes"].values.take(pick))
        deltas, last = unpacked(data)
        start = np.searchsorted(last, at)
        local = summed(deltas, start)
        tf = unpacked(bytes_of(self.row["counts"].values.take(pick))[0])[0]
        row = np.where(known[local] >= 0, place[known[local]], -1)
        out = np.zeros(((known >= 0).sum(), len(texts)), np.int64)
        out[row[row >= 0], np.repeat(np.arange(len(texts)), np.diff(start))[row >= 0]] = tf[row >= 0]
        return out, place

    def best(self, wanted: list[np.ndarray], floors: np.ndarray, k: int) -> Iterator[tuple]:
        """(item, doc_id, score) of at most k best texts of each item among the wanted ones, scored exactly, at the floor or above."""
        texts = np.unique(np.concatenate(wanted)) if wanted else np.empty(0, np.int64)
        if not len(texts):
            return
        tf, place = self.counts(texts)
        for i, own in enumerate(wanted):
            if not len(own):
                continue
            which, w = self.items.own(i)
            at = place[which]
            column = np.searchsorted(texts, own)
            scores = (w[at >= 0][:, None] * self.part(tf[at[at >= 0]][:, column], self.m[own])).sum(axis=0)
            stay = np.flatnonzero(scores >= max(1, floors[i]))
            for j in stay[np.lexsort((self.doc_ids[own][stay], -scores[stay]))[:k]].tolist():
                yield i, int(self.doc_ids[own[j]]), int(scores[j])


def _scored(index: DataFrame, sent, floors: np.ndarray, k: int, first: int | None) -> DataFrame:
    """(item, doc_id, score): of each block the k best texts whose bound reaches the floor, or the best of `first` with the highest bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        for batch in batches:
            for j in range(batch.num_rows):
                block = Block({name: batch.column(name)[j] for name in batch.schema.names}, items)
                bounds = block.bounds()
                if first:
                    order = np.argsort(-bounds, axis=1, kind="stable")[:, :first]
                    wanted = [own[bounds[i, own] > 0] for i, own in enumerate(order)]
                else:
                    wanted = [np.flatnonzero(b >= max(1, floors[i])) for i, b in enumerate(bounds)]
                found = [*block.best([np.sort(w) for w in wanted], floors, k)]
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    columns = ("rows", "terms", "signature", "doc_ids", "lengths", "codes", "counts")
    return index.select(*columns).mapInArrow(run, "item int, doc_id long, score long")


def _document_frequencies(index: DataFrame, terms: list[str]) -> np.ndarray:
    """In how many texts each term is. Blocks count before anything is shuffled."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = pa.array(sent.value, pa.string()), np.zeros(len(sent.value), np.int64)
        for batch in batches:
            at = pc.index_in(batch.column("terms").flatten(), wanted)
            have = at.is_valid()
            np.add.at(total, at.filter(have).to_numpy(), batch.column("dfs").flatten().filter(have).to_numpy())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["term", "df"])

    found = index.select("terms", "dfs").mapInArrow(counted, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # a row a term of the queries
    out = np.zeros(len(terms), np.int64)
    for r in found:
        out[r["term"]] = r["df"]
    return out


def search(index: DataFrame, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k texts of the index with the highest scores above 0 for each item.

    Equal scores rank by ascending doc_id, a null one first; a text that stands in several rows is ranked as often. The
    texts of a repeated item_id are one item, null being an id like any other. Items without words, or whose terms are
    in no text or all weigh nothing, have no rows; nor has an empty index.

    A first pass scores the texts with the highest bounds of each block and gives each item a floor, which k texts
    reach; the second scores every text whose bound reaches the floor. Blocks send at most k rows an item, and only floors
    come to the driver.
    """
    spark = index.sparkSession
    whole = index.agg(F.sum("n_texts").alias("n"), F.sum("n_words").alias("l"), F.count("*").alias("blocks")).first()
    own = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).distinct()
    size = own.agg(F.sum(F.octet_length(F.coalesce(F.col("text"), F.lit("")))) / 5).first()[0] or 0
    slices = max(1, -(-int(size) // BROADCAST_TERMS))
    part = F.pmod(F.xxhash64("item_id"), F.lit(slices))
    found = None
    for s in range(slices):
        ranked = _ranked(index, _items(own.where(part == s).collect(), index, whole), whole, k) if whole["blocks"] else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        found = ranked if found is None else found.unionByName(ranked)
    return found


def _items(rows: list, index: DataFrame, whole) -> Items:
    codes, terms, counts = split_words(pa.array([r["text"] for r in rows], pa.string()))
    ids = [*dict.fromkeys(r["item_id"] for r in rows)]
    place = {v: i for i, v in enumerate(ids)}
    item = np.repeat(np.array([place[r["item_id"]] for r in rows], np.int64), counts)
    pairs = np.unique(item << 32 | codes)
    names = terms.to_pylist()
    df = _document_frequencies(index, names)
    weights = np.floor(1000 * np.log((2 * whole["n"] + 2) / (2 * df + 1))).astype(np.int64)
    return Items(ids, terms.cast(pa.string()), _hashes(names), np.searchsorted(pairs >> 32, np.arange(len(ids) + 1)), pairs & 0xFFFFFFFF, weights, whole["n"], whole["l"])


def _ranked(index: DataFrame, items: Items, whole, k: int) -> DataFrame:
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast(items)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    first = _scored(index, sent, np.zeros(len(items.ids), np.int64), k, max(2, -(-2 * k // whole["blocks"])))
    reached = first.withColumn("at", F.row_number().over(best)).where(F.col("at") == k).select("item", "score").collect()  # a row an item
    floors = np.zeros(len(items.ids), np.int64)
    for r in reached:
        floors[r["item"]] = r["score"]
    scored = _scored(index, sent, floors, k, None)
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(items.ids)), "item int, item_id long")
    doc_id = F.when(F.col("doc_id") != _LEAST, F.col("doc_id"))
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", doc_id.alias("doc_id"), "score")  # bounded by BROADCAST_TERMS


def search_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """search() over an index of docs(doc_id, text), written as a scratch table."""
    return search(build_index(docs), items, k)
