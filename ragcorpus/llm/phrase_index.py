"""A positional inverted index of training texts: exact phrases, proximity matches, and words shared with a benchmark.

The index is a table of postings (segment, term, n, places). A segment is the texts of about eight megabytes, whose
words are numbered one after another with one number left out between texts, so that no phrase reaches over two texts.
A term's places are the ascending numbers of its words, as packed gaps. The row of a segment whose term is null has the
first place of each text, the place after the last, and the doc_ids. Every word of every text is posted, and no list is
longer than its segment, so a word that is everywhere is no hot key.

A phrase is looked up in each segment from its rarest term there: the term's places, less the term's offset in the
phrase, are where the phrase may begin, and each further term, by ascending number of places, keeps those that stand in its
own list at its own offset.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragcorpus.llm._common import save
from ragcorpus.llm._words import binaries, bytes_of, cut_batches, gaps, packed, ranges, split_words, summed, unpacked

#: Bytes of text of one segment; a longer text is a segment of its own.
SEGMENT_BYTES = 8 << 20
#: Bytes of test texts whose windows go to every task at once; more are looked up in so many passes over the index.
BROADCAST_BYTES = 16 << 20
#: Places that one step of a look-up compares at once.
STEP_PLACES = 2_000_000
INDEX_SCHEMA = "segment long, term string, n long, places binary, doc_ids array<bigint>"


def build_index(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The postings of docs as a table of INDEX_SCHEMA, written to path or a scratch table, so that segments keep their numbers.

    Null and empty texts and texts without words have no postings, but a place in their segment. doc_ids may be null
    or repeat: every row is a text of its own. Other columns are ignored; no rows give none.
    """
    build = uuid.uuid4().int & ((1 << 23) - 1)  # segments of several builds may stand in one table

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = build << 40 | TaskContext.get().partitionId() << 18
        for part in cut_batches(batches, "text", SEGMENT_BYTES):
            codes, terms, counts = split_words(part.column("text"))
            begin = np.concatenate(([0], np.cumsum(counts + 1)))
            places = np.arange(len(codes)) + np.repeat(np.arange(len(counts)), counts)
            order = np.sort(codes << 32 | places)
            at = np.searchsorted(order, np.arange(len(terms) + 1) << 32)
            values = order & 0xFFFFFFFF
            own, own_at = packed(gaps(values, at), at)
            docs_at, _ = packed(np.diff(begin, prepend=0), np.array([0]))
            n = len(terms)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n + 1, segment)),
                    pa.concat_arrays([terms.cast(pa.string()), pa.nulls(1, pa.string())]),
                    pa.array(np.append(np.diff(at), part.num_rows)),
                    pa.concat_arrays([binaries(own, own_at), pa.array([docs_at.tobytes()], pa.binary())]),
                    pa.concat_arrays([pa.nulls(n, pa.list_(pa.int64())), pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64()))]),
                ],
                names=["segment", "term", "n", "places", "doc_ids"],
            )
            segment += 1

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return save(own.mapInArrow(postings, INDEX_SCHEMA), path)


@dataclass
class Phrases:
    """Phrases as rows of numbers of terms, filled up with -1, and whose each is."""

    terms: dict[str, int]
    words: np.ndarray
    items: np.ndarray


def phrases(word_lists: list[list[str]], window: int | None = None) -> Phrases:
    """Each list as one phrase, or its windows of so many consecutive words; shorter lists are one window, empty ones none."""
    terms: dict[str, int] = {}
    numbered = [[terms.setdefault(w, len(terms)) for w in words] for words in word_lists]
    width = min(window or 1 << 30, max(map(len, numbered), default=0))
    rows, items = [np.empty((0, width), np.int64)], [np.empty(0, np.int64)]
    for i, own in enumerate(numbered):
        if not own:
            continue
        if len(own) <= width:
            cut = np.full((1, width), -1)
            cut[0, : len(own)] = own
        else:
            cut = np.lib.stride_tricks.sliding_window_view(np.array(own), width)
        rows.append(cut)
        items.append(np.full(len(cut), i))
    return Phrases(terms, np.concatenate(rows), np.concatenate(items))


class Segment:
    """The lists of one segment for the terms that are asked for, as sorted numbers term << 32 | place."""

    def __init__(self, table: pa.Table, terms: dict[str, int]):
        head = pc.is_null(table["term"])
        docs = table.filter(head)
        table = table.filter(pc.invert(head))
        self.doc_ids = docs["doc_ids"].combine_chunks().flatten()
        self.begin = np.cumsum(unpacked(bytes_of(docs["places"])[0])[0])
        ids = np.array([terms[t] for t in table["term"].to_pylist()], np.int64)
        order = np.argsort(ids)
        data, at = bytes_of(table["places"].take(pa.array(order)))
        deltas, last = unpacked(data)
        starts = np.searchsorted(last, at)
        self.count = np.zeros(len(terms) + 1, np.int64)  # the last for the filling -1
        self.count[ids[order]] = np.diff(starts)
        self.first = np.zeros(len(terms) + 1, np.int64)
        self.first[ids[order]] = starts[:-1]
        self.places = summed(deltas, starts)
        self.keys = np.repeat(ids[order], np.diff(starts)) << 32 | self.places

    def list(self, term: int) -> np.ndarray:
        return self.places[self.first[term] : self.first[term] + self.count[term]]

    def occurrences(self, found: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first place, number of the phrase) of every occurrence, in several parts."""
        n = self.count[found.words]
        alive = np.flatnonzero(((n > 0) | (found.words < 0)).all(axis=1))
        words = found.words[alive]
        rarity = np.where(words < 0, 1 << 40, n[alive])
        order = np.argsort(rarity, axis=1, kind="stable")
        least = rarity[np.arange(len(alive)), order[:, 0]] if len(alive) else np.empty(0, np.int64)
        step = np.cumsum(least) // STEP_PLACES
        for part in np.split(np.arange(len(alive)), np.flatnonzero(np.diff(step)) + 1):
            if not len(part):
                continue
            own = np.repeat(part, least[part])
            start = self.places[ranges(self.first[words[part, order[part, 0]]], least[part])] - order[own, 0]
            for j in range(1, words.shape[1]):
                term = words[own, order[own, j]]
                key = term << 32 | (start + order[own, j])
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                stay = (term < 0) | ((self.keys[at] == key) & (start >= 0))
                own, start = own[stay], start[stay]
            stay = start >= 0
            yield start[stay], alive[own[stay]]

    def near(self, terms: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
        """(first place, last place) of each stretch of at most `within` words of a text that begins with one of the terms, has
        all of them, and ends where it has."""
        lists = sorted((self.list(t) for t in np.unique(terms)), key=len)
        if not lists or not len(lists[0]):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        rare = np.append(lists[0], 1 << 62)
        # a stretch holds a place of the rarest term, so it begins at most within - 1 before one
        begins = np.unique(np.concatenate([p[rare[np.searchsorted(rare, p)] - p < within] for p in lists]))
        ends = begins
        for p in lists:
            at = np.searchsorted(p, begins)
            have = at < len(p)
            begins, ends, at = begins[have], ends[have], at[have]
            ends = np.maximum(ends, p[at])
        stay = (ends - begins < within) & (self.doc(begins) == self.doc(ends))
        return begins[stay], ends[stay]

    def doc(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, places, side="right") - 1


def _by_segment(index: DataFrame, terms: dict[str, int], search: Callable[[int, Segment], pa.Table], schema: str) -> DataFrame:
    """Rows of search() over the lists of the terms in each segment; only these lists are shuffled."""
    wanted = index.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    lists = index.join(F.broadcast(wanted), "term", "left_semi")  # bounded by BROADCAST_BYTES
    heads = index.where("term is null")
    return lists.unionByName(heads).groupBy("segment").applyInArrow(lambda key, table: search(key[0].as_py(), Segment(table, terms)), schema)


def _word_lists(texts: list[str | None]) -> list[list[str]]:
    codes, terms, counts = split_words(pa.array(texts, pa.string()))
    names = terms.to_pylist()
    ends = np.cumsum(counts)
    return [[names[c] for c in codes[e - n : e].tolist()] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]


def _slices(items: DataFrame, columns: list[str]) -> list[list]:
    """The rows of items in slices of about BROADCAST_BYTES of text, collected one after another."""
    own = items.select(*columns).distinct()
    total = own.agg(F.sum(F.octet_length(F.coalesce(F.col(columns[-1]), F.lit(""))) + 16)).first()[0] or 0
    slices = -(-total // BROADCAST_BYTES)
    part = F.pmod(F.xxhash64(*columns), F.lit(max(1, slices)))
    return [own.where(part == i).collect() for i in range(slices)]


def phrase_matches(index: DataFrame, queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, doc_id, start, n_words): each occurrence of the whole word sequence of a query in a text.

    start counts the text's words from 0. Queries without words match nothing.
    """
    found = None
    for rows in _slices(queries, [id_col, text_col]) or [[]]:
        own = phrases(_word_lists([r[text_col] for r in rows]))
        names = np.array([r[id_col] for r in rows], object)
        length = (own.words >= 0).sum(axis=1)

        def search(_: int, segment: Segment, own=own, names=names, length=length) -> pa.Table:
            parts = [*segment.occurrences(own)]
            start, which = (np.concatenate([p[i] for p in parts] or [np.empty(0, np.int64)]) for i in (0, 1))
            doc = segment.doc(start)
            return pa.table({"item_id": pa.array(names[own.items[which]].tolist(), pa.int64()), "doc_id": segment.doc_ids.take(pa.array(doc)), "start": start - segment.begin[doc], "n_words": length[which]})

        part = _by_segment(index, own.terms, search, "item_id long, doc_id long, start long, n_words long")
        found = part if found is None else found.unionByName(part)
    return found


def proximity_matches(index: DataFrame, queries: DataFrame, within: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, doc_id, start, end): stretches of at most `within` words of a text that hold all terms of a query, in any order.

    A stretch begins with one of the terms and ends where it first has all; start and end count the text's words from
    0, end is the last word. Queries without words match nothing.
    """
    found = None
    for rows in _slices(queries, [id_col, text_col]) or [[]]:
        own = phrases(_word_lists([r[text_col] for r in rows]))
        names = [r[id_col] for r in rows]

        def search(_: int, segment: Segment, own=own, names=names) -> pa.Table:
            items, docs, begins, ends = [], [], [], []
            for row, item in zip(own.words, own.items, strict=True):
                terms = row[row >= 0]
                if not segment.count[terms].all():
                    continue
                a, b = segment.near(terms, within)
                doc = segment.doc(a)
                items += [names[item]] * len(a)
                docs.append(doc)
                begins.append(a - segment.begin[doc])
                ends.append(b - segment.begin[doc])
            whole = lambda parts: np.concatenate(parts or [np.empty(0, np.int64)])
            return pa.table({"item_id": pa.array(items, pa.int64()), "doc_id": segment.doc_ids.take(pa.array(whole(docs))), "start": whole(begins), "end": whole(ends)})

        part = _by_segment(index, own.terms, search, "item_id long, doc_id long, start long, end long")
        found = part if found is None else found.unionByName(part)
    return found


def contaminated_words(index: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) for each text of the index, those without words too.

    A window is `window` consecutive words of a benchmark text; a shorter text is one window, one without words none. spans
    are the stretches of words that windows cover, as start, end, start, end, ... (ends exclusive); n_hit is their
    length; items are the ids of the texts whose windows occur, sorted as strings. A benchmark text without an id marks
    words but is not listed; repeated texts of one id count once. An empty benchmark marks nothing.
    """
    schema = "segment long, no int, doc_id long, n_words long, spans array<bigint>, items array<string>"
    found, slices = None, _slices(benchmark, [id_col, text_col]) or [[]]
    for rows in slices:
        own = phrases(_word_lists([r[text_col] for r in rows]), window)
        length = (own.words >= 0).sum(axis=1)
        ids = sorted({str(r[id_col]) for r in rows if r[id_col] is not None})
        place = {v: i for i, v in enumerate(ids)}
        rank = np.array([place.get(str(r[id_col]), -1) for r in rows], np.int64)

        def search(number: int, segment: Segment, own=own, length=length, ids=ids, rank=rank) -> pa.Table:
            begin = segment.begin
            change = np.zeros(begin[-1] + 1, np.int32)
            pairs = []
            for start, which in segment.occurrences(own):
                np.add.at(change, start, 1)
                np.add.at(change, start + length[which], -1)
                item = rank[own.items[which]]
                pairs.append(np.unique((segment.doc(start) << 32 | item)[item >= 0]))
            covered = np.cumsum(change) > 0
            edge = np.flatnonzero(np.diff(covered, prepend=False, append=False))
            doc = segment.doc(edge[0::2])
            cuts = (edge.reshape(-1, 2) - begin[doc][:, None]).ravel()
            docs = len(begin) - 1
            at = lambda owner, each: pa.array(each * np.searchsorted(owner, np.arange(docs + 1)), pa.int32())
            pair = np.unique(np.concatenate(pairs or [np.empty(0, np.int64)]))
            names = pa.array(ids, pa.string()).take(pa.array(pair & 0xFFFFFFFF))
            return pa.table(
                {
                    "segment": pa.array(np.full(docs, number)),
                    "no": pa.array(np.arange(docs), pa.int32()),
                    "doc_id": segment.doc_ids,
                    "n_words": np.diff(begin) - 1,
                    "spans": pa.ListArray.from_arrays(at(doc, 2), pa.array(cuts)),
                    "items": pa.ListArray.from_arrays(at(pair >> 32, 1), names),
                }
            )

        part = _by_segment(index, own.terms, search, schema)
        found = part if found is None else found.unionByName(part)
    if len(slices) > 1:  # what several slices cover in one text
        cuts = F.expr("filter(transform(spans, (x, i) -> named_struct('a', x, 'b', get(spans, i + 1), 'i', i)), s -> s.i % 2 = 0)")
        found = found.groupBy("segment", "no", "doc_id", "n_words").agg(F.array_sort(F.flatten(F.collect_list(cuts))).alias("cuts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        joined = F.aggregate("cuts", F.array().cast("array<bigint>"), lambda out, c: F.when((F.size(out) > 0) & (F.get(out, F.size(out) - 1) >= c["a"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.greatest(F.get(out, F.size(out) - 1), c["b"])))).otherwise(F.concat(out, F.array(c["a"], c["b"]))))
        found = found.withColumn("spans", joined)
    hit = F.expr("aggregate(transform(spans, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (n, x) -> n + x)")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), "spans", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """contaminated_words over an index of docs(doc_id, text), written as a scratch table."""
    return contaminated_words(build_index(docs), benchmark, window)
