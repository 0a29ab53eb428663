"""BM25 over a table of chunks: a stored index in segments, scores, and the exact best k for many queries at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragcorpus.functions.text import tokenize
from ragcorpus.operators._order import numbered
from ragcorpus.sources.scratch import exists, new_path, save

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Queries and their terms are broadcast below this number of rows; above it they are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Queries of so many different terms are pruned; the bounds of more add up to more than any floor, so all their postings are read.
PRUNED_TERMS = 16
#: Postings that give a query its floor, as a multiple of k, and the share of the floor that unread blocks may add up to: a
#: larger one leaves more postings unread, but more chunks to look up. What sums of doubles may differ by.
FIRST_POSTINGS, UNREAD, MARGIN = 32, 0.8, 1e-6
#: Postings of the queries from which on pruning pays: fewer are read whole sooner than bounds are looked up.
PRUNED_FROM = 50_000_000
#: Words of the chunks whose postings one task sorts, or whose lists it looks up; pairs of a query and a chunk that one task sums.
WORDS_PER_TASK, PAIRS_PER_TASK = 2_000_000, 1_000_000
#: Stored bytes that one task reads, as it holds all their terms, or the rows that it deals, and blocks that one task sums to
#: counts of terms.
BLOCK_BYTES, BLOCKS_PER_TASK = 32 << 20, 500_000


@dataclass
class Bm25Index:
    """A stored index as it stands now. A chunk's class is the number of bits of its length, a posting's level that of its tf; a
    block is the postings of one term, class and level, which all weigh nearly the same."""

    postings: DataFrame  # chunk_id, doc_order, dl, class, term, tf, level
    blocks: DataFrame  # term, class, level, df, max_tf, min_dl
    terms: DataFrame  # term, df, idf
    corpus: DataFrame  # one row: n_docs, avgdl, mean_idf
    chunks: DataFrame  # chunk_id, doc_order, dl
    forward: DataFrame  # chunk_id, doc_order, dl, class, words: the chunk's terms and their tf
    mean_idf: float
    n_docs: int
    length: int  # words of all chunks
    stored: dict[str, DataFrame]  # postings, forward and blocks with their segment, those of deleted chunks too; the first two are read few at once, and joined to others, whose session stays
    gone: DataFrame | None  # _id, _at: chunks of segments before _at that are deleted


def _forward(chunks: DataFrame, text_col: str) -> DataFrame:
    """A row a chunk with its terms, a map: a chunk's words are sorted, and equal ones stand together. Nothing is shuffled or
    gathered, so a task holds one chunk at a time."""
    own = chunks.select("chunk_id", "doc_order", F.array_sort(tokenize(F.coalesce(F.col(text_col), F.lit("")))).alias("_sorted"))
    first = lambda x, i: (i == 0) | (x["t"] != F.get("_sorted", i - 1))
    placed = F.transform("_sorted", lambda t, i: F.struct(t.alias("t"), i.alias("at")))
    runs = own.select("chunk_id", "doc_order", "_sorted", F.size("_sorted").alias("dl"), F.filter(placed, first).alias("_runs"))
    tf = lambda x, i: (F.coalesce(F.get("_runs", i + 1)["at"], F.col("dl")) - x["at"]).cast("long")
    words = F.transform("_runs", lambda x, i: F.struct(x["t"].alias("term"), tf(x, i).alias("tf")))
    return runs.select("chunk_id", "doc_order", "dl", words.alias("words"), _bits("dl").alias("class"))


def _bits(name: str) -> Column:
    return F.length(F.bin(name))


def _write_segment(forward: DataFrame, path: str, segment: int) -> None:
    """A segment: its chunks, their postings sorted by term within files, and statistics of both."""
    spark = forward.sparkSession
    at = lambda name: f"{path}/{name}/segment={segment}"
    # in groups of rows that are small, as no task reads less than one
    forward.write.mode("overwrite").option("parquet.block.size", BLOCK_BYTES // 2).parquet(at("forward"))
    corpus = spark.read.parquet(at("forward")).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length"))
    # dealt by number, or files would be packed and parts joined by their packed size, and a task would sort very many postings
    parts = max(1, -(-corpus.first()["length"] // WORDS_PER_TASK))
    dealt = _few_at_once(spark, at("forward"), parts).repartition(parts, "chunk_id")
    postings = dealt.select("chunk_id", "doc_order", "dl", "class", F.explode("words").alias("w")).select("chunk_id", "doc_order", "dl", "class", "w.term", "w.tf", _bits("w.tf").alias("level"))
    postings.sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(at("postings"))
    _blocks(_few_at_once(spark, at("postings"), parts)).write.mode("overwrite").parquet(at("blocks"))
    # last, as a segment counts from here on
    corpus.write.mode("overwrite").parquet(at("corpus"))


def _few_at_once(spark: SparkSession, path: str, parts: int = 1) -> DataFrame:
    """A stored table whose tasks read BLOCK_BYTES at most and whose shuffles have `parts` partitions at least, in a session of
    its own with the caller's settings, so that these stay. Where rows are dealt to more than 200 parts, a task holds all that it
    deals, which are many times what it reads."""
    own = spark.newSession()
    new = own.conf.getAll
    for name, value in spark.conf.getAll.items():
        if new.get(name) != value:
            own.conf.set(name, value)
    own.conf.set("spark.sql.files.maxPartitionBytes", min(BLOCK_BYTES, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    own.conf.set("spark.sql.shuffle.partitions", max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return own.read.parquet(path)


def _blocks(postings: DataFrame) -> DataFrame:
    """Statistics of the blocks of postings; they combine before their shuffle, so stop-words are no hot keys."""
    return postings.groupBy("term", "class", "level").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))


def _segments(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the segments, a row each."""
    return sorted(r["segment"] for r in spark.read.parquet(f"{path}/corpus").select("segment").distinct().collect()) if exists(spark, f"{path}/corpus") else []


def store_bm25_index(chunks: DataFrame, path: str, text_col: str = "content") -> Bm25Index:
    """Index chunks(chunk_id, doc_order, text) below path, as its first segment. The texts are tokenized once.

    A term's negative idf is replaced by EPSILON times the mean idf. Chunks without words have no postings but count as
    documents.
    """
    _write_segment(_forward(chunks, text_col), path, 0)
    return read_bm25_index(chunks.sparkSession, path)


def build_bm25_index(chunks: DataFrame, text_col: str = "content") -> Bm25Index:
    """As store_bm25_index, in a scratch table."""
    return store_bm25_index(chunks, new_path(chunks.sparkSession), text_col)


def append_to_bm25_index(chunks: DataFrame, path: str, text_col: str = "content") -> None:
    """Add chunks, none of which the index holds, as one more segment; nothing that is stored is read or written again."""
    _write_segment(_forward(chunks, text_col), path, max(_segments(chunks.sparkSession, path), default=-1) + 1)


def delete_from_bm25_index(ids: DataFrame, path: str) -> None:
    """Take the chunks of ids(chunk_id) out of the index: a segment with their ids and negative counts. Ids that the index
    does not hold change nothing; a chunk may be added again later."""
    spark = ids.sparkSession
    segment = max(_segments(spark, path), default=-1) + 1
    index = read_bm25_index(spark, path)
    at = lambda name: f"{path}/{name}/segment={segment}"
    parts = _parts(index)
    forward = index.stored["forward"] if index.gone is None else _live(_dealt(index.stored["forward"], parts), index.gone, parts)
    gone = _dealt(ids.select("chunk_id").distinct(), parts).join(forward, "chunk_id")
    gone.select("chunk_id", "dl", "class", "words").write.mode("overwrite").parquet(at("deleted"))
    stored = spark.read.parquet(at("deleted"))
    words = stored.select("class", F.explode("words").alias("w")).select("class", "w.term", _bits("w.tf").alias("level"))
    words.groupBy("term", "class", "level").agg((-F.count("*")).alias("df"), F.lit(0).cast("long").alias("max_tf"), F.lit((1 << 31) - 1).alias("min_dl")).write.mode("overwrite").parquet(at("blocks"))
    stored.agg((-F.count("*")).alias("n_docs"), (-F.coalesce(F.sum("dl"), F.lit(0))).alias("length")).write.mode("overwrite").parquet(at("corpus"))


def read_bm25_index(spark: SparkSession, path: str) -> Bm25Index:
    """The segments of an index, merged: counts are summed, deleted chunks left out. One row of statistics comes to the driver."""
    done = _segments(spark, path)
    table = lambda name: spark.read.parquet(f"{path}/{name}").where(F.col("segment").isin(done))
    few = lambda name: _few_at_once(spark, f"{path}/{name}").where(F.col("segment").isin(done))
    sums = table("corpus").agg(F.sum("n_docs").alias("n"), F.sum("length").alias("length")).first()
    n, avgdl = int(sums["n"] or 0), (sums["length"] / sums["n"] if sums["n"] else None)
    # dealt by number, as a fixed one would have tasks grow with the vocabulary; a term has few blocks, so none is a hot key
    rows = table("blocks")
    sums_in = max(spark.sparkContext.defaultParallelism, -(-rows.count() // BLOCKS_PER_TASK))
    dealt = rows.repartition(sums_in, "term")
    mean = _counts(few("blocks").repartition(sums_in, "term")).agg(F.avg(_idf(n)).alias("m")).first()["m"]
    corpus = spark.range(1).select(F.lit(n).cast("long").alias("n_docs"), F.lit(avgdl).cast("double").alias("avgdl"), F.lit(mean).cast("double").alias("mean_idf"))
    gone = table("deleted").select(F.col("chunk_id").alias("_id"), F.col("segment").alias("_at")) if exists(spark, f"{path}/deleted") else None
    names, parts = ("forward", "postings"), _parts_of(spark, int(sums["length"] or 0))
    live = {name: table(name).drop("segment") if gone is None else _live(_dealt(table(name), parts), gone, parts) for name in names}
    return Bm25Index(live["postings"], _merged(dealt), _terms(_counts(dealt), n, mean or 0.0), corpus, live["forward"].select("chunk_id", "doc_order", "dl"), live["forward"], mean or 0.0, n, int(sums["length"] or 0), {name: few(name) for name in names} | {"blocks": rows}, gone)


def _merged(blocks: DataFrame) -> DataFrame:
    """The blocks of all segments, a row each."""
    return blocks.groupBy("term", "class", "level").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl")).where("df > 0")


def _counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")


def _idf(n: int) -> Column:
    return F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def _terms(counts: DataFrame, n: int, mean: float) -> DataFrame:
    return counts.select("term", "df", F.when(_idf(n) < 0, F.lit(EPSILON * mean)).otherwise(_idf(n)).alias("idf"))


def _parts_of(spark: SparkSession, words: int, pairs: int = 0) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-words // WORDS_PER_TASK), -(-pairs // PAIRS_PER_TASK))


def _parts(index: Bm25Index, wanted: DataFrame | None = None) -> int:
    """Parts that chunks are dealt in: by their words, and by the pairs of chunks and queries that share a term, of which a query
    has as many as its terms have postings and as there are chunks, at most. So a task's memory stays as it is, whatever grows."""
    pairs = 0
    if wanted is not None:
        most = wanted.groupBy("query_id").agg(F.least(F.sum("df"), F.lit(index.n_docs)).alias("n"))
        pairs = most.agg(F.sum("n")).first()[0] or 0
    return _parts_of(index.forward.sparkSession, index.length, pairs)


def _dealt(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(parts, "chunk_id")


def _live(dealt: DataFrame, gone: DataFrame | None, parts: int) -> DataFrame:
    """Rows, with their segment, of chunks that are not deleted; they stay where they are dealt."""
    if gone is not None:
        dealt = dealt.join(gone.repartition(parts, "_id"), (F.col("chunk_id") == F.col("_id")) & (F.col("segment") < F.col("_at")), "left_anti")
    return dealt.drop("segment")


def _wanted(index: Bm25Index, queries: DataFrame) -> DataFrame:
    """(query_id, term, times, df, idf): the terms of the queries that the index has."""
    words = queries.select("query_id", F.explode(tokenize(F.coalesce("query", F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    own = _blocks_of(index, words)
    terms = index.terms if own is None else _terms(_counts(own), index.n_docs, index.mean_idf)
    return words.join(terms, "term").select("query_id", "term", "times", "df", "idf")


def _blocks_of(index: Bm25Index, wanted: DataFrame) -> DataFrame | None:
    """The segments' blocks of the wanted terms, where these are few: others are left out before anything is dealt or summed."""
    terms = wanted.select("term").distinct()
    return index.stored["blocks"].join(F.broadcast(terms), "term", "left_semi") if _is_small(terms) else None


def _weight(tf: Column, dl: Column, k1: float, b: float) -> Column:
    """What `times` * idf occurrences of a term give a chunk."""
    return F.col("times") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))


def _found(index: Bm25Index, priced: DataFrame, on: list[str], parts: int) -> DataFrame:
    """The postings of the columns `on` of priced(query_id, ...), joined to it. They are dealt by chunk before queries multiply
    them, so the sums of a chunk's weights shuffle no pairs of queries and chunks."""
    if not _is_small(priced):
        found = _live(_dealt(priced.join(index.stored["postings"], on), parts), index.gone, parts)
    else:
        own = F.broadcast(priced.select(*on).distinct()).join(index.stored["postings"], on)
        found = _live(_dealt(own, parts), index.gone, parts).join(F.broadcast(priced), on)
    return found.crossJoin(F.broadcast(index.corpus))  # one row


def _weights(index: Bm25Index, wanted: DataFrame, k1: float, b: float, parts: int) -> DataFrame:
    """(query_id, chunk_id, doc_order, weight): what each wanted term gives each chunk that has it."""
    found = _found(index, wanted.select("query_id", "term", "times", "idf"), ["term"], parts)
    return found.select("query_id", "chunk_id", "doc_order", _weight(F.col("tf"), F.col("dl"), k1, b).alias("weight"))


def _summed(weights: DataFrame) -> DataFrame:
    return weights.groupBy("query_id", "chunk_id", "doc_order").agg(F.round(F.sum("weight"), 9).alias("score"))


def bm25_scores(index: Bm25Index, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, chunk_id, doc_order, score) for chunks that share a term with a query(query_id, query).

    A term that a query repeats counts as often. The scores are rounded to nine places, as sums of doubles depend on
    their order.
    """
    wanted, _ = save(_wanted(index, queries))
    return _summed(_weights(index, wanted, k1, b, _parts(index, wanted)))


def _bounded(index: Bm25Index, wanted: DataFrame, k1: float, b: float) -> DataFrame:
    """(query_id, term, class, level, times, idf, df, bound): what a posting of a block gives its chunk at most."""
    own = _blocks_of(index, wanted)
    blocks = index.blocks if own is None else _merged(own)
    found = blocks.join(_small(wanted.select("query_id", "term", "times", "idf")), "term").crossJoin(F.broadcast(index.corpus))  # one row
    return found.select("query_id", "term", "class", "level", "times", "idf", "df", _weight(F.col("max_tf"), F.col("min_dl"), k1, b).alias("bound"))


def _exact(index: Bm25Index, pairs: DataFrame, wanted: DataFrame, k1: float, b: float, parts: int) -> DataFrame:
    """(query_id, chunk_id, doc_order, weight) of all terms of the pairs(query_id, chunk_id), from the chunks' own lists. A list is
    read once for all queries that ask for its chunk."""
    pairs, _ = save(pairs)
    if _is_small(pairs):
        asked = F.broadcast(pairs.groupBy("chunk_id").agg(F.collect_set("query_id").alias("asked")))
        lists = _live(_dealt(asked.join(index.stored["forward"], "chunk_id"), parts), index.gone, parts)
    else:
        asked = _dealt(pairs, parts).groupBy("chunk_id").agg(F.collect_set("query_id").alias("asked"))
        lists = asked.join(_live(_dealt(index.stored["forward"], parts), index.gone, parts), "chunk_id")
    words = lists.select("chunk_id", "doc_order", "dl", "asked", F.explode("words").alias("w")).select("chunk_id", "doc_order", "dl", "asked", "w.term", "w.tf")
    found = words.join(_small(wanted.select("query_id", "term", "times", "idf")), "term").where(F.array_contains("asked", F.col("query_id"))).crossJoin(F.broadcast(index.corpus))  # one row
    return found.select("query_id", "chunk_id", "doc_order", _weight(F.col("tf"), F.col("dl"), k1, b).alias("weight"))


def first_floor(index: Bm25Index, bounded: DataFrame, wanted: DataFrame, k: int, k1: float = K1, b: float = B) -> tuple[DataFrame, DataFrame]:
    """(query_id, floor), a score that k chunks reach, and the blocks of `bounded` that are read for it.

    The rarest terms are read, as many as have FIRST_POSTINGS * k postings or the first k; of the 2k chunks that they give most the
    exact scores are looked up.
    """
    best = bounded.groupBy("query_id", "term").agg(F.sum("df").alias("df"))
    before = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    chosen = best.withColumn("_read", F.coalesce(F.sum("df").over(before), F.lit(0))).where((F.col("_read") < k) | (F.col("_read") + F.col("df") <= FIRST_POSTINGS * k)).select("query_id", "term")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    rarest, _ = save(wanted.join(chosen, ["query_id", "term"], "left_semi"))
    parts = _parts(index, rarest)
    sums = _summed(_weights(index, rarest, k1, b, parts))
    most = sums.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= 2 * k).select("query_id", "chunk_id")
    scored = _summed(_exact(index, most, wanted, k1, b, parts))
    floor = scored.withColumn("_at", F.row_number().over(order)).where(F.col("_at") == k).select("query_id", F.col("score").alias("floor"))
    return floor, bounded.join(chosen, ["query_id", "term"], "left_semi")


def essential(bounded: DataFrame, floor: DataFrame) -> DataFrame:
    """The blocks of `bounded` that must be read, with floor, `unread`, the bound of the term's unread blocks in the class,
    and `rest`, what the unread blocks of all terms can give a chunk of the class together.

    A chunk has one posting of a term at most. Blocks are left unread from the least bound on, while the greatest unread
    bounds of all terms together stay below a share of the floor: a chunk whose postings are all unread cannot reach it.
    """
    of_term = Window.partitionBy("query_id", "class", "term").orderBy("bound", "level")
    up_to = Window.partitionBy("query_id", "class").orderBy("bound", "term", "level").rowsBetween(Window.unboundedPreceding, 0)
    more = bounded.join(_small(floor), "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))).withColumn("_more", F.col("bound") - F.coalesce(F.lag("bound").over(of_term), F.lit(0.0)))
    summed = more.withColumn("_sum", F.sum("_more").over(up_to))
    left = F.col("_sum") < UNREAD * F.col("floor") - MARGIN
    most = lambda c, *by: F.coalesce(F.max(F.when(left, F.col(c))).over(Window.partitionBy(*by)), F.lit(0.0))
    noted = summed.withColumns({"unread": most("bound", "query_id", "class", "term"), "rest": most("_sum", "query_id", "class"), "_left": left})
    return noted.where("not _left").drop("_sum", "_more", "_left")


def _candidates(index: Bm25Index, needed: DataFrame, k1: float, b: float, parts: int) -> DataFrame:
    """(query_id, chunk_id): chunks that may reach the floor, by what the needed blocks give and the others may give."""
    found = _found(index, needed.select("query_id", "term", "class", "level", "times", "idf", "unread"), ["term", "class", "level"], parts)
    over = found.select("query_id", "chunk_id", "class", (_weight(F.col("tf"), F.col("dl"), k1, b) - F.col("unread")).alias("over"))
    limits = _small(needed.groupBy("query_id", "class").agg((F.first("floor") - F.first("rest")).alias("needs")))
    sums = over.groupBy("query_id", "chunk_id", "class").agg(F.sum("over").alias("sum")).join(limits, ["query_id", "class"])
    return sums.where(F.col("sum") >= F.col("needs") - MARGIN).select("query_id", "chunk_id")


def bm25_topk(index: Bm25Index, queries: DataFrame, k: int = 20, k1: float = K1, b: float = B, pruned_from: int = PRUNED_FROM) -> DataFrame:
    """(query_id, rank, chunk_id, doc_order, score): the best k chunks of each query, ties in corpus order.

    Of queries of at most PRUNED_TERMS terms few postings are read, where they have `pruned_from` together: those of
    the rarest terms give a floor, which k chunks reach; then only blocks are read without which no chunk reaches it, and
    the chunks that may, by these and the bounds of what is unread, are scored from their own lists of words. So most
    postings of stop-words are left alone. Of longer queries all postings are read. Both ways give the same rows.

    Every chunk has a score, so chunks without a common term, which score 0, fill up in corpus order. While no score is
    below 0, the first 2k chunks of the corpus hold enough of them: fewer than k can be among the scored ones where
    any are needed. They join the best k, where one that is scored itself counts by its score. Scores are below 0 only where the mean idf is; then all pairs
    that share a term are scored, and the first k chunks that share none are found among the gaps between those that do.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_order", "chunk_id")
    columns = ["query_id", "chunk_id", "doc_order"]
    if index.mean_idf >= 0:
        first = index.chunks.select("chunk_id", "doc_order").orderBy("doc_order", "chunk_id").limit(2 * k)
        zeros = queries.select("query_id").crossJoin(F.broadcast(first)).withColumn("score", F.lit(0.0))  # 2k rows
        wanted, _ = save(_wanted(index, queries).withColumn("n_terms", F.count("*").over(Window.partitionBy("query_id"))))
        short, long = wanted.where(F.col("n_terms") <= PRUNED_TERMS), wanted.where(F.col("n_terms") > PRUNED_TERMS)
        postings = short.agg(F.sum("df")).first()[0]
        if postings is None or postings < pruned_from:
            scores = _summed(_weights(index, wanted, k1, b, _parts(index, wanted)))
        else:
            bounded, _ = save(_bounded(index, short, k1, b))
            floor, _ = save(first_floor(index, bounded, short, k, k1, b)[0])
            needed, _ = save(essential(bounded, floor))
            parts = _parts(index, short)
            scores = _summed(_exact(index, _candidates(index, needed, k1, b, parts), short, k1, b, parts))
            if long.limit(1).count():
                scores = scores.unionByName(_summed(_weights(index, long, k1, b, _parts(index, long))))
        best = scores.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= k).drop("_at")
        every = best.unionByName(zeros).groupBy(*columns).agg(F.max("score").alias("score"))
    else:
        scores, _ = save(bm25_scores(index, queries, k1, b))
        every = scores.unionByName(_unmatched(index, queries, scores, k).withColumn("score", F.lit(0.0)))
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", *columns[1:], "score")


def _unmatched(index: Bm25Index, queries: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, doc_order): the first k chunks in corpus order that have no score, of each query.

    Chunks are numbered in corpus order. Of n chunks before a place, of which m are scored, n - m are not; so the runs
    of unscored chunks that hold the first k follow from the places of the scored ones.
    """
    places = numbered(index.chunks.select("chunk_id", "doc_order"), ["doc_order", "chunk_id"], "place")
    n = index.chunks.agg(F.count("*").alias("_n"))  # one row
    placed = scores.join(places.select("chunk_id", "place"), "chunk_id").select("query_id", "place")
    ends = queries.select("query_id").distinct().crossJoin(F.broadcast(n)).select("query_id", F.col("_n").alias("place"))
    own = Window.partitionBy("query_id").orderBy("place")
    runs = placed.unionByName(ends).select("query_id", "place", (F.coalesce(F.lag("place").over(own), F.lit(-1)) + 1).alias("start"), (F.row_number().over(own) - 1).alias("scored"))
    before = F.col("start") - F.col("scored")  # unscored chunks before the run
    runs = runs.where((F.col("place") > F.col("start")) & (before < k))
    last = F.least(F.col("place"), F.col("start") + k - before) - 1
    wanted = runs.select("query_id", F.explode(F.sequence("start", last)).alias("place"))
    return wanted.join(places, "place").select("query_id", "chunk_id", "doc_order")


def _small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if it is checked to be small."""
    return F.broadcast(df) if _is_small(df) else df


def _is_small(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def rounded(score: Column, places: int = 6) -> Column:
    return F.round(score, places)
