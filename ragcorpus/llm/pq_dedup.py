"""Embedding near-duplicates by product quantisation.

Unit vectors go to the inverted list of their nearest coarse centroid and are kept there as the codes of their residual,
one byte for each of SUBSPACES parts. A query looks its products with all codewords up in tables, adds them by code, and
compares exactly what may be near. Three bounds make both steps lossless for the links asked for. Vectors of cosine c
or more are at most r = sqrt(2 - 2c) apart. So a query must probe list j only if its distance to the plane halfway
between its own centroid and j's is at most r, and only if it is within r of the ball that holds j's vectors. And a
vector that is e from its code can be within r of the query only if its code is within r + e.

Lists that lie near one another form a super list. A query is sent once to each super list that holds a list it must
probe, and finds the lists there; so the rows shuffled do not grow with the number of lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragcorpus.llm._common import save
from ragcorpus.llm.components import connected_components

#: At most about so many distinct vectors, chosen by a hash, teach centroids and codewords.
SAMPLE_VECTORS = 16_000
SUBSPACES, CODEWORDS = 8, 256
#: Vectors of the most frequent label for each list and for each super list; lists and super lists at most and least.
VECTORS_PER_LIST, LEAST_LISTS, MOST_LISTS = 32, 16, 1_024
VECTORS_PER_SUPER, MOST_SUPERS = 1_024, 256
#: Vectors of one super list, and queries to it, that one task compares.
BLOCK = 2_048


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres**2).sum(axis=1)
    return np.concatenate([(half - x[i : i + 4096] @ centres.T).argmin(axis=1) for i in range(0, len(x), 4096)] or [np.empty(0, int)])


@dataclass
class Quantiser:
    centroids: np.ndarray  # lists x dims, those of one super list side by side
    supers: np.ndarray  # the super list of each list, ascending
    codebooks: np.ndarray  # SUBSPACES x codewords x dims of a part
    reach: np.ndarray = field(default_factory=lambda: np.empty(0))  # how far a list's vectors are from its centroid at most

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, supers: int = 1) -> Quantiser:
        centroids = _kmeans(sample, lists, 8, 1)
        group = _nearest(centroids, _kmeans(centroids, supers, 8, 7))
        order = np.argsort(group, kind="stable")
        centroids = centroids[order]
        residual = sample - centroids[_nearest(sample, centroids)]
        width = sample.shape[1] // SUBSPACES
        books = np.stack([_kmeans(residual[:, m * width : (m + 1) * width], CODEWORDS, 5, 2 + m) for m in range(SUBSPACES)])
        return cls(centroids, group[order], books, np.full(len(centroids), np.inf))

    def padded(self, vectors: list) -> np.ndarray:
        """Vectors as unit rows in double precision, filled with zeros to the model's length."""
        out = np.zeros((len(vectors), self.centroids.shape[1]))
        sizes = {len(v) for v in vectors}
        if len(sizes) == 1:
            out[:, : sizes.pop()] = np.stack(vectors)
        else:
            for i, v in enumerate(vectors):
                out[i, : len(v)] = v
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Own list, codes, distance from the code, distance from the centroid, and the code's own part of its distances."""
        own = _nearest(unit, self.centroids)
        centre = self.centroids[own]
        residual = unit - centre
        width = residual.shape[1] // SUBSPACES
        codes = np.stack([_nearest(residual[:, m * width : (m + 1) * width], self.codebooks[m]) for m in range(SUBSPACES)], axis=1).astype(np.uint8)
        decoded = np.concatenate([self.codebooks[m][codes[:, m]] for m in range(SUBSPACES)], axis=1)
        return own, codes, np.linalg.norm(residual - decoded, axis=1), np.linalg.norm(residual, axis=1), (decoded * (decoded + 2 * centre)).sum(axis=1)

    def squares(self, unit: np.ndarray) -> np.ndarray:
        """rows x lists: squared distances to the centroids."""
        return np.maximum(0.0, (unit**2).sum(axis=1)[:, None] + (self.centroids**2).sum(axis=1)[None, :] - 2 * unit @ self.centroids.T)

    def probes(self, unit: np.ndarray, own: np.ndarray, radius: float) -> np.ndarray:
        """rows x lists: which lists may hold a vector within the radius; a query's own list always does."""
        out = np.empty((len(unit), len(self.centroids)), bool)
        norms = (self.centroids**2).sum(axis=1)
        apart = np.sqrt(np.maximum(0.0, norms[:, None] + norms[None, :] - 2 * self.centroids @ self.centroids.T))
        for at in range(0, len(unit), 1024):
            near, mine = self.squares(unit[at : at + 1024]), own[at : at + 1024]
            rows = np.arange(len(mine))
            plane = near - near[rows, mine][:, None] <= 2 * (radius + 1e-6) * apart[mine] + 1e-9
            out[at : at + 1024] = plane & (np.sqrt(near) <= self.reach[None, :] + radius + 1e-6)
            out[at + rows, mine] = True
        return out

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """SUBSPACES x codewords x queries: products of the codewords with the queries' parts."""
        width = queries.shape[1] // SUBSPACES
        return np.stack([(self.codebooks[m] @ queries[:, m * width : (m + 1) * width].T).astype(np.float32) for m in range(SUBSPACES)])


def looked_up(tables: np.ndarray, codes: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """vectors x asked queries: the products of queries and codes, added up by table."""
    n = tables.shape[2]
    total = np.zeros((len(codes), len(asked) if 8 * len(asked) < n else n), np.float32)
    for m in range(len(tables)):
        if 8 * len(asked) < n:
            total += np.take(tables[m].ravel(), codes[:, m].astype(np.int64)[:, None] * n + asked[None, :])
        else:  # whole rows of a table are faster to fetch than single values
            total += tables[m][codes[:, m]]
    return total if total.shape[1] == len(asked) else total[:, asked]


def near_vectors(rows: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of rows.

    Rows link when their labels are equal and not null, their vectors are of one length and their cosine in double
    precision is at least the threshold. Vectors that are null, empty, zero, or hold null or non-finite numbers link with
    nothing: n_links 0, component_id their own vec_id, kept. Equal vectors of a label (found by value) are compared once
    and counted as many times as they occur; rows that repeat count as other vectors. A row with a null vec_id links but
    never names a component and is not kept. Other columns are ignored; no rows give none.
    """
    vector = F.col(vector_col)
    length = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    usable = F.col(label_col).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (length > 0) & (length < float("inf"))
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), vector.alias("v"), F.coalesce(usable, F.lit(False)).alias("usable"))
    alone = own.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    usable_rows = own.where("usable").drop("usable")
    # numbered as it is written, so the numbers stay whatever is computed again later
    distinct = save(usable_rows.groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id")).withColumn("uid", F.monotonically_increasing_id()))
    counted = distinct.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max("dims").alias("dims")).first()
    if not counted["n"]:
        return alone
    model = fit_quantiser(distinct, counted["n"], counted["most"], counted["dims"])
    pairs = save(links(distinct.select("uid", "n", "label", "v"), model, threshold))
    comps = connected_components(pairs.where("b is not null").select("a", "b"))
    sums = pairs.groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("links"))
    named = distinct.select("uid", "n", "first_id").join(comps, F.col("uid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "uid"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    result = save(named.join(least, "component").join(sums, "uid", "left").select("uid", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), "component_id"))
    found = usable_rows.join(distinct.select("label", "v", "uid"), ["label", "v"]).select("vec_id", "uid").join(result, "uid")
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")).unionByName(alone)


def fit_quantiser(distinct: DataFrame, n: int, most: int, dims: int) -> Quantiser:
    """Fitted on about SAMPLE_VECTORS of n distinct vectors, for labels of at most `most` vectors each."""
    share = F.pmod(F.xxhash64("label", "v"), F.lit(1_000_000)) < max(1, int(1_000_000 * min(1.0, SAMPLE_VECTORS / n)))
    sample = distinct.where(share).select("label", "v").toPandas()
    if sample.empty:
        sample = distinct.select("label", "v").limit(1).toPandas()
    dims = -(-dims // SUBSPACES) * SUBSPACES
    blank = Quantiser(np.zeros((1, dims)), np.zeros(1, int), np.zeros((SUBSPACES, 1, dims // SUBSPACES)))
    unit = blank.padded(sample["v"].tolist())
    unit = unit[np.lexsort(unit.T[::-1])]  # whatever order the rows came in
    lists = max(LEAST_LISTS, min(MOST_LISTS, most // VECTORS_PER_LIST))
    return Quantiser.fit(unit, lists, max(1, min(MOST_SUPERS, most // VECTORS_PER_SUPER)))


def links(distinct: DataFrame, model: Quantiser, threshold: float) -> DataFrame:
    """From distinct(uid, n, label, v): rows (a, null, n) that add up to the rows that a links with, and edges (a, b, 0)
    with the components of all links; at most two rows for each vector of a block."""
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    kinds = dict(distinct.dtypes)

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            own, codes, error, far, shift = model.encode(model.padded(part["v"].tolist()))
            yield part.assign(list=own, codes=[c.tobytes() for c in codes], error=error, far=far, shift=shift)

    placed = save(distinct.mapInPandas(place, f"uid long, n long, label {kinds['label']}, v {kinds['v']}, list int, codes binary, error double, far double, shift double"))
    reach = np.full(len(model.centroids), -np.inf)
    for r in placed.groupBy("list").agg(F.max("far").alias("far")).collect():  # one row a list
        reach[r["list"]] = r["far"]
    model = Quantiser(model.centroids, model.supers, model.codebooks, reach)

    @F.pandas_udf("array<int>")
    def probed_supers(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for vectors, lists in parts:
            own = lists.to_numpy()
            # of two vectors that link, the one of the later list finds the other
            hits = model.probes(model.padded(vectors.tolist()), own, radius) & (np.arange(len(model.centroids))[None, :] <= own[:, None])
            yield pd.Series([np.unique(model.supers[h]).astype(np.int32) for h in hits], dtype=object)

    supers = F.element_at(F.lit(model.supers.astype(np.int32)), F.col("list") + 1)
    columns = ["label", F.size("v").alias("dims"), "list", "uid", "n", "v"]
    held = placed.select(*columns, supers.alias("super"), "codes", "error", "shift", F.lit(0).alias("side"))
    asked = placed.select(*columns, F.explode(probed_supers("v", "list")).alias("super"), F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("error"), F.lit(0.0).alias("shift"), F.lit(1).alias("side"))
    cell = ["label", "dims", "super"]
    every = held.unionByName(asked)
    count = lambda side, name: F.ceil(F.count_if(F.col("side") == side) / BLOCK).cast("long").alias(name)
    blocks = save(every.groupBy(*cell).agg(count(0, "hb"), count(1, "ab")).where("hb > 0 and ab > 0"))
    salt = lambda name: F.pmod(F.xxhash64("uid"), F.col(name))
    series = lambda name: F.sequence(F.lit(0).cast("long"), F.col(name) - 1)
    dealt = every.join(blocks, cell).withColumn("hold", F.explode(F.when(F.col("side") == 0, F.array(salt("hb"))).otherwise(series("hb"))))
    dealt = dealt.withColumn("ask", F.explode(F.when(F.col("side") == 1, F.array(salt("ab"))).otherwise(series("ab"))))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        index, query = part[part["side"] == 0].sort_values("list", kind="stable"), part[part["side"] == 1]
        out = {"a": [np.empty(0, np.int64)], "b": [np.empty(0, np.int64)], "n": [np.empty(0, np.int64)]}
        if len(index) and len(query):
            q, i = _near_pairs(model, index, query, radius, threshold)
            a, b = query["uid"].to_numpy(), index["uid"].to_numpy()
            sums = np.bincount(q, index["n"].to_numpy()[i], len(a)).astype(np.int64)
            # within a list each of two vectors asks for the other; between lists the answer counts for both
            far = query["list"].to_numpy()[q] != index["list"].to_numpy()[i]
            back = np.bincount(i[far], query["n"].to_numpy()[q[far]], len(b)).astype(np.int64)
            for uids, total in ((a, sums), (b, back)):
                hit = np.flatnonzero(total)
                out["a"].append(uids[hit])
                out["b"].append(np.full(len(hit), -1))
                out["n"].append(total[hit])
            moved, to = _stars(a[q], b[i])
            out["a"].append(moved)
            out["b"].append(to)
            out["n"].append(np.full(len(moved), 0))
        found = pd.DataFrame({k: np.concatenate(v) for k, v in out.items()})
        return found.assign(edge=found["n"] == 0)

    found = dealt.select(*cell, "hold", "ask", "side", "list", "uid", "n", "v", "codes", "error", "shift").groupBy(*cell, "hold", "ask").applyInPandas(compare, "a long, b long, n long, edge boolean")
    return found.select("a", F.when(F.col("edge"), F.col("b")).alias("b"), "n")


def _near_pairs(model: Quantiser, index: pd.DataFrame, query: pd.DataFrame, radius: float, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) of a cosine at the threshold or above, none of a vector with itself; index is ordered by list."""
    x, y = model.padded(index["v"].tolist()), model.padded(query["v"].tolist())
    codes = np.frombuffer(b"".join(index["codes"]), np.uint8).reshape(-1, SUBSPACES)
    lists, own = index["list"].to_numpy(), query["list"].to_numpy()
    shift, limit = index["shift"].to_numpy(), (radius + index["error"].to_numpy() + 1e-3) ** 2
    a, b = query["uid"].to_numpy(), index["uid"].to_numpy()
    tables, squares, probed = model.tables(y), model.squares(y), model.probes(y, own, radius)
    cuts = np.flatnonzero(np.diff(lists, prepend=-1))
    qs, xs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for low, high in zip(cuts, [*cuts[1:], len(lists)], strict=True):
        which = lists[low]
        asked = np.flatnonzero(probed[:, which] & (own >= which))
        if not len(asked):
            continue
        distance = (squares[asked, which][None, :] + shift[low:high, None]) - 2 * looked_up(tables, codes[low:high], asked)
        i, q = np.nonzero(distance <= limit[low:high, None])
        i, q = i + low, asked[q]
        ok = np.concatenate([(y[q[s : s + 65536]] * x[i[s : s + 65536]]).sum(axis=1) for s in range(0, len(q), 65536)] or [np.empty(0)]) >= threshold
        ok &= a[q] != b[i]
        qs.append(q[ok])
        xs.append(i[ok])
    return np.concatenate(qs), np.concatenate(xs)


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One edge for each node of a group under the pairs (a, b), to the group's smallest."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, label = flat[: len(a)], flat[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]
