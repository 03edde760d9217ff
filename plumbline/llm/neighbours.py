"""Approximate nearest neighbours by cosine: balanced posting lists, a centroid graph in memory, distance-ratio pruning.

Method. Centroids are fitted on a sample (the vectors of least hash of their id, ``sample_per_list`` for each list): a balanced bisection splits
every part at the median along its direction of greatest spread. The number of lists grows with the table, one for ``list_rows``
vectors, up to ``most_lists``, which bounds what is broadcast. A graph joins each centroid to its nearest ones. Every row
is indexed: best-first search in the graph finds its nearest centroids, and it is replicated to each whose distance is within
``replicate_ratio`` of the nearest one (``replicas`` at most), which covers vectors at the borders. A list whose rows exceed ``shard_rows``, for
example because one vector is very frequent, is split into shards by a hash of the id. A query takes all lists whose centroid
is within a ratio of the distance of its nearest one and is scored against them exactly, in double precision: first against the nearest
list, whose k-th hit bounds what the other lists hand on, so hits grow with the queries and hardly with their lists.

The ratio is measured, not set: ``trial_queries`` queries are answered by brute force over all rows, and the ratio is the least
that holds the lists of a share ``target`` of their true neighbours. So a table in clusters is searched in a few lists, and one without
any structure in as many as its recall needs. A query with more lists within the ratio than its search keeps is ranked against all
centroids, so nothing caps the lists of a query. A query that finds fewer than ``k`` candidates is scored against all rows, block by block.

Defined results: null vectors, those with null or non-finite components, zero vectors, and vectors of another length than the
most frequent one take no part, neither as queries nor as candidates; rows without an id take no part; rows that repeat an
id are separate candidates for others but never for their own id; ties go to the smaller id; fewer than ``k`` candidates give
all of them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.frames import written

_HIT = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Settings:
    list_rows: int = 100
    most_lists: int = 16_384
    sample_per_list: int = 8
    least_sample: int = 20_000
    degree: int = 24
    beam: int = 48
    index_beam: int = 16
    replicas: int = 3
    replicate_ratio: float = 1.08
    target: float = 0.96
    trial_queries: int = 256
    shard_rows: int = 4_000
    query_rows: int = 500


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): ids and vectors (arrays of double) that take part."""
    v = vectors[vector_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) &
        F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class Reach:
    """Lists of a query: those within ``ratio`` times its distance from the nearest centroid, which counts as ``floor`` at least.

    ``want`` centroids are met by the search; ``most``, if set, is the number of lists a row is copied to at most.
    """

    ratio: float
    floor: float
    want: int
    most: int | None = None

    def holds(self, gap: np.ndarray) -> np.ndarray:
        limit = self.ratio * np.maximum(np.sqrt(gap[:, :1]), self.floor)
        inside = np.sqrt(gap) <= limit + 1e-9
        inside[:, 0] = True
        return inside


class Centroids:
    """Unit centroids and the graph of their nearest ones."""

    def __init__(self, points: np.ndarray, degree: int) -> None:
        self.points = points
        n = len(points)
        near = np.empty((n, min(degree, max(1, n - 1))), np.int64)
        for at in range(0, n, 512):
            close = points[at : at + 512] @ points.T
            close[np.arange(len(close)), np.arange(at, at + len(close))] = -3
            near[at : at + 512] = np.argsort(-close, axis=1, kind="stable")[:, : near.shape[1]]
        ring = np.stack([np.roll(np.arange(n), 1), np.roll(np.arange(n), -1)], 1)  # keeps the graph in one piece
        edges = np.sort(np.concatenate([near, ring], 1), axis=1)
        edges[:, 1:][edges[:, 1:] == edges[:, :-1]] = -1  # an edge twice
        self.edges = np.where(edges < 0, np.arange(n)[:, None], edges)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 64)).astype(int))

    def ranked(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All centroids, nearest first, and their squared distances."""
        gap = np.maximum(2 - 2 * queries @ self.points.T, 0)
        order = np.argsort(gap, axis=1, kind="stable")
        return order, np.take_along_axis(gap, order, 1)

    def search(self, queries: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query ``want`` near centroids, nearest first, and their squared distances, met by best-first search in the graph.

        All queries step at once: each expands the best of its ``want`` that it has not expanded yet, until none is left. Where that would meet
        much of the graph, all centroids are ranked instead.
        """
        c = len(self.points)
        if 4 * want >= c:
            order, gap = self.ranked(queries)
            return order[:, :want], gap[:, :want]
        n = len(queries)
        pad = max(0, want - len(self.entries))
        ids = np.concatenate([np.broadcast_to(self.entries, (n, len(self.entries))), np.full((n, pad), -1)], 1)
        gap = np.concatenate([2 - 2 * queries @ self.points[self.entries].T, np.full((n, pad), np.inf)], 1)
        if ids.shape[1] > want:
            best = np.argpartition(gap, want - 1, axis=1)[:, :want]
            ids, gap = np.take_along_axis(ids, best, 1), np.take_along_axis(gap, best, 1)
        done = ~np.isfinite(gap)
        active = np.arange(n)
        while len(active):
            open_ = np.where(done[active], np.inf, gap[active])
            at = open_.argmin(axis=1)
            going = np.isfinite(open_[np.arange(len(active)), at])
            active, at = active[going], at[going]
            if not len(active):
                break
            done[active, at] = True
            ahead = self.edges[ids[active, at]]
            far = 2 - 2 * np.einsum("qd,qed->qe", queries[active], self.points[ahead])
            known = (ahead[:, :, None] == ids[active][:, None, :]).any(2) | (far >= gap[active].max(1)[:, None])
            far[known] = np.inf
            every = np.concatenate([gap[active], far], 1)
            keep = np.argpartition(every, want - 1, axis=1)[:, :want]
            gap[active] = np.take_along_axis(every, keep, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], ahead], 1), keep, 1)
            done[active] = np.take_along_axis(np.concatenate([done[active], ~np.isfinite(far)], 1), keep, 1)
        order = np.argsort(gap, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.maximum(np.take_along_axis(gap, order, 1), 0)

    def within(self, queries: np.ndarray, reach: Reach) -> tuple[np.ndarray, np.ndarray]:
        """(query, centroid) for all centroids within the reach of each query."""
        order, gap = self.search(queries, min(reach.want, len(self.points)))
        inside = reach.holds(gap)
        full = np.flatnonzero(inside[:, -1]) if order.shape[1] < len(self.points) else np.zeros(0, int)
        row, column = np.nonzero(inside)
        lists = order[row, column]
        if len(full):
            order, gap = self.ranked(queries[full])
            more, column = np.nonzero(reach.holds(gap))
            rest = ~np.isin(row, full)
            row, lists = np.concatenate([row[rest], full[more]]), np.concatenate([lists[rest], order[more, column]])
        return row, lists


def fit(rows: DataFrame, settings: Settings) -> Centroids | None:
    """Centroids from a bounded sample; None for an empty table."""
    lists = min(settings.most_lists, max(1, -(-rows.count() // settings.list_rows)))
    size = max(settings.least_sample, settings.sample_per_list * lists)
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(size).toPandas()
    if drawn.empty:
        return None
    sample = unit(np.stack(drawn["v"].to_numpy()).astype(float))
    parts = [np.arange(len(sample))]
    heap = [(-len(sample), 0)]
    while len(heap) < min(lists, len(sample)):  # always the largest part: lists stay balanced
        part = parts[heapq.heappop(heap)[1]]
        x = sample[part] - sample[part].mean(0)
        axis = x[np.argmax((x * x).sum(1))]
        for _ in range(4):
            axis = x.T @ (x @ axis)
            axis /= np.linalg.norm(axis) or 1.0
        order = part[np.argsort(x @ axis, kind="stable")]
        for half in (order[: len(order) // 2], order[len(order) // 2 :]):
            heapq.heappush(heap, (-len(half), len(parts)))
            parts.append(half)
    means = np.stack([sample[parts[i]].mean(0) for _, i in heap])
    for _ in range(2):  # two rounds of moving to the mean of the nearest
        centres = unit(means + 1e-12).T
        nearest = np.concatenate([(sample[at : at + 512] @ centres).argmax(1) for at in range(0, len(sample), 512)])
        sums = np.zeros_like(means)
        np.add.at(sums, nearest, sample)
        count = np.bincount(nearest, minlength=len(means))
        means = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], means)
    return Centroids(unit(means + 1e-12), settings.degree)


def _assigned(rows: DataFrame, centroids, reach: Reach) -> DataFrame:
    """(list, first, id, v): each row once for every list within its reach; ``first`` marks the nearest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                v = part.column("v")
                q = unit(v.flatten().to_numpy().reshape(part.num_rows, -1))
                if reach.most is None:
                    r, lists = centroids.value.within(q, reach)
                else:
                    order, gap = centroids.value.search(q, min(reach.want, len(centroids.value.points)))
                    r, k = np.nonzero(reach.holds(gap)[:, : reach.most])
                    lists = order[r, k]
                first = np.zeros(len(r), bool)
                first[np.unique(r, return_index=True)[1]] = True
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array(first), part.column("id").take(pa.array(r)), v.take(pa.array(r))],
                                                 names=["list", "first", "id", "v"])

    return rows.mapInArrow(run, "list int, first boolean, id long, v array<double>")


def calibrated(vectors: DataFrame, queries: DataFrame, index: DataFrame, centroids: Centroids, k: int, settings: Settings) -> Reach:
    """The least reach that holds a list of a share ``target`` of the true neighbours of a bounded number of queries."""
    trial = written(queries.orderBy(F.xxhash64("id", F.lit("trial")), "id").limit(settings.trial_queries), "ann-trial")
    truth = _ranked(exhaustive(vectors, trial, k, settings), k)
    lists = index.select(F.col("id").alias("vec_id"), "list").distinct()
    where = truth.join(lists, "vec_id").groupBy("query_id", "vec_id").agg(F.collect_set("list").alias("lists"))
    held, drawn = where.collect(), trial.dropDuplicates(["id"]).collect()  # trial_queries times k rows at most
    if not held:
        return Reach(1.0, 0.0, settings.beam)
    gap = np.sqrt(np.maximum(2 - 2 * unit(np.array([r.v for r in drawn], float)) @ centroids.points.T, 0))
    nearest = gap.min(1)
    floor = max(1e-6, 0.1 * float(np.median(nearest)))
    row = {r.id: i for i, r in enumerate(drawn)}
    needed = np.sort([gap[row[r.query_id], r.lists].min() / max(nearest[row[r.query_id]], floor) for r in held])
    ratio = max(1.0, float(needed[int(np.ceil(settings.target * len(needed))) - 1]))
    found = (gap <= ratio * np.maximum(nearest, floor)[:, None] + 1e-9).sum(1)
    return Reach(ratio, floor, max(settings.beam, int(1.25 * np.quantile(found, 0.9))))


def recall(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 5, settings: Settings = Settings()) -> float:
    """Share of the true ``k`` nearest of ``queries`` that a search has found, against brute force over all rows."""
    truth = _ranked(exhaustive(vectors, queries, k, settings), k).select("query_id", "vec_id")
    both = truth.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")).distinct(), ["query_id", "vec_id"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]


def best(query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of one block for each query (its own id left out) that reach its bound, exact cosines, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    out = []
    for at in range(0, len(queries), 64):
        scores = np.clip(np.einsum("qd,nd->qn", queries[at : at + 64], vectors), -1.0, 1.0)
        scores[query_ids[at : at + 64, None] == ids[None, :]] = -np.inf
        for q, row, bound in zip(query_ids[at : at + 64], scores, bounds[at : at + 64], strict=True):
            least = -np.partition(-row, k - 1)[k - 1] if len(row) > k else -np.inf
            at_least = np.flatnonzero(row >= max(least, bound))
            top = at_least[np.argsort(-row[at_least], kind="stable")[:k]]
            out += [(q, ids[i], row[i]) for i in top if np.isfinite(row[i])]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def _met(queries: DataFrame, lists: DataFrame, by: list[str], k: int) -> DataFrame:
    """Queries and candidates that share ``by``, scored block by block."""

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return best(left["id"].to_numpy(), unit(np.stack(left["v"].to_numpy())), left["bound"].to_numpy(), right["id"].to_numpy(), unit(np.stack(right["v"].to_numpy())), k)

    queries = queries.toDF(*[f"q_{c}" for c in queries.columns]).select(*[F.col(f"q_{c}").alias(c) for c in queries.columns])  # may stem from the same rows
    return queries.groupBy(*by).cogroup(lists.groupBy(*by)).applyInPandas(score, _HIT)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best distinct (candidate, score) of each query; tasks send their k best of a query only."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): both inputs are ``usable`` rows (id, v)."""
    spark = vectors.sparkSession
    fitted = fit(vectors, settings)
    if fitted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sent = spark.sparkContext.broadcast(fitted)
    copies = Reach(settings.replicate_ratio, 0.0, settings.index_beam, settings.replicas)
    index = written(_assigned(vectors, sent, copies), "ann-index")
    probes = written(_assigned(queries, sent, calibrated(vectors, queries, index, fitted, k, settings)), "ann-probes")
    # One row per list, at most ``most_lists``: into how many shards and query blocks it is cut.
    cuts = index.groupBy("list").agg(F.ceil(F.count("*") / settings.shard_rows).cast("int").alias("shards")).join(
        probes.groupBy("list").agg(F.ceil(F.count("*") / settings.query_rows).cast("int").alias("blocks")), "list")
    cuts = F.broadcast(cuts)
    h = F.xxhash64("id")
    rows = index.join(cuts, "list").select("list", F.pmod(h, "shards").cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v")

    def scored(asked: DataFrame, bound) -> DataFrame:
        dealt = asked.join(cuts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(h, "blocks").cast("int").alias("block"), "id", "v", bound.alias("bound"))
        return written(_met(dealt, rows, ["list", "shard", "block"], k), "ann-hits")

    none = F.lit(float("-inf"))
    nearest = scored(probes.where("first"), none)
    bounds = _ranked(nearest, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    hits = nearest.unionAll(scored(probes.where(~F.col("first")).join(bounds, "id", "left"), F.coalesce("least", none)))
    short = queries.join(hits.select("query_id", "vec_id").distinct().groupBy("query_id").count().where(F.col("count") >= k).select(
        F.col("query_id").alias("id")), "id", "left_anti")
    return _ranked(hits.unionAll(exhaustive(vectors, short, k, settings)), k)


def exhaustive(vectors: DataFrame, queries: DataFrame, k: int, settings: Settings = Settings()) -> DataFrame:
    """Hits of each query among all rows, in blocks of rows by blocks of queries."""
    found = queries.count()
    if found == 0:
        return queries.sparkSession.createDataFrame([], _HIT)
    shards = max(1, -(-vectors.count() // settings.shard_rows))
    blocks = max(1, -(-found // settings.query_rows))
    h = F.xxhash64("id")
    rows = vectors.select(F.pmod(h, F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(h, F.lit(blocks)).cast("int").alias("block"), "id", "v", F.lit(float("-inf")).alias("bound"))
    return _met(asked, rows, ["shard", "block"], k)


def nearest_neighbours(vectors: DataFrame, every: int = 50, k: int = 5, settings: Settings = Settings()) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's own."""
    rows = usable(vectors)
    return search(rows, rows.where(F.col("id") % every == 0), k, settings)
