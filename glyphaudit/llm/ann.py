"""Operator 5: nearest neighbours by balanced posting lists.

Vectors are clustered into balanced lists. The list centroids are searched by a nearest-
neighbour graph kept in memory. A vector near a border is replicated to further lists whose
centroids are not much farther than the nearest one, and a query reads every list whose distance
is within a ratio of its nearest; no number of lists limits it. Lists that follow each other lie near each other
and are compared in groups, to which a query goes once, with the distance up to which it reads lists.
Within them, inner products in single precision with a bound on their error leave out what can't be
among the nearest; the rest is computed exactly.

The ratio is calibrated: ``SAMPLE_QUERIES`` queries are compared with all vectors, and it is the
least at which their lists hold the share ``RECALL`` of their true neighbours. Where vectors lie
in clusters that is a small part of the lists, where they are spread evenly it may be most of them. With
``exact=True`` a second pass reads every list that, by its centroid's distance and its radius,
could hold a vector nearer than the last one found, so that nothing is missed; queries that have
found fewer than they ask for take that pass in any case.

Largest inner product becomes least distance by one added coordinate, which fills all vectors
up to the length of the longest. Centroids are fitted on a bounded sample (``SAMPLE`` vectors at
most); every vector is indexed. Of equal vectors only the 21 with the least vec_ids can ever be
among the 20 nearest, so the others are left out of the lists without changing a result, and
equal query vectors are searched once.

Vectors that are null, zero, of another length than most, or that hold null or non-finite
components take no part, nor do rows without a vec_id. Components keep their type: doubles aren't
rounded. Rows that repeat a vec_id with the same
vector count once. Ties go to the smaller vec_id. With few vectors there is one list, and the
result is exact. An empty table gives no rows. Extra columns, under any name, are not read; there are no texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphaudit.llm.common import Scratch, release

NEAREST = 20
#: Vectors a list aims at, and lists and sampled vectors at most.
LIST_SIZE, MOST_LISTS, SAMPLE = 128, 8192, 65_536
#: A vector goes to its nearest list and to so many in all, whose distances are within this ratio of the nearest.
REPLICAS, REPLICA_RATIO = 2, 1.03
#: Queries that are compared with all vectors, and the share of their neighbours that the lists must hold.
SAMPLE_QUERIES, RECALL = 64, 0.96
#: Rows of lists that are compared at once, if that makes no more than ``GROUPS`` groups; larger lists are split by vec_id.
CELL_ROWS, GROUPS = 20_000, 256
#: Queries that one group is compared with at once.
BLOCK_QUERIES = 100_000
DEGREE, ENTRIES = 24, 64


def balanced_centroids(x: np.ndarray, n_lists: int, seed: int = 11) -> np.ndarray:
    """Means of leaves of equal size: the sample is halved along two-means axes again and again."""
    rng = np.random.default_rng(seed)
    leaves = [np.arange(len(x))]
    while len(leaves) < n_lists:
        cut = []
        for leaf in leaves:
            if len(leaf) < 2:
                cut.append(leaf)
                continue
            own = x[leaf]
            a, b = own[rng.choice(len(leaf), 2, replace=False)]
            for _ in range(4):
                near = ((own - a) ** 2).sum(1) < ((own - b) ** 2).sum(1)
                if near.all() or not near.any():
                    break
                a, b = own[near].mean(0), own[~near].mean(0)
            order = np.argsort(own @ (b - a), kind="stable")
            half = len(leaf) // 2
            cut += [leaf[order[:half]], leaf[order[half:]]]
        if len(cut) == len(leaves):
            break
        leaves = cut
    return np.stack([x[leaf].mean(0) for leaf in leaves]).astype(np.float32)


class CentroidGraph:
    """Centroids with links to their nearest ones; a search follows links from fixed entries."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids.astype(np.float32)
        self.norm = (self.c**2).sum(1)
        n = len(self.c)
        k = min(DEGREE, n - 1)
        self.links = np.zeros((n, max(k, 1)), np.int32)
        for at in range(0, n, 1024) if k else ():
            d = self.norm[None, :] - 2 * self.c[at : at + 1024] @ self.c.T
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            self.links[at : at + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k]
        if k > 8:  # a few far links keep the graph connected
            self.links[:, -3:] = np.random.default_rng(5).integers(0, n, (n, 3))
        self.entries = np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int32))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of about the ``beam`` nearest centroids of each query, nearest first; -1 fills up."""
        n, b = len(self.c), len(q)
        q = q.astype(np.float32)
        base = (q**2).sum(1)[:, None]
        seen = np.zeros((b, n), bool)
        seen[:, self.entries] = True
        ids = np.full((b, beam), -1, np.int32)
        dist = np.full((b, beam), np.inf, np.float32)
        first = self.norm[self.entries][None, :] - 2 * q @ self.c[self.entries].T
        width = min(beam, len(self.entries))
        order = np.argsort(first, axis=1, kind="stable")[:, :width]
        ids[:, :width] = self.entries[order]
        dist[:, :width] = np.take_along_axis(first, order, 1)
        done = ids < 0
        rows = np.arange(b)
        while True:
            rows = rows[~done[rows].all(1)]
            if not len(rows):
                break
            best = np.argmin(done[rows], axis=1)  # the beam is sorted: the first that is not done
            done[rows, best] = True
            near = self.links[ids[rows, best]]
            d = self.norm[near] - 2 * np.einsum("bd,bkd->bk", q[rows], self.c[near])
            ordered = np.sort(near, axis=1)
            if (ordered[:, 1:] == ordered[:, :-1]).any():
                for i in np.flatnonzero((ordered[:, 1:] == ordered[:, :-1]).any(1)):
                    _, once = np.unique(near[i], return_index=True)
                    again = np.ones(len(near[i]), bool)
                    again[once] = False
                    d[i, again] = np.inf
            d[seen[rows[:, None], near]] = np.inf
            seen[rows[:, None], near] = True
            all_d = np.concatenate([dist[rows], d], axis=1)
            all_i = np.concatenate([ids[rows], near], axis=1)
            all_done = np.concatenate([done[rows], ~np.isfinite(d)], axis=1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            dist[rows] = np.take_along_axis(all_d, order, 1)
            ids[rows] = np.take_along_axis(all_i, order, 1)
            done[rows] = np.take_along_axis(all_done, order, 1) | ~np.isfinite(dist[rows])
        ids[~np.isfinite(dist)] = -1
        return ids, np.sqrt(np.maximum(dist + base, 0))

    def all(self, q: np.ndarray) -> np.ndarray:
        """Distances of each query from all centroids."""
        return np.sqrt(np.maximum((q**2).sum(1)[:, None] + self.norm[None, :] - 2 * q @ self.c.T, 0))

    def nearest(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``search``; a step of it costs as much as some hundred distances, so a wide beam is compared with all."""
        if len(self.c) > 256 * beam:
            return self.search(q, beam)
        dist = self.all(q.astype(np.float32))
        order = np.argpartition(dist, beam - 1, axis=1)[:, :beam] if beam < len(self.c) else np.broadcast_to(np.arange(len(self.c)), dist.shape)
        near = np.take_along_axis(dist, order, 1)
        sorted_ = np.argsort(near, axis=1, kind="stable")
        return np.take_along_axis(order, sorted_, 1).astype(np.int32), np.take_along_axis(near, sorted_, 1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    values = column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten()
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def filled(x: np.ndarray, longest: float) -> np.ndarray:
    """In units of the longest vector, with the coordinate that fills each up to its length."""
    x = x.astype(np.float64) / longest
    rest = np.sqrt(np.maximum(1 - (x**2).sum(1), 0))
    return np.concatenate([x, rest[:, None]], axis=1).astype(np.float32)


def aimed(q: np.ndarray) -> np.ndarray:
    """Queries of length one: their order of neighbours stays, distances become comparable."""
    q = q.astype(np.float64)
    q = q / np.abs(q).max(1)[:, None]
    q = q / np.sqrt((q**2).sum(1))[:, None]
    return np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32)


def _longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, components and the greatest Euclidean length of a batch, without overflow."""
    for batch in batches:
        if batch.num_rows:
            dim = len(batch.column("embedding")[0])
            x = _matrix(batch.column("embedding"), dim)
            most = np.abs(x).max(1)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([dim]), pa.array([float((most * np.sqrt(((x / most[:, None]) ** 2).sum(1))).max())])], ["n", "d", "most"])


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the vectors that take part."""
    kind = vectors.schema["embedding"].dataType
    kept = kind if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)) else T.ArrayType(T.DoubleType())
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kept).alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    most = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("embedding") == (most["d"] if most else 0))


def _posted(batch: pa.RecordBatch, ids: np.ndarray, take: np.ndarray, dist: np.ndarray) -> pa.RecordBatch:
    rows = pa.array(np.repeat(np.arange(len(take)), take.sum(1)))
    return pa.RecordBatch.from_arrays([pa.array(ids[take]), pa.array(dist[take].astype(np.float64)), batch.column("vec_id").take(rows), batch.column("embedding").take(rows)], ["list", "dist", "vec_id", "embedding"])


def _placing(graph, dim: int, longest: float) -> Callable:
    """Each vector with its nearest list and those within REPLICA_RATIO."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, dist = graph.value.nearest(filled(_matrix(part.column("embedding"), dim), longest), 8 * REPLICAS)
                ids, dist = ids[:, :REPLICAS], dist[:, :REPLICAS]
                yield _posted(part, ids, (ids >= 0) & (dist <= REPLICA_RATIO * dist[:, :1] + 1e-6), dist)

    return work


def _sent(batch: pa.RecordBatch, reads: np.ndarray, limit: np.ndarray, starts: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
    """Each query once for every cell of the groups in which it reads a list."""
    row, group = np.nonzero(np.logical_or.reduceat(reads, starts, axis=1))
    times = cells[group]
    row, group = np.repeat(row, times), np.repeat(group, times)
    cell = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    return pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(limit[row].astype(np.float64)), batch.column("vec_id").take(pa.array(row)), batch.column("embedding").take(pa.array(row))], ["group", "cell", "limit", "vec_id", "embedding"])


def _probing(graph, dim: int, ratio: float, width: int, starts: np.ndarray, cells: np.ndarray) -> Callable:
    """Each query with the distance within the ratio, up to which it reads every list; the beam is widened for queries that reach its end."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(graph.value.c)
        for batch in batches:
            part, beam = batch, min(width, n)
            while part.num_rows:
                more = []
                for at in range(0, part.num_rows, 512):
                    own = part.slice(at, 512)
                    ids, dist = graph.value.nearest(aimed(_matrix(own.column("embedding"), dim)), beam)
                    limit = ratio * dist[:, 0].astype(np.float64) + 1e-6
                    take = (ids >= 0) & (dist <= limit[:, None])
                    full = take.all(1) & (beam < n)
                    more.append(full)
                    reads = np.zeros((len(ids), n), bool)
                    reads[np.nonzero(take)[0], ids[take]] = True
                    yield _sent(own.filter(pa.array(~full)), reads[~full], limit[~full], starts, cells)
                part, beam = part.filter(pa.array(np.concatenate(more))), min(2 * beam, n)

    return work


def _further(graph, dim: int, longest: float, radius: np.ndarray, starts: np.ndarray, cells: np.ndarray) -> Callable:
    """Each query, with the score ``least`` of its last neighbour, and all lists that could hold a better one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = _matrix(part.column("embedding"), dim)
                least = part.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
                big = np.abs(x).max(1)
                limit = np.sqrt(np.maximum(2 - 2 * np.nan_to_num(least / big / longest / np.sqrt(((x / big[:, None]) ** 2).sum(1)), nan=-1.0), 0)) + 5e-3
                yield _sent(part, graph.value.all(aimed(x)) - radius[None, :] <= limit[:, None], limit, starts, cells)

    return work


def calibrated(vectors: DataFrame, lists: DataFrame, asked: DataFrame, graph, dim: int, k: int) -> tuple[float, int]:
    """The probe ratio that a sample of queries needs, and the most lists that any of them then reads."""
    spark = vectors.sparkSession
    drawn = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_QUERIES).toArrow()
    if not drawn.num_rows:
        return 1.0, 1
    q_ids, q = drawn.column("vec_id").to_numpy(), _matrix(drawn.column("embedding"), dim)
    shared = spark.sparkContext.broadcast((q_ids, q))  # SAMPLE_QUERIES vectors

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, own = shared.value
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            score = own @ _matrix(batch.column("embedding"), dim).T
            score[own_ids[:, None] == ids[None, :]] = -np.inf
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own_ids, best.shape[1])), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(score, best, 1).ravel())], ["query_id", "vec_id", "score"])

    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = vectors.mapInArrow(nearest, "query_id long, vec_id long, score double").withColumn("rank", F.row_number().over(rank)).where((F.col("rank") <= k) & (F.col("score") > float("-inf")))
    held = lists.select("list", "vec_id").join(F.broadcast(true.select("query_id", "vec_id")), "vec_id").collect()  # k * SAMPLE_QUERIES * REPLICAS rows
    g = graph.value
    dist = np.sqrt(np.maximum(1 + g.norm[None, :] - 2 * aimed(q) @ g.c.T, 0))
    place = {int(i): n for n, i in enumerate(q_ids)}
    need: dict[tuple[int, int], float] = {}
    for r in held:
        row = dist[place[r["query_id"]]]
        at = (r["query_id"], r["vec_id"])
        need[at] = min(need.get(at, np.inf), float(row[r["list"]] / max(row.min(), 1e-6)))
    ratio = float(np.quantile(list(need.values()), RECALL, method="higher")) if need else 1.0
    return ratio, int((dist <= ratio * dist.min(1)[:, None] + 1e-6).sum(1).max())


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best rows; score falling, then vec_id."""
    order = np.lexsort((vec, -score, query))
    q = query[order]
    new = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(q) else np.zeros(0, int)
    return order[rank < k]


def _gathered(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first list of each group of lists, and the cells of each group: one, or more for a list of more than ``most`` rows."""
    starts, cells, held = [0], [], 0
    for i, n in enumerate(counts.tolist()):
        if i > starts[-1] and held + n > most:
            cells.append(-(-held // most))
            starts.append(i)
            held = 0
        held += n
    return np.array(starts), np.maximum(np.array([*cells, -(-held // most)]), 1)


def _candidates(q: np.ndarray, v: np.ndarray, q32: np.ndarray, v32: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and row numbers of all pairs that can be among a query's k nearest rows.

    ``q32`` and ``v32`` are of length one at most, so a product of them is off by no more than ``slack``.
    The k-th best of some disjoint parts' best rows is no better than the k-th best row.
    """
    n = v.shape[0]
    if n <= k:
        return np.divmod(np.arange(len(q) * n), n)
    rough, slack, parts = q32 @ v32.T, 2.0 * (q.shape[1] + 4) * 2.0**-23, n // 32
    best = rough[:, : 32 * parts].reshape(len(q), 32, parts).max(1) if parts >= 2 * k else rough
    least = np.partition(best, -k, axis=1)[:, -k]
    found = np.flatnonzero(rough >= (least - slack)[:, None])
    if len(found) > 64 * k * len(q):  # too much alike for single precision
        rough = q @ v.T
        least = np.partition(rough, -k, axis=1)[:, -k]
        found = np.flatnonzero(rough >= (least - 1e-9 * (1 + np.abs(least)))[:, None])
    return np.divmod(found, n)


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Summed in one order for every pair, so equal vectors get equal scores."""
    out = np.zeros(len(q))
    for i in range(q.shape[1]):
        out += q[:, i] * v[:, i]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """In single precision, each vector by its own length."""
    x = x / np.abs(x).max(1)[:, None]
    return (x / np.sqrt((x**2).sum(1))[:, None]).astype(np.float32)


def search(vectors: DataFrame, queries: Column, k: int = NEAREST, exact: bool = False) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows where ``queries`` (a condition on vec_id) holds."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = scratch.put(usable(vectors).distinct(), "rows")
    # Limited before it is dealt out as well, so a vector that many rows have is k + 1 rows a task.
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    kept = scratch.put(rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy"), "kept")
    facts = kept.select("embedding").mapInArrow(_longest, "n long, d long, most double").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("most").alias("most"), F.max("d").alias("d")).first()
    n, dim, longest = facts["n"], facts["d"] or 1, float(facts["most"] or 1.0)
    n_lists = 1 << max(0, int(np.log2(max(1, min(MOST_LISTS, n / LIST_SIZE)))))
    part = min(1.0, min(SAMPLE, 32 * n_lists) / max(1, n))
    drawn = kept.where(F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(1 << 20)) < int(part * (1 << 20)) + 1).select("embedding").limit(SAMPLE * 2).toArrow()
    x = filled(_matrix(drawn.column(0), dim), longest) if drawn.num_rows else np.zeros((1, dim + 1), np.float32)
    graph = spark.sparkContext.broadcast(CentroidGraph(balanced_centroids(x, n_lists)))  # MOST_LISTS centroids at most

    posted = "list int, dist double, vec_id long, embedding " + kept.schema["embedding"].dataType.simpleString()
    lists = scratch.put(kept.mapInArrow(_placing(graph, dim, longest), posted), "lists")
    facts = lists.groupBy("list").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).collect()  # a row a list
    counts, radius = np.zeros(len(graph.value.c), np.int64), np.zeros(len(graph.value.c))
    for r in facts:
        counts[r["list"]], radius[r["list"]] = r["n"], r["radius"]
    starts, cells = _gathered(counts, max(CELL_ROWS, int(counts.sum()) // GROUPS))
    groups = np.searchsorted(starts, np.arange(len(counts)), "right") - 1
    layout = spark.createDataFrame([(i, int(g), int(cells[g])) for i, g in enumerate(groups)], "list int, group int, cells int")

    asked = rows.where(queries)
    distinct = scratch.put(asked.groupBy("embedding").agg(F.min("vec_id").alias("vec_id")), "distinct")
    ratio, width = calibrated(kept, lists, distinct, graph, dim, k)
    n_asked = distinct.count()
    n_buckets, n_blocks = max(8, min(65_536, n_asked // 100)), max(1, -(-n_asked // BLOCK_QUERIES))
    members = lists.select("list", "vec_id", "embedding").join(F.broadcast(layout), "list").withColumn("cell", F.pmod(F.xxhash64("vec_id"), "cells").cast("int")).drop("cells")
    members = members.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def compared(left: pa.Table, right: pa.Table, slack: np.ndarray | None) -> pa.Table:
        """The best of a cell for each query, packed by bucket of queries. Queries near each other read the same lists at once."""
        buckets, packed = [], []
        if left.num_rows and right.num_rows:
            g, left = graph.value, left.sort_by("list")
            lists, size = np.unique(left.column("list").to_numpy(), return_counts=True)
            v_ids, v = left.column("vec_id").to_numpy(), _matrix(left.column("embedding"), dim)
            big = np.abs(v).max()
            v32 = (v / big / np.sqrt(((v / big) ** 2).sum(1).max())).astype(np.float32)
            right = right.combine_chunks()
            q_ids, limit = right.column("vec_id").to_numpy(), right.column("limit").to_numpy()
            x = right.column("embedding")
            first = np.concatenate([np.sqrt(np.maximum(1 + g.norm[lists] - 2 * aimed(_matrix(x.slice(at, 4096), dim)) @ g.c[lists].T, 0)).argmin(1) for at in range(0, len(x), 4096)])
            order = np.argsort(first, kind="stable")
            parts, before = [], b""
            for at in range(0, len(order), 256):
                own = order[at : at + 256]
                q = _matrix(x.take(pa.array(own)), dim)
                near = np.sqrt(np.maximum(1 + g.norm[lists] - 2 * aimed(q) @ g.c[lists].T, 0))
                read = (near - (0 if slack is None else slack[lists]) <= limit[own][:, None] + 1e-6).any(0)
                if not read.any():
                    continue
                if read.tobytes() != before:
                    before, rows = read.tobytes(), np.flatnonzero(np.repeat(read, size))
                    rows = rows[np.unique(v_ids[rows], return_index=True)[1]]  # replicas once
                    some_ids, some, some32 = v_ids[rows], v[rows], v32[rows]
                a, b = _candidates(q, some, _unit(q), some32, k + 1)
                score = np.concatenate([_scores(q[a[i : i + 65_536]], some[b[i : i + 65_536]]) for i in range(0, len(a), 65_536)])
                best = _best(a, some_ids[b], score, k + 1)
                parts.append((q_ids[own[a[best]]], some_ids[b[best]], score[best]))
            if parts:
                a, b, s = map(np.concatenate, zip(*parts, strict=True))
                order = np.argsort(a % n_buckets, kind="stable")
                a, b, s = a[order], b[order], s[order]
                to, at = np.unique(a % n_buckets, return_index=True)
                for t, i, j in zip(to.tolist(), at, [*at[1:], len(a)], strict=True):
                    buckets.append(t)
                    packed.append(np.uint64(j - i).tobytes() + a[i:j].tobytes() + b[i:j].tobytes() + s[i:j].tobytes())
        return pa.table([pa.array(buckets, pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "packed"])

    def merge(table: pa.Table) -> pa.Table:
        parts = []
        for data in table.column("packed").to_pylist():
            n = int(np.frombuffer(data, np.uint64, 1)[0])
            parts.append((np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.int64, n, 8 + 8 * n), np.frombuffer(data, np.float64, n, 8 + 16 * n)))
        a, b, s = map(np.concatenate, zip(*parts, strict=True))
        order = np.lexsort((b, a))  # a replicated vector has the same score in every list
        a, b, s = a[order], b[order], s[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        a, b, s = a[new], b[new], s[new]
        best = _best(a, b, s, k + 1)
        return pa.table([pa.array(a[best]), pa.array(b[best]), pa.array(s[best])], names=["asked", "vec_id", "score"])

    def found_in(probes: DataFrame, name: str, slack: np.ndarray | None = None) -> DataFrame:
        """``asked, vec_id, score``: the k + 1 best of the lists that each query reads."""
        each = probes.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(n_blocks)).cast("int"))
        at = ["group", "cell", "block"]
        met = members.groupBy(*at).cogroup(each.groupBy(*at)).applyInArrow(lambda left, right: compared(left, right, slack), "bucket int, packed binary")
        return scratch.put(met.groupBy("bucket").applyInArrow(merge, "asked long, vec_id long, score double"), name)

    sent = "group int, cell int, limit double, vec_id long, embedding " + kept.schema["embedding"].dataType.simpleString()
    found = found_in(distinct.mapInArrow(_probing(graph, dim, ratio, max(32, width + width // 4), starts, cells), sent), "found")
    last = found.groupBy("asked").agg(F.count("*").alias("m"), F.min("score").alias("least")).withColumnRenamed("asked", "vec_id")
    open_ = distinct.join(last, "vec_id", "left").select("vec_id", "embedding", F.coalesce("m", F.lit(0)).alias("m"), "least")
    if not exact:  # queries whose lists hold too few vectors go on to as many lists as they need
        open_ = open_.where(F.col("m") < min(k + 1, n))
    open_ = scratch.put(open_.select("vec_id", "embedding", F.when(F.col("m") > k, F.col("least")).alias("least")), "open")
    if open_.limit(1).count():
        more = found_in(open_.mapInArrow(_further(graph, dim, longest, radius, starts, cells), sent), "more", radius)
        found = found.join(open_.select(F.col("vec_id").alias("asked")), "asked", "left_anti").union(more)
    who = asked.select(F.col("vec_id").alias("query_id"), "embedding").join(distinct.withColumnRenamed("vec_id", "asked"), "embedding").select("query_id", "asked")
    ranked = who.join(found, "asked").where("vec_id <> query_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = ranked.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    out = scratch.put(out, "out")
    scratch.drop("rows", "kept", "lists", "distinct", "found", "open", "more")
    release(spark)
    return out
