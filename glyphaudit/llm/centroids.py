"""Operator 11: centroid clustering in exact integers, filtered through ball trees.

Vectors become integers floor(scale * x). Each task cuts its vectors into blocks and builds a
ball tree over each: a node has a run of the block's vectors, their count and componentwise
integer sum, and a radius around their mean. The trees are written once to the shared folder.
A round walks them with the current centroids: a ball whose nearest centroid is nearer than any
other by more than its diameter goes to it whole, by count and sum, without its vectors being
looked at; else its children are asked, without the centroids that are already out. Leaves
compare their vectors exactly. Only sums by centroid and component leave a task.

Vectors that are null, have another length or hold null or non-finite components take no part.
Ties go to the centroid with the smaller number; a centroid without vectors stays. Repeated rows
count as often as they occur; among equal start hashes (repeated vec_ids) the smaller vector comes
first, a null vec_id last. With fewer vectors than centroids each is one; an empty table
gives no rows. Extra columns are not read. A component beyond 2^27 after scaling raises an error, as
its squared distances don't fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphaudit.llm.common import Scratch, trim

#: Vectors of a tree; bounds a task's memory.
BLOCK = 16_384
#: Vectors of a leaf.
LEAF = 24
#: Up to here all products and sums of 64 components are exact as doubles, and up to _LARGEST as longs.
_EXACT_DOUBLE, _LARGEST = 1 << 21, 1 << 27

TREES = "ids array<bigint>, vectors binary, wide boolean, first array<int>, last array<int>, child array<int>, radius array<double>, sums binary"
SUMS = "cluster int, place int, total bigint"
ASSIGNED = "vec_id bigint, cluster int, distance bigint"


class Tree(NamedTuple):
    """A block in tree order. Node ``i`` has the vectors ``first[i]`` to ``last[i]``; its children are ``child[i]`` and the next, 0 for a leaf."""

    vectors: np.ndarray
    first: np.ndarray
    last: np.ndarray
    child: np.ndarray
    radius: np.ndarray
    sums: np.ndarray


def usable(vector: Column, size: int) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == size) & finite, F.lit(False))


def scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    out = np.floor(vectors.astype(np.float64) * scale)
    if out.size and np.abs(out).max() > _LARGEST:
        raise ValueError("a component is too large for exact distances")
    return out.astype(np.int64)


def build(vectors: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, Tree]:
    """The tree over integer vectors, and their order in it. Balls are halved by the projection on the line between two far vectors."""
    order, nodes, todo = np.arange(len(vectors)), [(0, len(vectors))], [0]
    child, radius, sums = [0], [0.0], [None]
    real = vectors.astype(np.float64)
    while todo:
        at = todo.pop()
        a, b = nodes[at]
        own = real[order[a:b]]
        sums[at] = vectors[order[a:b]].sum(0)
        far = np.sqrt(((own - sums[at] / (b - a)) ** 2).sum(1))
        # Rounding must not make a ball too small.
        radius[at] = float(far.max()) * (1 + 1e-9) + 1e-9
        if b - a <= leaf or far.max() == 0:
            continue
        end = own[far.argmax()]
        other = own[((own - end) ** 2).sum(1).argmax()]
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(own @ (other - end), half)]
        child[at] = len(nodes)
        for part in ((a, a + half), (a + half, b)):
            todo.append(len(nodes))
            nodes.append(part)
            child.append(0)
            radius.append(0.0)
            sums.append(None)
    first, last = np.array(nodes).T
    return order, Tree(vectors[order], first, last, np.array(child), np.array(radius), np.array(sums))


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors by centroids."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) <= _EXACT_DOUBLE and vectors.shape[1] <= 64:
        x, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((vectors.astype(np.int64) - c) ** 2).sum(1) for c in centroids], 1)


def walk(tree: Tree, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | int]]:
    """``(nodes, cluster of each)`` for whole balls, and ``(nodes, -1)`` for leaves to be compared."""
    at, out = np.zeros(1, np.int64), np.zeros((1, len(centroids)), bool)
    real = centroids.astype(np.float64)
    while len(at):
        count = tree.last[at] - tree.first[at]
        middle = tree.sums[at] / count[:, None]
        far = np.sqrt(np.maximum(((middle[:, None, :] - real) ** 2).sum(2), 0))
        far[out] = np.inf
        best = far.argmin(1)
        least = far[np.arange(len(at)), best]
        # A margin for rounding, so that ties are always compared exactly.
        out = out | (far > (least + 2 * tree.radius[at] + 1e-6 + 1e-9 * least)[:, None])
        whole = out.sum(1) == len(centroids) - 1
        if whole.any():
            yield at[whole], best[whole]
        leaf = ~whole & (tree.child[at] == 0)
        if leaf.any():
            yield at[leaf], -1
        down = ~whole & ~leaf
        at = np.concatenate([tree.child[at[down]], tree.child[at[down]] + 1])
        out = np.concatenate([out[down], out[down]])


def _members(tree: Tree, nodes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.arange(tree.first[n], tree.last[n]) for n in nodes])


def sums_of(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and componentwise sums of the vectors nearest to each centroid."""
    counts, totals = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    for nodes, cluster in walk(tree, centroids):
        if isinstance(cluster, int):
            rows = tree.vectors[_members(tree, nodes)].astype(np.int64)
            cluster, n = distances(rows, centroids).argmin(1), 1
        else:
            rows, n = tree.sums[nodes], tree.last[nodes] - tree.first[nodes]
        np.add.at(counts, cluster, n)
        np.add.at(totals, cluster, rows)
    return counts, totals


def assign(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each vector, in tree order."""
    cluster, distance = np.zeros(len(tree.vectors), np.int64), np.zeros(len(tree.vectors), np.int64)
    for nodes, found in walk(tree, centroids):
        if isinstance(found, int):
            at = _members(tree, nodes)
            far = distances(tree.vectors[at], centroids)
            cluster[at] = far.argmin(1)
            distance[at] = far[np.arange(len(at)), cluster[at]]
        else:
            for c in np.unique(found):
                at = _members(tree, nodes[found == c])
                cluster[at] = c
                distance[at] = distances(tree.vectors[at], centroids[c : c + 1])[:, 0]
    return cluster, distance


# -- in Spark ---------------------------------------------------------------------------------


def trees(vectors: DataFrame, size: int, scale: int, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """One row for each block of a task's ``(vec_id, embedding)`` rows."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(ids: list, held: np.ndarray) -> pa.RecordBatch:
            order, t = build(held, leaf)
            wide = bool(np.abs(t.vectors).max() >= 1 << 15)
            kept = t.vectors.astype("<i8" if wide else "<i2").tobytes()
            values = [[ids[i] for i in order], kept, wide, t.first.tolist(), t.last.tolist(), t.child.tolist(), t.radius.tolist(), t.sums.astype("<i8").tobytes()]
            kinds = [pa.list_(pa.int64()), pa.binary(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.binary()]
            return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in TREES.split(", ")])

        ids, held, n = [], [], 0
        for batch in batches:
            whole = scaled(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size), scale)
            names = batch.column(0).to_pylist()
            for a in range(0, len(names), block):
                ids, held, n = ids + names[a : a + block], [*held, whole[a : a + block]], n + len(names[a : a + block])
                if n >= block:
                    yield row(ids, np.concatenate(held))
                    ids, held, n = [], [], 0
        if n:
            yield row(ids, np.concatenate(held))
        trim()

    return vectors.mapInArrow(blocks, TREES)


def _loaded(row: dict, size: int) -> Tree:
    vectors = np.frombuffer(row["vectors"], "<i8" if row["wide"] else "<i2").reshape(-1, size)
    return Tree(vectors, np.array(row["first"]), np.array(row["last"]), np.array(row["child"]), np.array(row["radius"]), np.frombuffer(row["sums"], "<i8").reshape(-1, size))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _round(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round. A task sends one sum for each centroid and component, and the counts as component -1."""
    k, size = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for row in _rows(batches):
            n, s = sums_of(_loaded(row, size), centroids)
            counts, totals = counts + n, totals + s
        places = np.tile(np.arange(-1, size, dtype=np.int32), k)
        yield pa.record_batch([pa.array(np.repeat(np.arange(k, dtype=np.int32), size + 1)), pa.array(places), pa.array(np.concatenate([counts[:, None], totals], 1).ravel())], names=["cluster", "place", "total"])

    found = blocks.mapInArrow(add, SUMS).groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    total = {(r["cluster"], r["place"]): int(r["total"]) for r in found}
    means = [[total[c, p] // total[c, -1] if total.get((c, -1)) else int(centroids[c, p]) for p in range(size)] for c in range(k)]
    return np.array(means, np.int64)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every vector that takes part."""
    scratch = Scratch(vectors.sparkSession, "centroids")
    kept = vectors.where(usable(F.col("embedding"), size)).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = kept.orderBy(drawn.asc_nulls_last(), "embedding").limit(k).collect()
    centroids = scaled(np.array([r["embedding"] for r in start], np.float64).reshape(-1, size), scale)
    blocks = scratch.put(trees(kept, size, scale, block, leaf), "trees")
    for _ in range(rounds if len(start) else 0):
        centroids = _round(blocks, centroids)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            found, far = assign(_loaded(row, size), centroids)
            yield pa.record_batch([pa.array(row["ids"], pa.int64()), pa.array(found.astype(np.int32)), pa.array(far)], names=["vec_id", "cluster", "distance"])
        trim()

    assigned = scratch.put(blocks.mapInArrow(last, ASSIGNED), "assigned")
    # As many rows as there are centroids.
    inertia = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    hashes = {c: hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for c, row in enumerate(centroids.tolist())}
    spark = vectors.sparkSession
    totals = spark.createDataFrame([(c, n, sum(inertia.values()), hashes[c]) for c, n in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1) -> str:
    """The same in DuckDB, every vector against every centroid in each round."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
near{i} AS (SELECT vec_id, v, min({{'distance': list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': c}}) AS best FROM vectors, cent{i} GROUP BY id, vec_id, v)""")
        if i < rounds:
            steps.append(f"""
part{i} AS (SELECT best.c AS c, p, sum(v[p])::HUGEINT AS s, count(*)::HUGEINT AS n FROM near{i}, (SELECT unnest(range(1, {size} + 1)) AS p) GROUP BY ALL),
mean{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS m FROM part{i} GROUP BY c),
cent{i + 1} AS (SELECT cent{i}.c, coalesce(mean{i}.m, cent{i}.m) AS m FROM cent{i} LEFT JOIN mean{i} USING (c))""")
    return f"""
WITH vectors AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cent0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v AS m FROM vectors ORDER BY c LIMIT {k}),{",".join(steps)}
SELECT vec_id, best.c::INT AS cluster, best.distance AS distance, (sum(best.distance) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM near{rounds} JOIN cent{rounds} ON best.c = cent{rounds}.c"""
