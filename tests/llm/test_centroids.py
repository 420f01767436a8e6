"""Ball-tree clustering beside a plain one in Python integers."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphaudit.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cid string, cluster string, ids string"


def brute(rows, k, rounds, size, scale):
    kept = [(i, tuple(int(np.floor(np.float64(x) * scale)) for x in v)) for i, v, *_ in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [v for _, v in start[:k]]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for n in range(rounds + 1):
        near = [min((dist(v, c), j) for j, c in enumerate(cents)) for _, v in kept]
        if n < rounds:
            for j in range(len(cents)):
                own = [v for (_, v), (_, c) in zip(kept, near, strict=True) if c == j]
                if own:
                    cents[j] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    total = sum(d for d, _ in near)
    by = [sum(d for d, c in near if c == j) for j in range(len(cents))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, d, by[c], total, sha[c]) for (i, _), (d, c) in zip(kept, near, strict=True)), key=repr)


def clustered(n, size, seed):
    rng = random.Random(seed)
    hubs = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(7)]
    return [(i, [x + rng.gauss(0, 0.02 if i % 3 else 0.4) for x in hubs[i % 7]], "x", "x", "x") for i in range(n)]


@pytest.mark.parametrize(("block", "leaf"), [(16384, 24), (50, 3), (7, 1)])
def test_equals_brute_force(spark, block, leaf):
    rows = clustered(300, 6, 1)
    # Null and odd vectors, one and the same vector often (ties between centroids), ids twice and null.
    rows += [(1000, None, "", "", ""), (1001, [1.0] * 5, "", "", ""), (1002, [1.0] * 5 + [None], "", "", ""), (1003, [float("nan")] + [0.0] * 5, "", "", ""), (1004, [float("-inf")] + [0.0] * 5, "", "", "")]
    rows += [(2000 + i, [0.5] * 6, "", "", "") for i in range(60)] + [(3, [0.25] * 6, "", "", ""), (3, [-0.25] * 6, "", "", ""), (None, [0.1] * 6, "", "", ""), (None, [0.1] * 6, "", "", "")]
    out = centroids.cluster(spark.createDataFrame(rows, SCHEMA), k=9, rounds=3, size=6, block=block, leaf=leaf)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(rows, 9, 3, 6, 64)


def test_few_vectors_and_none(spark):
    rows = clustered(5, 6, 2)
    out = centroids.cluster(spark.createDataFrame(rows, SCHEMA), size=6)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(rows, 16, 3, 6, 64)
    assert centroids.cluster(spark.createDataFrame([(1, None, "", "", "")], SCHEMA)).count() == 0


def test_whole_balls_go_without_their_vectors():
    rng = np.random.default_rng(3)
    hubs = rng.integers(-4000, 4000, (8, 16))
    vectors = (hubs[np.arange(4000) % 8] + rng.integers(-20, 20, (4000, 16))).astype(np.int64)
    _, tree = centroids.build(vectors)
    compared = sum(len(centroids._members(tree, nodes)) for nodes, found in centroids.walk(tree, hubs) if isinstance(found, int))
    counts, sums = centroids.sums_of(tree, hubs)
    near = centroids.distances(vectors, hubs).argmin(1)
    assert compared < 400
    assert counts.tolist() == np.bincount(near, minlength=8).tolist()
    assert all((sums[c] == vectors[near == c].sum(0)).all() for c in range(8))


def test_ties_go_to_the_smaller_number():
    _, tree = centroids.build(np.array([[1, 0]] * 40 + [[0, 3]] * 5, np.int64), leaf=2)
    assert set(centroids.assign(tree, np.array([[0, 0], [2, 0], [0, 0]], np.int64))[0]) == {0}


def test_large_components_stay_exact():
    rng = np.random.default_rng(5)
    x, c = rng.integers(-(1 << 27), 1 << 27, (20, 64)), rng.integers(-(1 << 27), 1 << 27, (3, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, m, strict=True)) for m in c] for v in x]
    assert centroids.distances(x, c).tolist() == want
    with pytest.raises(ValueError, match="too large"):
        centroids.scaled(np.array([[1e9]]), 64)


def test_sql(spark):
    rows = clustered(150, 64, 4)
    df = spark.createDataFrame([r[:2] for r in rows], "vec_id long, embedding array<double>").withColumn("embedding", F.col("embedding").cast("array<float>"))
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": [r["vec_id"] for r in df.collect()], "embedding": pa.array([r["embedding"] for r in df.collect()], pa.list_(pa.float32()))}))
    want = con.sql(centroids.sql())
    got = centroids.cluster(df).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
