from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphaudit.llm import ann

KIND = "vec_id long, embedding array<float>, label int"


def exact(rows, k=20):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).cumsum(1)[:, -1]
        s[ids == ids[i]] = -np.inf
        order = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(ann.search(df, F.col("vec_id") % 20 == 0).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_few_vectors_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(6).astype(np.float32).tolist(), 0) for i in range(60)] + [(100 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], 1) for i in range(70)]
    odd = [(300, None, 0), (301, [0.0] * 6, 0), (302, [float("nan")] * 6, 0), (303, [float("inf")] + [1.0] * 5, 0), (304, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (305, [1.0], 0), (None, [1.0] * 6, 0), (320, [], 0)]
    assert found(spark.createDataFrame(rows + odd + rows[:3], KIND)) == exact(rows)
    assert found(spark.createDataFrame(rows[:3], KIND)) == exact(rows[:3])


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_SIZE", 40)
    monkeypatch.setattr(ann, "CELL_ROWS", 60)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]
    got, want = found(spark.createDataFrame(rows, KIND)), exact(rows)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    scores = {(q, v): s for q, r in want.items() for v, s in r}
    assert all(scores.get((q, v), s) == pytest.approx(s, abs=0) for q, r in got.items() for v, s in r)


def noted(monkeypatch):
    """What calibration chose: (ratio, most lists a sampled query reads, lists)."""
    seen, old = [], ann.calibrated

    def calibrated(vectors, lists, asked, graph, dim, k):
        out = old(vectors, lists, asked, graph, dim, k)
        seen.append((*out, len(graph.value.c)))
        return out

    monkeypatch.setattr(ann, "calibrated", calibrated)
    return seen


def test_recall_with_few_probes_of_many_lists(spark, monkeypatch):
    """Clusters: a tenth of the lists at most is read, and 0.9 of the true neighbours are found."""
    monkeypatch.setattr(ann, "LIST_SIZE", 16)
    seen = noted(monkeypatch)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((150, 24))
    x = centres[rng.integers(0, 150, 9000)] + 0.15 * rng.standard_normal((9000, 24))
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]
    got, want = found(spark.createDataFrame(rows, KIND)), exact(rows)
    ratio, width, lists = seen[0]
    assert lists == 512 and 10 * width <= lists, (ratio, width)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_exact(spark, monkeypatch):
    """The second pass misses nothing, whatever the first one reads."""
    monkeypatch.setattr(ann, "LIST_SIZE", 30)
    monkeypatch.setattr(ann, "calibrated", lambda *a: (1.0, 1))
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 12)) * rng.uniform(0.5, 2, (1500, 1))
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]
    out = {}
    for r in sorted(ann.search(spark.createDataFrame(rows, KIND), F.col("vec_id") % 20 == 0, exact=True).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert out == exact(rows)


def test_doubles_are_not_rounded(spark):
    rows = [(i, [1.0 + 1e-9 * i, 0.5]) for i in range(40)] + [(60, [1e39, 0.0]), (80, [1e-60, 1e-61])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    first = {r["query_id"]: (r["vec_id"], r["score"]) for r in got if r["rank"] == 1}
    assert first == {0: (60, 1e39), 20: (60, 1e39 * (1.0 + 1e-9 * 20)), 60: (39, 1e39 * (1.0 + 1e-9 * 39)), 80: (60, 1e39 * 1e-60)}
    second = [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0][1:6]
    assert second == [39, 38, 37, 36, 35]


def test_empty(spark):
    assert ann.search(spark.createDataFrame([], KIND), F.col("vec_id") % 20 == 0).count() == 0


def test_graph_finds_the_nearest():
    rng = np.random.default_rng(3)
    c = rng.standard_normal((700, 8)).astype(np.float32)
    q = rng.standard_normal((50, 8)).astype(np.float32)
    ids, dist = ann.CentroidGraph(c).search(q, 32)
    best = ((q[:, None] - c[None]) ** 2).sum(2).argmin(1)
    assert (ids[:, 0] == best).mean() >= 0.95 and (np.diff(dist, axis=1) >= -1e-4).all()
    assert all(len(set(row)) == len(row) for row in ids.tolist())


def test_a_query_goes_once_to_a_group_of_lists():
    """Spread evenly, a query reads most lists; it isn't put out once a list, and a wide beam misses none."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((512, 16)).astype(np.float32)
    graph = SimpleNamespace(value=ann.CentroidGraph(ann.balanced_centroids(ann.filled(x, 8.0), 256)))
    starts, cells = ann._gathered(np.r_[np.full(255, 100), 4500], 2000)
    assert len(starts) == 14 and cells.tolist() == [1] * 13 + [3] and starts[-1] == 255
    q = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(x[:50].tolist(), pa.list_(pa.float32()))], ["vec_id", "embedding"])
    near = graph.value.all(ann.aimed(x[:50].astype(float)))
    ratio = float(np.quantile(near / near.min(1)[:, None], 0.6))
    reads = near <= ratio * near.min(1)[:, None] + 1e-6
    sent = pa.Table.from_batches(ann._probing(graph, 16, ratio, 100, starts, cells)(iter([q]))).to_pylist()
    assert reads.mean() > 0.5
    assert len(sent) == len({(r["vec_id"], r["group"], r["cell"]) for r in sent}) <= 50 * 16
    for i, group in zip(*np.nonzero(np.logical_or.reduceat(reads, starts, axis=1)), strict=True):
        assert sum(r["vec_id"] == i and r["group"] == group for r in sent) == cells[group]


def test_what_single_precision_cannot_tell_apart():
    """Pairs that differ in the tenth digit only are compared in double precision."""
    rng = np.random.default_rng(7)
    v = np.ones((3000, 8)) + 1e-9 * rng.standard_normal((3000, 8))
    q = v[:40]
    a, b = ann._candidates(q, v, ann._unit(q), ann._unit(v), 5)
    best = np.argsort(-(q @ v.T), axis=1)[:, :5]
    assert all(set(best[i]) <= set(b[a == i]) for i in range(40))
