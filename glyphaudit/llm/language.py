"""Operator 1: language by a bidirectional gated recurrent network over bytes.

Two GRUs read the UTF-8 bytes of a text in windows, one in each direction. At every byte both
states give probabilities over the languages; a document's probabilities are the mean over all
its bytes. The network is written in numpy and trained by backpropagation through time on the
cross-entropy at every position, with Adam.

The networks are small (``HIDDEN`` units a direction), and their states start anew every ``WINDOW`` bytes.

Training takes at most ``PER_LANGUAGE`` documents of a language, drawn by a hash of doc_id, none
longer than ``LONGEST_TEXT`` characters, and
windows drawn from them; languages aren't limited. Prediction reads every byte of every text. Null texts and those without
a letter are ``und`` with score 0, as is everything when there was nothing to learn from. Equal
texts get equal results, repeated rows too; an empty table gives no rows. Only doc_id and text are read for a prediction;
columns that the caller has under the names of results are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphaudit.llm.common import slices

PER_LANGUAGE, LONGEST_TEXT = 400, 50_000
HIDDEN = 8
#: Bytes of a window, in training and in use.
WINDOW = 128
STEPS, BATCH, RATE = 160, 192, 0.02
#: Windows that run through the network at once.
ROWS = 2048
_LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    #: For each direction: byte inputs (256 x 3H), recurrent weights (H x 3H), recurrent bias of the candidate (H).
    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray


def fresh(languages: list[str], seed: int = 1) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Model(
        languages,
        [draw(256, 3 * HIDDEN, scale=0.3) for _ in range(2)],
        [draw(HIDDEN, 3 * HIDDEN, scale=0.3) for _ in range(2)],
        [np.zeros(HIDDEN, np.float32) for _ in range(2)],
        draw(2 * HIDDEN, len(languages), scale=0.3),
        np.zeros(len(languages), np.float32),
    )


def _run(x: np.ndarray, inputs: np.ndarray, recurrent: np.ndarray, bias: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States after each byte of ``x`` (time, rows), as (time, rows, H)."""
    steps, rows = x.shape
    n = HIDDEN
    half = np.concatenate([np.full(2 * n, 0.5, np.float32), np.ones(n, np.float32)])
    inputs, recurrent = inputs * half, recurrent * half  # sigmoid(a) = (1 + tanh(a / 2)) / 2
    h = np.zeros((rows, n), np.float32)
    out = np.empty((steps, rows, n), np.float32)
    for t in range(steps):
        a = inputs[x[t]]
        b = h @ recurrent
        gates = np.tanh(a[:, : 2 * n] + b[:, : 2 * n])
        gates *= 0.5
        gates += 0.5
        r, u = gates[:, :n], gates[:, n:]
        inner = b[:, 2 * n :] + bias
        c = np.tanh(a[:, 2 * n :] + r * inner)
        if keep is not None:
            keep.append((h, r, u, inner, c))
        h = c + u * (h - c)
        out[t] = h
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


def probabilities(model: Model, x: np.ndarray) -> np.ndarray:
    """Language probabilities at each byte of ``x`` (time, rows)."""
    forward = _run(x, model.inputs[0], model.recurrent[0], model.bias[0])
    backward = _run(x[::-1], model.inputs[1], model.recurrent[1], model.bias[1])[::-1]
    z = forward @ model.out[:HIDDEN] + backward @ model.out[HIDDEN:] + model.out_bias
    return _softmax(z)


def _gradients(model: Model, x: np.ndarray, y: np.ndarray, there: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss and gradients, by backpropagation through time; ``there`` marks bytes that aren't padding."""
    n = HIDDEN
    kept: list[list] = [[], []]
    both = [_run(x, model.inputs[0], model.recurrent[0], model.bias[0], kept[0]), _run(x[::-1], model.inputs[1], model.recurrent[1], model.bias[1], kept[1])[::-1]]
    states = np.concatenate(both, axis=2)
    p = _softmax(states @ model.out + model.out_bias)
    total = there.sum()
    right = np.take_along_axis(p, np.broadcast_to(y[None, :, None], (*x.shape, 1)), 2)[..., 0]
    loss = float(-(np.log(right + 1e-9) * there).sum() / total)
    dz = p
    np.put_along_axis(dz, np.broadcast_to(y[None, :, None], (*x.shape, 1)), (right - 1)[..., None], 2)
    dz = dz * (there[..., None] / total)
    d_out = np.einsum("trh,trl->hl", states, dz)
    d_bias = dz.sum((0, 1))
    d_states = dz @ model.out.T
    grads: list[np.ndarray] = []
    for k in range(2):
        xs, ds = (x, d_states[..., :n]) if k == 0 else (x[::-1], d_states[::-1, :, n:])
        w = model.recurrent[k]
        g_in, g_rec, g_b = np.zeros((256, 3 * n), np.float32), np.zeros_like(w), np.zeros(n, np.float32)
        dh = np.zeros((x.shape[1], n), np.float32)
        for t in range(len(xs) - 1, -1, -1):
            h, r, u, inner, c = kept[k][t]
            dh = dh + ds[t]
            dc = dh * (1 - u) * (1 - c * c)
            du = dh * (h - c) * u * (1 - u)
            dr = dc * inner * r * (1 - r)
            da = np.concatenate([dr, du, dc], axis=1)
            db = np.concatenate([dr, du, dc * r], axis=1)
            np.add.at(g_in, xs[t], da)
            g_rec += h.T @ db
            g_b += (dc * r).sum(0)
            dh = dh * u + db @ w.T
        grads += [g_in, g_rec, g_b]
    return loss, [*grads, d_out, d_bias]


def fit(texts: list[str], langs: list[str], steps: int = STEPS, seed: int = 2) -> Model | None:
    """Trains on windows of the given texts, every language drawn as often."""
    languages = sorted(set(langs))
    if not languages:
        return None
    model = fresh(languages)
    data = [[t.encode("utf-8", "surrogatepass") for t, own in zip(texts, langs, strict=True) if own == lang and t] for lang in languages]
    if not all(data):
        return fit([t for t in texts if t], [own for t, own in zip(texts, langs, strict=True) if t], steps, seed) if any(data) else None
    rng = np.random.default_rng(seed)
    parts = [*[p for k in range(2) for p in (model.inputs[k], model.recurrent[k], model.bias[k])], model.out, model.out_bias]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, steps + 1):
        y = rng.integers(0, len(languages), BATCH)
        x = np.zeros((WINDOW, BATCH), np.uint8)
        there = np.zeros((WINDOW, BATCH), np.float32)
        for i, k in enumerate(y):
            b = data[k][rng.integers(len(data[k]))]
            at = int(rng.integers(max(1, len(b) - WINDOW + 1)))
            b = b[at : at + (WINDOW if rng.random() < 0.7 else int(rng.integers(4, WINDOW)))]
            x[: len(b), i] = np.frombuffer(b, np.uint8)
            there[: len(b), i] = 1
        _, grads = _gradients(model, x, y, there)
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1))) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        for p, g, m, v in zip(parts, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (size + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return model


def pooled(model: Model, texts: list[bytes]) -> np.ndarray:
    """Mean language probabilities over all bytes of each text; zeros for empty ones."""
    total = np.zeros((len(texts), len(model.languages)))
    counts = [-(-len(t) // WINDOW) for t in texts]
    owner = np.repeat(np.arange(len(texts)), counts)
    sizes = np.full(len(owner), WINDOW)
    if not len(owner):
        return total
    ends = np.cumsum(counts)
    lengths = np.array([len(t) for t in texts])
    filled = np.flatnonzero(lengths)
    sizes[ends[filled] - 1] = (lengths[filled] - 1) % WINDOW + 1
    x = np.frombuffer(b"".join(t + bytes(-len(t) % WINDOW) for t in texts), np.uint8).reshape(-1, WINDOW)
    for at in range(0, len(x), ROWS):
        n = sizes[at : at + ROWS]
        p = probabilities(model, np.ascontiguousarray(x[at : at + ROWS].T))
        p[np.arange(WINDOW)[:, None] >= n[None, :]] = 0
        np.add.at(total, owner[at : at + ROWS], p.sum(0, dtype=np.float64))
    return total / np.maximum(lengths, 1)[:, None]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame) -> Model | None:
    """Fits on documents with a language that aren't held out, PER_LANGUAGE of each at most; every language is learned."""
    rows = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").where(F.length("text") <= LONGEST_TEXT).where(~held_out(F.col("doc_id"))).select("lang", "doc_id", "text")
    # The ids first, so that texts aren't sorted; each task sends PER_LANGUAGE ids of a language at most.
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rows.select("lang", "doc_id").distinct().withColumn("at", F.row_number().over(order)).where(F.col("at") <= PER_LANGUAGE)
    drawn = rows.join(F.broadcast(ids), ["lang", "doc_id"]).groupBy("lang", "at").agg(F.min("text").alias("text")).collect()
    drawn.sort(key=lambda r: (r["lang"], r["at"]))
    return fit([r["text"] for r in drawn], [r["lang"] for r in drawn])


def predicted(docs: DataFrame, model: Model | None, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with the predicted language and its probability, under names of the caller's; taken ones are refused."""
    taken = [n for n in names if n.lower() in (c.lower() for c in docs.columns)]
    if taken:
        raise ValueError(f"the columns {taken} are there already: give other names")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in slices(batches, 2 << 20):
            texts = part.column("text").to_pylist()
            lettered = [m is not None and t is not None and _LETTER.search(t) is not None for t in texts]
            found, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            own = [i for i, fine in enumerate(lettered) if fine]
            if own:
                p = pooled(m, [texts[i].encode("utf-8", "surrogatepass") for i in own])
                best = p.argmax(1)
                for i, k, row in zip(own, best, p, strict=True):
                    found[i], scores[i] = m.languages[k], min(1.0, max(0.0, round(float(row[k]), 6)))
            yield part.append_column(names[0], pa.array(found, pa.string())).append_column(names[1], pa.array(scores, pa.float64()))

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))
