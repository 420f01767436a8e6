"""Operator 2: pack documents into fixed-length sequences along a Hilbert curve.

Every document's tokens are hashed into a vector, which is projected to a few dimensions; the
Hilbert index of the projected point is the sort key. Spark range-sorts the documents by it,
with ties in doc_id order, and every range is cut into full sequences, so documents close on
the curve share a sequence. What is left at the end of a range is cut at powers of two, which
need no padding. Documents under one key are split over ranges by doc_id, and those equal in both by the place that
they were written at.

Null texts count as empty, and an empty text has the separator alone. Null doc_ids, repeated
rows and extra columns, under any name, are allowed; every row is packed once, very long texts are packed whole. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphaudit.llm.bpe import loaded, n_ids, read_model
from glyphaudit.llm.common import Scratch, input_bytes, slices, trim

LENGTH = 2048
#: The id after each document.
SEPARATOR = 1
DIMENSIONS, BITS = 4, 15
#: Hashed vectors have so many entries before they are projected.
BUCKETS = 1024
#: About so many bytes of input text are packed by a task.
RANGE_BYTES = 16 << 20


def projection(n_ids: int) -> np.ndarray:
    """For each token id, what one occurrence adds to the projected document vector."""
    h = (np.arange(n_ids, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    matrix = np.random.default_rng(7).standard_normal((BUCKETS, DIMENSIONS))
    return (matrix[(h >> np.uint64(20)).astype(np.int64) % BUCKETS] * sign[:, None]).astype(np.float32)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (rows), each coordinate below ``2 ** bits``.

    The coordinates' bits are turned level by level into the curve's frame, then Gray-decoded
    and interleaved.
    """
    x = points.astype(np.int64).T.copy()
    d = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(d):
            turned = (x[i] & level) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] ^= np.where(turned, low, swap)
            if i:
                x[i] ^= np.where(turned, 0, swap)
        level >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        flip ^= np.where(x[d - 1] & level, level - 1, 0)
        level >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_keys(flat: np.ndarray, counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents whose ids lie one after another in ``flat``."""
    total = np.zeros((len(counts), DIMENSIONS))
    some = np.flatnonzero(counts)  # reduceat would give an empty document the next one's first row
    if len(some):
        total[some] = np.add.reduceat(table[flat], np.cumsum(counts)[some] - counts[some], axis=0)
    mean = total / np.maximum(counts, 1)[:, None]
    unit = np.arctan(4.0 * mean) / np.pi + 0.5
    return hilbert(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """Pieces ``doc_id, start, ids binary (unsigned 32-bit, little-endian), doc_tokens, sequence_id, offset, curve_key``."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(read_model(vocabulary))
    scratch = Scratch(spark, "packing")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(model.value)
        table = projection(len(bpe.offsets) - 1)
        end = np.array([SEPARATOR], bpe.dtype).tobytes()
        at = TaskContext.get().partitionId() << 40
        for part in slices(batches, 1 << 20):
            ids = [bpe.packed(t) + end for t in part.column("text").to_pylist()]
            counts = np.array([len(x) // len(end) for x in ids], np.int64)
            flat = np.frombuffer(b"".join(ids), bpe.dtype)
            place = np.arange(at, at + len(ids), dtype=np.int64)
            at += len(ids)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(curve_keys(flat, counts, table)), pa.array(place), pa.array(ids, pa.binary())], ["doc_id", "curve_key", "place", "packed"])

    n_ranges = max(1, -(-input_bytes(docs) // RANGE_BYTES))
    keyed = scratch.put(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tokens, "doc_id long, curve_key long, place long, packed binary"), "keyed")
    width = 2 if n_ids(model.value) <= 1 << 16 else 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(f"<u{width}")
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        filled = 0
        out: list[tuple] = []

        def close(pieces: list[tuple]) -> None:
            nonlocal sequence
            at = 0
            for doc_id, start, ids, n, key in pieces:
                out.append((doc_id, start, ids.astype("<u4").tobytes(), n, sequence, at, key))
                at += len(ids)
            sequence += 1

        def take(n: int) -> list[tuple]:
            """The first ``n`` ids of what is held."""
            nonlocal filled
            got = []
            filled -= n
            while n:
                doc_id, start, ids, total, key = held.pop(0)
                if len(ids) > n:
                    held.insert(0, (doc_id, start + n, ids[n:], total, key))
                    ids = ids[:n]
                got.append((doc_id, start, ids, total, key))
                n -= len(ids)
            return got

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        names = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset", "curve_key"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("curve_key").to_pylist(), batch.column("packed").to_pylist(), strict=True)
            for doc_id, key, packed in rows:
                ids = np.frombuffer(packed, kind)
                n, at = len(ids), 0
                while at < n:
                    step = min(length - filled, n - at)
                    held.append((doc_id, at, ids[at : at + step], n, key))
                    filled += step
                    at += step
                    if filled == length:
                        close(take(length))
                if len(out) >= 4096:
                    yield flush()
        while filled:
            close(take(1 << (filled.bit_length() - 1)))
        if out:
            yield flush()
        trim()

    ranged = keyed.repartitionByRange(int(n_ranges), "curve_key", "doc_id", "place").sortWithinPartitions("curve_key", "doc_id", "place")
    return ranged.mapInArrow(cut, "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long, curve_key long")


def digest(pieces: DataFrame) -> DataFrame:
    """The query's columns, from the pieces' ids."""
    return pieces.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "curve_key")
