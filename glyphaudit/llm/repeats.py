"""Operator 9: repeated word windows, found by Rabin-Karp hashes counted in Spark.

Every run of ``window`` words gets two polynomial hashes over different bases. A window is removed when the
same hashes start earlier, by document and then by position; removed windows merge into maximal
intervals of words. The hashes of a task's chunk are first made distinct, keeping the earliest
start, so a hash that occurs in a third of all documents is sent once per chunk. They then
travel in packed rows by their leading bits, in two steps where the input needs more than
``2 ** FAN_BITS`` buckets, and are compared in each bucket. Equality is decided by the bits of the
first step (15 at most), 48 more bits of the first hash and 32 of the second: 95 bits at 30 GB,
where 10^-9 windows are expected to go by chance, and 94 at 100 TB, where less than 0.01 of some
10^13 are.

Documents are ordered by doc_id, null first. Where a doc_id occurs twice, a hash of the text
tells its rows apart; rows with equal doc_id and text are one document and get equal results. Null and empty texts
have no words, texts with fewer words than a window lose nothing, very long texts are read whole. An empty
table gives no rows. Extra columns, under any name, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphaudit.llm.common import input_bytes, slices, words_of

WINDOW = 20
#: A task sends what it has hashed whenever it holds so many windows.
CHUNK_WINDOWS = 2_500_000
#: A bucket gets the hashes of about so many input bytes, so it fits a task's memory many times.
BUCKET_BYTES = 4 << 20
#: Bits by which a chunk is dealt out at once; where buckets need more, packed rows are dealt out again.
FAN_BITS = 15
#: What stands for a null doc_id in arrays; its part is negative, those of all other rows aren't.
LOWEST = -(1 << 63)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """64-bit hashes of words; 150000 short ones at most are remembered."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) > 150_000:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a hash over all bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Rabin-Karp hashes of all runs of ``n`` words from word hashes, without a loop over words."""

    def __init__(self, base: int = _BASES[0]) -> None:
        self._base, self._inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            n = 1 << n.bit_length()
            self._up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, self._base))])
            self._down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, self._inverse))])

    def prefix(self, hashes: np.ndarray) -> np.ndarray:
        self._powers(len(hashes) + 1)
        out = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self._up[: len(hashes)], out=out[1:])
        return out

    def windows(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """One hash for each start; none if there are fewer words."""
        if len(hashes) < n:
            return np.zeros(0, np.uint64)
        total = self.prefix(hashes)
        return mix((total[n:] - total[:-n]) * self._down[: len(hashes) - n + 1])


    def spans(self, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One hash for each run of words from ``begin`` up to ``end``, whatever their lengths."""
        total = self.prefix(hashes)
        return mix((total[end] - total[begin]) * self._down[begin] + (end - begin).astype(np.uint64))


class Twice:
    """Both hashes of runs of words: 64 bits of one, 32 of the other."""

    def __init__(self) -> None:
        self.first, self.second = Rolling(_BASES[0]), Rolling(_BASES[1])

    def windows(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        return self.first.windows(hashes, n), (self.second.windows(hashes, n) >> np.uint64(32)).astype(np.uint32)

    def spans(self, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.first.spans(hashes, begin, end), (self.second.spans(hashes, begin, end) >> np.uint64(32)).astype(np.uint32)


#: (doc_id, part, starts, hashes, second hashes) of a document: what the caller wants compared.
Windows = tuple[int | None, int, np.ndarray, np.ndarray, np.ndarray]
#: doc_ids, parts, starts: where windows are.
Places = tuple[np.ndarray, np.ndarray, np.ndarray]
#: ``known`` rows carry the starts of windows that are already flagged, and no hashes.
_SENT = pa.schema([("bucket", pa.int64()), ("known", pa.bool_()), ("places", pa.binary()), ("hashes", pa.binary())])
SENT = "bucket long, known boolean, places binary, hashes binary"
#: Packed places of flagged windows, dealt out by document.
_PLACED = pa.schema([("target", pa.int64()), ("places", pa.binary())])
PLACED = "target long, places binary"
_FLAGS = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("starts", pa.binary())])
FLAGS = "doc_id long, part long, starts binary"
#: Bytes of the first hash that are sent; the bucket gives its leading bits.
_HASH_BYTES = 6


def _planes(values: np.ndarray) -> bytes:
    """The values' bytes, all first bytes before all second bytes and so on: they compress better."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _from_planes(data: bytes, kind: str, n: int) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * wide).reshape(wide, n).T).view(kind).reshape(n)


def _changes(docs: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Where another document begins."""
    return np.r_[True, (docs[1:] != docs[:-1]) | (parts[1:] != parts[:-1])][: len(docs)]


def _pack(docs: np.ndarray, parts: np.ndarray, starts: np.ndarray) -> bytes:
    """Steps from one doc_id to the next, parts, and steps between starts within a document."""
    starts = starts.astype(np.uint32)
    gaps = np.where(_changes(docs, parts), starts, starts - np.r_[np.uint32(0), starts[:-1]][: len(starts)])
    body = _planes(np.diff(docs, prepend=np.int64(0))) + _planes(np.ascontiguousarray(parts)) + _planes(gaps.astype("<u4"))
    return np.uint32(len(docs)).tobytes() + zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    body = zstandard.ZstdDecompressor().decompress(data[4:])
    docs, parts, gaps = np.cumsum(_from_planes(body[: 8 * n], "<i8", n)), _from_planes(body[8 * n : 16 * n], "<i8", n), _from_planes(body[16 * n :], "<u4", n)
    new = _changes(docs, parts)
    total = np.cumsum(gaps, dtype=np.uint32)
    first = np.flatnonzero(new)
    return docs, parts, total - (total[first] - gaps[first])[np.cumsum(new) - 1]


def repeated(docs: np.ndarray, parts: np.ndarray, starts: np.ndarray, hashes: np.ndarray, seconds: np.ndarray, even_first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are flagged, and which are not the earliest of those with equal hashes.

    The latter are flagged, and with even_first also the earliest of several, if its start is even.
    """
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    same = h[1:] == h[:-1]
    own = order[np.r_[same, False] | np.r_[False, same]] if len(h) else order
    late = np.zeros(len(hashes), bool)
    if not len(own):
        return late, late
    own = own[np.lexsort((starts[own], parts[own], docs[own], seconds[own], hashes[own]))]
    h, k, d, p, s = hashes[own], seconds[own], docs[own], parts[own], starts[own]
    new = np.r_[True, (h[1:] != h[:-1]) | (k[1:] != k[:-1])]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    other = (d != d[first]) | (p != p[first]) | (s != s[first])
    late[own] = other
    if not even_first:
        return late, late
    shared = np.zeros(len(first), bool)
    shared[first[other]] = True
    every = late.copy()
    every[own] |= shared[first] & (s & 1 == 0)
    return every, late


def _flag_rows(docs: np.ndarray, parts: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """A row for each document with the starts of its flagged windows."""
    order = np.lexsort((starts, parts, docs))
    docs, parts, starts = docs[order], parts[order], starts[order].astype("<u4")
    edge = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (parts[1:] != parts[:-1])])
    cuts = np.r_[edge, len(docs)].astype(np.int32) * 4
    blob = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(starts.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(docs[edge]), pa.array(parts[edge]), blob], schema=_FLAGS)


def bucket_bits(docs: DataFrame) -> int:
    return max(5, math.ceil(math.log2(max(1, input_bytes(docs) / BUCKET_BYTES))))


def target_bits(bits: int) -> int:
    """For flagged windows, which are fewer."""
    return max(5, bits - 2)


def steps(bits: int) -> list[int]:
    """The bits known after each dealing out."""
    n = max(1, -(-bits // FAN_BITS))
    return [-(-bits * (k + 1) // n) for k in range(n)]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _edges(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the positions of its entries."""
    order = np.argsort(buckets, kind="stable")
    own = buckets[order]
    at = np.r_[np.flatnonzero(np.r_[True, own[1:] != own[:-1]]), len(own)] if len(own) else np.zeros(1, int)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield int(own[a]), order[a:b]


class _Sender:
    """Gathers windows up to a chunk, and gives the rows to send by the leading ``bits``; hashes are sent from bit ``lead`` on."""

    def __init__(self, bits: int, lead: int, even_first: bool, most: int):
        self.bits, self.lead, self.even_first, self.most = bits, lead, even_first, most
        self.held: list[tuple] = []
        self.size = 0

    def add(self, *arrays: np.ndarray) -> bool:
        """doc_ids, parts, starts, hashes, second hashes; whether the chunk is full."""
        if len(arrays[0]):
            self.held.append(arrays)
            self.size += len(arrays[0])
        return self.size >= self.most

    def chunk(self) -> Iterator[pa.RecordBatch]:
        held, self.held, self.size = self.held, [], 0
        if not held:
            return
        held.sort(key=lambda w: (int(w[0][0]), int(w[1][0])))
        docs, parts, starts, hashes, seconds = map(np.concatenate, zip(*held, strict=True))
        held.clear()
        flag, late = repeated(docs, parts, starts, hashes, seconds, self.even_first)
        rows = []
        known = np.flatnonzero(flag)
        for cut in np.array_split(known, -(-len(known) // (1 << 16))) if len(known) else ():
            # What repeats within the chunk is known now; its rows are spread over the buckets.
            to = mix(docs[cut[:1]].astype(np.uint64) + np.uint64(cut[0])) >> np.uint64(64 - self.bits)
            rows.append((int(to[0]), True, _pack(docs[cut], parts[cut], starts[cut]), None))
        keep = ~late
        docs, parts, starts, hashes, seconds = docs[keep], parts[keep], starts[keep], hashes[keep], seconds[keep]
        rest = (hashes << np.uint64(self.lead)) >> np.uint64(64 - 8 * _HASH_BYTES)
        for b, own in _edges((hashes >> np.uint64(64 - self.bits)).astype(np.int64)):
            sent = np.ascontiguousarray(rest[own].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_HASH_BYTES]).tobytes() + seconds[own].astype("<u4").tobytes()
            rows.append((b, False, _pack(docs[own], parts[own], starts[own]), sent))
            if len(rows) >= 256:
                yield _batch(rows, _SENT)
                rows = []
        if rows:
            yield _batch(rows, _SENT)


def _received(places: bytes, hashes: bytes) -> tuple:
    d, p, s = _unpack(places)
    wide = np.zeros((len(d), 8), np.uint8)
    wide[:, :_HASH_BYTES] = np.frombuffer(hashes, np.uint8, len(d) * _HASH_BYTES).reshape(-1, _HASH_BYTES)
    return d, p, s, wide.view("<u8").reshape(-1), np.frombuffer(hashes, "<u4", len(d), len(d) * _HASH_BYTES)


def _route(docs: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return mix(docs.astype(np.uint64) + mix(parts.astype(np.uint64)))


def placed(docs: np.ndarray, parts: np.ndarray, starts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Flagged windows, packed by the leading bits of their documents' hash."""
    rows = [(t, _pack(docs[own], parts[own], starts[own])) for t, own in _edges((_route(docs, parts) >> np.uint64(64 - bits)).astype(np.int64))]
    return _batch(rows, _PLACED) if rows else pa.RecordBatch.from_arrays([pa.array([], f.type) for f in _PLACED], schema=_PLACED)


def _dealt(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """Rows of a first step, each range of the column spread over several tasks."""
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(16))
    return rows.withColumn("_salt", salt).repartition(max(1 << min(bits, 12), 1), column, "_salt").drop("_salt")


def met(docs: DataFrame, windows_of: Callable[[], Callable[[pa.RecordBatch], Iterator[Windows]]], bits: int, even_first: bool = False, text: str = "text") -> DataFrame:
    """Windows that repeat, as packed places; see ``flagged``."""
    at = steps(bits)
    lead, n_target, most = at[0], steps(target_bits(bits))[0], CHUNK_WINDOWS

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, sender = windows_of(), _Sender(lead, lead, even_first, most)
        for part in slices(batches, 4 << 20, text):
            for doc_id, p, starts, hashes, seconds in get(part):
                n = len(starts)
                if sender.add(np.full(n, LOWEST if doc_id is None else doc_id, np.int64), np.full(n, p, np.int64), starts.astype(np.uint32), hashes, seconds):
                    yield from sender.chunk()
        yield from sender.chunk()

    def again(bits: int) -> Callable:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sender = _Sender(bits, lead, even_first, most)
            for batch in batches:
                for bucket, known, places, hashes in zip(*(batch.column(c).to_pylist() for c in _SENT.names), strict=True):
                    if known:
                        yield _batch([(bucket << (bits - lead), known, places, None)], _SENT)
                        continue
                    d, p, s, h, k = _received(places, hashes)
                    whole = (h << np.uint64(64 - 8 * _HASH_BYTES)) >> np.uint64(lead)
                    if sender.add(d, p, s, whole | (np.uint64(bucket) << np.uint64(64 - lead)), k):
                        yield from sender.chunk()
            yield from sender.chunk()

        return work

    def compare(table: pa.Table) -> pa.Table:
        out, open_ = [], []
        for known, places, hashes in zip(*(table.column(c).to_pylist() for c in _SENT.names[1:]), strict=True):
            if known:
                out.append(_unpack(places))
            else:
                open_.append(_received(places, hashes))
        if open_:
            arrays = [np.concatenate(x) for x in zip(*open_, strict=True)]
            flag, _ = repeated(*arrays, even_first)
            out.append(tuple(x[flag] for x in arrays[:3]))
        return pa.Table.from_batches([placed(*map(np.concatenate, zip(*out, strict=True)), n_target)])

    sent = docs.mapInArrow(send, SENT)
    for known_bits, more in zip(at, at[1:], strict=False):
        sent = _dealt(sent, "bucket", known_bits).mapInArrow(again(more), SENT)
    return sent.groupBy("bucket").applyInArrow(compare, PLACED)


def gathered(found: DataFrame, bits: int) -> DataFrame:
    """``doc_id, part, starts``: a row for each document, from packed places dealt out by the first step of ``bits``."""
    most = CHUNK_WINDOWS

    def again(bits: int) -> Callable:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[Places] = []
            for batch in batches:
                held += map(_unpack, batch.column("places").to_pylist())
                if sum(len(x[0]) for x in held) >= most:
                    yield placed(*map(np.concatenate, zip(*held, strict=True)), bits)
                    held = []
            if held:
                yield placed(*map(np.concatenate, zip(*held, strict=True)), bits)

        return work

    def merge(table: pa.Table) -> pa.Table:
        arrays = map(np.concatenate, zip(*map(_unpack, table.column("places").to_pylist()), strict=True))
        return pa.Table.from_batches([_flag_rows(*arrays)])

    at = steps(bits)
    for known_bits, more in zip(at, at[1:], strict=False):
        found = _dealt(found, "target", known_bits).mapInArrow(again(more), PLACED)
    return found.groupBy("target").applyInArrow(merge, FLAGS)


def flagged(docs: DataFrame, windows_of: Callable[[], Callable[[pa.RecordBatch], Iterator[Windows]]], even_first: bool = False) -> DataFrame:
    """``doc_id, part, starts`` of the windows that repeat: a row for each document that has any.

    ``windows_of()`` is called in each task and gives a function from an Arrow batch of ``docs``
    to the windows to compare. With even_first the earliest occurrence is flagged as well, if its start is even. The
    number of buckets follows the size of ``docs``.
    """
    bits = bucket_bits(docs)
    return gathered(met(docs, windows_of, bits, even_first), target_bits(bits))


def ids_repeat(docs: DataFrame) -> bool:
    """Whether some doc_id, null included, has more than one row."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0


def identified(docs: DataFrame, all_columns: bool = False, repeat: bool | None = None) -> DataFrame:
    """``doc_id, part, text``; part tells apart rows under one doc_id: 0 if no doc_id occurs twice, else a hash of the text; it is negative for a null doc_id only.

    ``repeat`` is what ``ids_repeat`` gives, where it is known. With all_columns, ``others``
    holds what else a row has, under any names; ``restored`` undoes it.
    """
    text = F.coalesce("text", F.lit(""))
    repeat = ids_repeat(docs) if repeat is None else repeat
    part = F.xxhash64(text).bitwiseAND(F.lit((1 << 63) - 1)) if repeat else F.lit(0).cast("long")
    part = F.when(F.col("doc_id").isNull(), F.xxhash64(text).bitwiseOR(F.lit(LOWEST))).otherwise(part)
    if all_columns:
        others = F.struct(F.lit(1).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"])
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), "text", others.alias("others"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), text.alias("text"))


def restored(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that ``identified(all_columns=True)`` was given."""
    return rows.select(*[F.col("text") if c == "text" else F.col("others").getField(c).alias(c) for c in columns])


def with_flags(docs: DataFrame, flags: DataFrame) -> DataFrame:
    """``docs`` with ``flags binary``, null where nothing is flagged; joined on doc_id and part."""
    each = flags.select(F.col("doc_id").alias("_d"), F.col("part").alias("_p"), F.col("starts").alias("flags"))
    return docs.join(each.hint("shuffle_hash"), (F.coalesce(docs["doc_id"], F.lit(LOWEST)) == each["_d"]) & (docs["part"] == each["_p"]), "left").drop("_d", "_p")


def intervals(starts: np.ndarray, window: int) -> np.ndarray:
    """Maximal half-open word intervals covered by windows at these starts, as rows."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    starts = np.unique(starts).astype(np.int64)
    cut = np.flatnonzero(np.diff(starts) > window)
    return np.stack([starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]] + window], axis=1)


def _all_windows(window: int) -> Callable[[], Callable[[pa.RecordBatch], Iterator[Windows]]]:
    def make() -> Callable[[pa.RecordBatch], Iterator[Windows]]:
        words, twice = WordHashes(), Twice()

        def get(part: pa.RecordBatch) -> Iterator[Windows]:
            for doc_id, text, p in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "part")), strict=True):
                h, k = twice.windows(words.of(words_of(text)), window)
                yield doc_id, p, np.arange(len(h), dtype=np.uint32), h, k

        return get

    return make


def removals(docs: DataFrame, flags: DataFrame, window: int) -> DataFrame:
    """``doc_id, part, n_words, spans array<struct<start, end>>, kept`` for every row; kept words are joined by one space."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4 << 20):
            n_words, spans, kept = [], [], []
            for text, flag in zip(part.column("text").to_pylist(), part.column("flags").to_pylist(), strict=True):
                words = words_of(text)
                n_words.append(len(words))
                if flag is None:
                    spans.append([])
                else:
                    found = intervals(np.frombuffer(flag, "<u4"), window).tolist()
                    spans.append([{"start": a, "end": b} for a, b in found])
                    left, at = [], 0
                    for a, b in found:
                        left += words[at:a]
                        at = b
                    words = left + words[at:]
                kept.append(b" ".join(words))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), pa.array(n_words, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "part", "n_words", "spans", "kept"])

    return with_flags(docs, flags).mapInArrow(work, "doc_id long, part long, n_words long, spans array<struct<start: long, end: long>>, kept string")


def without_spans(rows: DataFrame, window: int) -> DataFrame:
    """``rows`` with the flagged windows cut out of ``text``; other texts, and all other columns, stay as they are.

    Takes the result of ``with_flags``. A document that loses all its words is dropped.
    """
    schema = T.StructType([f for f in rows.schema.fields if f.name != "flags"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            texts, keep = [], []
            for text, flag in zip(batch.column("text").to_pylist(), batch.column("flags").to_pylist(), strict=True):
                if flag is not None:
                    words, left, at = words_of(text), [], 0
                    for a, b in intervals(np.frombuffer(flag, "<u4"), window).tolist():
                        left += words[at:a]
                        at = b
                    text = b" ".join(left + words[at:]).decode("utf-8", "surrogatepass")
                texts.append(text)
                keep.append(flag is None or bool(text))
            out = {name: batch.column(name) for name in schema.names} | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in out.values()], list(out))

    return rows.mapInArrow(work, schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, part, n_words, spans, kept`` for every row of ``docs(doc_id, text, ...)``."""
    rows = identified(docs)
    return removals(rows, flagged(rows, _all_windows(window)), window)


def digest(rows: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return rows.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
