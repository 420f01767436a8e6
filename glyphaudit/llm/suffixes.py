"""Operator 10: sparse suffix arrays over word minimisers remove long passages that occur earlier.

Suffixes are retained where a run of ``SEED`` words has the least hash among the runs that a
passage of ``least`` words can hold, so every passage of that length retains the same suffix
wherever it occurs. Suffixes whose leading run occurs nowhere else are dropped, and those whose
whole surroundings, all that the passages they govern can reach, occur earlier are known to be
late (by both hashes of ``repeats``). The others are sent with these surrounding words.

The suffixes that share a leading run are sorted by their words and each is compared with its
neighbour, which gives how far the match reaches to the right; sorted by the words before them,
read backwards, their neighbours give how far it reaches to the left. Runs of neighbours that
agree in ``l`` words to the left and ``least - l`` to the right hold one passage, and all but
its earliest occurrence are removed. What overlaps merges into maximal intervals, so a longer
match is removed whole. Here words are compared, not hashes.

A leading run with more than ``GROUP`` suffixes, as a line that a third of all documents share,
isn't sorted in one task: its passages are compared as in ``repeats``, by hashes made distinct
in each chunk. All suffixes of a run go the same way, so no passage is missed between the two.

Documents, nulls, empty, very long and repeated texts, empty tables and extra columns are
treated as in ``repeats``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphaudit.llm.common import Scratch, release, slices, words_of
from glyphaudit.llm.repeats import LOWEST, PLACED, Rolling, Twice, Windows, WordHashes, bucket_bits, flagged, gathered, identified, ids_repeat, met, mix, placed, removals, restored, steps, target_bits, with_flags, without_spans

#: Least words of a repeated passage, and of a suffix's leading run.
LEAST, SEED = 50, 8
#: Suffixes of one leading run that a task sorts.
GROUP = 5_000
#: Leading runs with more suffixes are broadcast up to this count.
BROADCAST_RUNS = 500_000
_CONTEXT = "seed long, doc_id long, part long, at int, low int, high int, words binary"


def minimisers(runs: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` runs, the position of the least hash, the leftmost among equals."""
    if len(runs) < width:
        return np.zeros(0, np.int64)
    out = np.empty(len(runs) - width + 1, np.int64)
    for at in range(0, len(out), 1 << 15):
        view = sliding_window_view(runs[at : at + (1 << 15) + width - 1], width)[: 1 << 15]
        out[at : at + len(view)] = np.argmin(view, axis=1) + np.arange(at, at + len(view))
    return out


def _governed(runs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the retained suffixes, and the first and last start of the passages that each governs."""
    chosen = minimisers(runs, width)  # never falls from one start to the next
    at, low = np.unique(chosen, return_index=True)
    return at, low, np.r_[low[1:], len(chosen)][: len(at)] - 1


def _retained(least: int, seed: int) -> Callable[[], Callable[[pa.RecordBatch], Iterator[Windows]]]:
    """Sparse suffixes: under even numbers the hash of their leading words, under odd ones that of all their surroundings."""

    def make() -> Callable[[pa.RecordBatch], Iterator[Windows]]:
        words, rolling, twice = WordHashes(), Rolling(), Twice()

        def get(batch: pa.RecordBatch) -> Iterator[Windows]:
            for doc_id, text, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part")), strict=True):
                h = words.of(words_of(text))
                runs = rolling.windows(h, seed)
                at, low, high = _governed(runs, least - seed + 1)
                whole, second = twice.spans(h, low, high + least)
                # Where the match lies within its surroundings counts too. A leading run that
                # agrees by chance costs a comparison of words later, so one hash is enough.
                whole += (at - low).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                # Minimisers are small numbers, so they are mixed again before they are dealt out.
                yield doc_id, part, np.r_[2 * at, 2 * at + 1], np.r_[mix(runs[at] + np.uint64(1)), whole], np.r_[np.zeros(len(at), np.uint32), second]

        return get

    return make


def _contexts(shared: DataFrame, least: int, seed: int) -> DataFrame:
    """A row for each retained suffix in ``flags``: its leading run's hash, its place, the first and last start of the passages it governs, and the words from the first to the end of the last, or null if these are known to be late."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rolling = WordHashes(), Rolling()
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["seed", "doc_id", "part", "at", "low", "high", "words"])

        for batch in slices(batches, 4 << 20):
            for doc_id, text, part, flags in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "flags")), strict=True):
                words = words_of(text)
                runs = rolling.windows(hashes.of(words), seed)
                at, low, high = _governed(runs, least - seed + 1)
                flagged = np.frombuffer(flags, "<u4").astype(np.int64)
                late = np.isin(2 * at + 1, flagged)
                own = np.flatnonzero(np.isin(2 * at, flagged) | late)
                for run, a, x, y, known in zip(mix(runs[at[own]] + np.uint64(1)).view(np.int64).tolist(), at[own].tolist(), low[own].tolist(), high[own].tolist(), late[own].tolist(), strict=True):
                    rows.append((run, LOWEST if doc_id is None else doc_id, part, a, x, y, None if known else b" ".join(words[x : y + least])))
                    held += 64 + (0 if known else len(rows[-1][-1]))
                    if held > 2 << 20:
                        yield flush()
                        held = 0
        if rows:
            yield flush()

    return shared.mapInArrow(work, _CONTEXT)


def reach(order: np.ndarray, group: np.ndarray, words: np.ndarray) -> np.ndarray:
    """How many leading columns each row, in sorted order, shares with the one before it; none across groups."""
    same = words[order[1:]] == words[order[:-1]]
    n = np.where(same.all(1), words.shape[1], np.argmin(same, axis=1))
    return np.r_[0, np.where(group[order[1:]] == group[order[:-1]], n, -1)] if len(order) else np.zeros(0, np.int64)


def late_of(seed: np.ndarray, docs: np.ndarray, parts: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, words: list[list[int]], least: int, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, part and start of the passages around some suffixes that occur earlier; ``words`` are numbered from 1, ``lead`` words begin a suffix."""
    order = np.lexsort((at, parts, docs))
    docs, parts, at, low, high, seed = docs[order], parts[order], at[order], low[order], high[order], seed[order]
    again = np.r_[False, (docs[1:] == docs[:-1]) & (parts[1:] == parts[:-1]) & (at[1:] == at[:-1])]  # a repeated row
    lengths = np.array([len(w) for w in words])[order]
    flat = np.concatenate([np.array(words[i], np.int32) for i in order])
    begin = np.cumsum(lengths) - lengths
    once = ~again
    docs, parts, at, low, high, seed, lengths, begin = docs[once], parts[once], at[once], low[once], high[once], seed[once], lengths[once], begin[once]
    m, ahead = len(docs), at - low

    def taken(offset: np.ndarray, there: np.ndarray) -> np.ndarray:
        return np.where(there, flat[np.clip(begin[:, None] + offset, 0, len(flat) - 1)], 0)

    step = np.arange(least)
    right = taken(ahead[:, None] + step, step < (lengths - ahead)[:, None])
    back = np.arange(least - lead)
    left = taken(ahead[:, None] - 1 - back, back < ahead[:, None])
    sorted_right = np.lexsort((*right.T[::-1], seed))
    to_right = reach(sorted_right, seed, right)
    sorted_left = np.lexsort((*left.T[::-1], seed))
    to_left = reach(sorted_left, seed, left)
    found: list[tuple] = []
    a, b = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for n in range(least - lead + 1):
        own = np.flatnonzero((at - high <= n) & (n <= ahead))
        if len(own) < 2:
            continue
        a[sorted_left], b[sorted_right] = np.cumsum(to_left < n), np.cumsum(to_right < least - n)
        _, first = np.unique(a[own] * (m + 1) + b[own], return_index=True)  # rows are in order, so the first is the earliest
        late = np.ones(len(own), bool)
        late[first] = False
        own = own[late]
        found.append((docs[own], parts[own], at[own] - n))
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (docs[:0], parts[:0], at[:0])


def _sorted(contexts: DataFrame, bits: int, least: int, seed: int) -> DataFrame:
    """Packed places of passages that occur earlier, bucket by bucket of leading runs."""
    n_target = steps(target_bits(bits))[0]

    def compare(table: pa.Table) -> pa.Table:
        numbers: dict[bytes, int] = {}
        words = [[numbers.setdefault(w, len(numbers) + 1) for w in x.split()] for x in table.column("words").to_pylist()]
        docs, parts, starts = late_of(*(table.column(c).to_numpy().astype(np.int64) for c in ("seed", "doc_id", "part", "at", "low", "high")), words, least, seed)
        return pa.Table.from_batches([placed(docs, parts, starts.astype(np.uint32), n_target)])

    bucketed = contexts.withColumn("bucket", F.shiftrightunsigned("seed", 64 - bits))
    return bucketed.groupBy("bucket").applyInArrow(compare, PLACED)


def _passages(least: int) -> Callable[[], Callable[[pa.RecordBatch], Iterator[Windows]]]:
    """The governed passages of contexts, hashed."""

    def make() -> Callable[[pa.RecordBatch], Iterator[Windows]]:
        words, twice = WordHashes(), Twice()

        def get(batch: pa.RecordBatch) -> Iterator[Windows]:
            for doc_id, part, low, x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "low", "words")), strict=True):
                h, k = twice.windows(words.of(x.split()), least)
                yield doc_id, part, np.arange(low, low + len(h)), h, k

        return get

    return make


def _known(contexts: DataFrame, bits: int) -> DataFrame:
    """Packed places of passages that are known to be late."""
    n_target = steps(target_bits(bits))[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, parts, low, high = (batch.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "part", "low", "high"))
            n = high - low + 1
            starts = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield placed(np.repeat(docs, n), np.repeat(parts, n), starts.astype(np.uint32), n_target)

    return contexts.select("doc_id", "part", "low", "high").mapInArrow(work, PLACED)


def late_passages(rows: DataFrame, scratch: Scratch, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """``doc_id, part, starts``: where passages of ``least`` words start that occur earlier; rows as ``identified`` gives them."""
    bits = bucket_bits(rows)
    shared = with_flags(rows, flagged(rows, _retained(least, seed), even_first=True)).where(F.col("flags").isNotNull())
    contexts = scratch.put(_contexts(shared, least, seed), "contexts")
    release(rows.sparkSession)
    late, contexts = _known(contexts.where("words IS NULL"), bits), contexts.where("words IS NOT NULL")
    large = scratch.put(contexts.groupBy("seed").count().where(F.col("count") > GROUP).select("seed"), "large")
    n = large.count()
    sortable = contexts
    if n:
        large = F.broadcast(large) if n <= BROADCAST_RUNS else large.hint("shuffle_hash")
        sortable = contexts.join(large, "seed", "left_anti")
        late = late.union(met(contexts.join(large, "seed", "left_semi"), _passages(least), bits, text="words"))
    late = scratch.put(gathered(late.union(_sorted(sortable, bits, least, seed)), target_bits(bits)), "late")
    scratch.drop("contexts", "large")
    release(rows.sparkSession)
    return late


def remove_passages(docs: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """``doc_id, part, n_words, spans, kept`` for every row of ``docs(doc_id, text, ...)``."""
    rows, scratch = identified(docs), Scratch(docs.sparkSession, "suffixes")
    return removals(rows, late_passages(rows, scratch, least, seed), least)


def cleaned(docs: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """``docs`` without the passages, all columns kept; a document that is left without a word goes."""
    scratch, repeat = Scratch(docs.sparkSession, "suffixes"), ids_repeat(docs)
    late = late_passages(identified(docs, repeat=repeat), scratch, least, seed)
    return restored(without_spans(with_flags(identified(docs, all_columns=True, repeat=repeat), late), least), docs.columns)


def digest(rows: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return rows.select("doc_id", "n_words", removed.alias("n_removed"), spans.alias("removed_words"), F.sha2("kept", 256).alias("kept_sha256"), F.col("kept").alias("text"))
