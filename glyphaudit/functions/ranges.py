"""Scripts of code points as one sorted table of ranges, and runs of texts found with it in one Arrow pass.

The table follows from the character classes in ``scripts``: a small query asks them about every
code point once a session, and what comes back, some hundreds of ranges, is all that tasks need.
A batch's texts are looked at as one array of code points; cutting it into runs, counting scripts and
finding the dominant one are array operations, and a run's text is a slice of the batch's own bytes.
What the checks ask of a text comes from a function of its own (``signs``), so that runs are made only where they are used.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

KIND = "struct<runs: array<struct<script: string, text: string, n: int>>, census: array<struct<script: string, n: bigint>>, dominant: string>"
SIGNS = "struct<dominant: string, dominant_n: bigint, lettered: bigint, latin_n: bigint, vietnamese: boolean, arrow: string, bidi_run: string, unknown: array<string>>"
_ALL = 0x110000
# Bits of code points that the checks look for.
_NEUTRAL, _DIGIT, _ARROW, _VIETNAMESE = 1, 2, 4, 8
_TABLES: dict[str, list[tuple[int, int, str, bool]]] = {}
_LOADED: dict = {}


def table(spark: SparkSession) -> list[tuple[int, int, str, bool]]:
    """``(first, last, script, clustered)`` for all code points but surrogates, ascending.

    ``clustered``: text with such a code point has to be cut into grapheme clusters first.
    """
    from glyphaudit.functions import scripts as S

    app = spark.sparkContext.applicationId
    if app not in _TABLES:
        c = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        points = spark.range(0, _ALL, 1, 16).where(~F.col("id").between(0xD800, 0xDFFF)).select("id", c.alias("c"))
        asked = points.select("id", S.script_of_letter(F.regexp_extract("c", S.LETTER, 0)).alias("s"), F.col("c").rlike(S.CLUSTERED).alias("k")).toArrow()
        ids, script, k = asked["id"].to_numpy(), asked["s"].to_pandas().where(lambda s: ~s.str.startswith("?"), "unknown").to_numpy(), asked["k"].to_numpy()
        order = np.argsort(ids)
        ids, script, k = ids[order], script[order], k[order]
        cut = np.flatnonzero(np.r_[True, (np.diff(ids) != 1) | (script[1:] != script[:-1]) | (k[1:] != k[:-1])])
        ends = np.r_[cut[1:] - 1, len(ids) - 1]
        _TABLES[app] = [(int(ids[a]), int(ids[b]), str(script[a]), bool(k[a])) for a, b in zip(cut, ends, strict=True)]
    return _TABLES[app]


def _loaded(ranges: tuple) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The ranges spread over all code points, once a worker: script numbers, clustered flags, names."""
    if ranges not in _LOADED:
        names = sorted({r[2] for r in ranges} | {"common", "unknown"})
        script, clustered = np.full(_ALL, names.index("unknown"), np.uint8), np.zeros(_ALL, bool)
        for a, b, name, k in ranges:
            script[a : b + 1], clustered[a : b + 1] = names.index(name), k
        _LOADED[ranges] = script, clustered, names
    return _LOADED[ranges]


def _bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of all texts, and where each begins and the last ends; nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    # An array without any text has no buffers.
    at = np.frombuffer(texts.buffers()[1] or b"\0" * 8, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


class _Cut:
    """A batch's texts as code points, cut into runs of one script."""

    def __init__(self, texts: pa.StringArray, ranges: tuple):
        script_of, clustered, self.names = _loaded(ranges)
        self.data, at = _bytes(texts)
        self.points = np.frombuffer(self.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        self.begins = np.flatnonzero((self.data & 0xC0) != 0x80)
        self.row_at = row_at = np.searchsorted(self.begins, at)
        own = script_of[self.points]
        odd = np.r_[0, np.cumsum(clustered[self.points])]
        self.null = odd[row_at[1:]] > odd[row_at[:-1]]
        change = np.ones(len(own), bool)
        change[1:] = own[1:] != own[:-1]
        change[row_at[:-1][row_at[:-1] < len(own)]] = True
        self.first = np.flatnonzero(change)
        self.script, self.n = own[self.first], np.diff(np.r_[self.first, len(own)])
        self.runs_at = np.searchsorted(self.first, row_at)
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.runs_at))

    def firsts(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows with any of these code points, given by ascending place, and the first one of each."""
        rows, where = np.unique(np.searchsorted(self.row_at, at, "right") - 1, return_index=True)
        return rows, at[where]


def runs_of(texts: pa.StringArray, ranges: tuple) -> pa.StructArray:
    """``KIND`` for each text; null where clusters are needed."""
    c = _Cut(texts, ranges)
    names, data, begins, first, script, n, runs_at, row, null = c.names, c.data, c.begins, c.first, c.script, c.n, c.runs_at, c.row, c.null
    common = names.index("common")
    spelled = pa.array(names)
    cut = np.r_[begins[first], len(data)].astype(np.int32)
    run_text = pa.StringArray.from_buffers(len(first), pa.py_buffer(cut), pa.py_buffer(data.tobytes()))
    run = pa.StructArray.from_arrays([spelled.take(pa.array(script)), run_text, pa.array(n.astype(np.int32))], ["script", "text", "n"])
    runs = pa.ListArray.from_arrays(pa.array(runs_at.astype(np.int32)), run)

    real = np.flatnonzero(script != common)
    key, place, which = np.unique(row[real].astype(np.int64) * 64 + script[real], return_index=True, return_inverse=True)
    total = np.bincount(which, weights=n[real], minlength=len(key)).astype(np.int64)
    by_place = np.argsort(place)
    key, total = key[by_place], total[by_place]
    counted = pa.StructArray.from_arrays([spelled.take(pa.array((key % 64).astype(np.uint8))), pa.array(total)], ["script", "n"])
    census_at = np.searchsorted(key // 64, np.arange(len(texts) + 1))
    census = pa.ListArray.from_arrays(pa.array(census_at.astype(np.int32)), counted)
    most = np.lexsort((np.arange(len(key)), -total, key // 64))
    top = np.full(len(texts), common, np.uint8)
    rows, where = np.unique((key // 64)[most], return_index=True)
    top[rows] = (key % 64)[most][where]
    return pa.StructArray.from_arrays([runs, census, spelled.take(pa.array(top))], ["runs", "census", "dominant"], mask=pa.array(null))


def _signs() -> np.ndarray:
    """Bits of all code points, once a worker."""
    if "signs" not in _LOADED:
        from glyphaudit.functions import scripts as S
        from glyphaudit.operators.rules import ARROWS, NEUTRAL

        bits = np.zeros(_ALL, np.uint8)
        for pattern, bit in ((NEUTRAL, _NEUTRAL), ("[0-9]", _DIGIT), (ARROWS, _ARROW), (S.VIETNAMESE, _VIETNAMESE)):
            bits[[ord(x) for x in re.findall(pattern, "".join(map(chr, range(0xD800))))]] |= bit
        _LOADED["signs"] = bits
    return _LOADED["signs"]


def _dominant(c: _Cut, total: np.ndarray) -> np.ndarray:
    """The script of most letters in each row; of equal ones the first to appear; ``common`` without letters."""
    common, most = c.names.index("common"), total.max(axis=1)
    top = np.where(most > 0, total.argmax(axis=1), common)
    tied = (most > 0) & ((total == most[:, None]).sum(axis=1) > 1)
    at = np.flatnonzero(tied[c.row] & (c.script != common) & (total[c.row, c.script] == most[c.row]))
    rows, where = np.unique(c.row[at], return_index=True)
    top[rows] = c.script[at][where]
    return top


def _bidi_runs(c: _Cut, sign: np.ndarray, rtl: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Rows with an unisolated left-to-right run, as the check defines it, and the first such run of each."""
    if not len(c.first):
        return c.first, c.first
    common, latin = c.names.index("common"), c.names.index("latin")
    of_run = np.bitwise_or.reduceat(sign, c.first)
    neutral = (of_run & _NEUTRAL) > 0
    beside, inner = neutral & (c.script == common), c.row[1:] == c.row[:-1]
    near = neutral.copy()
    near[1:] |= beside[:-1] & inner
    near[:-1] |= beside[1:] & inner
    ltr = (c.script == latin) | ((c.script == common) & ((of_run & _DIGIT) > 0))
    at = np.flatnonzero(ltr & (c.n >= 2) & near)
    real = np.flatnonzero((c.script != common) & (c.script != latin))
    k = np.searchsorted(real, at)
    at, k = at[(k > 0) & (k < len(real))], k[(k > 0) & (k < len(real))]
    turns = np.isin(np.array(c.names)[c.script[real]], rtl)
    ok = turns[k - 1] & turns[k] & (c.row[real[k - 1]] == c.row[at]) & (c.row[real[k]] == c.row[at])
    rows, where = np.unique(c.row[at[ok]], return_index=True)
    return rows, at[ok][where]


def _samples(c: _Cut) -> list[list[str] | None]:
    """The first distinct samples of each row's runs of no known script; null where there is no such run.

    What comes after a row's first ``SAMPLES`` can't be among the first of its page either.
    """
    from glyphaudit.functions.scripts import SAMPLE_LENGTH, SAMPLES

    out: list[list[str] | None] = [None] * (len(c.row_at) - 1)
    for i in np.flatnonzero(c.script == c.names.index("unknown")):
        held = out[c.row[i]] = out[c.row[i]] or []
        if len(held) < SAMPLES:
            sample = "".join(map(chr, c.points[c.first[i] : c.first[i] + min(c.n[i], SAMPLE_LENGTH)]))
            if sample not in held:
                held.append(sample)
    return out


def signs_of(texts: pa.StringArray, ranges: tuple, rtl: tuple[str, ...]) -> pa.StructArray:
    """``SIGNS`` for each text; null where clusters are needed."""
    c = _Cut(texts, ranges)
    rows, names = len(texts), c.names
    sign = _signs()[c.points]
    total = np.bincount(c.row * len(names) + c.script, weights=c.n, minlength=rows * len(names)).astype(np.int64).reshape(rows, len(names))
    total[:, names.index("common")] = 0
    top = _dominant(c, total)
    vietnamese = np.zeros(rows, bool)
    vietnamese[c.firsts(np.flatnonzero(sign & _VIETNAMESE))[0]] = True
    arrow, bidi = [None] * rows, [None] * rows
    for r, i in zip(*c.firsts(np.flatnonzero(sign & _ARROW)), strict=True):
        arrow[r] = chr(c.points[i])
    for r, i in zip(*_bidi_runs(c, sign, rtl), strict=True):
        bidi[r] = "".join(map(chr, c.points[c.first[i] : c.first[i] + c.n[i]]))
    columns = [pa.array(names).take(pa.array(top)), pa.array(total[np.arange(rows), top]), pa.array(total.sum(axis=1)), pa.array(total[:, names.index("latin")]), pa.array(vietnamese), pa.array(arrow, pa.string()), pa.array(bidi, pa.string()), pa.array(_samples(c), pa.list_(pa.string()))]
    return pa.StructArray.from_arrays(columns, ["dominant", "dominant_n", "lettered", "latin_n", "vietnamese", "arrow", "bidi_run", "unknown"], mask=pa.array(c.null))


def signs(text: Column, spark: SparkSession) -> Column:
    """``SIGNS`` of a text column: null for a text that needs clusters."""
    from glyphaudit.operators.rules import RTL

    ranges, rtl = tuple(table(spark)), tuple(RTL)

    @F.arrow_udf(returnType=SIGNS)
    def signs_by_ranges(texts: pa.Array) -> pa.Array:
        return signs_of(texts, ranges, rtl)

    return signs_by_ranges(text)


def analysis(text: Column, spark: SparkSession) -> Column:
    """``KIND`` of a text column: null for a text that needs clusters."""
    ranges = tuple(table(spark))

    @F.arrow_udf(returnType=KIND)
    def analysis_by_ranges(texts: pa.Array) -> pa.Array:
        return runs_of(texts, ranges)

    return analysis_by_ranges(text)
