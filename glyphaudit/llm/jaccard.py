"""Operator 6: exact Jaccard join on word n-grams by vertical partitioning.

A document's set holds the distinct hashes of its four-word shingles. All n-grams have one
global order: those found in many documents come last, the rest by hash. The order is cut into
fragments. Each fragment proposes pairs from the n-grams that fall in it, then overlaps are
counted fragment by fragment and the partial counts are summed per pair.

A fragment doesn't join an n-gram's members with one another. The shorter set of a pair that
links has a common n-gram among the first ``n - ceil(2 t n / (1 + t)) + 1`` of its order (its
index part), the longer one among the first ``n - ceil(t n) + 1`` (its probe part), and the
first one they share leaves both enough n-grams to reach the overlap that their sizes ask for.
The join takes index entries on one side and probe entries on the other and keeps the pairs
that pass this bound, and another: every n-gram flips one of 384 bits of its set (of 2048 besides for
long sets, which entries of common n-grams carry), so two sets differ in at least as many n-grams as their
bits differ. A match is passed over if the entry before it, in both sets, is of one n-gram as
well: it is not the first that they share. An n-gram that many documents have is split by set size: a probe entry
goes only to the size bands in which a partner can pass, so copies of about one size with many
edits of their own, which share all common n-grams but can't link, never meet.

Equal sets form one class and are compared once. Before the fragments propose anything, classes
that agree in two min-hashes are counted against the member that holds most common n-grams, the
hub, if most of their other min-hashes agree as well; that joins groups of near copies with about
one pair a member, and only pairs of different components are proposed after it. Where an n-gram has many
members of different components, a share of its pairs by hashes of both ends is proposed and counted first, then a share that is
larger by ``STEP``, in the end all. Pairs that link and are still apart once a share ``1/R`` has been
joined number about ``R`` a class at most, so a family whose members have edits of their own doesn't put out
the square of its size. Of the last pairs, one
for each class is counted first, and the others only if their ends are still apart. Nothing is capped: a pair
within one component needs no count, as only components are asked for.

Null and empty texts have an empty set and link with nothing. Texts with fewer words than a
shingle have their whole sequence as the only member. Null doc_ids are allowed; a component's
id is its least doc_id. Repeated rows fall into one class. An empty table gives no rows. Very long texts
are read whole. Extra columns, under any name, are not read. N-grams are compared by 64-bit
hashes; sets by 64 bits, and where two sets that differ in 64 more bits meet in one, the class
is split.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphaudit.llm.common import Scratch, release, slices
from glyphaudit.llm.graph import components
from glyphaudit.llm.repeats import Rolling, identified, ids_repeat, mix, restored

SHINGLE = 4
#: Pairs link when 100 * intersection >= PERCENT * union.
PERCENT = 85
FRAGMENTS = 8
#: N-grams known to be in more than this share of the documents (16 at least) come last in the
#: order, so many of the most frequent at most. They only guide the order: any set of them is right.
COMMON_SHARE, COMMON_LEAST, MOST_COMMON = 1e-4, 16, 2_000_000
#: Size bands a factor e, by which the entries of a common n-gram are split.
BANDS = 50
#: Shingles whose counts a task keeps before it reports the repeated ones.
COUNT_CHUNK = 2_000_000
#: Bytes of text whose words a task hashes together, and words that it does so at a time.
SLICE, WORDS_AT_ONCE = 1 << 18, 1 << 18
#: Min-hashes of a set, how many make a key under which classes are grouped, and how many of them a pair has in common.
HASHES, KEYED, AGREE = 8, 2, 5
#: Ids of texts to read again are broadcast up to this many rows (about 32 bytes each).
BROADCAST_ROWS = 200_000
#: Longs of a set's parity bits, and of those that sets of more than so many n-grams have besides.
ODD, WIDE, LONG = 6, 32, 200
#: An n-gram with more members of several components than this has shares of its pairs counted first, each this many times the one before.
CROWD, STEP = 64, 16
_TOP = np.uint64(1 << 63)
#: Masks that leave the first 0 to 8 bytes of a number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: N-gram hashes are mixed already, so odd factors give independent orders.
_MULTIPLIERS = (np.arange(1, 2 * HASHES, 2, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words ``[^\\x20\\x09-\\x0D]+`` of lower-cased bytes begin, and their 64-bit hashes.

    Words up to 16 bytes are read as two numbers, with their length, all at once; longer ones are hashed one by one.
    """
    data = b"\n" + data + b"\n"
    raw = np.frombuffer(data, np.uint8)
    gap = (raw == 0x20) | ((raw - np.uint8(0x09)) <= 4)
    edges = np.flatnonzero(gap[1:] != gap[:-1])  # a word's first byte less one, its last byte, and so on
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(data) + 8, "<u8", data + bytes(15), strides=(1,))  # the 8 bytes from each place on
    out = np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), WORDS_AT_ONCE):
        begin, n = starts[at : at + WORDS_AT_ONCE] + 1, sizes[at : at + WORDS_AT_ONCE]
        h = mix((eight[begin] & _FIRST[np.minimum(n, 8)]) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        more = np.flatnonzero(n > 8)
        h[more] ^= mix((eight[begin[more] + 8] & _FIRST[np.minimum(n[more] - 8, 8)]) + np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xC2B2AE3D27D4EB4F)
        for k in np.flatnonzero(n > 16).tolist():
            h[k] = xxhash.xxh3_64_intdigest(data[begin[k] : begin[k] + n[k]])
        out[at : at + len(h)] = mix(h + np.uint64(1))
    return starts, out


class Shingles:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, size: int):
        self.size, self.rolling = size, Rolling()

    def each(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Of every text; the words of all are hashed together."""
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        starts, h = word_hashes(b"\n".join(raw).lower())
        places = np.cumsum([0, *(len(x) + 1 for x in raw)])
        edges = np.searchsorted(starts, places).tolist()
        windows = self.rolling.windows(h, self.size)
        for begin, end in itertools.pairwise(edges):
            if 0 < end - begin < self.size:
                yield mix(self.rolling.windows(h[begin:end], end - begin) + np.uint64(end - begin))
            else:
                grams = np.sort(windows[begin : max(begin, end - self.size + 1)])
                new = grams[1:] != grams[:-1]
                yield grams if new.all() else grams[np.r_[True, new]]

    def of(self, text: str | None) -> np.ndarray:
        return next(self.each([text]))


def ordered(grams: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Keys in the global order, as sorted signed integers; ``grams`` and ``common`` are sorted."""
    keys = grams >> np.uint64(1)
    if not len(common):
        return (keys ^ _TOP).view(np.int64)
    last = common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] == grams
    return np.concatenate([keys[~last] ^ _TOP, keys[last]]).view(np.int64)


def prefix_length(n: int, percent: int) -> int:
    """Of the probe part: what the longer set of a pair needs."""
    return n - (percent * n + 99) // 100 + 1


def parity(grams: np.ndarray, longs: int = ODD) -> np.ndarray:
    """Bits that the n-grams of a set flip, as signed longs."""
    at = ((grams * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(32)).astype(np.int64) % (64 * longs)
    return np.packbits((np.bincount(at, minlength=64 * longs) & 1).astype(np.uint8)).view("<i8")


def set_hash(grams: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set."""
    whole = xxhash.xxh3_128_intdigest(grams.tobytes())
    return tuple(x - (1 << 64) if x >> 63 else x for x in (whole & ((1 << 64) - 1), whole >> 64))


def fragment_of(keys: np.ndarray) -> np.ndarray:
    """Which of the order's fragments a key falls in."""
    return ((keys.view(np.uint64) ^ _TOP) >> np.uint64(64 - (FRAGMENTS.bit_length() - 1))).astype(np.int32)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)]).astype(np.int64)))


def common_grams(docs: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of n-grams that many documents have: a hint for the order, so it may miss some."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        held: list[np.ndarray] = []
        total = 0

        def report() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts >= max(4, int(len(held) * COMMON_SHARE))
            return pa.RecordBatch.from_arrays([pa.array(values[many].view(np.int64)), pa.array(counts[many].astype(np.int64))], ["gram", "n"])

        for part in slices(batches, SLICE):
            for grams in shingles.each(part.column("text").to_pylist()):
                held.append(grams)
                total += len(grams)
                if total >= COUNT_CHUNK:
                    yield report()
                    held, total = [], 0
        if held:
            yield report()

    least = max(COMMON_LEAST, int(docs.count() * COMMON_SHARE))
    found = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "gram").limit(MOST_COMMON).select("gram")
    return np.sort(found.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def _sets(rows: DataFrame, size: int, percent: int, common) -> DataFrame:
    """``doc_id, part, cid, alt, n, share, prefix, keys, odd, wide``: a set's hashes, size, share of common n-grams, probe part, min-hashes and parity bits; arrays are empty for a set that the task has met."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingles(size), set()
        none = np.zeros(0, np.int64)
        for part in slices(batches, SLICE):
            cid, alt, n, prefix, keys, share, odd, wide = [], [], [], [], [], [], [], []
            for grams in shingles.each(part.column("text").to_pylist()):
                both = set_hash(grams) if len(grams) else (0, 0)
                cid.append(both[0])
                alt.append(both[1])
                n.append(len(grams))
                new = len(grams) > 0 and both not in seen
                if len(seen) < 500_000:
                    seen.add(both)
                key = ordered(grams, common.value) if new else none
                share.append(1.0 - float(np.searchsorted(key, 0)) / len(key) if new else 0.0)  # keys of common n-grams aren't negative
                prefix.append(key[: prefix_length(len(key), percent)] if new else none)
                keys.append((_MULTIPLIERS[:, None] * grams).min(axis=1).view(np.int64) if new else none)
                odd.append(parity(grams) if new else none)
                wide.append(parity(grams, WIDE) if new and len(grams) > LONG else none)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("part"), pa.array(cid, pa.int64()), pa.array(alt, pa.int64()), pa.array(n, pa.int64()), pa.array(share, pa.float64()), _lists(prefix), _lists(keys), _lists(odd), _lists(wide)],
                ["doc_id", "part", "cid", "alt", "n", "share", "prefix", "keys", "odd", "wide"],
            )

    return rows.mapInArrow(work, "doc_id long, part long, cid long, alt long, n long, share double, prefix array<long>, keys array<long>, odd array<long>, wide array<long>")


def _told_apart(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """``sets`` with classes of their own for sets that met in one 64-bit hash by chance."""
    for turn in range(1, 64):
        met = sets.where("n > 0").groupBy("cid").agg(F.min("alt").alias("lo"), F.max("alt").alias("hi")).where("lo <> hi").select(F.col("cid").alias("_c"))
        if not met.limit(1).count():
            break
        cid = F.when(F.col("_c").isNotNull(), F.xxhash64("cid", "alt", F.lit(turn))).otherwise(F.col("cid"))
        sets = scratch.put(sets.join(met, F.col("cid") == F.col("_c"), "left").withColumn("cid", cid).drop("_c"), f"sets{turn}")
    return sets


def _segments(rows: DataFrame, size: int, common) -> DataFrame:
    """``cid, fragment, grams`` of the given texts' sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for part in slices(batches, SLICE):
            cids, fragments, grams = [], [], []
            for cid, own_grams in zip(part.column("cid").to_pylist(), shingles.each(part.column("text").to_pylist()), strict=True):
                keys = ordered(own_grams, common.value)
                own = fragment_of(keys)
                edges = np.searchsorted(own, np.arange(FRAGMENTS + 1))
                for f in np.flatnonzero(np.diff(edges)):
                    cids.append(cid)
                    fragments.append(int(f))
                    grams.append(keys[edges[f] : edges[f + 1]])
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(fragments, pa.int32()), _lists(grams)], ["cid", "fragment", "grams"])

    return rows.mapInArrow(work, "cid long, fragment int, grams array<long>")


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """``a, b, na, nb, both``: overlaps counted in each fragment and summed per pair."""
    left = pairs.join(segments.select(F.col("cid").alias("a"), "fragment", F.col("grams").alias("x")), "a")
    met = left.join(segments.select(F.col("cid").alias("b"), "fragment", F.col("grams").alias("y")), ["b", "fragment"])
    partial = met.select("a", "b", "na", "nb", F.size(F.array_intersect("x", "y")).alias("part"))
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))


def _pair(x: str, y: str, nx: str, ny: str) -> list:
    first = F.col(x) < F.col(y)
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.when(first, F.col(nx)).otherwise(F.col(ny)).alias("na"), F.when(first, F.col(ny)).otherwise(F.col(nx)).alias("nb")]


def _bits_allow(x: str, y: str, nx: str, ny: str, longs: int, percent: int) -> Column:
    """Whether parity bits leave room for the overlap that the sizes ask for."""
    differ = sum((F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(1, longs)), F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0])))
    total = F.col(nx) + F.col(ny)
    return (100 + percent) * (total - differ) >= 2 * percent * total


def _near_enough(x: str, y: str, nx: str, ny: str, percent: int) -> Column:
    """Whether sizes and the shorter parity bits leave room for the overlap that the sizes ask for."""
    return (100 * F.least(F.col(nx), F.col(ny)) >= percent * F.greatest(F.col(nx), F.col(ny))) & _bits_allow(x, y, nx, ny, ODD, percent)


def _chained(classes: DataFrame, salts: int, percent: int) -> DataFrame:
    """``a, b, na, nb``: classes under one key with the hub and with a neighbour in size, where enough of their min-hashes agree.

    A key's group is dealt out by salts; each has a hub of its own, the best of which, out of
    ``salts`` rows at most, is the group's. What this misses, the fragments find.
    """
    # Copies of one text with edits of their own may be less alike than each is to that text, whose n-grams are the common ones.
    keys = F.array(*[F.struct(F.lit(j).alias("turn"), F.xxhash64(*[F.col("keys")[j + k] for k in range(KEYED)]).alias("key")) for j in range(0, HASHES, KEYED)])
    each = classes.select("cid", F.explode(keys).alias("k")).select("cid", "k.turn", "k.key")
    # Most keys are of one class; these go before anything wider is sent.
    each = each.join(each.groupBy("turn", "key").count().where("count > 1"), ["turn", "key"], "left_semi")
    each = each.join(classes.select("cid", "n", "share", "keys", "odd"), "cid").withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(salts)))
    member = F.struct("share", "cid", "n", "keys", "odd")
    own, whole = Window.partitionBy("key", "turn", "salt"), Window.partitionBy("key", "turn")
    rows = each.withColumns({"hub": F.max(member).over(own), "last": F.lag(member).over(own.orderBy("n", "cid"))})
    heads = rows.where("hub.cid = cid").withColumn("top", F.max("hub").over(whole)).select("key", "turn", "salt", "top")
    rows = rows.join(heads, ["key", "turn", "salt"])
    near = rows.select("cid", "n", "keys", "odd", F.explode(F.array("hub", "last", "top")).alias("hub")).where("cid <> hub.cid")
    agree = F.aggregate(F.arrays_zip(F.col("keys").alias("x"), F.col("hub.keys").alias("y")), F.lit(0), lambda acc, z: acc + (z["x"] == z["y"]).cast("int"))
    near = near.where((agree >= AGREE) & _near_enough("odd", "hub.odd", "n", "hub.n", percent)).select("cid", "n", F.col("hub.cid").alias("c0"), F.col("hub.n").alias("n0"))
    return near.select(*_pair("cid", "c0", "n", "n0")).distinct()


def _unlike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of pairs of long sets that the wider parity bits rule out."""
    ends = classes.where(F.size("wide") > 0).select("cid", "wide")
    met = pairs.join(ends.select(F.col("cid").alias("a"), F.col("wide").alias("x")), "a").join(ends.select(F.col("cid").alias("b"), F.col("wide").alias("y")), "b")
    return met.where(~_bits_allow("x", "y", "na", "nb", WIDE, percent)).select("a", "b")


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs that may link by what their probe parts share: up to the lesser of both parts' ends, that is the whole overlap."""
    ends = classes.select("cid", "prefix").join(_small(_ends(pairs)), "cid", "left_semi")
    met = pairs.join(ends.select(F.col("cid").alias("a"), F.col("prefix").alias("x")), "a").join(ends.select(F.col("cid").alias("b"), F.col("prefix").alias("y")), "b")
    rest = F.when(F.element_at("x", -1) <= F.element_at("y", -1), F.col("na") - F.size("x")).otherwise(F.col("nb") - F.size("y"))
    return met.where((100 + percent) * (F.size(F.array_intersect("x", "y")) + rest) >= percent * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()


def _small(rows: DataFrame) -> DataFrame:
    """Ids for a broadcast up to BROADCAST_ROWS of them, for a shuffle beyond."""
    return _sent(rows.count())(rows)


def _sent(n: int) -> Callable[[DataFrame], DataFrame]:
    return F.broadcast if n <= BROADCAST_ROWS else lambda rows: rows


def _foremost(pairs: DataFrame) -> DataFrame:
    """For each class its pair with the least partner, on either side."""
    of_a = pairs.groupBy("a").agg(F.min(F.struct("b", "na", "nb")).alias("p")).select("a", "p.b", "p.na", "p.nb")
    of_b = pairs.groupBy("b").agg(F.min(F.struct("a", "na", "nb")).alias("p")).select("p.a", "b", "p.na", "p.nb")
    return of_a.union(of_b).distinct()


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    met = pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
    return met.where("x <> y").select("a", "b", "na", "nb")


def _entries(classes: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """``gram, at, cid, n, root, odd, wide, leading, low, high, before``: probe entries of n-grams that entries of several components may meet in.

    wide is there for common n-grams only. ``leading`` marks index entries; low and high are the least and largest size of a shorter
    partner whose first common n-gram can be this one; before is the n-gram of the set's entry before.
    """
    leading = (100 + percent) * (F.col("n") - F.col("at")) >= 2 * percent * F.col("n")
    low, most = F.expr(f"({percent} * n + 99) div 100"), F.expr(f"({100 + percent} * (n - at)) div {percent} - n")
    high = F.least("n", most)
    moved = _small(roots.where("node <> root").select(F.col("node").alias("cid"), "root"))
    each = classes.select("cid", F.col("n").cast("int").alias("n"), "prefix").join(moved, "cid", "left")
    each = each.select("cid", "n", F.coalesce("root", "cid").alias("root"), F.posexplode("prefix").alias("at", "gram"))
    # Most n-grams are in one class. Of two entries the sizes, and the largest partner that each may have, tell whether they can meet.
    met, own = Window.partitionBy("gram"), F.col("n").cast("long") * (1 << 32) + most
    each = each.select("*", F.min("root").over(met).alias("r0"), F.max("root").over(met).alias("r1"), F.max(leading).over(met).alias("led"), F.count("*").over(met).alias("k"), F.min(own).over(met).alias("p"), F.max(own).over(met).alias("q"))
    can = f"p % {1 << 32} >= q div {1 << 32} AND q % {1 << 32} >= p div {1 << 32} AND 100 * (p div {1 << 32}) >= {percent} * (q div {1 << 32})"
    each = each.where(f"r0 <> r1 AND led AND (k > 2 OR ({can}))").select("gram", "at", "cid", "n", "root")
    each = each.join(classes.select("cid", "odd", "wide"), "cid")
    wide = F.when((F.col("gram") >= 0) & (F.size("wide") > 0), F.col("wide"))
    each = each.select("gram", "at", "cid", F.col("n").cast("long").alias("n"), "root", "odd", wide.alias("wide"))
    each = each.select("*", leading.alias("leading"), low.alias("low"), high.alias("high")).where("leading OR low <= high")
    return each.withColumn("before", F.lag("gram").over(Window.partitionBy("cid").orderBy("at")))


def _apart(entries: DataFrame, roots: DataFrame, sent: Callable[[DataFrame], DataFrame], crowd: int = 1) -> DataFrame:
    """``entries`` under new roots, of n-grams with more than ``crowd`` entries, still of several components; ``sent`` may broadcast n-grams."""
    ids = entries.select("gram", "cid").join(roots.withColumnRenamed("node", "cid"), "cid")
    held = ids.groupBy("gram").agg(F.count("*").alias("k"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    held = sent(held.where((F.col("r0") != F.col("r1")) & (F.col("k") > crowd)).select("gram"))
    return entries.drop("root").join(held, "gram", "left_semi").join(roots.withColumnRenamed("node", "cid"), "cid").select(entries.columns)


def proposed(entries: DataFrame, percent: int, share: int = 1) -> DataFrame:
    """``a, b, na, nb``: pairs of different components that an n-gram's index and probe entries allow; of these one in ``share``, by hashes of both ends."""
    band = lambda x: F.when(F.col("gram") >= 0, F.floor(F.log(x.cast("double")) * BANDS)).otherwise(F.lit(0)).cast("int")
    left = entries.where("leading").select("gram", band(F.col("n")).alias("band"), F.col("cid").alias("x"), F.col("n").alias("nx"), F.col("at").alias("i"), F.col("root").alias("rx"), F.col("odd").alias("ox"), F.col("wide").alias("wx"), F.col("before").alias("bx"))
    right = entries.where("low <= high").select("gram", F.explode(F.sequence(band(F.col("low")), band(F.col("high")))).alias("band"), F.col("cid").alias("y"), F.col("n").alias("ny"), F.col("at").alias("j"), F.col("root").alias("ry"), F.col("odd").alias("oy"), F.col("wide").alias("wy"), F.col("before").alias("by"))
    shorter = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    enough = (100 + percent) * F.least(F.col("nx") - F.col("i"), F.col("ny") - F.col("j")) >= percent * (F.col("nx") + F.col("ny"))
    l, r = left.alias("l"), right.alias("r")
    first = F.coalesce(F.col("bx") != F.col("by"), F.lit(True))
    on = (F.col("l.gram") == F.col("r.gram")) & (F.col("l.band") == F.col("r.band")) & shorter & (F.col("rx") != F.col("ry")) & first & enough
    if share > 1:  # by two hashes, so that a share's members meet in cells of their own
        l, r = left.withColumn("cell", F.pmod(F.xxhash64("x", F.lit(1)), F.lit(share))).alias("l"), right.withColumn("cell", F.pmod(F.xxhash64("y", F.lit(2)), F.lit(share))).alias("r")
        on = on & (F.col("l.cell") == F.col("r.cell"))
    on = on & _near_enough("ox", "oy", "nx", "ny", percent) & F.coalesce(_bits_allow("wx", "wy", "nx", "ny", WIDE, percent), F.lit(True))
    return l.join(r, on).select(*_pair("x", "y", "nx", "ny")).distinct()


def near_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, part, n_shingles, component, component_id`` for every row.

    component_id is the least doc_id reachable by links, component an id that no other group
    has, null for empty sets.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    repeat = ids_repeat(docs)
    rows = identified(docs, repeat=repeat)
    common = spark.sparkContext.broadcast(common_grams(rows, size))
    sets = _told_apart(scratch.put(_sets(rows, size, percent, common), "sets"), scratch)
    release(spark)
    keyed = scratch.put(sets.where(F.size("keys") > 0).dropDuplicates(["cid"]), "keyed")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that link: partial counts by fragment, summed. Only texts of these pairs are read again."""
        ends = scratch.put(_ends(pairs), f"ends_{name}")
        again = keyed.join(ends, "cid", "left_semi").select("cid", F.col("doc_id").alias("_d"), F.col("part").alias("_p"))
        again = F.broadcast(again) if ends.count() <= BROADCAST_ROWS else again.hint("shuffle_hash")
        texts = rows.join(again, rows["doc_id"].eqNullSafe(again["_d"]) & (rows["part"] == again["_p"])).select("cid", "text")
        if repeat:  # a repeated row would give its class every n-gram again
            texts = texts.dropDuplicates(["cid"])
        segments = scratch.put(_segments(texts, size, common), f"segments_{name}")
        release(spark)
        enough = 100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))
        links = scratch.put(overlaps(pairs, segments).where(enough).select("a", "b"), f"links_{name}")
        scratch.drop(f"ends_{name}", f"segments_{name}")
        release(spark)
        return links

    salts = max(16, keyed.count() // 50_000)
    links = linked(scratch.put(_chained(keyed, salts, percent), "chained"), "chains")
    roots = _rooted(keyed.select(F.col("cid").alias("node"), F.col("cid").alias("root")), links, scratch, "roots_chains")
    entries = scratch.put(_entries(keyed, roots, percent), "entries")
    release(spark)
    # Shares of the pairs of crowded n-grams first: what these join needs no further pair.
    crowds = scratch.put(entries.groupBy("gram").count().where(F.col("count") > CROWD), "crowds")
    crowd, n = crowds.agg(F.max("count"), F.count("*")).first()
    sent = _sent(n)
    share, joined = 1, False
    while (crowd or 0) > CROWD * share:
        share *= STEP
    if share > 1:
        few = sent(crowds.select("gram"))
        crowded, rest = scratch.put(entries.join(few, "gram", "left_semi"), "crowded"), entries.join(few, "gram", "left_anti")
    while share > 1:
        some = scratch.put(proposed(_apart(crowded, roots, sent, CROWD * share // STEP), percent, share), f"some{share}")
        if some.limit(1).count():
            joined, roots = True, _rooted(roots, linked(some, f"some{share}"), scratch, f"roots_some{share}")
        scratch.drop(f"some{share}")
        release(spark)
        share //= STEP
    pairs = proposed(entries, percent)
    if joined:
        pairs = _between(proposed(rest.union(scratch.put(_apart(crowded, roots, sent), "crowded_apart")), percent), roots)
    pairs = scratch.put(pairs, "proposed")
    scratch.drop("entries", "crowded", "crowded_apart")
    release(spark)
    pairs = scratch.put(pairs.join(scratch.put(_unlike(pairs, keyed, percent), "unlike"), ["a", "b"], "left_anti"), "likely")
    pairs = scratch.put(_possible(pairs, keyed, percent), "possible")
    release(spark)
    # A pair for each class first: what these join needs no further pair.
    first = scratch.put(_foremost(pairs), "foremost")
    if first.limit(1).count():
        roots = _rooted(roots, linked(first, "foremost"), scratch, "roots_foremost")
        pairs = scratch.put(_between(pairs.join(first.select("a", "b"), ["a", "b"], "left_anti"), roots), "between")
        if pairs.limit(1).count():
            roots = _rooted(roots, linked(pairs, "rest"), scratch, "roots")

    classes = sets.groupBy("cid").agg(F.min("doc_id").alias("least"))
    classes = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.select("cid", "root").join(named, "root").select("cid", F.col("root").alias("component"), "component_id")
    out = sets.where("n > 0").select("doc_id", "part", "n", "cid").join(named, "cid").select("doc_id", "part", F.col("n").alias("n_shingles"), "component", "component_id")
    empty = sets.where("n = 0").select("doc_id", "part", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    out = scratch.put(out.union(empty), "out")
    scratch.drop("sets", "keyed", "chained", "proposed", "unlike", "likely", "possible", "foremost", "between", "links_chains", "links_foremost", "links_rest", "roots_chains", "roots_foremost", "roots")
    release(spark)
    return out


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group: the least doc_id, by the text's hash where a doc_id has several texts.

    Rows with an empty set are no copies of each other and stay.
    """
    groups = near_groups(docs, size, percent)
    first = groups.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "part")).alias("f")).select("f.doc_id", "f.part")
    kept = first.union(groups.where("component IS NULL").select("doc_id", "part")).distinct()
    kept = kept.select(F.col("doc_id").alias("_d"), F.col("part").alias("_p")).hint("shuffle_hash")
    repeat = ids_repeat(docs)
    rows = identified(docs, all_columns=True, repeat=repeat)
    out = rows.join(kept, rows["doc_id"].eqNullSafe(kept["_d"]) & (rows["part"] == kept["_p"]), "left_semi")
    if repeat:
        empty = F.coalesce(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", ""), F.lit("")) == ""
        out = out.where(~empty).dropDuplicates(["doc_id", "part"]).unionByName(out.where(empty))
    return restored(out, docs.columns)


def _rooted(roots: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, root`` after ``links`` as well: only components that they join are looked at."""
    sent = _sent(links.count())
    ends = roots.select(F.col("node").alias("a"), F.col("root").alias("x")).join(sent(links), "a").select("x", "b")
    ends = roots.select(F.col("node").alias("b"), F.col("root").alias("y")).join(sent(ends), "b")
    found = sent(components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    joined = roots.join(found.select(F.col("node").alias("root"), F.col("root").alias("_r")), "root", "left")
    return scratch.put(joined.select("node", F.coalesce("_r", "root").alias("root")), name)
