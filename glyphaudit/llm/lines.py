"""Operator 13: drops lines that occur in many documents, counted through levelled sorted runs.

A line's key is the line without blanks at both ends, A-Z in lower case; its hash the key's MD5. A
batch of documents becomes one sorted run of ``(line, n)``, n being the documents of the batch that
have the line. Before it is added, the batch is anti-joined by a merge join with the keys that the
runs already have in enough documents: those are settled and aren't counted on. Whenever a level
has ``FAN`` runs they are merged into one run of the next level, so a line is rewritten once a level.
All runs together give the lines that go. Their positions are gathered for each distinct text and
joined to the documents.

Each row is a document. Null texts are empty: one empty line. Lines with too short keys always
stay. Copies share their positions and are told apart by nothing. Very long texts are read whole.
Rows equal in all columns stay as often as they occur. An empty table gives no rows. Extra columns
are not read. All of this is built-in functions: no Python runs on the executors.

Hot keys: counts are added up within tasks first. Lines with a 10000th or more of any batch's rows,
and texts with as many of all documents, are at most 10000 a batch; those lines are broadcast, and
documents of those texts are spread over parts as their share demands, with their positions beside.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphaudit.llm.common import Scratch, release

#: Runs of a level that are merged into one of the next.
FAN = 4
#: Batches that the query adds one after another.
BATCHES = 8
#: A key with this part of all rows counts as hot, so there are no more hot keys than this.
HOT = 10_000
#: Parts over which a text with all documents would be spread.
PARTS = 2048
_BLANKS = " \t\n\x0b\x0c\r"


def key(line: Column) -> Column:
    """A line without blanks at both ends, with A-Z (and no other letters) in lower case."""
    bare = F.btrim(line, F.lit(_BLANKS))
    plain = F.octet_length(bare) == F.length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def hashed(docs: DataFrame, shortest: int = 1, batches: int = BATCHES) -> DataFrame:
    """``text_md5, batch, lines`` for every document; a line with too short a key is an empty string."""
    text = F.coalesce("text", F.lit(""))
    line = lambda k: F.when(F.length(k) >= max(shortest, 1), F.md5(k.cast("binary"))).otherwise(F.lit(""))
    return docs.select(
        F.md5(text.cast("binary")).alias("text_md5"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long"), text), F.lit(batches)).cast("int").alias("batch"),
        F.transform(F.transform(F.split(text, "\n"), key), line).alias("lines"),
    )


class LineRuns:
    """Sorted runs of ``(line, n)`` in levels, as tables of a scratch folder.

    ``add`` takes one batch, ``(line, n)`` with each line once; ``frequent`` gives the lines
    in ``least`` documents or more over all batches.
    """

    def __init__(self, scratch: Scratch, least: int, fan: int = FAN):
        self.scratch, self.least, self.fan = scratch, least, fan
        self.levels: list[list[str]] = []
        self.tables: dict[str, DataFrame] = {}
        self._written = 0

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"run{level}-{self._written}"
        self._written += 1
        self.tables[name] = self.scratch.put(rows.sortWithinPartitions("line"), name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _all(self, names: list[str]) -> DataFrame:
        out = self.tables[names[0]]
        for name in names[1:]:
            out = out.unionAll(self.tables[name])
        return out

    def add(self, batch: DataFrame) -> None:
        """Adds one batch as a run of the lowest level, without lines that are settled, and merges full levels."""
        if self.tables:
            settled = self._all(list(self.tables)).where(F.col("n") >= self.least).select("line")
            batch = batch.join(settled.hint("merge"), "line", "left_anti")
        self._write(batch.groupBy("line").agg(F.sum("n").alias("n")), 0)
        level = 0
        while len(self.levels[level]) >= self.fan:
            full, self.levels[level] = self.levels[level], []
            self._write(self._all(full).groupBy("line").agg(F.sum("n").alias("n")), level + 1)
            for name in full:
                del self.tables[name]
            self.scratch.drop(*full)
            level += 1

    def frequent(self) -> DataFrame:
        return self._all(list(self.tables)).groupBy("line").agg(F.sum("n").alias("n")).where(F.col("n") >= self.least).select("line")


def without(lines: Column, gone: Column) -> Column:
    """Lines but for those at the ascending positions ``gone``: the slices between them."""
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda p: p + 1))
    ends = F.concat(gone, F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))


def drop_lines(docs: DataFrame, least: int = 10, shortest: int = 1, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` for every document, its text without the lines that ``least`` documents have."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    whole = scratch.put(hashed(docs, shortest, batches), "hashes")
    counted = whole.select("batch", F.explode(F.array_distinct("lines")).alias("line")).where("line <> ''").groupBy("batch", F.unhex("line").alias("line")).agg(F.count("*").alias("n"))
    counted = scratch.put(counted, "counts")
    sizes = {r["batch"]: r["rows"] for r in counted.groupBy("batch").agg(F.sum("n").alias("rows")).collect()}
    runs = LineRuns(scratch, least, fan)
    for batch in range(batches):
        runs.add(counted.where(F.col("batch") == batch).select("line", "n"))
    gone = scratch.put(runs.frequent(), "frequent")

    share = F.lit(0)
    for batch, rows in sizes.items():
        share = F.when(F.col("batch") == batch, F.lit(rows)).otherwise(share)
    # At most HOT lines of each batch.
    hot = F.broadcast(counted.where(F.col("n") * HOT >= share).select("line").distinct().join(gone, "line", "left_semi"))
    places = whole.select("text_md5", F.posexplode("lines").alias("place", "line")).where("line <> ''").select("text_md5", "place", F.unhex("line").alias("line"))
    rest = places.join(hot, "line", "left_anti").join(gone.hint("merge"), "line", "left_semi")
    marked = places.join(hot, "line", "left_semi").unionByName(rest).select("text_md5", "place").distinct()
    texts = scratch.put(marked.groupBy("text_md5").agg(F.sort_array(F.collect_list("place")).alias("gone")), "places")

    n_docs = whole.count()
    # At most HOT texts.
    heavy = scratch.put(whole.groupBy("text_md5").agg(F.count("*").alias("n")).where(F.col("n") * HOT >= n_docs).select("text_md5", F.ceil(F.col("n") * PARTS / n_docs).cast("int").alias("parts")), "heavy")
    release(spark)
    part = F.pmod(F.monotonically_increasing_id(), F.coalesce("parts", F.lit(1))).cast("int")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.md5(text.cast("binary")).alias("text_md5")).join(F.broadcast(heavy), "text_md5", "left").withColumn("part", part).drop("parts")
    spread = texts.join(F.broadcast(heavy), "text_md5", "left").select("text_md5", "gone", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    both = rows.join(spread, ["text_md5", "part"], "left")
    lines = F.split("text", "\n")
    return both.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(without(lines, F.col("gone")), "\n")).alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def sql(least: int = 10, shortest: int = 1) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS k FROM l),
f AS (SELECT k FROM k WHERE length(k) >= {max(shortest, 1)} GROUP BY k HAVING count(DISTINCT id) >= {least}),
m AS (SELECT id, line, place, f.k IS NOT NULL AS gone FROM k LEFT JOIN f ON k.k = f.k),
s AS (SELECT id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') AS kept FROM m GROUP BY id)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM s JOIN d USING (id)"""
