"""Operator 7: document fingerprints as Merkle trees over sections and paragraphs.

A paragraph is a line, a section a run of paragraphs that ends after one whose hash begins with
0 to 3, so section borders follow the content. A paragraph's leaves are its sentences: 64 bits
of their hash, and their length. A paragraph's hash is that of its leaves, a section's that of its
paragraphs' hashes, and the root that of the sections' hashes:

    <root>#<section>:<paragraph>=<leaf>.<length>,...;<paragraph>=...|<section>:...

Equal roots mean equal texts; where roots differ, ``edits`` passes over sections and paragraphs
with known hashes and locates the rest. ``proof`` gives what shows that a section belongs to a
root without the others' text. Likeness is the share of leaf characters in common, repeated
sentences counted as often as they occur.

Null texts count as empty. An empty text has one empty paragraph. Equal texts have equal
fingerprints. Rows are ordered by doc_id from the largest, null last, ties by the MD5 of the text
from the largest; "next" goes round from the last to the first, so a lone row is its own next. An empty table gives no rows.
Very long texts are read whole. Extra columns, under any name, are not read.
All of this is built-in functions: no Python runs on the executors.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphaudit.llm.common import input_bytes

#: A sentence, cut at 160 characters.
SENTENCE = "[^.!?]{1,160}[.!?]*|[.!?]+"
LEAF = "[0-9a-f]{16}[.][0-9]+"
#: Rows are dealt out by doc_id ranges of about so many bytes. Borders are held by the driver, so
#: past so many ranges these grow instead, to 1.5 GB at 100 TB, which a task sorts and scans with spills.
BLOCK_BYTES, MOST_BLOCKS = 8 << 20, 65_536
#: Borders are quantiles of about so many ids a range. They decide the layout only.
BORDER_IDS = 200
_LOWEST = -(1 << 63)


def _md5(x: Column, n: int) -> Column:
    return F.substring(F.md5(x.cast("binary")), 1, n)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body and its lambdas refer to it."""
    return F.transform(F.array(value), body)[0]


def fingerprint(text: Column) -> Column:
    """The serialised tree of a text."""

    def leaf(s: Column) -> Column:
        return F.concat(_md5(s, 16), F.lit("."), F.length(s).cast("string"))

    def paragraph(p: Column) -> Column:
        leaves = F.array_join(F.transform(F.regexp_extract_all(p, F.lit(SENTENCE), F.lit(0)), leaf), ",")
        return _let(leaves, lambda x: F.concat(_md5(x, 16), F.lit("="), x))

    def section(s: Column) -> Column:
        return F.concat(_md5(F.array_join(F.regexp_extract_all(s, F.lit("([0-9a-f]{16})="), F.lit(1)), ""), 16), F.lit(":"), s)

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), paragraph)
    ended = F.transform(lines, lambda p: F.concat(p, F.when(F.substring(p, 1, 1) < "4", F.lit("|")).otherwise(F.lit(";"))))
    sections = F.transform(F.split(F.regexp_replace(F.array_join(ended, ""), "[|;]$", ""), "[|]"), section)
    return _let(sections, lambda x: F.concat(F.md5(F.array_join(F.transform(x, lambda s: F.substring(s, 1, 16)), "").cast("binary")), F.lit("#"), F.array_join(x, "|")))


def proof(tree: Column, section: Column) -> Column:
    """``struct<before, hash, after>``: the section's hash, and the other sections' hashes before and after it."""
    hashes = F.array_join(F.transform(F.split(F.substring_index(tree, "#", -1), "[|]"), lambda s: F.substring(s, 1, 16)), "")
    return F.struct(F.substring(hashes, F.lit(1), section * 16).alias("before"), F.substring(hashes, section * 16 + 1, F.lit(16)).alias("hash"), F.substring(hashes, section * 16 + 17, F.lit(1 << 30)).alias("after"))


def proves(root: Column, body: Column, proof: Column) -> Column:
    """Whether a section's serialised paragraphs and a proof give the root."""
    own = _md5(F.array_join(F.regexp_extract_all(body, F.lit("([0-9a-f]{16})="), F.lit(1)), ""), 16)
    return (own == proof["hash"]) & (F.md5(F.concat(proof["before"], own, proof["after"]).cast("binary")) == root)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: twice the leaf characters in common over the leaf characters of both."""

    def leaves(x: Column) -> Column:
        return F.array_sort(F.regexp_extract_all(x, F.lit(LEAF), F.lit(0)))

    def numbered(x: Column) -> Column:
        """The k-th of equal leaves gets the number k, so that common elements are those of multisets."""

        def runs(s: Column) -> Column:
            begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
            return _let(begins, lambda at: F.flatten(F.transform(at, lambda i, k: F.transform(F.sequence(F.lit(0), F.coalesce(F.get(at, k + 1), F.size(s)) - i - 1), lambda n: F.concat(F.get(s, i), F.lit("#"), n.cast("string"))))))

        return F.when(F.size(F.array_distinct(x)) == F.size(x), F.transform(x, lambda v: F.concat(v, F.lit("#0")))).otherwise(runs(x))

    def weight(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("long"), lambda acc, v: acc + F.substring_index(F.substring(v, 18, 1 << 30), "#", 1).cast("long"))

    def ratio(x: Column, y: Column) -> Column:
        return _let(weight(x) + weight(y), lambda both: F.when(both == 0, F.lit(0.0)).otherwise(F.lit(2.0) * weight(F.array_intersect(x, y)) / both))

    one = lambda x: _let(leaves(x), numbered)
    return F.when(a == b, F.lit(1.0)).otherwise(_let(one(a), lambda x: _let(one(b), lambda y: ratio(x, y))))


def edits(a: Column, b: Column) -> Column:
    """``array<struct<section, paragraph>>``: the paragraphs of ``a`` that differ from those of ``b``, from 0.

    Sections whose hash occurs in ``b`` are passed over whole.
    """
    theirs = F.split(F.substring_index(b, "#", -1), "[|]")
    known = F.transform(theirs, lambda s: F.substring(s, 1, 16))
    paragraphs = F.regexp_extract_all(b, F.lit("([0-9a-f]{16})="), 1)

    def section(s: Column, i: Column) -> Column:
        own = F.transform(F.split(F.substring(s, 18, 1 << 30), ";"), lambda p, j: F.struct(i.alias("section"), j.alias("paragraph"), F.substring(p, 1, 16).alias("hash")))
        return F.when(F.array_contains(known, F.substring(s, 1, 16)), F.slice(own, 1, 0)).otherwise(F.filter(own, lambda p: ~F.array_contains(paragraphs, p["hash"])))

    found = F.flatten(F.transform(F.split(F.substring_index(a, "#", -1), "[|]"), section))
    return F.transform(found, lambda p: F.struct(p["section"].alias("section"), p["paragraph"].alias("paragraph")))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs(doc_id, text, ...)`` with ``next_<column>``: the columns of the next row by doc_id, from the largest, going round.

    Borders cut the order into ranges, and the rows of a doc_id that fills several ranges, null
    included, into ranges of their text's hash. A border is a row: it goes to its own range and,
    as the row that follows, to the range before it, so no task sees all rows. Only rows equal in doc_id and text stay together.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST))
    tie = F.conv(F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") + F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.lit(1 << 60))
    n = int(min(MOST_BLOCKS, -(-input_bytes(docs) // BLOCK_BYTES)))
    row = docs.agg(F.count("*").alias("n"), F.max(key).alias("most")).first()
    most, share = row["most"] if row["most"] is not None else 0, min(1.0, BORDER_IDS * n / max(1, row["n"]))
    asked = [i / n for i in range(1, n)]
    at = []
    if asked:
        drawn = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1) if share < 1 else docs
        at = drawn.agg(F.percentile_approx(key, asked, 20 * n + 1000).alias("at")).first()["at"] or []
    bounds = sorted({x for x in at if x < most})
    # A doc_id at several quantiles is cut by hash; the largest hash of each piece is its border.
    pieces = {v: c for v, c in Counter(at).items() if c > 1}
    tops: dict[int, list[int]] = {}
    if pieces:
        steps = F.create_map(*[F.lit(x) for v, c in pieces.items() for x in (v, -(-(1 << 61) // c))])
        for r in docs.where(key.isin(*pieces)).groupBy(key.alias("key"), F.floor(tie / steps[key]).alias("piece")).agg(F.max(tie).alias("top")).collect():  # MOST_BLOCKS rows at most
            tops.setdefault(r["key"], []).append(r["top"])
    if bounds:
        wide = max(1, int(len(bounds) ** 0.5))
        groups = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
        lasts, nested = F.lit([g[-1] for g in groups]), F.array(*[F.lit(g) for g in groups])
        g = F.size(F.filter(lasts, lambda x: x < F.col("_key")))
        block = F.when(g == len(groups), F.lit(len(bounds))).otherwise(g * wide + F.size(F.filter(F.get(nested, g), lambda x: x < F.col("_key"))))
        is_last = F.coalesce(F.get(F.lit(bounds), F.col("_block")) == F.col("_key"), F.lit(False))
    else:
        block, is_last = F.lit(0), F.lit(False)
    keyed = docs.withColumn("_key", key).withColumn("_tie", tie).withColumn("_block", block)
    if tops:
        own = F.create_map(*[x for v, t in tops.items() for x in (F.lit(v), F.lit(sorted(t)))])[F.col("_key")]
        piece = F.coalesce(F.size(F.filter(own, lambda x: x < F.col("_tie"))), F.lit(0))
        border = F.coalesce(F.array_contains(own, F.col("_tie")), F.lit(True))
        inner = F.coalesce(piece < F.size(own) - 1, F.lit(False))
    else:
        piece, border, inner = F.lit(0), F.lit(True), F.lit(False)
    keyed = keyed.withColumns({"_piece": piece, "_border": border, "_inner": inner})

    def place(block: Column, piece: Column | int, extra: int) -> Column:
        return F.struct(block.cast("int").alias("block"), (F.lit(piece) if isinstance(piece, int) else piece).cast("int").alias("piece"), F.lit(extra).alias("extra"))

    here = place(F.col("_block"), F.col("_piece"), 0)
    where = (
        F.when(F.col("_border") & F.col("_inner"), F.array(here, place(F.col("_block"), F.col("_piece") + 1, 1)))
        .when(F.col("_border") & (F.col("_key") == most), F.array(here, place(F.lit(0), 0, 1)))
        .when(F.col("_border") & is_last, F.array(here, place(F.col("_block") + 1, 0, 1)))
        .otherwise(F.array(here))
    )
    order = Window.partitionBy("_at.block", "_at.piece").orderBy("_at.extra", F.col("_key").desc(), F.col("_tie").desc(), F.col("text").desc())
    out = keyed.withColumn("_at", F.explode(where)).withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return out.where("_at.extra = 0").drop("_key", "_tie", "_block", "_piece", "_border", "_inner", "_at")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text, edited, fingerprint, edited_fingerprint, next_fingerprint`` for every row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(rows.withColumn("fingerprint", fingerprint(F.col("text"))), ["text", "fingerprint"])
    third = F.floor(F.length("text") / 3).cast("int")
    edited = paired.select("doc_id", "text", "fingerprint", "next_fingerprint", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("next_text"), F.lit(1), third)).alias("edited"))
    return edited.withColumn("edited_fingerprint", fingerprint(F.col("edited")))


def digest(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def _sql_fingerprint(x: str) -> str:
    leaf = "substr(md5(s), 1, 16) || '.' || length(s)"
    hashes = "array_to_string(regexp_extract_all(b, '([0-9a-f]{16})=', 1), '')"
    lines = f"list_transform(string_split({x}, chr(10)), lambda p: array_to_string(list_transform(regexp_extract_all(p, '{SENTENCE}'), lambda s: {leaf}), ','))"
    ended = f"list_transform(list_transform({lines}, lambda q: substr(md5(q), 1, 16) || '=' || q), lambda q: q || CASE WHEN q < '4' THEN '|' ELSE ';' END)"
    body = f"regexp_replace(array_to_string({ended}, ''), '[|;]$', '')"
    sections = f"list_transform(string_split(body, '|'), lambda b: substr(md5({hashes}), 1, 16) || ':' || b)"
    return f"(SELECT md5(array_to_string(list_transform(t, lambda s: substr(s, 1, 16)), '')) || '#' || array_to_string(t, '|') FROM (SELECT {sections} AS t FROM (SELECT {body} AS body)))"


def _sql_likeness(a: str, b: str) -> str:
    counts = lambda x: f"list_aggregate(regexp_extract_all({x}, '{LEAF}'), 'histogram')"
    weight = lambda x: f"coalesce(list_sum(list_transform(regexp_extract_all({x}, '{LEAF}'), lambda v: substr(v, 18)::BIGINT)), 0)::BIGINT"
    common = f"(SELECT coalesce(sum(least(x.n, y.n) * substr(x.v, 18)::BIGINT), 0)::BIGINT FROM (SELECT unnest(map_keys({counts(a)})) AS v, unnest(map_values({counts(a)})) AS n) x JOIN (SELECT unnest(map_keys({counts(b)})) AS v, unnest(map_values({counts(b)})) AS n) y USING (v))"
    both = f"({weight(a)} + {weight(b)})"
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {both} = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {common} / {both} END"


def sql() -> str:
    tie = "('0x' || substr(md5(text), 1, 15))::BIGINT"
    order = f"ORDER BY doc_id DESC NULLS LAST, {tie} DESC, text DESC"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER ({order}), first_value(text) OVER ({order})) AS after FROM d),
e AS (SELECT doc_id, text, after, substr(text, 1, length(text) - length(text) // 3) || substr(after, 1, length(text) // 3) AS edited FROM n),
f AS (SELECT doc_id, text, edited, {_sql_fingerprint('text')} AS fingerprint, {_sql_fingerprint('edited')} AS edited_fingerprint, {_sql_fingerprint('after')} AS next_fingerprint FROM e)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
  {_sql_likeness('fingerprint', 'edited_fingerprint')} AS near_edited, {_sql_likeness('fingerprint', 'next_fingerprint')} AS near_next FROM f"""
