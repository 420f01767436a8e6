"""A page's markup as a parent-pointer table: one row an element or text, in document order.

``page_markup`` is a table function for SQL, called laterally on a table of pages. What follows
from an element's place (its path, what it inherits, what it stands in) is a recursive query over that
table, level by level from the root; ``ancestry`` is that query, and ``text_rows`` what a page's visible
texts look like by it, equal to what ``html.text_nodes`` finds with the parser's own stack.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphaudit.sources import html as source

MARKUP = "ord int, parent int, tag string, anchor string, lang string, dir string, class string, hidden boolean, turned boolean, text string"
#: Levels of elements below the root that are followed; a deeper page raises an error.
DEEPEST = 1000


class _Recorder(source.TextNodes):
    """Elements and texts with the place of the element that they stand in."""

    def __init__(self):
        super().__init__(most_nodes=0, most_text=0)
        self.n = 0
        self.out: list[tuple] = []

    def _put(self, parent, *rest) -> None:
        self.out.append((self.n, None if parent is None else parent.ord, *rest))
        self.n += 1

    def opened(self, e) -> None:
        e.ord = self.n
        a = e.attrs
        self._put(e.parent, e.tag, source.anchor(a["id"]) if a.get("id") else None, a.get("lang"), a.get("dir"), a.get("class"), e.own_hidden, source.turned(e), None)

    def handle_data(self, data: str) -> None:
        if self.at is not None:
            self._put(self.at, None, None, None, None, None, False, False, data)


def markup_of(html: str | None) -> list[tuple]:
    parser = _Recorder()
    parser.feed(html or "")
    parser.close()
    return parser.out


@F.udtf(returnType=MARKUP, useArrow=True)
class PageMarkup:
    """``page_markup(html)``: the rows of one page."""

    def eval(self, html: str) -> Iterator[tuple]:
        yield from markup_of(html)


def register(spark: SparkSession) -> None:
    """Makes ``page_markup`` known to SQL."""
    spark.udtf.register("page_markup", PageMarkup)


def markup(pages: DataFrame) -> DataFrame:
    """``page_id`` and the markup's columns for ``pages(page_id, html)``."""
    spark = pages.sparkSession
    register(spark)
    return spark.sql("SELECT CAST(p.page_id AS STRING) AS page_id, m.* FROM {pages} p, LATERAL page_markup(p.html) m", pages=pages)


_ANCESTRY = """
WITH RECURSIVE counted AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, parent, tag ORDER BY ord) AS nth, count(*) OVER (PARTITION BY page_id, parent, tag) AS alike
  FROM {markup} WHERE tag IS NOT NULL),
named AS (
  SELECT page_id, ord, parent, tag, lang, dir, class, hidden, turned, anchor, CASE WHEN parent IS NULL AND tag = 'HTML' THEN 'html' WHEN alike > 1 THEN concat(lower(tag), ':nth-of-type(', nth, ')') ELSE lower(tag) END AS part FROM counted),
placed MAX RECURSION LEVEL {deepest} AS (
  SELECT page_id, ord, tag, lang, dir, class, coalesce(anchor, part) AS path, CAST(NULL AS STRING) AS lang_above, CAST(NULL AS STRING) AS dir_above, coalesce(lower(dir) = 'rtl', false) AS in_rtl, tag = 'BDI' AS in_bdi, tag IN ('CODE', 'PRE', 'KBD', 'SAMP') AS in_code,
    turned, false AS turned_above, hidden, tag IN ('HEAD', 'TITLE') AS in_head
  FROM named WHERE parent IS NULL
  UNION ALL
  SELECT e.page_id, e.ord, e.tag, e.lang, e.dir, e.class, coalesce(e.anchor, concat(p.path, ' > ', e.part)),
    CASE WHEN trim(p.lang) <> '' THEN p.lang ELSE p.lang_above END, CASE WHEN trim(p.dir) <> '' THEN p.dir ELSE p.dir_above END,
    p.in_rtl OR coalesce(lower(e.dir) = 'rtl', false), p.in_bdi OR e.tag = 'BDI', p.in_code OR e.tag IN ('CODE', 'PRE', 'KBD', 'SAMP'),
    e.turned, p.turned OR p.turned_above, p.hidden OR e.hidden, p.in_head OR e.tag IN ('HEAD', 'TITLE')
  FROM placed p JOIN named e ON e.page_id = p.page_id AND e.parent = p.ord)
SELECT * FROM placed"""


def ancestry(markup: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """Each element with its path and what it inherits, from the root down.

    The session's limit on a recursive query's rows is lifted, as a table of pages has any number of elements.
    """
    spark = markup.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(_ANCESTRY.replace("{deepest}", str(deepest)), markup=markup)


def text_rows(markup: DataFrame, most_nodes: int = source.MOST_NODES, most_text: int = source.MOST_TEXT) -> DataFrame:
    """Visible texts with the columns that ``html.text_nodes`` has."""
    texts = markup.where("tag IS NULL").select("page_id", "ord", "parent", F.regexp_replace("text", source.BLANK_ENDS, "").alias("text"))
    places = ancestry(markup).alias("e")
    seen = texts.alias("t").join(places, (F.col("t.page_id") == F.col("e.page_id")) & (F.col("t.parent") == F.col("e.ord"))).select("t.page_id", "t.ord", "t.text", *[f"e.{c}" for c in ("path", "tag", "lang", "dir", "class", "lang_above", "dir_above", "in_rtl", "in_bdi", "in_code", "turned_above", "hidden", "in_head")])
    shown = seen.where((F.col("text") != "") & ~F.col("tag").isin(*source.SILENT) & ~F.col("in_head") & ~F.col("hidden"))
    numbered = shown.withColumn("node_ord", F.row_number().over(Window.partitionBy("page_id").orderBy("ord")) - 1)
    last = numbered.where(F.col("node_ord") == most_nodes - 1).select("page_id", F.col("ord").alias("last"))
    cut = texts.join(last, "page_id").groupBy("page_id").agg(F.max(F.col("ord") > F.col("last")).alias("truncated"))
    roots = markup.where("parent IS NULL AND tag = 'HTML'").groupBy("page_id").agg(F.min_by("lang", "ord").alias("document_lang"), F.min_by("dir", "ord").alias("document_dir"))
    out = numbered.where(F.col("node_ord") < most_nodes).join(cut, "page_id", "left").join(roots, "page_id", "left")
    names = F.filter(F.split(F.coalesce("class", F.lit("")), r"\s+"), lambda c: c != "")
    return out.select(
        "page_id", "node_ord", F.col("path").alias("selector"), source.utf16_cut("text", most_text).alias("text"), F.col("lang").alias("own_lang"), F.col("lang_above").alias("inherited_lang"), F.col("dir").alias("own_dir"), F.col("dir_above").alias("inherited_dir"),
        F.col("in_rtl").alias("ancestor_has_dir_rtl"), names.alias("class_names"), F.col("tag").alias("tag_name"), F.col("in_bdi").alias("has_bdi_ancestor"), F.col("in_code").alias("has_code_ancestor"), F.col("turned_above").alias("has_transformed_ancestor"),
        "document_lang", "document_dir", F.coalesce("truncated", F.lit(False)).alias("truncated"), F.lit("static").alias("capture_mode"),
    )
