"""Snapshot-like tables derived from the test tables by rule, as Spark columns and as SQL.

Every line of a document is a text node, written in one of ten writing systems; its styles follow
from its number. The expressions are the same text in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphaudit.dims import GROUPS
from glyphaudit.functions.scripts import analysed

LATIN = "abcdefghijklmnopqrstuvwxyz"


def _from(*starts: tuple[int, int]) -> str:
    return "".join(chr(a + i) for a, n in starts for i in range(n))


#: 26 letters without marks of each script that nodes are spelled in; the last is no modelled script.
ALPHABETS = [
    LATIN,
    _from((0x0628, 19), (0x0641, 7)),
    _from((0x05D0, 26)),
    _from((0x0E01, 26)),
    _from((0x0915, 26)),
    _from((0x1780, 26)),
    _from((0x4E00, 26)),
    _from((0xAC00, 26)),
    _from((0x0712, 26)),
    _from((0x0995, 20), (0x09AA, 6)),
]
NAMES = ["latin", "arabic", "hebrew", "thai", "devanagari", "khmer", "han", "hangul", "syriac", "unknown"]

_H = "(doc_id * 7 + node_ord)"
_G = f"CAST(floor({_H} / 10) AS BIGINT)"


def _pick(m: int, values: list[str], by: str = _G) -> str:
    """A CASE by remainder; the last value is for all others."""
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE {by} % {m} {cases} ELSE {values[-1]} END"


_SPELLED = "CASE " + _H + " % 10 " + " ".join(f"WHEN {i} THEN translate(lower(line), '{LATIN}', '{a}')" for i, a in enumerate(ALPHABETS) if i) + " ELSE line END"
_BASE = {"page_id": "concat('d', doc_id)", "selector": "concat('p:nth-of-type(', node_ord + 1, ')')", "spelled": _SPELLED}
_TEXT = f"CASE WHEN {_H} % 7 = 3 THEN concat(spelled, ' (web) ', spelled) WHEN {_H} % 13 = 5 THEN concat(spelled, ' →') ELSE spelled END"
_HIDDEN = f"{_G} % 11 = 0"
ATTRIBUTES = {
    "own_lang": _pick(8, ["'ar'", "''", "'he'", "'en'", "'th-TH'", "'zh-Hant'", "'sr-Latn'", "NULL"]),
    "inherited_lang": _pick(3, ["'en'", "'hi'", "NULL"]),
    "own_dir": _pick(4, ["'rtl'", "''", "NULL"]),
    "inherited_dir": _pick(3, ["'rtl'", "NULL"]),
    "computed_direction": _pick(2, ["'rtl'", "'ltr'"]),
    "letter_spacing": _pick(6, ["'normal'", "'0px'", "'0.005px'", "'0.01px'", "'-1.5px'", "'2px'"]),
    "line_height": _pick(5, ["'normal'", "'20px'", "'24px'", "'25px'", "'25.6px'"]),
    "font_size": "'16px'",
    "text_align": _pick(5, ["'start'", "'left'", "'right'", "' LEFT'", "'center'"]),
    "text_transform": _pick(4, ["'none'", "'uppercase'", "'Capitalize'", "'full-width'"]),
    "css_transform": _pick(6, ["'none'", "'matrix(-1, 0, 0, 1, 0, 0)'", "'matrix(1, 0, 0, 1, 5, 0)'", "'matrix(0.7, 0.7, -0.7, 0.7, 0, 0)'", "''", "'none'"]),
    "word_break": _pick(3, ["'normal'", "'break-all'", "'keep-all'"]),
    "hyphens": _pick(4, ["'manual'", "'auto'", "'none'"]),
    "overflow_y": _pick(5, ["'visible'", "'hidden'", "'clip'", "'auto'", "'Hidden '"]),
    "clip": f"CASE WHEN {_HIDDEN} THEN 'rect(1px, 1px, 1px, 1px)' ELSE 'auto' END",
    "client_height": f"CASE WHEN {_HIDDEN} THEN 2 ELSE {_pick(4, ['31', '32', '48', '64'])} END",
    "client_width": f"CASE WHEN {_HIDDEN} THEN 1 ELSE 300 END",
    "over": _pick(3, ["0", "1", "5"], _H),
    "class_name": _pick(5, ["'arrow-left'", "'Chevron_Right x'", "'arrows-left'", "''"]),
    "tag_name": _pick(9, ["'BUTTON'", "'CODE'", "'P'"]),
    "has_bdi": f"{_G} % 6 = 5",
    "has_code": f"{_G} % 7 = 6",
    "has_transformed": f"{_G} % 5 = 4",
    "fallback": f"{_G} % 3 = 1",
}

SQL_NODES = f"""
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS node_ord FROM documents WHERE text IS NOT NULL),
spelled AS (SELECT doc_id, CAST(node_ord AS INT) AS node_ord, {", ".join(f"{v} AS {k}" for k, v in _BASE.items())} FROM lines WHERE trim(line) <> ''),
nodes AS (SELECT doc_id, page_id, node_ord, selector, {_TEXT} AS text, {", ".join(f"{v} AS {k}" for k, v in ATTRIBUTES.items())} FROM spelled)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes as a capture delivers them, with doc_id beside."""
    lines = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("node_ord", "line")).where("trim(line) <> ''")
    spelled = lines.selectExpr("doc_id", "node_ord", *[f"{v} AS {k}" for k, v in _BASE.items()])
    flat = spelled.selectExpr("doc_id", "page_id", "node_ord", "selector", f"{_TEXT} AS text", *[f"{v} AS {k}" for k, v in ATTRIBUTES.items()])
    css = {"letterSpacing": "letter_spacing", "lineHeight": "line_height", "fontSize": "font_size", "textAlign": "text_align", "textTransform": "text_transform", "transform": "css_transform", "wordBreak": "word_break", "hyphens": "hyphens", "overflowY": "overflow_y", "clip": "clip"}
    fixed = {"clipPath": "none", "webkitLineClamp": "none"}
    return flat.select(
        "doc_id", "page_id", "node_ord", "selector", "text", "own_lang", "inherited_lang", "own_dir", "inherited_dir", "computed_direction",
        F.struct(*[F.col(v).alias(k) for k, v in css.items()], *[F.lit(v).alias(k) for k, v in fixed.items()]).alias("css"),
        F.struct(F.col("client_height").alias("clientHeight"), (F.col("client_height") + F.col("over")).alias("scrollHeight"), F.col("client_width").alias("clientWidth"), F.col("client_width").alias("scrollWidth")).alias("box"),
        F.struct(F.array(F.lit("Arial"), F.lit("sans-serif")).alias("declaredStack"), F.lit(None).cast("string").alias("renderedFamily"), F.col("fallback").alias("fallbackSuspected")).alias("font_probe"),
        F.split("class_name", " ").alias("class_names"), "tag_name", F.col("has_bdi").alias("has_bdi_ancestor"), F.col("has_code").alias("has_code_ancestor"), F.col("has_transformed").alias("has_transformed_ancestor"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysed(raw_nodes(spark, sf_dir))


# -- sites ------------------------------------------------------------------------------------

_GROUP = "CASE list_ord % 7 " + " ".join(f"WHEN {i} THEN '{g}'" for i, g in enumerate(GROUPS)) + " END"
SITE_COLUMNS = {
    "url": "concat('https://site', list_ord, '.example/')",
    "target_group": _GROUP,
    "status": "CASE list_ord % 10 WHEN 7 THEN 'disallowed' WHEN 8 THEN 'skipped' WHEN 9 THEN 'failed' ELSE 'scanned' END",
    "passes": "CAST(list_ord * 3 + 10 AS BIGINT)",
}
#: Sites that have pages.
N_SITES = 30
STANDARD_COLUMNS = {
    "list_ord": f"CAST(event_id % {N_SITES} AS INT)",
    "pos": "event_id",
    "id": "event_type",
    "help": "concat('about ', event_type, ' ', event_id % 2)",
    "impact": "CASE WHEN event_type = 'click' THEN NULL WHEN user_id % 4 = 0 THEN 'critical' WHEN user_id % 4 = 1 THEN 'serious' WHEN user_id % 4 = 2 THEN 'moderate' ELSE 'minor' END",
    "n_nodes": "CAST(1 + event_id % 3 AS INT)",
}
SQL_SITES = f"""
sites AS (SELECT list_ord, {", ".join(f"{v} AS {k}" for k, v in SITE_COLUMNS.items())} FROM (SELECT CAST(c_custkey AS INT) AS list_ord FROM customer)),
standard AS (SELECT {", ".join(f"{v} AS {k}" for k, v in STANDARD_COLUMNS.items())} FROM events)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site for each customer; pages and third-party findings fall to the first of them."""
    return table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS INT) AS list_ord").selectExpr("list_ord", *[f"{v} AS {k}" for k, v in SITE_COLUMNS.items()])


def standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{v} AS {k}" for k, v in STANDARD_COLUMNS.items()])


def site_of(page: str = "page_id") -> str:
    return f"CAST(CAST(substr({page}, 2) AS BIGINT) % {N_SITES} AS INT)"
