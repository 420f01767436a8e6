"""Queries over the test tables, one or more for each operator, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphaudit.functions import scalars
from glyphaudit.functions import scripts as S
from glyphaudit.operators import campaign, engine, pages, records, robots
from glyphaudit.operators import rules as R
from glyphaudit.operators.engine import Filters
from glyphaudit.plans import synth

Query = Callable[[SparkSession, str], DataFrame]

# What the SQL knows of scripts and languages: written out here, so that a wrong entry in the engine's tables shows.


def _table(text: str) -> dict[str, list[str]]:
    """``keys = values; ...`` as a value list for each key."""
    pairs = (part.split("=") for part in text.replace("\n", " ").split(";"))
    return {k: v.split() for keys, v in pairs for k in keys.split()}


CURSIVE, RTL = "arabic mongolian nko syriac".split(), "arabic hebrew nko syriac thaana".split()
CASELESS = "arabic devanagari han hangul hebrew kana khmer lao mongolian nko syriac thaana thai".split()
MARKED = "arabic devanagari hebrew khmer lao mongolian nko syriac thaana thai".split()
SEGMENTED_MARKED, SEGMENTED_PLAIN = "khmer lao thai".split(), "han kana".split()
KNOWN = [*CASELESS, "latin", "cyrillic", "greek"]
HEIGHTS = {1.5: "latin arabic hebrew devanagari han kana hangul cyrillic greek syriac nko thaana".split(), 1.6: "thai lao khmer".split()}
LABELLED = {"arabic": "Arabic", "hebrew": "Hebrew", "syriac": "Syriac", "nko": "N'Ko", "thaana": "Thaana"}
LANGUAGES = _table("""ar fa ur ps ckb sd ug ku = arabic; he yi = hebrew; hi mr ne sa bho kok = devanagari; th = thai; lo = lao; km = khmer; zh = han;
ja = han kana latin; ko = hangul han; vi en fr de es pt id tr = latin; ru uk bg mk = cyrillic; sr = cyrillic latin; el = greek; dv = thaana""")
SUBTAGS = _table("""latn = latin; arab = arabic; hebr = hebrew; syrc = syriac; thaa = thaana; nkoo = nko; deva = devanagari; thai = thai; laoo = lao; khmr = khmer;
mong = mongolian; hani hans hant = han; hira kana hrkt = kana; jpan = han kana; hang = hangul; kore = hangul han; cyrl = cyrillic; grek = greek""")
GROUPS = {"arabic": ["arabic"], "persian/urdu": ["arabic"], "hebrew": ["hebrew"], "thai": ["thai"], "devanagari": ["devanagari"], "vietnamese": ["latin"], "cjk": ["han", "kana", "hangul"]}
CONTROL_TAGS, CODE_TAGS = "BUTTON INPUT OPTION SELECT TEXTAREA".split(), "CODE KBD PRE SAMP".split()
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# -- script analysis in SQL: one row a code point, then runs by gaps and islands ---------------

#: Code point ranges of the scripts that the test tables hold.
_CLASS = """CASE WHEN u BETWEEN 97 AND 122 OR u BETWEEN 65 AND 90 OR u IN (170, 186) OR (u BETWEEN 192 AND 591 AND u NOT IN (215, 247)) THEN 'latin'
 WHEN u BETWEEN 1568 AND 1610 THEN 'arabic' WHEN u BETWEEN 1488 AND 1514 THEN 'hebrew' WHEN u BETWEEN 3585 AND 3632 THEN 'thai' WHEN u BETWEEN 2309 AND 2361 THEN 'devanagari'
 WHEN u BETWEEN 6016 AND 6067 THEN 'khmer' WHEN u BETWEEN 19968 AND 40959 THEN 'han' WHEN u BETWEEN 44032 AND 55203 THEN 'hangul' WHEN u BETWEEN 1808 AND 1839 AND u <> 1809 THEN 'syriac'
 WHEN u BETWEEN 2437 AND 2489 OR u = 181 THEN 'unknown' ELSE 'common' END"""


def _analysis(source: str, key: str) -> str:
    """CTEs ``runs`` and ``census`` and ``dom`` over ``source(key, text)``."""
    return f"""
chars AS (SELECT {key}, i, c, {_CLASS} AS s FROM (SELECT {key}, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i, unicode(unnest(string_split(text, ''))) AS u FROM {source} WHERE text <> '')),
marked AS (SELECT *, i - row_number() OVER (PARTITION BY {key}, s ORDER BY i) AS island FROM chars),
runs AS (SELECT {key}, s AS script, min(i) AS begins, count(*) AS n, string_agg(c, '' ORDER BY i) AS text, row_number() OVER (PARTITION BY {key} ORDER BY min(i)) - 1 AS run_ord FROM marked GROUP BY {key}, s, island),
census AS (SELECT {key}, s AS script, count(*) AS n, min(i) AS first FROM chars WHERE s <> 'common' GROUP BY {key}, s),
dom AS (SELECT {key}, arg_max(script, n * 10000000 - first) AS dominant, max(n) AS cnt, sum(n)::BIGINT AS lettered, coalesce(sum(n) FILTER (script = 'latin'), 0)::BIGINT AS latin FROM census GROUP BY {key})"""


_DOCS = "WITH docs AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents)," + _analysis("docs", "doc_id")
_NODES = "WITH " + synth.SQL_NODES + "," + _analysis("nodes", "page_id, node_ord")
_ANALYSED = """,
analysed AS (SELECT n.*, coalesce(d.dominant, 'common') AS dominant, coalesce(d.cnt, 0) AS cnt, coalesce(d.lettered, 0) AS lettered, coalesce(d.latin, 0) AS latin FROM nodes n LEFT JOIN dom d USING (page_id, node_ord))"""
_ALL = _NODES + _ANALYSED


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.analysed(synth.table(spark, sf_dir, "documents"))


@query(_DOCS + " SELECT lang, coalesce(dominant, 'common') AS script, count(*) AS n_docs FROM docs LEFT JOIN dom USING (doc_id) GROUP BY ALL")
def script_tally_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("lang", F.col("dominant_script").alias("script")).agg(F.count("*").alias("n_docs"))


@query(_DOCS + " SELECT lang, script, sum(n)::BIGINT AS n_graphemes FROM docs JOIN census USING (doc_id) GROUP BY ALL")
def letters_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("lang", F.inline("census")).groupBy("lang", "script").agg(F.sum("n").alias("n_graphemes"))


@query("SELECT lang, count(*) FILTER (regexp_matches(text, '[Ạ-ỹăâêôơưđĂÂÊÔƠƯĐ]')) AS n_matching, count(*) AS n_docs FROM documents GROUP BY lang")
def vietnamese_profile_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(S.is_vietnamese(F.col("text"))).alias("n_matching"), F.count("*").alias("n_docs"))


@query(_ALL + " SELECT page_id, node_ord, dominant AS script FROM analysed")
def dominant_script_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.nodes(spark, sf_dir).select("page_id", "node_ord", F.col("dominant_script").alias("script"))


@query(_NODES + " SELECT page_id, node_ord, run_ord::INT AS run_ord, script, text, n::INT AS length, (begins - 1)::INT AS start FROM runs")
def script_runs_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = S.with_offsets(S.with_runs(synth.raw_nodes(spark, sf_dir)))
    return nodes.select("page_id", "node_ord", F.posexplode("script_runs").alias("run_ord", "r")).select("page_id", "node_ord", "run_ord", "r.script", "r.text", "r.length", "r.start")


@query(_NODES + " SELECT page_id, node_ord, c.script, c.n, floor(c.n::DOUBLE / d.lettered * 1000 + 0.5) / 10 AS share FROM census c JOIN dom d USING (page_id, node_ord)")
def script_census_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synth.nodes(spark, sf_dir).select("page_id", "node_ord", "census", F.explode("census").alias("c"))
    return rows.select("page_id", "node_ord", "c.script", "c.n", scalars.percent(F.col("c.n"), S.lettered(F.col("census"))).alias("share"))


@query("SELECT doc_id, length(text) AS n_graphemes FROM documents WHERE text IS NOT NULL")
def grapheme_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", S.grapheme_count(F.col("text")).cast("long").alias("n_graphemes"))


@query("WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN length(t) > 60 THEN substr(t, 1, 60) || '…' ELSE t END AS snippet FROM f")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", S.snippet(F.col("text")).alias("snippet"))


_TAGS = "concat(lower(substr(n_name, 1, 2)), CASE n_nationkey % 5 WHEN 0 THEN '' WHEN 1 THEN '-Latn' WHEN 2 THEN '-ARAB-x' WHEN 3 THEN '-XX' ELSE '-Zzzz' END)"


def _lookup(table: dict[str, list[str]], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in table.items()) + " ELSE '' END"


@query(f"WITH t AS (SELECT {_TAGS} AS tag FROM nation), p AS (SELECT tag, string_split(lower(tag), '-') AS p FROM t) SELECT tag, CASE WHEN regexp_full_match(coalesce(p[2], ''), '[a-z]{{4}}') THEN {_lookup(SUBTAGS, 'p[2]')} ELSE {_lookup(LANGUAGES, 'p[1]')} END AS scripts FROM p")
def expected_scripts_for_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = synth.table(spark, sf_dir, "nation").selectExpr(f"{_TAGS} AS tag")
    return tags.select("tag", F.array_join(scalars.expected_scripts(F.col("tag")), ",").alias("scripts"))


_PX = "CASE WHEN trim({0}) LIKE '%px' THEN try_cast(regexp_extract(trim({0}), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') AS DOUBLE) END"


@query("WITH " + synth.SQL_NODES + f" SELECT letter_spacing, line_height, {_PX.format('letter_spacing')} AS spacing_px, {_PX.format('line_height')} AS height_px, count(*) AS n FROM nodes GROUP BY ALL")
def pixel_length_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("css.letterSpacing"), F.col("css.lineHeight")
    return synth.raw_nodes(spark, sf_dir).groupBy(a.alias("letter_spacing"), b.alias("line_height"), scalars.pixel_length(a).alias("spacing_px"), scalars.pixel_length(b).alias("height_px")).agg(F.count("*").alias("n"))


@query("WITH " + synth.SQL_NODES + " SELECT css_transform, css_transform IN ('matrix(-1, 0, 0, 1, 0, 0)', 'matrix(0.7, 0.7, -0.7, 0.7, 0, 0)') AS turned, count(*) AS n FROM nodes GROUP BY ALL")
def transform_matrix_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("css.transform")
    return synth.raw_nodes(spark, sf_dir).groupBy(t.alias("css_transform"), scalars.reverses_or_turns(t).alias("turned")).agg(F.count("*").alias("n"))


def _in(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_HEIGHT = "CASE " + " ".join(f"WHEN dominant IN {_in(names)} THEN {h}" for h, names in HEIGHTS.items()) + " END"


@query(_ALL + f" SELECT dominant AS script, dominant IN {_in(CURSIVE)} AS is_cursive, dominant IN {_in(RTL)} AS is_rtl, {_HEIGHT}::DOUBLE AS min_line_height, count(*) AS n FROM analysed WHERE dominant IN {_in(KNOWN)} GROUP BY ALL")
def script_props_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphaudit.dims import scripts_table

    props = F.broadcast(scripts_table(spark).where("NOT vietnamese"))
    nodes = synth.nodes(spark, sf_dir).select(F.col("dominant_script").alias("script"))
    return nodes.join(props, "script").groupBy("script", "is_cursive", "is_rtl", "min_line_height").agg(F.count("*").alias("n"))


# -- the checks -------------------------------------------------------------------------------

_RATIO = f"({_PX.format('line_height')} / 16.0)"
_EXPECTED = f"""string_split(CASE WHEN regexp_full_match(coalesce(string_split(lower(tag), '-')[2], ''), '[a-z]{{4}}') THEN {_lookup(SUBTAGS, "string_split(lower(tag), '-')[2]")} ELSE {_lookup(LANGUAGES, "string_split(lower(tag), '-')[1]")} END, ',')"""
_TAGGED = "SELECT *, coalesce(own_lang, inherited_lang, '') AS tag FROM analysed"
_BIDI = """SELECT DISTINCT page_id, node_ord FROM (
 SELECT *, last_value(CASE WHEN script NOT IN ('common', 'latin') THEN script END IGNORE NULLS) OVER (PARTITION BY page_id, node_ord ORDER BY run_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  first_value(CASE WHEN script NOT IN ('common', 'latin') THEN script END IGNORE NULLS) OVER (PARTITION BY page_id, node_ord ORDER BY run_ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after,
  lag(script) OVER w AS s0, lag(text) OVER w AS t0, lead(script) OVER w AS s1, lead(text) OVER w AS t1 FROM runs WINDOW w AS (PARTITION BY page_id, node_ord ORDER BY run_ord))
 WHERE (script = 'latin' OR (script = 'common' AND regexp_matches(text, '[0-9]'))) AND n >= 2 AND before IN {rtl} AND after IN {rtl}
 AND (regexp_matches(text, '{neutral}') OR (s0 = 'common' AND regexp_matches(t0, '{neutral}')) OR (s1 = 'common' AND regexp_matches(t1, '{neutral}')))""".format(rtl=_in(RTL), neutral='[.,:;!?()"\'\'\\[\\]{}]')
_VIETNAMESE = "regexp_matches(text, '[Ạ-ỹăâêôơưđĂÂÊÔƠƯĐ]')"
#: Condition of each check on ``analysed``.
CONDITIONS = {
    "cursive-script-letter-spacing": f"dominant IN {_in(CURSIVE)} AND abs({_PX.format('letter_spacing')}) >= 0.01 AND cnt >= 2",
    "insufficient-line-height-for-script": f"{_RATIO} < ({_HEIGHT}) AND tag_name NOT IN {_in(CONTROL_TAGS)} AND client_height >= 32",
    "missing-script-font-coverage": f"dominant IN {_in([n for n in KNOWN if n != 'latin'])} AND fallback AND cnt >= 2",
    "case-transform-on-caseless-script": f"dominant IN {_in(CASELESS)} AND lower(trim(text_transform)) IN ('uppercase', 'lowercase', 'capitalize') AND latin::DOUBLE / lettered < 0.2",
    "missing-dir-attribute": f"dominant IN {_in(RTL)} AND cnt >= 15 AND own_dir IS NULL AND inherited_dir IS NULL",
    "lang-script-mismatch": f"dominant IN {_in(KNOWN)} AND tag_name NOT IN {_in(CODE_TAGS)} AND NOT has_code AND ({_EXPECTED})[1] <> '' AND NOT list_contains({_EXPECTED}, dominant) AND cnt >= 20 AND cnt::DOUBLE / lettered >= 0.8",
    "physical-css-in-bidi-context": "computed_direction = 'rtl' AND lower(trim(text_align)) IN ('left', 'right')",
    "unisolated-bidi-run": f"dominant IN {_in(RTL)} AND NOT has_bdi AND (page_id, node_ord) IN ({_BIDI})",
    "unmirrored-directional-icon": "computed_direction = 'rtl' AND (regexp_matches(text, '[←→‹›«»⟵⟶⇐⇒◀▶◄►]') OR regexp_matches(class_name, '(?i)(arrow|chevron|caret|angle)[-_](left|right)')) AND css_transform NOT IN ('matrix(-1, 0, 0, 1, 0, 0)', 'matrix(0.7, 0.7, -0.7, 0.7, 0, 0)') AND NOT has_transformed",
    "unsafe-word-break-for-script": f"((dominant IN {_in(CURSIVE)} AND (word_break = 'break-all' OR hyphens = 'auto')) OR (dominant IN {_in(SEGMENTED_MARKED)} AND word_break = 'break-all') OR (dominant IN {_in(SEGMENTED_PLAIN)} AND hyphens = 'auto')) AND cnt >= 2",
    "clipped-stacked-marks": f"dominant IN {_in(KNOWN)} AND (dominant IN {_in(MARKED)} OR (dominant = 'latin' AND {_VIETNAMESE}) OR regexp_matches(text, '\\p{{Mn}}')) AND lower(trim(overflow_y)) IN ('hidden', 'clip') AND clip = 'auto' AND over > 1",
}
# Severity and confidence of each check, as the SQL knows them.
_GRADES = _table("""cursive-script-letter-spacing = critical high; insufficient-line-height-for-script = moderate heuristic; missing-script-font-coverage = serious heuristic;
case-transform-on-caseless-script = minor high; missing-dir-attribute = serious medium; lang-script-mismatch = serious medium; physical-css-in-bidi-context = moderate medium;
unisolated-bidi-run = moderate heuristic; unmirrored-directional-icon = minor heuristic; unsafe-word-break-for-script = moderate medium; clipped-stacked-marks = moderate heuristic""")
_SEVERITY = {k: f"'{v[0]}'" for k, v in _GRADES.items()} | {"missing-dir-attribute": "CASE WHEN computed_direction = 'rtl' THEN 'moderate' ELSE 'serious' END"}
_WCAG = {"insufficient-line-height-for-script": f"CASE WHEN {_RATIO} < 1.5 THEN '1.4.8' END"}


def _one(rule: str) -> str:
    return f"SELECT page_id, node_ord, '{rule}' AS rule_id, {_SEVERITY[rule]} AS severity, '{_GRADES[rule][1]}' AS confidence, dominant AS script, selector, {_WCAG.get(rule, 'NULL')}::VARCHAR AS wcag_ref FROM tagged WHERE coalesce({CONDITIONS[rule]}, false)"


def found_sql(nodes: str) -> str:
    """``WITH`` CTEs up to ``found``, all checks' findings, after CTEs that give ``nodes``."""
    return nodes + "," + _analysis("nodes", "page_id, node_ord") + _ANALYSED + f", tagged AS ({_TAGGED}), found AS (" + " UNION ALL ".join(map(_one, CONDITIONS)) + ")"


_FOUND = found_sql("WITH " + synth.SQL_NODES)
_COLUMNS = ["page_id", "node_ord", "rule_id", "severity", "confidence", "script", "selector", "wcag_ref"]
_RANKED = "CASE severity WHEN 'critical' THEN 0 WHEN 'serious' THEN 1 WHEN 'moderate' THEN 2 ELSE 3 END"


def _add_rule(rule: R.Rule) -> None:
    name = "rule_" + rule.id.replace("-", "_")
    QUERIES[name] = lambda spark, sf_dir: engine.findings(synth.nodes(spark, sf_dir), Filters(rules=(rule.id,))).select(_COLUMNS)
    SQL[name] = _ALL + f", tagged AS ({_TAGGED}) " + _one(rule.id)


for _rule in R.RULES:
    _add_rule(_rule)


@query(_FOUND + f" SELECT * FROM found ORDER BY page_id, {_RANKED}, rule_id, selector, node_ord")
def findings_all_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.ordered(engine.findings(synth.nodes(spark, sf_dir))).select(_COLUMNS)


_SNIP = "trim(regexp_replace(text, '[\\s\\x{A0}]+', ' ', 'g'))"
_SAID = {
    "missing-dir-attribute": ("Right-to-left text without a declared direction", "CASE dominant " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in LABELLED.items()) + " END || ' text has no dir attribute on or above it.'", "Punctuation and numbers land on the wrong side.", 'Put dir="rtl" on the element or the page.'),
    "cursive-script-letter-spacing": ("Letter spacing on joined letters", "'Letters of ' || CASE dominant " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in LABELLED.items()) + " END || ' text are set ' || CASE letter_spacing WHEN '0.01px' THEN '0.01' WHEN '-1.5px' THEN '-1.5' ELSE '2' END || 'px apart.'", "Joined letters come apart or collide, and words stop being words.", "Apply letter-spacing to scripts with separate letters only."),
    "physical-css-in-bidi-context": ("Physical alignment in right-to-left context", "'text-align is ' || lower(trim(text_align)) || ' in right-to-left context.'", None, "Use start or end."),
}


def _said(rule: str) -> str:
    title, wrong, why, fix = _SAID[rule]
    reason = f"'{why}'" if why else "CASE WHEN lower(trim(text_align)) = 'left' THEN 'Lines start at the far edge.' ELSE 'It looks right now, and stays there when the direction changes.' END"
    return f"SELECT page_id, node_ord, '{rule}' AS rule_id, '{title}' AS title, CASE WHEN length({_SNIP}) > 60 THEN substr({_SNIP}, 1, 60) || '…' ELSE {_SNIP} END AS snippet, {wrong} AS what_is_wrong, {reason} AS why_it_matters, '{fix}' AS how_to_fix, 'script_aware' AS source FROM tagged WHERE coalesce({CONDITIONS[rule]}, false)"


@query(_ALL + f", tagged AS ({_TAGGED}) " + " UNION ALL ".join(_said(r) for r in _SAID))
def finding_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = engine.findings(synth.nodes(spark, sf_dir), Filters(rules=tuple(_SAID)))
    return out.select("page_id", "node_ord", "rule_id", "title", "snippet", "what_is_wrong", "why_it_matters", "how_to_fix", "source")


_FILTERS = {
    "findings_filtered_severity": (Filters(severity="serious"), "severity IN ('critical', 'serious')"),
    "findings_only_rules": (Filters(rules=("missing-dir-attribute", "clipped-stacked-marks")), "rule_id IN ('missing-dir-attribute', 'clipped-stacked-marks')"),
    "findings_disabled": (Filters(rules=("missing-dir-attribute", "lang-script-mismatch"), disabled=("missing-dir-attribute",)), "rule_id = 'lang-script-mismatch'"),
    "findings_scripts": (Filters(scripts=("arabic", "thai")), "script IN ('arabic', 'thai')"),
}


def _add_filter(name: str, filters: Filters, condition: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: engine.findings(synth.nodes(spark, sf_dir), filters).select(_COLUMNS)
    SQL[name] = _FOUND + f" SELECT * FROM found WHERE {condition}"


for _name, (_f, _condition) in _FILTERS.items():
    _add_filter(_name, _f, _condition)


@query(_FOUND + f" SELECT page_id, count(*) FILTER ({_RANKED} <= 1 AND script IN ('arabic', 'hebrew')) AS shown, count(*) FILTER (NOT ({_RANKED} <= 1 AND script IN ('arabic', 'hebrew'))) AS withheld FROM found GROUP BY page_id")
def findings_withheld_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.withheld(synth.nodes(spark, sf_dir), Filters(scripts=("arabic", "hebrew"), severity="serious"))


_STD = "WITH " + synth.SQL_SITES


@query(_STD + " SELECT pos, id, impact FROM standard WHERE id <> 'view' AND (impact IS NULL OR impact IN ('critical', 'serious'))")
def standard_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.third_party(synth.standard(spark, sf_dir), Filters(disabled=("view",), severity="serious")).select("pos", "id", "impact")


# -- pages ------------------------------------------------------------------------------------


@query(_ALL + " SELECT page_id, dominant AS script, count(*) AS n_nodes FROM analysed GROUP BY ALL")
def script_tally_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.script_tally(synth.nodes(spark, sf_dir))


@query(
    _NODES + """, own AS (SELECT page_id, node_ord, run_ord, substr(trim(text), 1, 40) AS sample FROM runs WHERE script = 'unknown'),
first AS (SELECT page_id, sample, min(node_ord * 1000000 + run_ord) AS place FROM own WHERE sample <> '' GROUP BY ALL),
best AS (SELECT page_id, string_agg(sample, '|' ORDER BY place) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place) AS k FROM first) WHERE k <= 5 GROUP BY page_id)
SELECT page_id, count(DISTINCT node_ord) AS n_nodes, any_value(samples) AS samples FROM own JOIN best USING (page_id) GROUP BY page_id"""
)
def unsupported_text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.unsupported(synth.nodes(spark, sf_dir)).withColumn("samples", F.array_join("samples", "|"))


@query(_FOUND + " SELECT page_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'serious') AS serious, count(*) FILTER (severity = 'moderate') AS moderate, count(*) FILTER (severity = 'minor') AS minor, 0::BIGINT AS ungraded, count(*) AS total FROM found GROUP BY page_id")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.severity_counts(engine.findings(synth.nodes(spark, sf_dir)))


@query(_FOUND + f" SELECT page_id, rule_id, min({_RANKED})::INT AS worst, string_agg(DISTINCT script, ',' ORDER BY script) AS scripts, count(*) AS n_elements FROM found GROUP BY ALL")
def script_aware_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.script_aware_section(engine.findings(synth.nodes(spark, sf_dir)))
    return out.select("page_id", "rule_id", engine.rank(F.col("severity")).alias("worst"), F.array_join("scripts", ",").alias("scripts"), "n_elements")


@query(_STD + " SELECT list_ord::VARCHAR AS page_id, id, impact, count(*) AS n_rules, sum(n_nodes)::BIGINT AS n_elements FROM standard GROUP BY ALL")
def standard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synth.standard(spark, sf_dir).select(F.col("list_ord").cast("string").alias("page_id"), "id", "impact", F.array_repeat(F.lit("x"), F.col("n_nodes")).alias("nodes"))
    return pages.standard_section(rows).groupBy("page_id", "id", "impact").agg(F.count("*").alias("n_rules"), F.sum("n_elements").alias("n_elements"))


@query(_FOUND + " SELECT page_id, bool_or(confidence = 'heuristic') AS has_heuristic_findings FROM found GROUP BY page_id")
def heuristic_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.has_heuristic(engine.findings(synth.nodes(spark, sf_dir)))


@query(_FOUND + ", t AS (SELECT *, row_number() OVER (PARTITION BY page_id, rule_id ORDER BY selector, node_ord) AS k, count(*) OVER (PARTITION BY page_id, rule_id) AS m FROM found) SELECT page_id, rule_id, node_ord, greatest(m - 5, 0) AS more FROM t WHERE k <= 5")
def findings_top_per_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.top_per_rule(engine.findings(synth.nodes(spark, sf_dir))).select("page_id", "rule_id", "node_ord", "more")


# -- campaigns --------------------------------------------------------------------------------

_SITE = f"(substr(page_id, 2)::BIGINT % {synth.N_SITES})::INT"
_CAMPAIGN = _FOUND + "," + synth.SQL_SITES + f""",
ours AS (SELECT {_SITE} AS list_ord, substr(page_id, 2)::BIGINT * 1000000 + node_ord AS pos, rule_id, severity, confidence, script FROM found),
ok AS (SELECT * FROM sites WHERE status = 'scanned'),
std AS (SELECT * FROM standard JOIN ok USING (list_ord)), own AS (SELECT * FROM ours JOIN ok USING (list_ord)), total AS (SELECT count(*) AS n FROM ok)"""
_PERCENT = "floor(count(DISTINCT url)::DOUBLE / (SELECT n FROM total) * 1000 + 0.5) / 10 AS percent_of_sites"


def _ours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine.findings(synth.nodes(spark, sf_dir))
    return found.selectExpr(f"{synth.site_of()} AS list_ord", "CAST(substr(page_id, 2) AS BIGINT) * 1000000 + node_ord AS pos", "rule_id", "title", "severity", "confidence", "script")


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = synth.nodes(spark, sf_dir).withColumn("list_ord", F.expr(_WRITTEN))
    return pages.script_tally(nodes, "list_ord").withColumnRenamed("n_nodes", "n")


@query(_STD + ", every AS (SELECT unnest(['scanned', 'disallowed', 'skipped', 'failed']) AS status) SELECT status, count(list_ord) AS n_sites FROM every LEFT JOIN sites USING (status) GROUP BY status")
def campaign_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign.outcomes(synth.sites(spark, sf_dir))


@query(_CAMPAIGN + f" SELECT id AS rule_id, arg_min(help, list_ord::BIGINT * 10000000000 + pos) AS title, arg_min(coalesce(impact, 'ungraded'), list_ord::BIGINT * 10000000000 + pos) AS severity, count(DISTINCT url) AS n_sites, sum(n_nodes)::BIGINT AS n_elements, {_PERCENT} FROM std GROUP BY id")
def campaign_issues_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign.standard_issues(synth.sites(spark, sf_dir), synth.standard(spark, sf_dir))


@query(_CAMPAIGN + f" SELECT rule_id, ['critical', 'serious', 'moderate', 'minor'][min({_RANKED}) + 1] AS severity, any_value(confidence) AS confidence, count(DISTINCT url) AS n_sites, count(*) AS n_elements, {_PERCENT} FROM own GROUP BY rule_id")
def campaign_issues_script_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign.script_aware_issues(synth.sites(spark, sf_dir), _ours(spark, sf_dir)).drop("title")


@query(_CAMPAIGN + " SELECT 'standard' AS layer, count(DISTINCT url) AS n_sites, count(DISTINCT id) AS n_rules, sum(n_nodes)::BIGINT AS n_elements, (SELECT sum(passes)::BIGINT FROM ok) AS n_passes FROM std UNION ALL SELECT 'script_aware', count(DISTINCT url), count(DISTINCT rule_id), count(*), 0 FROM own")
def campaign_layer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign.layer_totals(synth.sites(spark, sf_dir), synth.standard(spark, sf_dir), _ours(spark, sf_dir))


@query(
    _CAMPAIGN + """, s AS (SELECT list_ord, sum(n_nodes)::BIGINT AS s FROM std GROUP BY 1), a AS (SELECT list_ord, count(*) AS a FROM own GROUP BY 1)
SELECT list_contains([""" + ", ".join(f"'{g}'" for g in GROUPS) + """], target_group) AS known, list_position([""" + ", ".join(f"'{g}'" for g in GROUPS) + """], target_group) - 1 AS group_ord, target_group, count(*) AS listed, count(*) FILTER (status = 'scanned') AS scanned, count(s) AS standard_sites, coalesce(sum(s), 0)::BIGINT AS standard_elements, count(a) AS script_aware_sites, coalesce(sum(a), 0)::BIGINT AS script_aware_elements
FROM sites LEFT JOIN s USING (list_ord) LEFT JOIN a USING (list_ord) GROUP BY target_group"""
)
def campaign_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign.by_group(synth.sites(spark, sf_dir), synth.standard(spark, sf_dir), _ours(spark, sf_dir)).withColumn("known", F.lit(True))


@query(_CAMPAIGN + " SELECT script, count(DISTINCT url) AS n_sites, count(*) AS n_findings FROM own GROUP BY script")
def campaign_by_detected_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign.by_detected_script(synth.sites(spark, sf_dir), _ours(spark, sf_dir))


#: Sites are written in one script each, beside what common nodes they have, so some aren't written in that of their group.
_WRITTEN = "CAST((doc_id * 7 + node_ord) % 10 * 3 + doc_id % 3 AS INT)"
_MISMATCH = _ALL + "," + synth.SQL_SITES + f""",
detected AS (SELECT {_WRITTEN} AS list_ord, dominant AS script, count(*) AS n FROM analysed GROUP BY ALL),
expected AS (SELECT * FROM (VALUES {", ".join(f"('{g}', '{s}')" for g, v in GROUPS.items() for s in v)}) AS e(target_group, script)),
met AS (SELECT DISTINCT list_ord FROM detected JOIN sites USING (list_ord) JOIN expected USING (target_group, script)),
names AS (SELECT list_ord, string_agg(script, ',' ORDER BY n DESC, script) AS detected FROM detected WHERE script <> 'common' GROUP BY list_ord),
wrong AS (SELECT list_ord, url, target_group, coalesce(detected, '') AS detected FROM sites LEFT JOIN names USING (list_ord) WHERE status = 'scanned' AND list_ord NOT IN (SELECT list_ord FROM met))"""


@query(_MISMATCH + " SELECT * FROM wrong")
def campaign_label_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign.label_mismatches(synth.sites(spark, sf_dir), _detected(spark, sf_dir)).withColumn("detected", F.array_join("detected", ","))


@query(_MISMATCH + " SELECT count(*) AS n_scanned, (SELECT count(*) FROM wrong) AS n_mismatched, count(*) - (SELECT count(*) FROM wrong) AS n_measured FROM sites WHERE status = 'scanned'")
def campaign_measured_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign.measured(synth.sites(spark, sf_dir), _detected(spark, sf_dir))


@query(
    _CAMPAIGN + """, k AS (SELECT rule_id, any_value(confidence) AS confidence, count(*) AS n, count(DISTINCT url) AS m, row_number() OVER (ORDER BY count(DISTINCT url) DESC, count(*) DESC, rule_id) AS p FROM own GROUP BY rule_id)
SELECT max(m) FILTER (rule_id = 'cursive-script-letter-spacing') AS flagship_sites, max(n) FILTER (rule_id = 'cursive-script-letter-spacing') AS flagship_elements,
 max(rule_id) FILTER (p = 1) AS first_rule, max(confidence) FILTER (p = 1) AS first_confidence, max(rule_id) FILTER (p = 2) AS second_rule, max(confidence) FILTER (p = 2) AS second_confidence,
 sum(n) FILTER (p <= 2)::BIGINT AS top_two, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (confidence = 'high'), 0)::BIGINT AS high_confidence, floor(sum(n) FILTER (p <= 2)::DOUBLE / sum(n) * 1000 + 0.5) / 10 AS top_two_percent FROM k"""
)
def campaign_caveats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign.caveats(synth.sites(spark, sf_dir), _ours(spark, sf_dir))


@query(_STD + ", every AS (SELECT unnest([" + ", ".join(f"'{g}'" for g in GROUPS) + "]) AS target_group) SELECT target_group, count(list_ord) AS n_targets FROM every LEFT JOIN sites USING (target_group) GROUP BY target_group")
def targets_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign.count_by_group(synth.sites(spark, sf_dir).withColumnRenamed("target_group", "script"))


_TARGETS = "SELECT CAST(s_suppkey AS INT) AS list_ord, CASE s_suppkey % 6 WHEN 0 THEN 'ftp://a.example/' WHEN 1 THEN 'nonsense' WHEN 2 THEN 'https://same.example/' ELSE concat('https://s', s_suppkey, '.example/x') END AS url, CASE s_suppkey % 5 WHEN 0 THEN 'klingon' ELSE 'thai' END AS script FROM supplier"


@query(
    f"""WITH t AS ({_TARGETS}), c AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY list_ord) AS n FROM t)
SELECT list_ord, 'the address can''t be read' AS problem FROM c WHERE url = 'nonsense' UNION ALL SELECT list_ord, 'the address is neither http nor https' FROM c WHERE url LIKE 'ftp%' UNION ALL
SELECT list_ord, 'the address is listed twice' FROM c WHERE n > 1 AND url LIKE 'http%' UNION ALL SELECT list_ord, 'the group isn''t known' FROM c WHERE script = 'klingon'"""
)
def target_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = synth.table(spark, sf_dir, "supplier")
    url = "CASE s_suppkey % 6 WHEN 0 THEN 'ftp://a.example/' WHEN 1 THEN 'nonsense' WHEN 2 THEN 'https://same.example/' ELSE concat('https://s', s_suppkey, '.example/x') END AS url"
    return campaign.target_errors(t.selectExpr("CAST(s_suppkey AS INT) AS list_ord", url, "CASE s_suppkey % 5 WHEN 0 THEN 'klingon' ELSE 'thai' END AS script"))


# -- robots, errors, HTML ---------------------------------------------------------------------

_BODY = "concat('# site\\nUser-agent: *\\nDisallow: /private', chr(10), 'Allow: /private/open*', chr(10), 'Crawl-delay: 3', chr(10), CASE s_suppkey % 3 WHEN 0 THEN concat('User-agent: GlyphAudit', chr(10), 'User-agent: other', chr(10), 'Disallow: /*.pdf$', chr(10), 'Disallow:', chr(10)) ELSE '' END)".replace("\\n", "', chr(10), '")
_PATHS = ["/", "/private/a", "/private/open/a", "/doc.pdf", "/doc.pdfx", ""]
_URL = "concat('https://s', s_suppkey, '.example', CASE s_suppkey % 6 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PATHS)) + " END)"
_STATUS = "CASE s_suppkey % 7 WHEN 5 THEN 404 WHEN 6 THEN 503 WHEN 4 THEN NULL ELSE 200 END"


@query(
    f"""WITH t AS (SELECT s_suppkey AS k, {_URL} AS url, {_STATUS} AS st FROM supplier)
SELECT url, coalesce(st, 0) IN (200, 404) AND NOT (st = 200 AND bad) AS allowed,
 CASE WHEN st = 404 THEN 'no-robots-file' WHEN coalesce(st, 0) <> 200 THEN 'robots-unreachable' WHEN bad THEN 'robots-disallows' ELSE 'robots-allows' END AS reason,
 CASE WHEN st = 200 AND NOT bad AND k % 3 <> 0 THEN 3.0::DOUBLE END AS crawl_delay_s
FROM (SELECT *, CASE WHEN k % 3 = 0 THEN k % 6 = 3 ELSE k % 6 = 1 END AS bad FROM t)"""
)
def robots_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetched = synth.table(spark, sf_dir, "supplier").selectExpr(f"{_URL} AS url", f"CAST({_STATUS} AS INT) AS http_status", f"{_BODY} AS body", "CAST(NULL AS STRING) AS error")
    return robots.decisions(fetched)


_SPELT = "CASE s_suppkey % 8 WHEN 0 THEN 'HTTPS://User@Same.Example:443' WHEN 1 THEN 'https://same.example/A' WHEN 2 THEN 'https://same.example/a/' WHEN 3 THEN 'http://Same.example:80?q=A' WHEN 4 THEN 'http://same.example:8080#F' WHEN 5 THEN ' https://same.example/a ' WHEN 6 THEN 'https://SAME.EXAMPLE' ELSE 'https://same.example/' END"


@query("SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN 'https://User@same.example/' WHEN 1 THEN 'https://same.example/A' WHEN 2 THEN 'https://same.example/a/' WHEN 3 THEN 'http://same.example/?q=A' WHEN 4 THEN 'http://same.example:8080/#F' WHEN 5 THEN 'https://same.example/a' ELSE 'https://same.example/' END AS href FROM supplier")
def target_hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.table(spark, sf_dir, "supplier").select("s_suppkey", scalars.href(F.expr(_SPELT)).alias("href"))


@query(
    f"""WITH t AS (SELECT s_suppkey AS k, {_URL} AS url, {_STATUS} AS st FROM supplier),
r AS (SELECT *, CASE WHEN st = 404 THEN 'no-robots-file' WHEN coalesce(st, 0) <> 200 THEN 'robots-unreachable' WHEN CASE WHEN k % 3 = 0 THEN k % 6 = 3 ELSE k % 6 = 1 END THEN 'robots-disallows' ELSE 'ok' END AS w FROM t),
s AS (SELECT *, CASE WHEN w = 'robots-disallows' THEN 'disallowed' WHEN w = 'robots-unreachable' THEN 'skipped' WHEN k % 5 = 4 OR k % 10 = 3 THEN 'failed' ELSE 'scanned' END AS status FROM r)
SELECT CAST(k AS INT) AS list_ord, url, 'thai' AS target_group, status,
 CASE WHEN status = 'disallowed' THEN 'The robots file does not allow the page.' WHEN status = 'skipped' THEN 'The robots file could not be read.' WHEN status = 'failed' AND k % 5 = 4 THEN 'no result came in 60000 ms, so the site was left' WHEN status = 'failed' THEN 'It took too long.' END AS reason,
 CASE WHEN status = 'skipped' AND st IS NOT NULL THEN 'HTTP status ' || st WHEN status = 'skipped' THEN 'no answer' WHEN status = 'failed' AND k % 5 <> 4 THEN 'Timeout 1ms' END AS detail,
 CASE WHEN status = 'scanned' THEN k % 4 END::BIGINT AS passes, CASE WHEN status = 'scanned' THEN CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END END::INT AS n_standard FROM s"""
)
def campaign_site_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = synth.table(spark, sf_dir, "supplier")
    fetched = t.selectExpr(f"{_URL} AS url", f"CAST({_STATUS} AS INT) AS http_status", f"{_BODY} AS body", f"CASE WHEN {_STATUS} IS NULL THEN 'no answer' END AS error")
    listed = t.selectExpr("CAST(s_suppkey AS INT) AS list_ord", f"{_URL} AS url", "'thai' AS script", "CAST(NULL AS STRING) AS note")
    scans = t.where("s_suppkey % 5 <> 4").selectExpr("CAST(s_suppkey AS STRING) AS page_id", f"{_URL} AS url", f"{_URL} AS final_url", "'2024-01-01T00:00:00Z' AS captured_at", "CAST(1000 + s_suppkey AS BIGINT) AS duration_ms", "CASE WHEN s_suppkey % 10 = 3 THEN named_struct('kind', 'timeout', 'message', 'It took too long.', 'detail', 'Timeout 1ms') END AS error", "CAST(s_suppkey % 4 AS BIGINT) AS passes")
    standard = t.where("s_suppkey % 2 = 0").selectExpr("CAST(s_suppkey AS STRING) AS page_id", "explode(array(0, 1)) AS ord", "'x' AS id", "'serious' AS impact", "'h' AS help", "array('n') AS nodes")
    none = spark.createDataFrame([], "page_id string, node_ord int, rule_id string, title string, severity string, confidence string, script string, n_nodes long, samples array<string>")
    out = records.site_records(listed, robots.decisions(fetched), fetched, scans, standard, none, none, none)
    return out.select("list_ord", "url", "target_group", "status", "reason", "detail", "passes", F.when(F.col("standard").isNotNull(), F.size("standard")).alias("n_standard"))


# Codes in the order in which they are looked for, as the SQL knows them.
_ERRORS = _table("""ERR_NAME_NOT_RESOLVED ERR_NAME_RESOLUTION_FAILED = dns-failure; ERR_CONNECTION_TIMED_OUT ERR_CONNECTION_REFUSED ERR_CONNECTION_RESET ERR_CONNECTION_CLOSED ERR_CONNECTION_FAILED = unreachable-host;
ERR_ADDRESS_UNREACHABLE ERR_SOCKET_NOT_CONNECTED = unreachable-host; ERR_EMPTY_RESPONSE = empty-body; ERR_TOO_MANY_REDIRECTS = redirect-loop; ERR_SSL_PROTOCOL_ERROR ERR_CERT_ ERR_SSL_ = invalid-ssl;
ERR_UNSAFE_PORT = blocked-port; ERR_TIMED_OUT = timeout""")
_DETAIL = "concat('net::', CASE p_partkey % 18 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_ERRORS)) + " WHEN 16 THEN 'Timeout 20000ms exceeded ERR_CERT_X' ELSE 'other' END)"


@query(f"WITH t AS (SELECT {_DETAIL} AS detail FROM part) SELECT CASE WHEN contains(detail, 'Timeout') THEN 'timeout' " + " ".join(f"WHEN contains(detail, '{c}') THEN '{k}'" for c, (k,) in _ERRORS.items()) + " ELSE 'unknown' END AS kind, count(*) AS n FROM t GROUP BY 1")
def scan_error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.table(spark, sf_dir, "part").selectExpr(f"{_DETAIL} AS detail").groupBy(scalars.error_kind(F.col("detail")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/robots.txt' AS robots_url, CASE WHEN regexp_matches(url, '^https?://(127\\.0\\.0\\.1|localhost)') THEN 1500 ELSE 2000 END::BIGINT AS delay_ms FROM pages")
def url_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return synth.table(spark, sf_dir, "pages").select("url", scalars.robots_url(u).alias("robots_url"), scalars.delay_after(u, F.lit(1500), F.lit(None).cast("double")).alias("delay_ms"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return script_tally_by_lang(spark, sf_dir)
