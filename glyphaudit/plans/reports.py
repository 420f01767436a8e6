"""Queries over reports, stored documents and static pages, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphaudit.functions.scripts import analysed
from glyphaudit.operators import campaign, documents, page_reports, records
from glyphaudit.operators.engine import Filters
from glyphaudit.plans import catalogue as C
from glyphaudit.plans import synth

QUERIES: dict[str, C.Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: C.Query) -> C.Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# -- the whole report of a page ----------------------------------------------------------------

#: Third-party objects from events: known fields and one that nobody here knows. The text is the same in both engines.
_RAW = """concat('{"help":"about ', event_type, '","id":"', event_type, '",', CASE WHEN event_type = 'click' THEN '' WHEN user_id % 5 = 0 THEN '"impact":null,' ELSE concat('"impact":"', CASE user_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'serious' WHEN 2 THEN 'moderate' ELSE 'minor' END, '",') END,
 '"nodes":[', CASE event_id % 3 WHEN 0 THEN '{"html":"<b>"}' WHEN 1 THEN '{"html":"<i>"},{"html":"é"}' ELSE '' END, ']', CASE WHEN event_id % 7 = 0 THEN ',"source":"own"' ELSE '' END, ',"unheard":', replace(replace(props, ' ', ''), '''', ''), '}')"""
_OBJECTS = {
    "page_id": "concat('d', event_id % 150)",
    "ord": "event_id",
    "id": "event_type",
    "impact": "CASE WHEN event_type = 'click' OR user_id % 5 = 0 THEN NULL ELSE CASE user_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'serious' WHEN 2 THEN 'moderate' ELSE 'minor' END END",
    "n": "CAST((event_id + 1) % 3 AS INT)",
    "t": _RAW,
}
_SCANS = {
    "page_id": "concat('d', doc_id)",
    "url": "concat('https://site.example/', doc_id)",
    "final_url": "concat('https://site.example/', doc_id, '/')",
    "captured_at": "'2024-01-02T03:04:05.000Z'",
    "duration_ms": "CAST(n_chars AS BIGINT)",
    "passes": "CAST(doc_id % 7 AS BIGINT)",
    "doc_id": "doc_id",
}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in columns.items())


#: Checks whose messages the SQL has, and third-party checks.
_ASKED = Filters(rules=(*C._SAID, "click", "error", "purchase"), disabled=("error",), severity="moderate")


def _counted(grade: str, kept: str) -> str:
    by = " || ".join(f"""'"{s}":' || count(*) FILTER ({kept} AND {grade} = '{s}') || ','""" for s in ("critical", "serious", "moderate", "minor"))
    return f"""{by} || '"ungraded":' || count(*) FILTER ({kept} AND {grade} IS NULL) || ',"total":' || count(*) FILTER ({kept})"""


_LABELS = "CASE script " + " ".join(f"WHEN '{n}' THEN '{label}'" for n, label in {"arabic": "Arabic", "hebrew": "Hebrew", "syriac": "Syriac", "nko": "N''Ko", "thaana": "Thaana", "latin": "Latin", "thai": "Thai", "devanagari": "Devanagari", "khmer": "Khmer", "han": "Han", "hangul": "Hangul", "common": "Common", "unknown": "Unrecognised"}.items()) + " END"
_LIMITS = {"cursive-script-letter-spacing": "Spacing that a reader applies isn''t seen.", "missing-dir-attribute": "", "physical-css-in-bidi-context": ""}
_ALLOWED = C._in(list(C._SAID))
_SQL_REPORTS = C._FOUND + f""",
said AS ({" UNION ALL ".join(C._said(r) for r in C._SAID)}),
ours AS (SELECT f.*, coalesce(f.rule_id IN {_ALLOWED} AND {C._RANKED.replace("severity", "f.severity")} <= 2, false) AS kept FROM found f),
full_ours AS (SELECT o.*, s.title, s.snippet, s.what_is_wrong, s.why_it_matters, s.how_to_fix, {C._RANKED} AS rank, min({C._RANKED}) OVER (PARTITION BY o.page_id, o.rule_id) AS worst FROM ours o JOIN said s USING (page_id, node_ord, rule_id) WHERE o.kept),
findings AS (SELECT page_id, to_json(list(json_object('ruleId', rule_id, 'title', title, 'severity', severity, 'confidence', confidence, 'source', 'script_aware', 'script', script, 'selector', selector, 'snippet', snippet, 'whatIsWrong', what_is_wrong, 'whyItMatters', why_it_matters, 'howToFix', how_to_fix)
  ORDER BY worst, rule_id, rank, selector, snippet, node_ord))::VARCHAR AS j FROM full_ours GROUP BY page_id),
by_rule AS (SELECT page_id, rule_id, worst, json_object('ruleId', rule_id, 'title', any_value(title), 'severity', ['critical', 'serious', 'moderate', 'minor'][worst + 1], 'confidence', any_value(confidence),
  'limitations', CASE rule_id {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LIMITS.items())} END, 'scripts', list(DISTINCT script ORDER BY script), 'elements', count(*)) AS j FROM full_ours GROUP BY page_id, rule_id, worst),
rules AS (SELECT page_id, to_json(list(j ORDER BY worst, rule_id))::VARCHAR AS j, count(*) AS n FROM by_rule GROUP BY page_id),
our_counts AS (SELECT page_id, {_counted("severity", "kept")} AS c, count(*) FILTER (kept) AS n, count(*) FILTER (NOT kept) AS withheld FROM ours GROUP BY page_id),
by_script AS (SELECT page_id, to_json(list(json_object('script', script, 'label', {_LABELS}, 'count', n) ORDER BY n DESC, script))::VARCHAR AS j FROM (SELECT page_id, script, count(*) AS n FROM ours WHERE kept GROUP BY ALL) GROUP BY page_id),
detected AS (SELECT page_id, to_json(list(json_object('script', script, 'label', {_LABELS}, 'count', n) ORDER BY n DESC, script))::VARCHAR AS j FROM (SELECT page_id, dominant AS script, count(*) AS n FROM analysed GROUP BY ALL) GROUP BY page_id),
objects AS (SELECT {_select(_OBJECTS)} FROM events),
theirs AS (SELECT *, id IN ('click', 'purchase') AND (impact IS NULL OR impact <> 'minor') AS kept, CASE impact WHEN 'critical' THEN 0 WHEN 'serious' THEN 1 WHEN 'moderate' THEN 2 WHEN 'minor' THEN 3 ELSE 4 END AS rank,
  CASE WHEN contains(t, '"source"') THEN t ELSE replace(t, ',"unheard"', ',"source":"standard","unheard"') END AS labelled FROM objects),
std AS (SELECT page_id, {_counted("impact", "kept")} AS c, count(*) FILTER (kept) AS rules, coalesce(sum(n) FILTER (kept), 0) AS elements, count(*) FILTER (NOT kept) AS withheld, '[' || coalesce(string_agg(labelled, ',' ORDER BY rank, id, ord) FILTER (kept), '') || ']' AS j FROM theirs GROUP BY page_id),
own AS (SELECT page_id, node_ord, run_ord, substr(trim(text), 1, 40) AS sample FROM runs WHERE script = 'unknown'),
firsts AS (SELECT page_id, sample, min(node_ord * 1000000 + run_ord) AS place FROM own WHERE sample <> '' GROUP BY ALL),
best AS (SELECT page_id, list(sample ORDER BY place) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place) AS k FROM firsts) WHERE k <= 5 GROUP BY page_id),
strange AS (SELECT page_id, json_object('nodeCount', count(DISTINCT node_ord), 'samples', any_value(samples))::VARCHAR AS j FROM own JOIN best USING (page_id) GROUP BY page_id),
scans AS (SELECT {_select(_SCANS)} FROM documents),
zero AS (SELECT '"critical":0,"serious":0,"moderate":0,"minor":0,"ungraded":0,"total":0' AS z)
SELECT page_id, url, final_url, captured_at AS scanned_at, duration_ms,
 '{{"standard":{{' || coalesce(std.c, z) || ',"rules":' || coalesce(std.rules, 0) || ',"elements":' || coalesce(std.elements, 0)::BIGINT || ',"passes":' || passes || '}},"scriptAware":{{' || coalesce(our_counts.c, z) || ',"rules":' || coalesce(rules.n, 0) || ',"elements":' || coalesce(our_counts.n, 0) || '}},"byScript":' || coalesce(by_script.j, '[]') || ',"scriptsDetected":' || coalesce(detected.j, '[]') || '}}' AS summary,
 coalesce(std.j, '[]') AS standard_findings, coalesce(findings.j, '[]') AS script_aware_findings, coalesce(rules.j, '[]') AS rules, strange.j AS unsupported,
 '{{"applied":{{"onlyRules":["missing-dir-attribute","cursive-script-letter-spacing","physical-css-in-bidi-context","click","error","purchase"],"disabledRules":["error"],"minSeverity":"moderate"}},"withheld":{{"standard":' || coalesce(std.withheld, 0) || ',"scriptAware":' || coalesce(our_counts.withheld, 0) || '}}}}' AS filters,
 CASE WHEN doc_id % 50 = 3 THEN '{{"kind":"timeout","message":"It took too long."}}' END AS error
FROM scans CROSS JOIN zero LEFT JOIN std USING (page_id) LEFT JOIN our_counts USING (page_id) LEFT JOIN rules USING (page_id) LEFT JOIN findings USING (page_id) LEFT JOIN by_script USING (page_id) LEFT JOIN detected USING (page_id) LEFT JOIN strange USING (page_id)"""


@query(_SQL_REPORTS)
def page_report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON of every page's report, taken apart again field by field."""
    from glyphaudit.llm.common import Scratch

    # Nodes are looked at once: what the parts of a report take from them is written, and read by each.
    facts = Scratch(spark, "reports").put(page_reports.facts(analysed(synth.raw_nodes(spark, sf_dir)), _ASKED), "facts")
    raw = synth.table(spark, sf_dir, "events").selectExpr(*[f"{v} AS {k}" for k, v in _OBJECTS.items()])
    standard = raw.select("page_id", "ord", "id", "impact", F.from_json("t", "nodes array<struct<html string>>")["nodes"].alias("nodes"), F.parse_json("t").alias("raw"))
    scans = synth.table(spark, sf_dir, "documents").selectExpr(*[f"{v} AS {k}" for k, v in _SCANS.items()])
    scans = scans.withColumn("error", F.when(F.col("doc_id") % 50 == 3, F.struct(F.lit("timeout").alias("kind"), F.lit("It took too long.").alias("message"), F.lit(None).cast("string").alias("detail"))))
    whole = page_reports.page_json(page_reports.page_reports(scans, standard, *page_reports.parts(facts), _ASKED))
    # Parsed once; a field read as a string is its JSON.
    kinds = "url string, finalUrl string, scannedAt string, durationMs string, summary string, standard struct<findings: string>, scriptAware struct<findings: string, rules: string>, unsupportedScript string, filters string, error string"
    whole = whole.select("page_id", F.from_json("json", kinds).alias("r"))
    part = lambda path: F.col(f"r.{path}")
    return whole.select(
        "page_id", part("url").alias("url"), part("finalUrl").alias("final_url"), part("scannedAt").alias("scanned_at"), part("durationMs").cast("long").alias("duration_ms"), part("summary").alias("summary"), part("standard.findings").alias("standard_findings"),
        part("scriptAware.findings").alias("script_aware_findings"), part("scriptAware.rules").alias("rules"), part("unsupportedScript").alias("unsupported"), part("filters").alias("filters"), part("error").alias("error"),
    )


# -- a campaign's document ---------------------------------------------------------------------

#: Records of a campaign from customers: some refused, some failed, some given up on, with findings in them.
_RECORDS = {
    "list_ord": "CAST(c_custkey AS INT)",
    "url": "concat('https://c', c_custkey, '.example/')",
    "target_group": "CASE c_nationkey % 4 WHEN 0 THEN 'arabic' WHEN 1 THEN 'thai' WHEN 2 THEN 'cjk' ELSE 'hebrew' END",
    "status": "CASE WHEN c_custkey % 10 = 7 THEN 'disallowed' WHEN c_custkey % 10 = 8 THEN 'skipped' WHEN c_custkey % 10 = 9 OR c_custkey % 25 = 3 THEN 'failed' ELSE 'scanned' END",
    "gave_up": "c_custkey % 25 = 3",
    "duration_ms": "CAST(c_custkey * 10 AS BIGINT)",
    "passes": "CAST(c_custkey % 9 AS BIGINT)",
    "n_found": "CAST(c_custkey % 4 AS INT)",
}


def campaign_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = synth.table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_mktsegment", *[f"{v} AS {k}" for k, v in _RECORDS.items()])
    ours = "transform(IF(n_found > 0, sequence(1, n_found), array()), i -> named_struct('rule_id', concat('r', (c_custkey + i) % 3), 'title', 't', 'severity', IF(i = 1, 'serious', 'minor'), 'confidence', IF((c_custkey + i) % 3 = 0, 'high', 'heuristic'), 'script', IF(i % 2 = 0, 'thai', 'arabic')))"
    theirs = "transform(IF(c_custkey % 3 > 0, array(CAST(c_custkey % 3 AS INT)), array()), i -> named_struct('id', c_mktsegment, 'help', 'h', 'impact', CAST(NULL AS STRING), 'n_nodes', i))"
    own = lambda x: f"IF(status = 'scanned', {x}, NULL)"
    return flat.selectExpr(
        "list_ord", "url", "url AS final_url", "target_group", "CAST(NULL AS STRING) AS note", "status", "'2024-01-02T03:04:05.000Z' AS started_at", "duration_ms", "CAST(NULL AS STRING) AS reason", "CAST(NULL AS STRING) AS detail",
        f"{own(theirs)} AS standard", f"{own('passes')} AS passes", f"{own(ours)} AS script_aware", f"{own('map(IF(c_custkey % 2 = 0, "thai", "arabic"), CAST(c_custkey % 5 AS BIGINT))')} AS scripts_detected", "CAST(NULL AS STRUCT<nodeCount: BIGINT, samples: ARRAY<STRING>>) AS unsupported", "gave_up",
    )


_SITES = "WITH sites AS (SELECT c_custkey, c_mktsegment, " + ", ".join(f"{v} AS {k}" for k, v in _RECORDS.items()) + """ FROM customer), ok AS (SELECT * FROM sites WHERE status = 'scanned'),
ours AS (SELECT list_ord, url, target_group, 'r' || (c_custkey + i) % 3 AS rule_id, CASE WHEN (c_custkey + i) % 3 = 0 THEN 'high' ELSE 'heuristic' END AS confidence, CASE WHEN i % 2 = 0 THEN 'thai' ELSE 'arabic' END AS script FROM ok, (SELECT unnest([1, 2, 3]) AS i) WHERE i <= n_found)"""
_MEASURED = "count(DISTINCT list_ord) AS n_sites, count(*) AS n_elements, count(*) FILTER (confidence = 'high') AS n_certain FROM ours"


@query(
    _SITES
    + f" SELECT 'rule_id' AS by, rule_id AS name, {_MEASURED} GROUP BY rule_id UNION ALL SELECT 'script', script, {_MEASURED} GROUP BY script UNION ALL SELECT 'target_group', target_group, {_MEASURED} GROUP BY target_group UNION ALL SELECT 'all', NULL, {_MEASURED}"
)
def campaign_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass of grouping sets beside three groupings and a total."""
    sites = campaign_sites(spark, sf_dir)
    return campaign.measures(sites, campaign.script_aware_rows(sites))


@query(
    _SITES + """, bad AS (SELECT list_ord FROM ok WHERE NOT (c_custkey % 5 > 0 AND target_group = CASE WHEN c_custkey % 2 = 0 THEN 'thai' ELSE 'arabic' END))
SELECT 1::INT AS campaign_version, '2024-01-02T03:04:05.000Z' AS started_at, strftime(TIMESTAMP '2024-01-02 03:04:05' + to_milliseconds(max(duration_ms)), '%Y-%m-%dT%H:%M:%S.%gZ') AS finished_at, 'GlyphAudit' AS user_agent, 2000::BIGINT AS delay_ms, 60000::BIGINT AS site_timeout_ms,
 count(*) FILTER (gave_up) AS abandoned_scans, 'customers' AS path, 9000::BIGINT AS available, count(*) AS attempted, count(*) FILTER (status = 'scanned') AS n_scanned, (SELECT count(*) FROM bad) AS n_mismatched,
 concat('scanned ', count(*) FILTER (status = 'scanned'), ', disallowed ', count(*) FILTER (status = 'disallowed'), ', skipped ', count(*) FILTER (status = 'skipped'), ', failed ', count(*) FILTER (status = 'failed')) AS outcomes,
 (SELECT count(*) FROM ours) AS script_aware_elements, (SELECT sum(c_custkey % 3)::BIGINT FROM ok) AS standard_elements, (SELECT sum(passes)::BIGINT FROM ok) AS n_passes,
 (SELECT string_agg(rule_id || ' ' || n, ', ' ORDER BY m DESC, n DESC, rule_id) FROM (SELECT rule_id, count(*) AS n, count(DISTINCT url) AS m FROM ours GROUP BY rule_id)) AS issues FROM sites"""
)
def campaign_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of a campaign's document: run fields, and counts out of its aggregate."""
    m = documents.manifest(campaign_sites(spark, sf_dir), documents.Run("customers", 9000))
    layer = lambda name, c: F.filter("aggregate.layers", lambda x: x["layer"] == name)[0][c]
    joined = lambda c, one: F.array_join(F.transform(c, one), ", ")
    return m.select(
        "campaign_version", "started_at", "finished_at", "user_agent", "delay_ms", "site_timeout_ms", "abandoned_scans", "target_list.path", "target_list.available", "target_list.attempted", "aggregate.measured.n_scanned", "aggregate.measured.n_mismatched",
        joined("aggregate.outcomes", lambda x: F.concat_ws(" ", x["status"], x["n_sites"].cast("string"))).alias("outcomes"),
        layer("script_aware", "n_elements").alias("script_aware_elements"), layer("standard", "n_elements").alias("standard_elements"), layer("standard", "n_passes").alias("n_passes"),
        joined("aggregate.issues_script_aware", lambda x: F.concat_ws(" ", x["rule_id"], x["n_elements"].cast("string"))).alias("issues"),
    )


@query(_SITES + """, shown AS (SELECT list_ord, status, (CASE WHEN c_custkey % 3 > 0 THEN 1 ELSE 0 END)::VARCHAR AS s, n_found::VARCHAR AS a, url, target_group FROM sites)
SELECT list_ord, url, target_group, CASE status WHEN 'disallowed' THEN 'disallowed by robots.txt' ELSE status END AS outcome, CASE WHEN status = 'scanned' THEN s ELSE '—' END AS standard, CASE WHEN status = 'scanned' THEN a ELSE '—' END AS script_aware FROM shown""")
def campaign_site_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each site as tables show them."""
    return records.site_rows(campaign_sites(spark, sf_dir))


@query(_SITES + """ SELECT id AS rule_id, n || ' of ' || (SELECT count(*) FROM ok) AS sites, replace(CAST(floor(n::DOUBLE / (SELECT count(*) FROM ok) * 1000 + 0.5) / 10 AS VARCHAR) || '%', '.0%', '%') AS percent, e AS n_elements, 'ungraded' AS grade
FROM (SELECT c_mktsegment AS id, count(DISTINCT url) AS n, sum(c_custkey % 3)::BIGINT AS e FROM ok WHERE c_custkey % 3 > 0 GROUP BY 1)""")
def campaign_issue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third-party issues as a campaign's table shows them."""
    sites = campaign_sites(spark, sf_dir)
    return records.issue_rows(campaign.standard_issues(sites, campaign.standard_rows(sites)), campaign.scanned(sites).count())
