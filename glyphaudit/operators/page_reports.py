"""The whole report of a page as one JSON document: both layers' findings, untouched and apart, and what was left out."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphaudit.dims import LABELS, SEVERITIES
from glyphaudit.operators import engine, pages
from glyphaudit.operators.engine import Filters, rank
from glyphaudit.operators.records import REPORT_VERSION
from glyphaudit.operators.rules import FOUND, RULES, found_by

ATTRIBUTION = "Found by an independent checker and passed on as it said them: no field is changed, graded anew or left out."
DISCLAIMER = "An automated check finds things that are no problem and misses things that are. Nothing here accuses anyone or says what the law asks. Heuristic findings are guesses from evidence; look at the page before acting on any."

#: Fields of our findings, as the document names them.
_FINDING = {"ruleId": "rule_id", "title": "title", "severity": "severity", "confidence": "confidence", "source": "source", "script": "script", "selector": "selector", "snippet": "snippet", "whatIsWrong": "what_is_wrong", "whyItMatters": "why_it_matters", "howToFix": "how_to_fix", "wcagRef": "wcag_ref"}


def _sorted(pairs: Column) -> Column:
    """Values ``v`` of an array of ``struct<at, v>`` by ``at``; values need no order of their own. Places are sorted, not compared by a function."""
    places = F.array_sort(F.transform(pairs, lambda x, i: F.struct(x["at"].alias("at"), i.alias("i"))))
    return F.transform(places, lambda p: F.get(pairs, p["i"])["v"])


def _counts(grade: Column, kept: Column) -> list[Column]:
    return [*[F.count_if(kept & (grade == s)).alias(s) for s in SEVERITIES], F.count_if(kept & grade.isNull()).alias("ungraded"), F.count_if(kept).alias("total")]


def labelled(raw: Column) -> Column:
    """A third-party object, a variant whose JSON is ``_text``, with a ``source`` beside what it says; an object that has one keeps its own."""
    text = F.col("_text")
    rest = F.expr("substring(_text, 2)")
    joined = F.concat(F.lit('{"source":"standard"'), F.when(rest == "}", F.lit("")).otherwise(F.lit(",")), rest)
    return F.when(F.variant_get(raw, "$.source", "variant").isNull() & text.startswith("{"), F.parse_json(joined)).otherwise(raw)


def standard_part(third_party: DataFrame, filters: Filters) -> DataFrame:
    """``page_id, counts, rules, elements, withheld, findings``: kept objects worst first, ungraded last, then by id and as they came."""
    kept = F.coalesce(engine.third_party_kept(filters), F.lit(False))
    worst = F.coalesce(rank(F.col("impact")), F.lit(len(SEVERITIES)))
    rows = third_party.withColumn("_kept", kept).withColumn("_text", F.when(F.col("_kept"), F.to_json("raw"))).withColumn("_raw", F.when(F.col("_kept"), labelled(F.col("raw"))))
    n = F.when(F.col("_kept"), F.coalesce(F.size("nodes"), F.lit(0)))
    value = F.struct(F.struct(worst.alias("w"), F.col("id").alias("i"), F.col("ord").alias("o")).alias("at"), F.col("_raw").alias("v"))
    return rows.groupBy("page_id").agg(
        F.struct(*_counts(F.col("impact"), F.col("_kept"))).alias("counts"),
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("elements"),
        F.count_if(~F.col("_kept")).alias("withheld"),
        _sorted(F.collect_list(F.when(F.col("_kept"), value))).alias("findings"),
    )


def script_aware_part(findings: DataFrame, filters: Filters) -> DataFrame:
    """``page_id, counts, withheld, findings, rules, by_script`` from findings of all checks.

    Findings go by rule as the rules do, worst first, and within a rule by severity, selector and
    snippet. Rows are grouped by page and rule before a page's rules come together.
    """
    rows = findings.withColumn("_kept", engine.wanted(filters))
    at = F.struct(rank(F.col("severity")).alias("s"), F.col("selector").alias("e"), F.col("snippet").alias("t"), F.col("node_ord").alias("n"))
    said = F.struct(at.alias("at"), F.struct(*[F.col(c).alias(k) for k, c in _FINDING.items()]).alias("v"))
    grade = F.col("severity")
    by_rule = rows.groupBy("page_id", "rule_id").agg(
        F.struct(*_counts(grade, F.col("_kept"))).alias("counts"),
        F.count_if(~F.col("_kept")).alias("withheld"),
        _sorted(F.collect_list(F.when(F.col("_kept"), said))).alias("found"),
    )
    section = pages.script_aware_section(rows.where("_kept"))
    rule = F.struct(F.col("rule_id").alias("ruleId"), "title", "severity", "confidence", "limitations", F.col("wcag_ref").alias("wcagRef"), "scripts", F.col("n_elements").alias("elements"))
    both = by_rule.join(section.select("page_id", "rule_id", rank(F.col("severity")).alias("_worst"), rule.alias("rule")), ["page_id", "rule_id"], "left")
    place = F.struct(F.col("_worst").alias("w"), F.col("rule_id").alias("r"))
    whole = both.groupBy("page_id").agg(
        F.struct(*[F.sum(f"counts.{c}").alias(c) for c in (*SEVERITIES, "ungraded", "total")]).alias("counts"),
        F.sum("withheld").alias("withheld"),
        F.flatten(_sorted(F.collect_list(F.when(F.col("_worst").isNotNull(), F.struct(place.alias("at"), F.col("found").alias("v")))))).alias("findings"),
        _sorted(F.collect_list(F.when(F.col("_worst").isNotNull(), F.struct(place.alias("at"), F.col("rule").alias("v"))))).alias("rules"),
    )
    scripts = rows.where("_kept").groupBy("page_id", "script").agg(F.count("*").alias("n"))
    return whole.join(_tallied(scripts, "n", "by_script"), "page_id", "left")


def facts(nodes: DataFrame, filters: Filters = Filters()) -> DataFrame:  # noqa: B008
    """What a report needs of analysed nodes, made in one pass over them: a row for each finding, and for each node without any.

    What a filter leaves out is counted only, so its snippets and messages are null. The rows hold no texts of nodes.
    """
    rows = found_by(nodes, RULES, every=True)
    shown = engine.wanted(filters)
    kept = {"page_id", "node_ord", "rule_id", "severity", "script", "first", "unknown"}
    return rows.select(*[c if c in kept else F.when(shown, F.col(c)).alias(c) for c in rows.columns])


def parts(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings, script tally and unsupported text out of ``facts``, as ``page_reports`` takes them."""
    nodes = rows.where("first")
    tally = pages.script_tally(nodes.withColumnRenamed("script", "dominant_script"))
    return rows.where("rule_id IS NOT NULL").select(*FOUND), tally, pages.unsupported_of(nodes.select("page_id", "node_ord", "unknown"))


def _tallied(tally: DataFrame, n: str, name: str) -> DataFrame:
    """``page_id, <name>``: scripts with labels and counts, most first, then by script."""
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[F.col("script")]
    value = F.struct(F.struct((-F.col(n)).alias("n"), F.col("script").alias("s")).alias("at"), F.struct("script", label.alias("label"), F.col(n).alias("count")).alias("v"))
    return tally.where(F.col(n) > 0).groupBy("page_id").agg(_sorted(F.collect_list(value)).alias(name))


def applied(filters: Filters) -> Column:
    """What was asked for, without what wasn't."""
    names = {"onlyRules": filters.rules, "disabledRules": filters.disabled, "onlyScripts": filters.scripts}
    asked = [F.array(*[F.lit(x) for x in v]).cast("array<string>").alias(k) for k, v in names.items() if v is not None]
    return F.struct(*asked, *([F.lit(filters.severity).alias("minSeverity")] if filters.severity is not None else []))


def page_reports(scans: DataFrame, third_party: DataFrame, findings: DataFrame, tally: DataFrame, unsupported: DataFrame, filters: Filters = Filters()) -> DataFrame:  # noqa: B008
    """``page_id, report``: a struct for each scan that ``to_json`` writes whole.

    ``third_party`` has the objects as variants in ``raw`` beside the fields read from them, and
    ``findings`` is unfiltered: both are filtered here, so that what a filter withheld is counted in
    the same pass. What a page doesn't have is null and so left out, ``filters`` where none was asked for.
    """
    theirs, ours = standard_part(third_party, filters), script_aware_part(findings, filters)
    rename = lambda df, p: df.select("page_id", *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "page_id"])
    strange = unsupported.select("page_id", F.struct(F.col("n_nodes").alias("nodeCount"), "samples").alias("unsupported"))
    out = scans
    for part in (rename(theirs, "s"), rename(ours, "a"), _tallied(tally, "n_nodes", "detected"), strange):
        out = out.join(part, "page_id", "left")
    kinds = {f.name: f.dataType for f in out.schema.fields}
    listed = lambda c: F.coalesce(F.col(c), F.array().cast(kinds[c]) if not isinstance(kinds[c].elementType, T.VariantType) else F.expr("CAST(array() AS array<variant>)"))
    long = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    graded = lambda p: [long(f"{p}_counts.{c}").alias(c) for c in (*SEVERITIES, "ungraded", "total")]
    passes = long("passes") if "passes" in scans.columns else F.lit(0).cast("long")
    summary = F.struct(
        F.struct(*graded("s"), F.size(listed("s_findings")).cast("long").alias("rules"), long("s_elements").alias("elements"), passes.alias("passes")).alias("standard"),
        F.struct(*graded("a"), F.size(listed("a_rules")).cast("long").alias("rules"), F.size(listed("a_findings")).cast("long").alias("elements")).alias("scriptAware"),
        listed("a_by_script").alias("byScript"),
        listed("detected").alias("scriptsDetected"),
    )
    withheld = F.struct(long("s_withheld").alias("standard"), long("a_withheld").alias("scriptAware"))
    report = F.struct(
        F.lit("glyphaudit").alias("tool"),
        F.lit(REPORT_VERSION).alias("reportVersion"),
        "url",
        F.col("final_url").alias("finalUrl"),
        F.col("captured_at").alias("scannedAt"),
        F.col("duration_ms").alias("durationMs"),
        summary.alias("summary"),
        F.struct(F.lit("standard").alias("source"), F.lit(ATTRIBUTION).alias("attribution"), listed("s_findings").alias("findings")).alias("standard"),
        F.struct(F.lit("script_aware").alias("source"), listed("a_findings").alias("findings"), listed("a_rules").alias("rules")).alias("scriptAware"),
        F.col("unsupported").alias("unsupportedScript"),
        *([F.struct(applied(filters).alias("applied"), withheld.alias("withheld")).alias("filters")] if filters.any() else []),
        "error",
        F.lit(DISCLAIMER).alias("disclaimer"),
    )
    return out.select("page_id", report.alias("report"))


def page_json(reports: DataFrame) -> DataFrame:
    """``page_id, json``: the document's text, without absent fields."""
    return reports.select("page_id", F.to_json("report").alias("json"))


def bare_scans(nodes: DataFrame) -> DataFrame:
    """A scan for each page of which only the nodes are known."""
    unknown = {"url": "string", "final_url": "string", "captured_at": "string", "duration_ms": "bigint", "error": "struct<kind:string,message:string,detail:string>"}
    return nodes.select("page_id").distinct().select("page_id", *[F.lit(None).cast(t).alias(c) for c, t in unknown.items()])


def rendered(reports: DataFrame, form: str) -> DataFrame:
    """``page_id, report`` as ``json``, ``text`` or ``html``; each page is rendered where its row is."""
    from glyphaudit import report

    if form == "json":
        return reports.select("page_id", F.to_json("report").alias("report"))
    render = {"text": report.page_report_text, "html": report.page_report_html}[form]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"page_id": frame["page_id"], "report": [render(json.loads(x)) for x in frame["json"]]})

    return page_json(reports).mapInPandas(work, "page_id string, report string")
