"""Site records of a campaign and the aggregate of its document, as nested rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphaudit.dims import LABELS, SEVERITIES
from glyphaudit.operators import campaign
from glyphaudit.operators.robots import REASONS

REPORT_VERSION, CAMPAIGN_VERSION = 1, 1
SITE_TIMEOUT_MS = 60_000


def _label(script: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[script]


def _in_order(pairs: Column) -> Column:
    """Values ``v`` of an array of ``struct<at, v>`` by ``at`` alone."""
    placed = F.array_sort(pairs, lambda x, y: F.when(x["at"] < y["at"], F.lit(-1)).when(x["at"] > y["at"], F.lit(1)).otherwise(F.lit(0)))
    return F.transform(placed, lambda x: x["v"])


def _nested(rows: DataFrame, by: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """``by, <name>``: a group's values as one array, in order. A group is what one page or one site has."""
    pairs = F.collect_list(F.struct(F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)]).alias("at"), value.alias("v")))
    return rows.groupBy(by).agg(_in_order(pairs).alias(name))


def site_records(targets: DataFrame, decisions: DataFrame, fetched: DataFrame, scans: DataFrame, standard: DataFrame, findings: DataFrame, tally: DataFrame, unsupported: DataFrame, timeout_ms: int = SITE_TIMEOUT_MS) -> DataFrame:
    """A record for each target, in the order of the list and of schema ``SITES``; nothing of the nodes is kept.

    ``scans(page_id, url, final_url, captured_at, duration_ms, error, passes)`` has what was
    scanned; a target that was allowed and has no scan ran out of time. The other tables go by
    ``page_id``, robots decisions and answers by ``url``. Only scanned sites carry findings.
    """
    of_scan = scans.select("page_id", F.col("url").alias("_url"), "final_url", "captured_at", "duration_ms", "error", "passes")
    ours = _nested(findings, "page_id", [F.col("node_ord"), F.col("rule_id")], F.struct("rule_id", "title", "severity", "confidence", "script"), "script_aware")
    theirs = _nested(standard, "page_id", [F.col("ord")], F.struct("id", "help", "impact", F.size("nodes").alias("n_nodes")), "standard")
    detected = tally.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("script", "n_nodes")))).alias("scripts_detected"))
    strange = unsupported.select("page_id", F.struct(F.col("n_nodes").alias("nodeCount"), "samples").alias("unsupported"))
    robots = decisions.select(F.col("url").alias("_r"), "allowed", F.col("reason").alias("_reason")).dropDuplicates(["_r"])
    answers = fetched.select(F.col("url").alias("_f"), F.coalesce("error", F.concat(F.lit("HTTP status "), F.col("http_status").cast("string"))).alias("_detail")).dropDuplicates(["_f"])
    rows = targets.join(robots, F.col("url") == F.col("_r"), "left").join(answers, F.col("url") == F.col("_f"), "left").join(of_scan, F.col("url") == F.col("_url"), "left")
    for table in (theirs, ours, detected, strange):
        rows = rows.join(table, "page_id", "left")
    refused, failed = ~F.coalesce("allowed", F.lit(False)), F.col("error").isNotNull()
    status = F.when(refused & (F.col("_reason") == "robots-disallows"), F.lit("disallowed")).when(refused, F.lit("skipped")).when(F.col("page_id").isNull() | failed, F.lit("failed")).otherwise(F.lit("scanned"))
    why = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])[F.coalesce("_reason", F.lit("robots-unreachable"))]
    late = F.lit(f"no result came in {timeout_ms} ms, so the site was left")
    rows = rows.withColumn("status", status)
    own = F.col("status") == "scanned"
    empty = {"standard": "array<struct<id:string,help:string,impact:string,n_nodes:int>>", "script_aware": "array<struct<rule_id:string,title:string,severity:string,confidence:string,script:string>>"}
    return rows.select(
        "list_ord",
        "url",
        F.when(~refused, F.col("final_url")).alias("final_url"),
        F.col("script").alias("target_group"),
        "note",
        "status",
        F.col("captured_at").alias("started_at"),
        F.when(refused, F.lit(0).cast("long")).otherwise(F.col("duration_ms")).alias("duration_ms"),
        F.when(refused, why).when(F.col("page_id").isNull(), late).when(failed, F.col("error.message")).alias("reason"),
        F.when(refused & ~F.coalesce(F.col("_reason") == "robots-disallows", F.lit(False)), F.col("_detail")).when(~refused & failed, F.col("error.detail")).alias("detail"),
        *[F.when(own, F.coalesce(c, F.array().cast(t))).alias(c) for c, t in empty.items()],
        F.when(own, F.coalesce("passes", F.lit(0)).cast("long")).alias("passes"),
        F.when(own, F.col("scripts_detected")).alias("scripts_detected"),
        F.when(own, F.col("unsupported")).alias("unsupported"),
        (~refused & F.col("page_id").isNull()).alias("gave_up"),
    ).orderBy("list_ord")


def _list(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """One row with the whole of a small table, a struct for each rule, script, group or site."""
    at = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)])
    packed = rows.select(at.alias("at"), F.struct(*rows.columns).alias("v"))
    return packed.agg(_in_order(F.collect_list(F.struct("at", "v"))).alias(name))


def _one(row: DataFrame, name: str) -> DataFrame:
    return row.select(F.struct(*row.columns).alias(name))


def aggregate(sites: DataFrame) -> DataFrame:
    """One row, from site records: all that a campaign's manifest says beside the run. Layers are never added up.

    Lists hold a row for each rule, script or group; what grows with the sites is only counted.
    """
    standard, ours, detected = campaign.standard_rows(sites), campaign.script_aware_rows(sites), campaign.detected_rows(sites)
    ranked = lambda rows: [-F.col("n_sites"), -F.col("n_elements"), F.col("rule_id")]
    s, a = campaign.standard_issues(sites, standard), campaign.script_aware_issues(sites, ours)
    totals = campaign.layer_totals(sites, standard, ours)
    groups = campaign.by_group(sites, standard, ours)
    parts = [
        sites.agg(F.count("*").alias("targets"), F.count_if(F.col("status") == "scanned").alias("percentages_are_out_of")),
        _list(campaign.outcomes(sites).withColumn("ord", F.array_position(F.array(*[F.lit(x) for x in campaign.STATUSES]), F.col("status"))), [F.col("ord")], "outcomes"),
        _list(totals, [F.col("layer")], "layers"),
        _list(s.withColumn("source", F.lit("standard")), ranked(s), "issues_standard"),
        _list(a.withColumn("source", F.lit("script_aware")), ranked(a), "issues_script_aware"),
        _list(groups, [F.array_position(F.array(*[F.lit(g) for g in campaign.GROUPS]), F.col("target_group"))], "by_group"),
        _list(campaign.by_detected_script(sites, ours).withColumn("label", _label(F.col("script"))), [-F.col("n_findings"), F.col("script")], "by_detected_script"),
        _list(campaign.measures(sites, ours), [F.array_position(F.array(*[F.lit(x) for x in campaign.MEASURES]), F.col("by")), -F.col("n_elements"), F.col("name")], "measures"),
        _one(campaign.measured(sites, detected), "measured"),
        _one(campaign.caveats(sites, ours), "caveats"),
    ]
    return reduce(lambda x, y: x.crossJoin(y), parts)  # one row each


def flat_target(target: Column) -> Column:
    """A third-party selector as text: nested arrays (frames, shadow roots) joined by a space, empty parts left out, anything else empty.

    ``target`` is a variant. Arrays of selectors and arrays of such arrays are met; deeper ones don't occur.
    """
    text = F.try_variant_get(target, "$", "string")
    one = F.try_variant_get(target, "$", "array<variant>")

    def part(v: Column) -> Column:
        inner = F.try_variant_get(v, "$", "array<variant>")
        plain = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.lit(""))
        return F.when(inner.isNotNull(), F.array_join(F.filter(F.transform(inner, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.lit(""))), lambda x: x != ""), " ")).otherwise(plain)

    joined = F.array_join(F.filter(F.transform(one, part), lambda x: x != ""), " ")
    return F.coalesce(F.when(F.schema_of_variant(target) == "STRING", text), joined, F.lit(""))


# What an outcome is called in tables.
OUTCOMES = {"scanned": "scanned", "disallowed": "disallowed by robots.txt", "skipped": "skipped", "failed": "failed"}


def count_rows(counts: DataFrame) -> DataFrame:
    """``page_id, row_ord, name, n`` from severity counts: the severities, what wasn't graded if there is any, the total."""
    cells = [F.struct(F.lit(i).alias("row_ord"), F.lit(s).alias("name"), F.col(s).alias("n")) for i, s in enumerate(SEVERITIES)]
    k = len(SEVERITIES)
    cells += [F.struct(F.lit(k).alias("row_ord"), F.lit("not graded").alias("name"), F.col("ungraded").alias("n")), F.struct(F.lit(k + 1).alias("row_ord"), F.lit("total").alias("name"), F.col("total").alias("n"))]
    return counts.select("page_id", F.inline(F.array(*cells))).where((F.col("name") != "not graded") | (F.col("n") > 0))


def issue_rows(issues: DataFrame, n_scanned: int) -> DataFrame:
    """``rule_id, sites, percent, n_elements, grade`` as a campaign's table shows them."""
    grade = F.concat_ws(" · ", "severity", *(["confidence"] if "confidence" in issues.columns else []))
    return issues.select("rule_id", F.concat(F.col("n_sites").cast("string"), F.lit(f" of {n_scanned}")).alias("sites"), F.concat(F.regexp_replace(F.col("percent_of_sites").cast("string"), r"\.0$", ""), F.lit("%")).alias("percent"), "n_elements", grade.alias("grade"))


def site_rows(sites: DataFrame) -> DataFrame:
    """``list_ord, url, target_group, outcome, standard, script_aware``: findings of each layer, a dash for sites that weren't scanned."""
    names = F.create_map(*[F.lit(x) for kv in OUTCOMES.items() for x in kv])
    shown = lambda c: F.when(F.col("status") == "scanned", F.coalesce(F.size(c), F.lit(0)).cast("string")).otherwise(F.lit("—"))
    return sites.select("list_ord", "url", "target_group", F.coalesce(names[F.col("status")], "status").alias("outcome"), shown("standard").alias("standard"), shown("script_aware").alias("script_aware"))
