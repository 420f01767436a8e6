"""Aggregates over many sites. Third-party and script-aware findings are never added up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphaudit.dims import GROUPS, groups_table
from glyphaudit.functions.scalars import href, percent
from glyphaudit.functions.scripts import trimmed
from glyphaudit.operators.engine import rank
from glyphaudit.operators.pages import severity_of

STATUSES = ("scanned", "disallowed", "skipped", "failed")


def scanned(sites: DataFrame) -> DataFrame:
    return sites.where("status = 'scanned'")


def outcomes(sites: DataFrame) -> DataFrame:
    """``status, n_sites`` for all four statuses."""
    every = sites.sparkSession.createDataFrame([(i, s) for i, s in enumerate(STATUSES)], "status_ord int, status string")
    counts = sites.groupBy("status").agg(F.count("*").alias("n"))
    return F.broadcast(every).join(counts, "status", "left").orderBy("status_ord").select("status", F.coalesce("n", F.lit(0)).alias("n_sites"))


def _ranked(rows: DataFrame, sites: DataFrame) -> DataFrame:
    total = scanned(sites).agg(F.count("*").alias("n_scanned"))
    out = rows.crossJoin(F.broadcast(total))  # one row
    return out.withColumn("percent_of_sites", percent(F.col("n_sites"), F.col("n_scanned"))).drop("n_scanned").orderBy(F.desc("n_sites"), F.desc("n_elements"), "rule_id")


def standard_rows(sites: DataFrame) -> DataFrame:
    """Third-party findings of nested site records, one a row: ``list_ord, pos, id, help, impact, n_nodes``."""
    return sites.select("list_ord", F.posexplode("standard").alias("pos", "v")).select("list_ord", "pos", "v.id", "v.help", "v.impact", "v.n_nodes")


def script_aware_rows(sites: DataFrame) -> DataFrame:
    """Our findings of nested site records: ``list_ord, pos, rule_id, title, severity, confidence, script``."""
    return sites.select("list_ord", F.posexplode("script_aware").alias("pos", "v")).select("list_ord", "pos", "v.rule_id", "v.title", "v.severity", "v.confidence", "v.script")


def detected_rows(sites: DataFrame) -> DataFrame:
    """Script tallies of nested site records: ``list_ord, script, n``."""
    return sites.select("list_ord", F.explode("scripts_detected").alias("script", "n"))


def _of(sites: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of scanned sites, with the site's address and group."""
    return rows.join(scanned(sites).select("list_ord", "url", "target_group"), "list_ord")


def standard_issues(sites: DataFrame, standard: DataFrame) -> DataFrame:
    """Third-party issues by rule: title and severity first seen, distinct sites, elements; most sites first."""
    at = F.struct("list_ord", "pos")
    by = _of(sites, standard).groupBy(F.col("id").alias("rule_id")).agg(F.min_by("help", at).alias("title"), F.min_by(F.coalesce("impact", F.lit("ungraded")), at).alias("severity"), F.count_distinct("url").alias("n_sites"), F.sum("n_nodes").cast("long").alias("n_elements"))
    return _ranked(by, sites)


def script_aware_issues(sites: DataFrame, findings: DataFrame) -> DataFrame:
    """Our issues by rule: worst severity, first title and confidence; an element a finding."""
    at = F.struct("list_ord", "pos")
    by = _of(sites, findings).groupBy("rule_id").agg(F.min_by("title", at).alias("title"), severity_of(F.min(rank(F.col("severity")))).alias("severity"), F.min_by("confidence", at).alias("confidence"), F.count_distinct("url").alias("n_sites"), F.count("*").alias("n_elements"))
    return _ranked(by, sites)


def layer_totals(sites: DataFrame, standard: DataFrame, findings: DataFrame) -> DataFrame:
    """A row for each layer: sites with findings, rules, elements, passes (only third-party checks report any). There is no sum of both."""
    s = _of(sites, standard).agg(F.lit("standard").alias("layer"), F.count_distinct("url").alias("n_sites"), F.count_distinct("id").alias("n_rules"), F.coalesce(F.sum("n_nodes"), F.lit(0)).cast("long").alias("n_elements"))
    p = scanned(sites).agg(F.coalesce(F.sum("passes"), F.lit(0)).cast("long").alias("n_passes"))
    a = _of(sites, findings).agg(F.lit("script_aware").alias("layer"), F.count_distinct("url").alias("n_sites"), F.count_distinct("rule_id").alias("n_rules"), F.count("*").alias("n_elements"))
    return s.crossJoin(p).unionByName(a.withColumn("n_passes", F.lit(0).cast("long")))  # one row each


#: What ``measures`` counts by; the last is everything.
MEASURES = ("rule_id", "script", "target_group", "all")


def measures(sites: DataFrame, findings: DataFrame) -> DataFrame:
    """``by, name, n_sites, n_elements, n_certain``: our findings by rule, by script, by group and over all, in one pass of grouping sets.

    ``n_certain`` are those of high confidence; ``name`` is null over all.
    """
    keys = MEASURES[:-1]
    rows = _of(sites, findings).select(*keys, "list_ord", "confidence")
    counted = rows.groupingSets([[k] for k in keys] + [[]], *keys).agg(F.grouping_id().alias("left_out"), F.count_distinct("list_ord").alias("n_sites"), F.count("*").alias("n_elements"), F.count_if(F.col("confidence") == "high").alias("n_certain"))
    # grouping_id has a bit for each key that a row doesn't go by, the first key's highest.
    by = F.lit(MEASURES[-1])
    for i, k in enumerate(keys):
        by = F.when(F.col("left_out") == (2 ** len(keys) - 1) - 2 ** (len(keys) - 1 - i), F.lit(k)).otherwise(by)
    return counted.select(by.alias("by"), F.coalesce(*keys).alias("name"), "n_sites", "n_elements", "n_certain")


def by_detected_script(sites: DataFrame, findings: DataFrame) -> DataFrame:
    return _of(sites, findings).groupBy("script").agg(F.count_distinct("url").alias("n_sites"), F.count("*").alias("n_findings")).orderBy(F.desc("n_findings"), "script")


def by_group(sites: DataFrame, standard: DataFrame, findings: DataFrame) -> DataFrame:
    """Groups in their fixed order: listed, scanned, sites with findings and elements of each layer."""
    s = _of(sites, standard).groupBy("list_ord").agg(F.sum("n_nodes").cast("long").alias("s"))
    a = _of(sites, findings).groupBy("list_ord").agg(F.count("*").alias("a"))
    counts = (
        sites.join(s, "list_ord", "left")
        .join(a, "list_ord", "left")
        .groupBy("target_group")
        .agg(
            F.count("*").alias("listed"),
            F.count_if(F.col("status") == "scanned").alias("scanned"),
            F.count_if(F.col("s").isNotNull()).alias("standard_sites"),
            F.coalesce(F.sum("s"), F.lit(0)).alias("standard_elements"),
            F.count_if(F.col("a").isNotNull()).alias("script_aware_sites"),
            F.coalesce(F.sum("a"), F.lit(0)).alias("script_aware_elements"),
        )
    )
    order = sites.sparkSession.createDataFrame([(i, g) for i, g in enumerate(GROUPS)], "group_ord int, target_group string")
    return counts.join(F.broadcast(order), "target_group").orderBy("group_ord")


def label_mismatches(sites: DataFrame, detected: DataFrame) -> DataFrame:
    """Scanned sites in none of whose nodes an expected script was found, with what was: most nodes first."""
    seen = _of(sites, detected).where("n > 0")
    expected = F.broadcast(groups_table(sites.sparkSession).select("target_group", "script"))
    met = seen.join(expected, ["target_group", "script"], "left_semi").select("list_ord").distinct()
    # At most one entry for each script.
    names = seen.where("script <> 'common'").groupBy("list_ord").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "script"))).alias("d"))
    out = scanned(sites).join(met, "list_ord", "left_anti").join(names, "list_ord", "left")
    return out.select("list_ord", "url", "target_group", F.coalesce(F.transform("d", lambda e: e["script"]), F.array().cast("array<string>")).alias("detected")).orderBy("list_ord")


def measured(sites: DataFrame, detected: DataFrame) -> DataFrame:
    """``n_scanned, n_mismatched, n_measured``."""
    return scanned(sites).agg(F.count("*").alias("n_scanned")).crossJoin(label_mismatches(sites, detected).agg(F.count("*").alias("n_mismatched"))).withColumn("n_measured", F.greatest(F.lit(0).cast("long"), F.col("n_scanned") - F.col("n_mismatched")))


FLAGSHIP = "cursive-script-letter-spacing"


def caveats(sites: DataFrame, findings: DataFrame) -> DataFrame:
    """One row of what must be said beside the numbers.

    What the flagship check found (null where it found nothing), the two most widespread checks
    with their share of all elements (null where there are not two), and elements of high confidence.
    """
    issues = script_aware_issues(sites, findings).select("rule_id", "confidence", "n_sites", "n_elements")
    place = F.row_number().over(Window.orderBy(F.desc("n_sites"), F.desc("n_elements"), "rule_id"))  # a row for each rule
    out = issues.withColumn("place", place)
    at = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c)))
    flagship = lambda c: F.max(F.when(F.col("rule_id") == FLAGSHIP, F.col(c)))
    sums = out.agg(
        flagship("n_sites").alias("flagship_sites"),
        flagship("n_elements").alias("flagship_elements"),
        at(1, "rule_id").alias("first_rule"),
        at(1, "confidence").alias("first_confidence"),
        at(2, "rule_id").alias("second_rule"),
        at(2, "confidence").alias("second_confidence"),
        F.sum(F.when(F.col("place") <= 2, F.col("n_elements"))).alias("_two"),
        F.coalesce(F.sum("n_elements"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("confidence") == "high", F.col("n_elements"))), F.lit(0)).alias("high_confidence"),
    )
    both = F.col("second_rule").isNotNull() & (F.col("total") > 0)
    return sums.withColumns({"top_two": F.when(both, F.col("_two")), "top_two_percent": F.when(both, percent(F.col("_two"), F.col("total")))}).drop("_two")


def count_by_group(targets: DataFrame) -> DataFrame:
    order = targets.sparkSession.createDataFrame([(i, g) for i, g in enumerate(GROUPS)], "group_ord int, target_group string")
    counts = targets.groupBy(F.col("script").alias("target_group")).agg(F.count("*").alias("n"))
    return F.broadcast(order).join(counts, "target_group", "left").orderBy("group_ord").select("target_group", F.coalesce("n", F.lit(0)).alias("n_targets"))


def target_errors(targets: DataFrame) -> DataFrame:
    """``list_ord, problem`` for every target that can't be used; an address that was listed before is named at its repeat."""
    address = href(F.col("url"))
    again = F.row_number().over(Window.partitionBy(address).orderBy("list_ord")) > 1
    readable = F.coalesce(F.col("url").rlike(r"^[\x00-\x20]*[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#\s]+"), F.lit(False))
    web = F.lower(trimmed(F.col("url"))).rlike("^https?://")
    note = F.col("note_fine") if "note_fine" in targets.columns else F.lit(True)
    checks = [
        (F.coalesce(trimmed(F.col("url")), F.lit("")) == "", "an address is needed"),
        ((trimmed(F.col("url")) != "") & ~readable, "the address can't be read"),
        (readable & ~web, "the address is neither http nor https"),
        (readable & web & again, "the address is listed twice"),
        (~F.coalesce(F.col("script").isin(*GROUPS), F.lit(False)), "the group isn't known"),
        (~note, "the note is not text"),
    ]
    found = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(p)) for c, p in checks])
    return targets.withColumn("problems", F.filter(found, lambda p: p.isNotNull())).select("list_ord", F.explode("problems").alias("problem")).orderBy("list_ord", "problem")


def status_of(reason: str) -> str:
    """A site's status when its robots file doesn't let it be scanned."""
    return "disallowed" if reason == "robots-disallows" else "skipped"
