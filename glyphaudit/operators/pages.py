"""Aggregates of one page: script tally, unrecognised text, severity counts, grouped sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphaudit.dims import LABELS, SEVERITIES
from glyphaudit.functions.scripts import SAMPLE_LENGTH, SAMPLES, trimmed
from glyphaudit.operators.engine import rank
from glyphaudit.operators.rules import rules_table


def severity_of(r: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), r + 1)


def script_tally(nodes: DataFrame, by: str = "page_id") -> DataFrame:
    """``<by>, script, n_nodes``: nodes by dominant script, common and unknown included."""
    return nodes.groupBy(by, F.col("dominant_script").alias("script")).agg(F.count("*").alias("n_nodes"))


def tally_list(tally: DataFrame, by: str = "page_id") -> DataFrame:
    """Script tally with labels, most nodes first, then by script."""
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return tally.where("n_nodes > 0").withColumn("label", label[F.col("script")]).orderBy(by, F.desc("n_nodes"), "script")


def unsupported(nodes: DataFrame) -> DataFrame:
    """``page_id, n_nodes, samples``: nodes with text of no known script, and up to five distinct samples in page order.

    Samples are aggregated as their first place first, so no task gathers a page's texts.
    """
    if "signs" in nodes.columns:
        return unsupported_of(nodes.select("page_id", "node_ord", F.col("signs.unknown").alias("unknown")))
    runs = F.filter("script_runs", lambda r: r["script"] == "unknown")
    texts = F.transform(runs, lambda r: F.substring(trimmed(r["text"]), 1, SAMPLE_LENGTH))
    return unsupported_of(nodes.select("page_id", "node_ord", F.when(F.size(runs) > 0, texts).alias("unknown")))


def unsupported_of(nodes: DataFrame) -> DataFrame:
    """The same from ``page_id, node_ord, unknown``: a node's samples in order, null without such text."""
    own = nodes.where("unknown IS NOT NULL").select("page_id", "node_ord", F.posexplode_outer("unknown").alias("run_ord", "sample"))
    counts = own.groupBy("page_id").agg(F.count_distinct("node_ord").alias("n_nodes"))
    samples = own.where("sample <> ''")
    first = samples.groupBy("page_id", "sample").agg(F.min(F.struct("node_ord", "run_ord")).alias("at"))
    best = first.groupBy("page_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "sample"))), 1, SAMPLES).alias("s"))
    return counts.join(best, "page_id", "left").select("page_id", "n_nodes", F.coalesce(F.transform("s", lambda x: x["sample"]), F.array().cast("array<string>")).alias("samples"))


def severity_counts(rows: DataFrame, grade: str = "severity", by: str = "page_id") -> DataFrame:
    """``<by>``, a count for each severity, ``ungraded`` and ``total``."""
    return rows.groupBy(by).agg(*[F.count_if(F.col(grade) == s).alias(s) for s in SEVERITIES], F.count_if(F.col(grade).isNull()).alias("ungraded"), F.count("*").alias("total"))


def standard_section(rows: DataFrame) -> DataFrame:
    """Third-party findings, worst first, ungraded last: ``page_id, id, impact, n_elements``."""
    out = rows.select("page_id", "id", "impact", F.size("nodes").cast("long").alias("n_elements"))
    return out.orderBy("page_id", F.coalesce(rank(F.col("impact")), F.lit(len(SEVERITIES))), "id")


def script_aware_section(rows: DataFrame) -> DataFrame:
    """Findings by rule: worst severity, scripts, elements; titles and limits from the rules, else from the finding."""
    first = F.min_by(F.struct("title", "wcag_ref", "confidence"), F.struct(rank(F.col("severity")), "selector", "snippet", "node_ord"))
    grouped = rows.groupBy("page_id", "rule_id").agg(F.min(rank(F.col("severity"))).alias("worst"), F.array_sort(F.collect_set("script")).alias("scripts"), F.count("*").alias("n_elements"), first.alias("first"))
    known = F.broadcast(rules_table(rows.sparkSession).select("rule_id", F.col("title").alias("rule_title"), F.col("wcag_ref").alias("rule_wcag"), "limitations"))
    return (
        grouped.join(known, "rule_id", "left")
        .select(
            "page_id",
            "rule_id",
            F.coalesce("rule_title", "first.title").alias("title"),
            severity_of(F.col("worst")).alias("severity"),
            F.col("first.confidence").alias("confidence"),
            "scripts",
            "n_elements",
            F.coalesce("first.wcag_ref", "rule_wcag").alias("wcag_ref"),
            F.coalesce("limitations", F.lit("")).alias("limitations"),
        )
        .orderBy("page_id", rank(F.col("severity")), "rule_id")
    )


def has_heuristic(rows: DataFrame) -> DataFrame:
    return rows.groupBy("page_id").agg(F.bool_or(F.col("confidence") == "heuristic").alias("has_heuristic_findings"))


def top_per_rule(rows: DataFrame, most: int = 5) -> DataFrame:
    """The first findings of each rule of a page, and how many more there are."""
    from pyspark.sql import Window

    by = Window.partitionBy("page_id", "rule_id")
    place = F.row_number().over(by.orderBy("selector", "snippet", "node_ord"))
    return rows.withColumn("place", place).withColumn("more", F.greatest(F.count("*").over(by) - most, F.lit(0))).where(F.col("place") <= most)
