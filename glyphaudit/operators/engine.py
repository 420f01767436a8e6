"""Running the checks: one pass over analysed nodes, filters, order, counts of what was withheld."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from glyphaudit.dims import SEVERITIES
from glyphaudit.operators.rules import RULES, found_by


@dataclass(frozen=True)
class Filters:
    """Which findings are wanted; None: all."""

    rules: tuple[str, ...] | None = None
    disabled: tuple[str, ...] | None = None
    scripts: tuple[str, ...] | None = None
    severity: str | None = None

    def any(self) -> bool:
        return any(x is not None for x in (self.rules, self.disabled, self.scripts, self.severity))


def rank(severity: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(SEVERITIES))):
        out = F.when(severity == s, F.lit(i)).otherwise(out)
    return out


def wanted_rules(filters: Filters) -> list:
    """Disabled ids lose first, then only the listed ones stay; the rest never enters the plan."""
    return [r for r in RULES if r.id not in (filters.disabled or ()) and (filters.rules is None or r.id in filters.rules)]


def kept(filters: Filters) -> Column:
    """Condition on finding rows for the script and severity filters."""
    out = F.lit(True)
    if filters.scripts is not None:
        out = out & F.col("script").isin(*filters.scripts)
    if filters.severity is not None:
        out = out & (rank(F.col("severity")) <= SEVERITIES.index(filters.severity))
    return out


def findings(nodes: DataFrame, filters: Filters = Filters()) -> DataFrame:  # noqa: B008
    """``page_id, node_ord`` and the finding's columns; every node is read once, whatever the number of rules."""
    rules = wanted_rules(filters)
    found = found_by(nodes, rules or RULES[:1])
    return found.where(kept(filters)) if rules else found.where(F.lit(False))


def ordered(rows: DataFrame) -> DataFrame:
    """A page's findings side by side, worst first, then by rule, selector, snippet and place.

    The order is that within a page: pages are dealt out by hash, so nothing is sampled or sorted across them.
    """
    return rows.repartition("page_id").sortWithinPartitions("page_id", rank(F.col("severity")), "rule_id", "selector", "snippet", "node_ord")


def third_party_kept(filters: Filters) -> Column:
    """Condition on third-party findings ``(id, impact)``; ungraded ones always pass the severity filter."""
    out = F.lit(True)
    if filters.disabled is not None:
        out = out & ~F.col("id").isin(*filters.disabled)
    if filters.rules is not None:
        out = out & F.col("id").isin(*filters.rules)
    if filters.severity is not None:
        r = rank(F.col("impact"))
        out = out & (r.isNull() | (r <= SEVERITIES.index(filters.severity)))
    return out


def third_party(rows: DataFrame, filters: Filters) -> DataFrame:
    return rows.where(third_party_kept(filters))


def withheld(nodes: DataFrame, filters: Filters) -> DataFrame:
    """``page_id, shown, withheld``: one run of all rules, with what each filter keeps counted beside it."""
    allowed = [r.id for r in wanted_rules(filters)]
    ok = F.col("rule_id").isin(*allowed) & kept(filters) if allowed else F.lit(False)
    return findings(nodes).groupBy("page_id").agg(F.count_if(ok).alias("shown"), (F.count("*") - F.count_if(ok)).alias("withheld"))


def wanted(filters: Filters) -> Column:
    """Condition on rows of all checks' findings: what the filters keep."""
    allowed = [r.id for r in wanted_rules(filters)]
    if not allowed:
        return F.lit(False)
    chosen = F.col("rule_id").isin(*allowed) if filters.rules is not None or filters.disabled is not None else F.lit(True)
    return F.coalesce(chosen & kept(filters), F.lit(False))


def counted(found: DataFrame, filters: Filters) -> tuple[DataFrame, Observation]:
    """Findings of all checks with ``kept``, and what an observation counts as they pass: ``shown`` and ``withheld``.

    The counts come with the first action on the rows, without a pass of their own.
    """
    seen = Observation("findings")
    rows = found.withColumn("kept", wanted(filters))
    return rows.observe(seen, F.count_if("kept").alias("shown"), F.count_if(~F.col("kept")).alias("withheld")), seen


def unrecognised(spark: SparkSession, ids: Iterable[str]) -> list[str]:
    """Requested ids that no rule has, in their order, repeats included."""
    known = {r.id for r in RULES}
    return [i for i in ids if i not in known]
