"""A campaign's document at any size: a folder of site records, one a line, with a manifest of one row beside them.

``sites`` and ``mismatches`` are JSON lines in as many files as there are partitions; ``manifest``
has the run's fields and the aggregate, whose lists hold a row for each rule, script or group.
Nothing that grows with the number of sites goes through one row or the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphaudit import schema
from glyphaudit.operators import campaign, records

USER_AGENT = "GlyphAudit"
DELAY_MS = 2000


@dataclass(frozen=True)
class Run:
    """What a run was asked to do."""

    path: str
    available: int
    user_agent: str = USER_AGENT
    delay_ms: int = DELAY_MS
    timeout_ms: int = records.SITE_TIMEOUT_MS


def _iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def run_fields(sites: DataFrame, run: Run) -> DataFrame:
    """One row: when the run began and ended by its records, how it was set, scans that were left running."""
    begun = F.try_to_timestamp("started_at")
    ended = F.timestamp_millis(F.unix_millis(begun) + F.coalesce("duration_ms", F.lit(0)))
    return sites.agg(
        F.lit(records.CAMPAIGN_VERSION).alias("campaign_version"),
        _iso(F.min(begun)).alias("started_at"),
        _iso(F.max(ended)).alias("finished_at"),
        F.lit(run.user_agent).alias("user_agent"),
        F.lit(run.delay_ms).cast("long").alias("delay_ms"),
        F.lit(run.timeout_ms).cast("long").alias("site_timeout_ms"),
        F.count_if("gave_up").alias("abandoned_scans"),
        F.struct(F.lit(run.path).alias("path"), F.lit(run.available).cast("long").alias("available"), F.count("*").alias("attempted")).alias("target_list"),
    )


def manifest(sites: DataFrame, run: Run) -> DataFrame:
    """One row of schema ``MANIFEST``."""
    totals = records.aggregate(sites)
    whole = run_fields(sites, run).crossJoin(totals.select(F.struct(*totals.columns).alias("aggregate")))  # one row each
    return whole.select(*[schema.shaped(F.col(f.name), f.dataType).alias(f.name) for f in schema.parsed(schema.MANIFEST)])


def write(sites: DataFrame, run: Run, folder: str) -> None:
    """Writes records first; mismatches and the manifest are counted from what was written, and the manifest comes last."""
    spark = sites.sparkSession
    sites.write.mode("overwrite").json(f"{folder}/sites")
    stored = spark.read.schema(schema.SITES).json(f"{folder}/sites")
    campaign.label_mismatches(stored, campaign.detected_rows(stored)).write.mode("overwrite").json(f"{folder}/mismatches")
    manifest(stored, run).write.mode("overwrite").json(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manifest, records and mismatches of a stored document; refuses one of another version or without an aggregate."""
    found = spark.read.schema(schema.MANIFEST).json(f"{folder}/manifest")
    held = found.select("campaign_version", F.col("aggregate").isNotNull().alias("whole")).take(2)
    if len(held) != 1:
        raise ValueError(f"{folder} has {len(held)} manifests, not one")
    if held[0]["campaign_version"] != records.CAMPAIGN_VERSION:
        raise ValueError(f"{folder} is of version {held[0]['campaign_version']}, not {records.CAMPAIGN_VERSION}")
    if not held[0]["whole"]:
        raise ValueError(f"{folder} has no aggregate, so there is nothing to show")
    return found, spark.read.schema(schema.SITES).json(f"{folder}/sites"), spark.read.schema(schema.MISMATCHES).json(f"{folder}/mismatches")
