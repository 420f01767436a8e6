"""Snapshots as a stream. All checks read one row at a time, so they run on a stream as they are.

This goes beyond one-shot scans: new captures are checked as they arrive, and tallies are kept by
time window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphaudit.functions.scripts import analysed
from glyphaudit.operators.engine import Filters, findings
from glyphaudit.schema import NODES


def node_stream(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(NODES).format(fmt).load(path)


def finding_stream(nodes: DataFrame, filters: Filters = Filters()) -> DataFrame:  # noqa: B008
    """Findings of arriving nodes; append mode, no state."""
    return findings(analysed(nodes), filters)


def tally_stream(nodes: DataFrame, time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Nodes by script and time window; nodes later than ``late`` are left out of closed windows."""
    by = F.window(time, window)
    return analysed(nodes).withWatermark(time, late).groupBy(by.alias("w"), "dominant_script").agg(F.count("*").alias("n_nodes")).select(F.col("w.start").alias("start"), "dominant_script", "n_nodes")
