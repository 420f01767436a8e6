"""Explicit schemas of the input and output tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNAPSHOT_VERSION = 4

_CSS = "letterSpacing lineHeight fontSize fontFamily textAlign textTransform direction writingMode transform wordBreak overflowWrap hyphens overflowX overflowY height webkitLineClamp clip clipPath marginLeft marginRight paddingLeft paddingRight"
CSS = T.StructType([T.StructField(c, T.StringType()) for c in _CSS.split()])
BOX = T.StructType([T.StructField(c, T.IntegerType()) for c in ("clientHeight", "scrollHeight", "clientWidth", "scrollWidth")])
FONT = T.StructType([T.StructField("declaredStack", T.ArrayType(T.StringType())), T.StructField("renderedFamily", T.StringType()), T.StructField("fallbackSuspected", T.BooleanType())])

#: What a capture delivers; script columns are added by ``functions.scripts.analysed``.
NODES = T.StructType(
    [
        T.StructField("page_id", T.StringType(), False),
        T.StructField("node_ord", T.IntegerType(), False),
        T.StructField("selector", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("own_lang", T.StringType()),
        T.StructField("inherited_lang", T.StringType()),
        T.StructField("own_dir", T.StringType()),
        T.StructField("inherited_dir", T.StringType()),
        T.StructField("computed_direction", T.StringType()),
        T.StructField("ancestor_has_dir_rtl", T.BooleanType()),
        T.StructField("css", CSS),
        T.StructField("box", BOX),
        T.StructField("font_probe", FONT),
        T.StructField("class_names", T.ArrayType(T.StringType())),
        T.StructField("tag_name", T.StringType()),
        T.StructField("has_bdi_ancestor", T.BooleanType()),
        T.StructField("has_code_ancestor", T.BooleanType()),
        T.StructField("has_transformed_ancestor", T.BooleanType()),
        T.StructField("unicode_bidi", T.StringType()),
    ]
)

PAGES = "page_id string, snapshot_version int, url string, final_url string, captured_at string, viewport struct<width int, height int>, document_lang string, document_dir string, truncated boolean, error struct<kind string, message string, detail string>, duration_ms bigint"
STANDARD = "page_id string, ord int, id string, impact string, help string, description string, help_url string, tags array<string>, nodes array<struct<html string, target string>>"
SITES = (
    "list_ord int, url string, final_url string, target_group string, note string, status string, started_at string, duration_ms bigint, reason string, detail string,"
    " standard array<struct<id string, help string, impact string, n_nodes int>>, passes bigint,"
    " script_aware array<struct<rule_id string, title string, severity string, confidence string, script string>>,"
    " scripts_detected map<string, bigint>, unsupported struct<nodeCount bigint, samples array<string>>, gave_up boolean"
)
MISMATCHES = "list_ord int, url string, target_group string, detected array<string>"
_ISSUE = "rule_id string, title string, severity string, {}n_sites bigint, n_elements bigint, percent_of_sites double, source string"
MANIFEST = (
    "campaign_version int, started_at string, finished_at string, user_agent string, delay_ms bigint, site_timeout_ms bigint, abandoned_scans bigint,"
    " target_list struct<path string, available bigint, attempted bigint>, aggregate struct<"
    "targets bigint, percentages_are_out_of bigint, outcomes array<struct<status string, n_sites bigint>>,"
    " layers array<struct<layer string, n_sites bigint, n_rules bigint, n_elements bigint, n_passes bigint>>,"
    f" issues_standard array<struct<{_ISSUE.format('')}>>, issues_script_aware array<struct<{_ISSUE.format('confidence string, ')}>>,"
    " by_group array<struct<target_group string, listed bigint, scanned bigint, standard_sites bigint, standard_elements bigint, script_aware_sites bigint, script_aware_elements bigint>>,"
    " by_detected_script array<struct<script string, label string, n_sites bigint, n_findings bigint>>,"
    " measures array<struct<by string, name string, n_sites bigint, n_elements bigint, n_certain bigint>>,"
    " measured struct<n_scanned bigint, n_mismatched bigint, n_measured bigint>,"
    " caveats struct<flagship_sites bigint, flagship_elements bigint, first_rule string, first_confidence string, second_rule string, second_confidence string, total bigint, high_confidence bigint, top_two bigint, top_two_percent double>>"
)
TARGETS = "list_ord int, url string, script string, note string"
ROBOTS_FETCH = "url string, http_status int, body string, error string"


def parsed(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def shaped(value: Column, kind: T.DataType) -> Column:
    """A value in the shape of a type, nested fields taken by name."""
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[shaped(value.getField(f.name), f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: shaped(x, kind.elementType))
    return value.cast(kind)


def checked_version(pages: DataFrame) -> DataFrame:
    """``pages`` whose rows raise when they are of another snapshot version."""
    wrong = F.concat(F.lit(f"snapshot_version must be {SNAPSHOT_VERSION}, not "), F.coalesce(F.col("snapshot_version").cast("string"), F.lit("null")))
    fine = F.coalesce(F.col("snapshot_version") == SNAPSHOT_VERSION, F.lit(False))
    return pages.withColumn("snapshot_version", F.when(fine, F.col("snapshot_version")).otherwise(F.raise_error(wrong).cast("int")))
