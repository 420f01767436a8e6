"""Readers with explicit schemas, and writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphaudit import schema


def snapshots(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Captured nodes (Parquet, JSON or ORC)."""
    return spark.read.schema(schema.NODES).format(fmt).load(path)


def pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return schema.checked_version(spark.read.schema(schema.PAGES).format(fmt).load(path))


def third_party(spark: SparkSession, path: str) -> DataFrame:
    """Third-party findings, one JSON object a line: known fields as columns, everything else untouched in ``raw``."""
    lines = spark.read.text(path)
    parsed = F.from_json("value", schema.STANDARD.replace("help_url", "helpUrl").replace("page_id", "pageId"))
    return lines.select(parsed.alias("v"), F.parse_json("value").alias("raw")).select(F.col("v.pageId").alias("page_id"), "v.ord", "v.id", "v.impact", "v.help", "v.description", F.col("v.helpUrl").alias("help_url"), "v.tags", "v.nodes", "raw")


def no_third_party(spark: SparkSession) -> DataFrame:
    """The table of third-party findings where none were captured."""
    return spark.createDataFrame([], schema.STANDARD + ", raw variant")


def targets(spark: SparkSession, path: str) -> DataFrame:
    """``list_ord, url, script, note, note_fine`` of a target list, ``{"targets": [{"url", "script", "note"}, ...]}``.

    A byte-order mark is passed over. A file of another shape, or without a target, is refused.
    Members of another type than text are null; ``campaign.target_errors`` says what is wrong.
    """
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"^\x{FEFF}", "").alias("value"))
    parsed = text.select(F.try_parse_json("value").alias("v"))
    listed = F.try_variant_get("v", "$.targets", "array<variant>")
    refused = lambda why: F.raise_error(F.lit(why)).cast("array<variant>")
    fine = (
        F.when(F.col("v").isNull(), refused("the targets file is not valid JSON"))
        .when(listed.isNull(), refused('the targets file must have a "targets" array'))
        .when(F.size(listed) == 0, refused("the targets file lists no targets"))
        .otherwise(listed)
    )
    rows = parsed.select(fine.alias("t")).select(F.posexplode("t").alias("list_ord", "t"))
    kind = lambda name: F.schema_of_variant(F.try_variant_get("t", f"$.{name}", "variant"))
    text_of = lambda name: F.when(kind(name) == "STRING", F.try_variant_get("t", f"$.{name}", "string"))
    note = text_of("note")
    return rows.select("list_ord", text_of("url").alias("url"), text_of("script").alias("script"), F.nullif(note, F.lit("")).alias("note"), (F.coalesce(kind("note"), F.lit("STRING")) == "STRING").alias("note_fine"))


def newest(spark: SparkSession, folder: str) -> str:
    """The last stored campaign by name; a folder without a manifest isn't one."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    pattern = jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "/campaign-*/manifest/_SUCCESS")
    found = pattern.getFileSystem(jsc.hadoopConfiguration()).globStatus(pattern)
    names = [str(f.getPath().getParent().getParent().toString()) for f in found or ()]
    if not names:
        raise ValueError(f"no campaign is stored in {folder}")
    return max(names)


def save(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    rows.write.mode("overwrite").format(fmt).save(path)


def read_text(spark: SparkSession, path: str) -> str:
    """One small text file."""
    return spark.read.text(path, wholetext=True).first()["value"]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file, in whatever store the path names."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
