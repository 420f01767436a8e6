"""Checks and tallies on a stream against the same work on a table."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphaudit.functions.scripts import analysed
from glyphaudit.operators import engine
from glyphaudit.operators.engine import Filters
from glyphaudit.schema import NODES
from glyphaudit.streaming import snapshots

ARABIC = "مرحبا بالعالم كيف الحال"
PLAIN = {
    "page_id": "p", "node_ord": 0, "selector": "#x", "text": "hello world", "own_lang": None, "inherited_lang": None, "own_dir": None, "inherited_dir": None, "computed_direction": "ltr", "ancestor_has_dir_rtl": False,
    "css": {"letterSpacing": "normal", "lineHeight": "normal", "fontSize": "16px", "textAlign": "start", "textTransform": "none", "transform": "none", "wordBreak": "normal", "hyphens": "manual", "overflowX": "visible", "overflowY": "visible", "webkitLineClamp": "none", "clip": "auto", "clipPath": "none"},
    "box": {"clientHeight": 18, "scrollHeight": 18, "clientWidth": 1264, "scrollWidth": 1264}, "font_probe": {"declaredStack": ["Arial"], "renderedFamily": "Arial", "fallbackSuspected": False},
    "class_names": [], "tag_name": "P", "has_bdi_ancestor": False, "has_code_ancestor": False, "has_transformed_ancestor": False, "unicode_bidi": "isolate",
}


def test_tally_of_a_stream_like_a_batch(spark, tmp_path):
    """Files that arrive one by one give the tally of one table; a node behind the watermark of a closed window is left out."""
    hour = lambda h: f"2024-01-01 {h:02d}:10:00"
    rows = [[("a", "hello world", 1), ("b", ARABIC, 1)], [("c", "hello again", 2), ("d", "another text", 1)], [("e", ARABIC, 9)], [("f", "too late", 1), ("g", "in time", 9)]]
    schema = T.StructType([*NODES.fields, T.StructField("seen", T.TimestampType())])
    for k, part in enumerate(rows):
        nodes = [{**PLAIN, "page_id": page, "text": text, "seen": hour(h)} for page, text, h in part]
        batch = spark.createDataFrame([json.dumps(n, ensure_ascii=False) for n in nodes], "string").select(F.from_json("value", schema).alias("n")).select("n.*")
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "nodes"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "nodes"))
        query = snapshots.tally_stream(stream, "seen").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = {(r["start"].hour, r["dominant_script"]): r["n_nodes"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, "latin"): 2, (1, "arabic"): 1, (2, "latin"): 1}
    found = snapshots.finding_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "nodes"))).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    found.awaitTermination()
    want = engine.findings(analysed(spark.read.schema(schema).parquet(str(tmp_path / "nodes"))), Filters())
    key = lambda rows: sorted((r["page_id"], r["rule_id"]) for r in rows)
    assert key(spark.table("found").collect()) == key(want.collect()) != []
