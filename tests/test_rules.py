import os

import pytest
from pyspark.sql import functions as F

from glyphaudit.dims import SEVERITIES
from glyphaudit.functions.scripts import analysed, dominant, is_vietnamese, snippet, with_snippet
from glyphaudit.operators import engine, page_reports, pages
from glyphaudit.operators.engine import Filters
from glyphaudit.operators.rules import RULES, signs_by_runs
from glyphaudit.plans import reports
from glyphaudit.schema import NODES

ARABIC = "مرحبا بالعالم كيف الحال"
PLAIN = {
    "page_id": "p", "node_ord": 0, "selector": "#x", "text": "hello world", "own_lang": None, "inherited_lang": None, "own_dir": None, "inherited_dir": None, "computed_direction": "ltr", "ancestor_has_dir_rtl": False,
    "css": {"letterSpacing": "normal", "lineHeight": "normal", "fontSize": "16px", "textAlign": "start", "textTransform": "none", "transform": "none", "wordBreak": "normal", "hyphens": "manual", "overflowX": "visible", "overflowY": "visible", "webkitLineClamp": "none", "clip": "auto", "clipPath": "none"},
    "box": {"clientHeight": 18, "scrollHeight": 18, "clientWidth": 1264, "scrollWidth": 1264}, "font_probe": {"declaredStack": ["Arial"], "renderedFamily": "Arial", "fallbackSuspected": False},
    "class_names": [], "tag_name": "P", "has_bdi_ancestor": False, "has_code_ancestor": False, "has_transformed_ancestor": False, "unicode_bidi": "isolate",
}
RTL = {"text": ARABIC, "own_dir": "rtl", "computed_direction": "rtl"}
HIDDEN = {"clip": "rect(1px, 1px, 1px, 1px)", "overflowY": "hidden"}
#: (rule that fires or None, changes to the plain node, changes to its css, changes to its box)
CASES = [
    (None, {}, {}, {}),
    ("cursive-script-letter-spacing", RTL, {"letterSpacing": "2px"}, {}),
    ("cursive-script-letter-spacing", RTL, {"letterSpacing": "-0.01px"}, {}),
    (None, RTL, {"letterSpacing": "0.005px"}, {}),
    (None, {}, {"letterSpacing": "2px"}, {}),
    ("insufficient-line-height-for-script", {}, {"lineHeight": "20px"}, {"clientHeight": 32}),
    (None, {}, {"lineHeight": "24px"}, {"clientHeight": 32}),
    (None, {"tag_name": "BUTTON"}, {"lineHeight": "20px"}, {"clientHeight": 32}),
    ("insufficient-line-height-for-script", {"text": "กขคง"}, {"lineHeight": "25px"}, {"clientHeight": 40}),
    ("missing-script-font-coverage", RTL | {"font_probe": {"declaredStack": [], "renderedFamily": None, "fallbackSuspected": True}}, {}, {}),
    ("case-transform-on-caseless-script", RTL, {"textTransform": "Uppercase "}, {}),
    (None, {}, {"textTransform": "uppercase"}, {}),
    ("missing-dir-attribute", RTL | {"own_dir": None}, {}, {}),
    (None, RTL | {"own_dir": ""}, {}, {}),
    ("lang-script-mismatch", RTL | {"own_lang": "en"}, {}, {}),
    (None, RTL | {"own_lang": "", "inherited_lang": "en"}, {}, {}),
    (None, RTL | {"own_lang": "en", "has_code_ancestor": True}, {}, {}),
    ("physical-css-in-bidi-context", RTL, {"textAlign": "left"}, {}),
    ("physical-css-in-bidi-context", {"computed_direction": "rtl", "text": "12"}, {"textAlign": "right"}, {}),
    ("unisolated-bidi-run", RTL | {"text": ARABIC + " (abc) " + ARABIC}, {}, {}),
    ("unisolated-bidi-run", RTL | {"text": ARABIC + " 12,5 " + ARABIC}, {}, {}),
    (None, RTL | {"text": ARABIC + " abc " + ARABIC}, {}, {}),
    (None, RTL | {"text": ARABIC + " (a) " + ARABIC}, {}, {}),
    (None, RTL | {"text": ARABIC + " (abc)"}, {}, {}),
    (None, RTL | {"text": ARABIC + " (abc) " + ARABIC, "has_bdi_ancestor": True}, {}, {}),
    (None, RTL | {"text": ARABIC + " ⁨(abc)⁩ " + ARABIC}, {}, {}),
    ("unmirrored-directional-icon", RTL | {"text": ARABIC + " →"}, {}, {}),
    ("unmirrored-directional-icon", RTL | {"class_names": ["x", "Chevron-left"]}, {}, {}),
    (None, RTL | {"text": ARABIC + " →"}, {"transform": "matrix(-1, 0, 0, 1, 0, 0)"}, {}),
    (None, RTL | {"text": ARABIC + " →", "has_transformed_ancestor": True}, {}, {}),
    ("unsafe-word-break-for-script", RTL, {"hyphens": "auto"}, {}),
    ("unsafe-word-break-for-script", {"text": "กขคง"}, {"wordBreak": "break-all"}, {}),
    (None, {"text": "กขคง"}, {"hyphens": "auto"}, {}),
    ("unsafe-word-break-for-script", {"text": "漢字"}, {"hyphens": "auto"}, {}),
    ("clipped-stacked-marks", {"text": "नमस"}, {"overflowY": "hidden"}, {"scrollHeight": 20}),
    ("clipped-stacked-marks", {"text": "Phở ạ"}, {"overflowY": "clip"}, {"scrollHeight": 20}),
    (None, {"text": "नमस"}, {"overflowY": "hidden"}, {"scrollHeight": 19}),
    (None, {"text": "नमस"}, HIDDEN, {"clientHeight": 1, "scrollHeight": 20, "clientWidth": 1}),
    (None, {"text": "plain"}, {"overflowY": "hidden"}, {"scrollHeight": 30}),
]


@pytest.fixture(scope="module")
def nodes(spark):
    rows = []
    for i, (_, change, css, box) in enumerate(CASES):
        row = PLAIN | change | {"node_ord": i}
        row["css"], row["box"] = PLAIN["css"] | css, PLAIN["box"] | box
        rows.append(row)
    return analysed(spark.createDataFrame(rows, NODES)).cache()


def test_each_rule(nodes):
    got = {}
    for r in engine.findings(nodes).collect():
        got.setdefault(r["node_ord"], []).append(r)
    for i, (rule, change, *_) in enumerate(CASES):
        found = [r["rule_id"] for r in got.get(i, [])]
        assert found == ([rule] if rule else []), (i, change)
        for r in got.get(i, []):
            assert r["what_is_wrong"] and r["why_it_matters"] and r["how_to_fix"] and r["source"] == "script_aware"


def test_wcag_reference_only_below_its_figure(nodes):
    got = {r["node_ord"]: r["wcag_ref"] for r in engine.findings(nodes, Filters(rules=("insufficient-line-height-for-script",))).collect()}
    assert set(got.values()) == {"1.4.8", None}


def test_filters(nodes):
    every = engine.findings(nodes).count()
    only = engine.findings(nodes, Filters(rules=(RULES[0].id, RULES[4].id), disabled=(RULES[0].id,))).collect()
    assert {r["rule_id"] for r in only} == {RULES[4].id}
    assert engine.findings(nodes, Filters(rules=())).count() == 0
    shown = engine.findings(nodes, Filters(severity="serious", scripts=("arabic",))).count()
    counts = engine.withheld(nodes, Filters(severity="serious", scripts=("arabic",))).first()
    assert (counts["shown"], counts["withheld"]) == (shown, every - shown)
    assert engine.unrecognised(nodes.sparkSession, ["nope", RULES[0].id, "nope"]) == ["nope", "nope"]
    assert Filters(rules=()).any() and not Filters().any()


def test_every_rule_and_pair_on_structs_built_in_the_plan(spark):
    """css and box made by the same plan that checks them: no rule may depend on which fields others read."""
    wide, box = sorted(PLAIN["css"]), sorted(PLAIN["box"])
    rows = []
    for i, (_, change, css, sizes) in enumerate(CASES):
        node = PLAIN | change
        rows.append((i, node["text"], node["own_dir"], node["own_lang"], node["computed_direction"], *[(PLAIN["css"] | css)[c] for c in wide], *[(PLAIN["box"] | sizes)[c] for c in box]))
    names = ["node_ord", "text", "own_dir", "own_lang", "computed_direction", *wide, *box]
    kinds = ["int", "string", "string", "string", "string", *["string"] * len(wide), *["int"] * len(box)]
    flat = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    rest = {"page_id": "'p'", "selector": "'#x'", "inherited_lang": "CAST(NULL AS STRING)", "inherited_dir": "CAST(NULL AS STRING)", "class_names": "array()", "tag_name": "'P'", "has_bdi_ancestor": "false", "has_code_ancestor": "false", "has_transformed_ancestor": "false"}
    made = analysed(
        flat.select(
            "node_ord", "text", "own_dir", "own_lang", "computed_direction", *[F.expr(v).alias(k) for k, v in rest.items()], F.struct(*wide).alias("css"), F.struct(*box).alias("box"),
            F.struct(F.array(F.lit("Arial")).alias("declaredStack"), F.lit(False).alias("fallbackSuspected")).alias("font_probe"),
        )
    )
    every = {}
    for r in engine.findings(made).collect():
        every.setdefault(r["rule_id"], set()).add((r["node_ord"], r["what_is_wrong"]))
    assert len(every) >= 9
    ids = [r.id for r in RULES]
    for wanted in [(a,) for a in ids] + [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (i + ids.index(b)) % 5 == 0 or "clipped-stacked-marks" in (a, b)]:
        got = {}
        for r in engine.findings(made, Filters(rules=wanted)).select("node_ord", "rule_id", "what_is_wrong").collect():
            got.setdefault(r["rule_id"], set()).add((r["node_ord"], r["what_is_wrong"]))
        assert got == {k: v for k, v in every.items() if k in wanted}, wanted


def test_order_within_pages_is_of_the_data_alone(nodes):
    def by_page(df):
        out = {}
        for r in engine.ordered(engine.findings(df)).collect():
            out.setdefault(r["page_id"], []).append(r)
        return out

    two = nodes.union(nodes.withColumn("page_id", F.lit("q")))
    a, b = by_page(two), by_page(two.repartition(3))
    assert a == b and len(a) == 2
    levels = [SEVERITIES.index(r["severity"]) for r in a["p"]]
    assert levels == sorted(levels) and len(set(levels)) > 2


def test_sections(nodes):
    rows = engine.findings(nodes)
    section = pages.script_aware_section(rows).collect()
    assert sum(r["n_elements"] for r in section) == rows.count()
    counts = pages.severity_counts(rows).first()
    assert counts["total"] == rows.count() and counts["ungraded"] == 0
    assert pages.has_heuristic(rows).first()["has_heuristic_findings"]
    tally = pages.tally_list(pages.script_tally(nodes)).collect()
    assert [r["n_nodes"] for r in tally] == sorted((r["n_nodes"] for r in tally), reverse=True)


def test_a_check_looks_at_no_text_that_it_cannot_concern(spark):
    """Conditions on the node go below the analysis, and runs of texts aren't made where no check reads them."""
    nodes = analysed(spark.createDataFrame([PLAIN], NODES))
    plan = engine.findings(nodes, Filters(rules=("missing-script-font-coverage",)))._jdf.queryExecution().executedPlan().toString()
    assert "signs_by_ranges" in plan and "analysis_by_ranges" not in plan
    assert "fallbackSuspected" in plan[plan.index("signs_by_ranges") :].split("Filter", 1)[1]
    assert "analysis_by_ranges" not in engine.findings(nodes)._jdf.queryExecution().executedPlan().toString()


def test_signs_are_those_of_runs(spark):
    """What the Arrow pass says of a text is what its runs and census say, for texts with and without clusters of several code points."""
    import random

    draw = random.Random(5)
    parts = ["مرحبا", "שלום", "abc", "a", "é", "ă", "→", "«", " ", "12", "(", ")", ".", ", ", "漢字", "กขค", "আমি", "\n", "\U0001f600", "ܐܒ", "é", "नमस्ते"]
    texts = [None, "", " ", *["".join(draw.choices(parts[:-2] if i % 4 else parts, k=draw.randint(1, 14))) for i in range(1200)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(3)
    got = analysed(df).select("*", F.struct(*[v.alias(k) for k, v in signs_by_runs(F.col("text"), F.col("script_runs"), F.col("census"), dominant(F.col("census"))).items()]).alias("want"), dominant(F.col("census")).alias("d"), is_vietnamese(F.col("text")).alias("v")).collect()
    assert sum(r["want"]["bidi_run"] is not None for r in got) > 10
    for r in got:
        assert (r["signs"], r["dominant_script"], r["is_vietnamese_profile"]) == (r["want"], r["d"], r["v"]), r["text"]


def test_snippets_by_a_beginning(spark):
    """The same as of whole texts, at the lengths where a beginning is no longer enough."""
    long = ["a" * 61, " " * 200 + "b" * 80, ("x" + " " * 9) * 40, "é" * 70, "a" * 60 + "́" * 120 + "b", "a" * 61 + " " * 120, "c" * 59 + " " * 300, "c" * 59 + " " * 300 + "d", "\U0001f1e6\U0001f1e7" * 50, " \t\n" * 90, "", None, "k " * 300]
    df = with_snippet(spark.createDataFrame([(t,) for t in long], "text string"), "s").select("text", "s", snippet(F.col("text")).alias("w"))
    for r in df.collect():
        assert r["s"] == r["w"], r["text"]


def test_facts_are_made_once_and_give_all_parts_of_reports(spark, nodes):
    """One pass over nodes, however many parts of a report read it; the parts are those made from nodes one by one."""
    filters = Filters(severity="serious")
    made = page_reports.facts(analysed(spark.createDataFrame([PLAIN], NODES)), filters)
    assert made._jdf.queryExecution().executedPlan().toString().count("signs_by_ranges(") == 1
    two = nodes.union(nodes.withColumn("page_id", F.lit("q")).withColumn("text", F.lit("আমি b")).withColumn("signs", F.col("signs").withField("unknown", F.array(F.lit("আমি")))))
    found, tally, strange = page_reports.parts(page_reports.facts(two, filters).cache())
    assert sorted(found.where(engine.wanted(filters)).collect()) == sorted(engine.findings(two, filters).collect())
    assert sorted(found.select("page_id", "node_ord", "rule_id").collect()) == sorted(engine.findings(two).select("page_id", "node_ord", "rule_id").collect())
    assert sorted(tally.collect()) == sorted(pages.script_tally(two).collect())
    assert strange.collect() == pages.unsupported(two).collect() and strange.count() == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_report_documents_analyse_no_text_twice(spark):
    plan = reports.page_report_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "by_ranges" not in plan
