import json

import pytest

from pyspark.sql import functions as F

from glyphaudit import report, schema
from glyphaudit.__main__ import main
from glyphaudit.functions.scripts import analysed
from glyphaudit.operators import campaign, documents, engine, page_reports, pages, records, robots
from glyphaudit.schema import NODES
from glyphaudit.sources import files

ARABIC = "مرحبا بالعالم كيف الحال"
SITES = ["https://a.example/", "https://b.example/", "https://c.example/", "https://d.example/", "https://e.example/"]


def captured(spark):
    """One site with findings of both layers, one that failed, one disallowed, one without an answer, one that ran out of time."""
    node = {"page_id": "1", "node_ord": 0, "selector": "#x", "text": ARABIC, "own_dir": "rtl", "computed_direction": "rtl", "own_lang": "en", "css": {"letterSpacing": "2px"}, "box": {}, "font_probe": {}, "class_names": [], "tag_name": "P", "has_bdi_ancestor": False, "has_code_ancestor": False, "has_transformed_ancestor": False}
    nodes = spark.createDataFrame([{f.name: None for f in NODES} | n for n in (node, node | {"node_ord": 1, "text": "abc", "own_lang": None, "own_dir": None, "computed_direction": "ltr"}, node | {"node_ord": 2, "text": "বাংলা", "own_lang": None, "css": {}})], NODES)
    scans = spark.createDataFrame(
        [("1", SITES[0], SITES[0] + "home", "t", 12, None, 7), ("2", SITES[1], None, "t", 3, ("timeout", "It took too long.", "Timeout"), 0)],
        "page_id string, url string, final_url string, captured_at string, duration_ms bigint, error struct<kind string, message string, detail string>, passes bigint",
    )
    fetched = spark.createDataFrame([(SITES[0], 404, None, None), (SITES[1], 200, "", None), (SITES[2], 200, "User-agent: *\nDisallow: /", None), (SITES[3], None, None, "no answer"), (SITES[4], 200, "", None)], "url string, http_status int, body string, error string")
    standard = spark.createDataFrame([("1", 0, "b", "minor", "Help b", ["n"]), ("1", 1, "c", None, "Help c", ["n"] * 3), ("1", 2, "a", "critical", "Help a", ["n", "n"])], "page_id string, ord int, id string, impact string, help string, nodes array<string>")
    return nodes, scans, fetched, standard


@pytest.fixture(scope="module")
def tables(spark):
    nodes, scans, fetched, standard = captured(spark)
    checked = analysed(nodes).cache()
    return scans, fetched, standard, engine.findings(checked).cache(), pages.script_tally(checked), pages.unsupported(checked)


def test_records_and_document(spark, tables):
    scans, fetched, standard, findings, tally, strange = tables
    targets = spark.createDataFrame([(i, u, "thai" if i else "arabic", "n" if i == 0 else None) for i, u in enumerate(SITES)], "list_ord int, url string, script string, note string")
    sites = records.site_records(targets, robots.decisions(fetched), fetched, scans, standard, findings, tally, strange)
    rows = sites.collect()
    assert [(r["status"], r["reason"], r["detail"]) for r in rows] == [
        ("scanned", None, None),
        ("failed", "It took too long.", "Timeout"),
        ("disallowed", robots.REASONS["robots-disallows"], None),
        ("skipped", robots.REASONS["robots-unreachable"], "no answer"),
        ("failed", "no result came in 60000 ms, so the site was left", None),
    ]
    first = rows[0]
    assert (first["final_url"], first["note"], first["passes"], first["scripts_detected"]) == (SITES[0] + "home", "n", 7, {"arabic": 1, "latin": 1, "unknown": 1})
    assert [s["id"] for s in first["standard"]] == ["b", "c", "a"] and {s["rule_id"] for s in first["script_aware"]} == {"cursive-script-letter-spacing", "lang-script-mismatch"}
    assert first["unsupported"]["samples"] == ["বাংলা"] and all(r["standard"] is None and r["passes"] is None for r in rows[1:])
    a = records.aggregate(sites).first().asDict(recursive=True)
    assert (a["targets"], a["percentages_are_out_of"]) == (5, 1)
    assert [(o["status"], o["n_sites"]) for o in a["outcomes"]] == [("scanned", 1), ("disallowed", 1), ("skipped", 1), ("failed", 2)]
    assert [i["rule_id"] for i in a["issues_standard"]] == ["c", "a", "b"] and a["measured"] == {"n_scanned": 1, "n_mismatched": 0, "n_measured": 1}
    assert {x["layer"]: x["n_elements"] for x in a["layers"]} == {"standard": 6, "script_aware": 2}
    assert [(g["target_group"], g["listed"], g["script_aware_elements"]) for g in a["by_group"]] == [("arabic", 1, 2), ("thai", 4, 0)]
    assert [(r["outcome"], r["standard"], r["script_aware"]) for r in records.site_rows(sites).orderBy("list_ord").collect()] == [("scanned", "3", "2"), ("failed", "—", "—"), ("disallowed by robots.txt", "—", "—"), ("skipped", "—", "—"), ("failed", "—", "—")]
    shown = records.issue_rows(campaign.script_aware_issues(sites, campaign.script_aware_rows(sites)), 1).orderBy("rule_id").first()
    assert tuple(shown) == ("cursive-script-letter-spacing", "1 of 1", "100%", 1, "critical · high")
    assert [(m["by"], m["name"], m["n_sites"], m["n_elements"], m["n_certain"]) for m in a["measures"]] == [("rule_id", "cursive-script-letter-spacing", 1, 1, 1), ("rule_id", "lang-script-mismatch", 1, 1, 0), ("script", "arabic", 1, 2, 1), ("target_group", "arabic", 1, 2, 1), ("all", None, 1, 2, 1)]


def test_document_is_written_and_read_back(spark, tables, tmp_path):
    scans, fetched, standard, findings, tally, strange = tables
    targets = spark.createDataFrame([(i, u, "thai" if i else "hebrew", None) for i, u in enumerate(SITES)], "list_ord int, url string, script string, note string")
    scans = scans.withColumn("captured_at", F.lit("2024-01-02T03:04:05.000Z"))
    sites = records.site_records(targets, robots.decisions(fetched), fetched, scans, standard, findings, tally, strange)
    folder = f"{tmp_path}/campaign-2024-01-02"
    documents.write(sites, documents.Run("list.json", 9), folder)
    assert files.newest(spark, str(tmp_path)).endswith("/campaign-2024-01-02")
    held, rows, mismatches = documents.read(spark, folder)
    stored = held.first().asDict(recursive=True)
    assert {k: stored[k] for k in ("campaign_version", "started_at", "finished_at", "user_agent", "delay_ms", "site_timeout_ms", "abandoned_scans", "target_list")} == {
        "campaign_version": 1, "started_at": "2024-01-02T03:04:05.000Z", "finished_at": "2024-01-02T03:04:05.012Z", "user_agent": "GlyphAudit", "delay_ms": 2000, "site_timeout_ms": 60000, "abandoned_scans": 1, "target_list": {"path": "list.json", "available": 9, "attempted": 5}}
    as_dicts = lambda df: [r.asDict(recursive=True) for r in df.orderBy("list_ord").collect()]
    assert as_dicts(rows) == as_dicts(sites)
    assert [(r["url"], r["detected"]) for r in mismatches.collect()] == [(SITES[0], ["arabic", "latin", "unknown"])]
    page = report.campaign_html(stored, [r.asDict() for r in mismatches.collect()], "<C>")
    assert "&lt;C&gt;" in page and "cursive-script-letter-spacing" in page and "arabic, latin, unknown" in page and "1 scan given up on" in page
    block = report.metrics_block(stored)
    assert "5 of 9 listed sites were tried, 1 scanned, 0 of them in a script of their group. 1 scan ran out of time." in block and "| arabic | 1 | 2 | 1 |" in block and "Campaign of 2024-01-02" in block
    assert "**Two units.**" in block and "cursive-script-letter-spacing (high) and lang-script-mismatch (medium)" in block
    line = json.loads(held.toJSON().first())
    for change, why in (({"campaign_version": 2}, "version 2"), ({"aggregate": None}, "no aggregate")):
        spark.createDataFrame([(json.dumps(line | change),)], "value string").write.mode("overwrite").text(f"{folder}/manifest")
        with pytest.raises(ValueError, match=why):
            documents.read(spark, folder)
    with pytest.raises(ValueError, match="no campaign is stored"):
        files.newest(spark, folder)


def test_a_large_campaign_goes_through_no_single_row(spark, tmp_path):
    """A hundred thousand records: as many lines, in several files, and a manifest of a few kilobytes."""
    n = 100_000
    kinds = {f.name: f.dataType.simpleString() for f in schema.parsed(schema.SITES)}
    given = {"list_ord": "CAST(id AS INT)", "url": "concat('https://s', id, '.example/')", "target_group": "elt(id % 2 + 1, 'thai', 'arabic')", "status": "if(id % 10 = 9, 'failed', 'scanned')", "started_at": "'2024-01-02T03:04:05.000Z'", "duration_ms": "id", "gave_up": "id % 10 = 9", "passes": "2L",
             "script_aware": "if(id % 10 < 9, array(named_struct('rule_id', concat('r', id % 3), 'title', 't', 'severity', 'minor', 'confidence', 'high', 'script', 'thai')), NULL)", "scripts_detected": "map('thai', 1L)"}
    sites = spark.range(n).selectExpr(*[f"CAST({given.get(c, 'NULL')} AS {t}) AS {c}" for c, t in kinds.items()])
    documents.write(sites, documents.Run("list.json", n), f"{tmp_path}/campaign-x")
    held, rows, mismatches = documents.read(spark, f"{tmp_path}/campaign-x")
    stored = held.first().asDict(recursive=True)
    assert stored["aggregate"]["measured"] == {"n_scanned": 90000, "n_mismatched": 40000, "n_measured": 50000} and stored["abandoned_scans"] == 10000
    assert rows.count() == n and mismatches.count() == 40000 and len(list((tmp_path / "campaign-x" / "sites").glob("part-*"))) > 1
    assert len(held.toJSON().first()) < 10_000
    assert [m["n_elements"] for m in stored["aggregate"]["measures"] if m["by"] == "all"] == [90000]


RAW = ['{"id": "b", "impact": "minor", "help": "Help b", "nodes": [{"html": "<i>", "target": ["i"]}], "unheard of": {"z": [1, null], "a": "é"}}',
       '{"id": "c", "help": "Help c", "nodes": [{}, {}, {}], "source": "theirs"}',
       '{"id": "a", "impact": "critical", "help": "Help a", "nodes": [{}, {}]}']


def third_party(spark, tmp_path):
    (tmp_path / "standard.json").write_text("\n".join('{"pageId": "1", "ord": %d, %s' % (i, x[1:]) for i, x in enumerate(RAW)))
    return files.third_party(spark, str(tmp_path / "standard.json"))


def reports(rows):
    return {r["page_id"]: json.loads(r["json"]) for r in page_reports.page_json(rows).collect()}


def test_page_reports(spark, tables, tmp_path):
    scans, _, _, findings, tally, strange = tables
    standard = third_party(spark, tmp_path)
    got = reports(page_reports.page_reports(scans, standard, findings, tally, strange))
    one, two = got["1"], got["2"]
    assert list(one) == ["tool", "reportVersion", "url", "finalUrl", "scannedAt", "durationMs", "summary", "standard", "scriptAware", "unsupportedScript", "disclaimer"]
    # Third-party objects: worst first, every field as it came, their own label if they have one.
    assert one["standard"]["findings"] == [{"pageId": "1", "ord": i, **json.loads(RAW[i])} | ({} if i == 1 else {"source": "standard"}) for i in (2, 0, 1)]
    assert one["summary"]["standard"] == {"critical": 1, "serious": 0, "moderate": 0, "minor": 1, "ungraded": 1, "total": 3, "rules": 3, "elements": 6, "passes": 7}
    assert [(f["ruleId"], f["severity"], f["source"], f["selector"], f["snippet"]) for f in one["scriptAware"]["findings"]] == [("cursive-script-letter-spacing", "critical", "script_aware", "#x", ARABIC), ("lang-script-mismatch", "serious", "script_aware", "#x", ARABIC)]
    assert [(g["ruleId"], g["elements"], g["scripts"], g["confidence"], "wcagRef" in g) for g in one["scriptAware"]["rules"]] == [("cursive-script-letter-spacing", 1, ["arabic"], "high", False), ("lang-script-mismatch", 1, ["arabic"], "medium", False)]
    assert one["summary"]["byScript"] == [{"script": "arabic", "label": "Arabic", "count": 2}] and [x["script"] for x in one["summary"]["scriptsDetected"]] == ["arabic", "latin", "unknown"]
    assert one["unsupportedScript"] == {"nodeCount": 1, "samples": ["বাংলা"]}
    assert two["standard"]["findings"] == two["scriptAware"]["findings"] == [] and two["error"]["kind"] == "timeout" and "unsupportedScript" not in two and "filters" not in two


def test_report_filters(spark, tables, tmp_path):
    scans, _, _, findings, tally, strange = tables
    standard = third_party(spark, tmp_path)
    for filters, applied, withheld, left in (
        (engine.Filters(severity="critical"), {"minSeverity": "critical"}, {"standard": 1, "scriptAware": 1}, (["a", "c"], ["cursive-script-letter-spacing"])),
        (engine.Filters(rules=("a", "lang-script-mismatch"), scripts=("thai",)), {"onlyRules": ["a", "lang-script-mismatch"], "onlyScripts": ["thai"]}, {"standard": 2, "scriptAware": 2}, (["a"], [])),
        (engine.Filters(disabled=("a", "c", "b")), {"disabledRules": ["a", "c", "b"]}, {"standard": 3, "scriptAware": 0}, ([], ["cursive-script-letter-spacing", "lang-script-mismatch"])),
    ):
        one = reports(page_reports.page_reports(scans, standard, findings, tally, strange, filters))["1"]
        assert one["filters"] == {"applied": applied, "withheld": withheld}
        assert ([f["id"] for f in one["standard"]["findings"]], [f["ruleId"] for f in one["scriptAware"]["findings"]]) == left
        assert one["summary"]["standard"]["rules"] == len(left[0]) and one["summary"]["scriptAware"]["total"] == len(left[1])
        shown = page_reports.rendered(page_reports.page_reports(scans, standard, findings, tally, strange, filters), "text").where("page_id = '1'").first()["report"]
        assert f"and {withheld['scriptAware']} of ours" in shown
    assert engine.Filters().any() is False and all(engine.Filters(**{k: v}).any() for k, v in (("rules", ()), ("disabled", ("x",)), ("scripts", ("thai",)), ("severity", "minor")))


def test_rendered_pages(spark, tables, tmp_path):
    scans, _, _, findings, tally, strange = tables
    rows = page_reports.page_reports(scans, third_party(spark, tmp_path), findings, tally, strange)
    page = {r["page_id"]: r["report"] for r in page_reports.rendered(rows, "html").collect()}
    assert "<caption>By severity</caption>" in page["1"] and "not graded" in page["1"] and "<code>#x</code>" in page["1"] and page_reports.DISCLAIMER in page["1"] and "It took too long." in page["2"]
    text = {r["page_id"]: r["report"] for r in page_reports.rendered(rows, "text").collect()}
    assert "UNGRADED  c  Help c  (3 elements)" in text["1"] and "in no supported script" in text["1"] and "No findings" in text["2"]
    counted = records.count_rows(pages.severity_counts(tables[2], "impact")).orderBy("row_ord").collect()
    assert [(r["name"], r["n"]) for r in counted] == [("critical", 1), ("serious", 0), ("moderate", 0), ("minor", 1), ("not graded", 1), ("total", 3)]


def test_counts_come_with_the_pass(tables):
    """What the observation counts equals the counts of a pass of their own."""
    found = tables[3]
    for filters in (engine.Filters(), engine.Filters(severity="critical"), engine.Filters(rules=()), engine.Filters(scripts=("thai",))):
        marked, seen = engine.counted(found, filters)
        n = marked.where("kept").count()
        assert seen.get == {"shown": n, "withheld": found.count() - n}


def test_notices():
    assert report.notices(["x"], {"n_nodes": 1, "samples": ["a", "b"]}, (1, 2)) == ["no check is called x", "1 text node in no supported script weren't checked: a | b", "filters withheld 1 third-party finding and 2 of ours"]
    assert report.notices([], None, (0, 0)) == []


def test_campaign_command(spark, tmp_path, capsys):
    nodes, scans, fetched, standard = captured(spark)
    for name, table in (("nodes", nodes), ("pages", scans), ("robots", fetched), ("standard", standard)):
        table.write.parquet(f"{tmp_path}/in/{name}")
    listed = tmp_path / "t.json"
    listed.write_text(json.dumps({"targets": [{"url": u, "script": "arabic"} for u in SITES]}))
    out = tmp_path / "out"
    run = lambda day, *more: main(["campaign", str(listed), "--captured", f"{tmp_path}/in", "--out", str(out), "--day", day, *more])
    assert run("2024-01-02") == 1
    whole = documents.read(spark, f"{out}/campaign-2024-01-02")[0].first()
    assert whole["target_list"]["attempted"] == 5 and "1 scanned" in capsys.readouterr().err
    assert run("2024-01-03", "--limit", "1", "--html") == 1 and "What these numbers don't say" in (out / "index.html").read_text()
    assert documents.read(spark, f"{out}/campaign-2024-01-03")[0].first()["target_list"].asDict() == {"path": str(listed), "available": 5, "attempted": 1}
    # A page and a README's block are made from the newest stored campaign.
    assert main(["page", str(out), f"{tmp_path}/public"]) == 0 and "1 of 5 listed sites" in (tmp_path / "public" / "index.html").read_text()
    readme = tmp_path / "README.md"
    readme.write_text(f"before {report.BEGIN} old {report.END} after")
    assert main(["metrics", str(out), str(readme)]) == 0
    assert readme.read_text().startswith("before <!--") and "1 of 5 listed sites were tried" in readme.read_text() and " old " not in readme.read_text()
    readme.write_text("no markers")
    assert main(["metrics", str(out), str(readme)]) == 2 and main(["page", f"{tmp_path}/in", str(tmp_path)]) == 2
    listed.write_text(json.dumps({"targets": [{"url": SITES[2], "script": "arabic"}]}))
    assert run("x") == 2
    listed.write_text(json.dumps([{"url": SITES[2], "script": "arabic"}]))
    assert run("x") == 3
    listed.write_text(json.dumps({"targets": [{"url": SITES[2], "script": "klingon"}]}))
    assert run("x") == 3 and "the group isn't known" in capsys.readouterr().err


def test_scan_command(spark, tmp_path, capsys):
    nodes = captured(spark)[0]
    nodes.write.parquet(f"{tmp_path}/nodes")
    assert main(["scan", f"{tmp_path}/nodes"]) == 1
    seen = capsys.readouterr()
    assert "CRITICAL  cursive-script-letter-spacing" in seen.out and "1 text node in no supported script" in seen.err
    assert main(["scan", f"{tmp_path}/nodes", "--rules", "missing-dir-attribute", "nope"]) == 0
    seen = capsys.readouterr()
    assert "no check is called nope" in seen.err and "and 2 of ours" in seen.err
    assert main(["scan", f"{tmp_path}/none"]) == 2
    third_party(spark, tmp_path)
    assert main(["scan", f"{tmp_path}/nodes", "--format", "json", "--standard", f"{tmp_path}/standard.json", "--severity", "critical"]) == 1
    one = json.loads(capsys.readouterr().out)
    assert [f["id"] for f in one["standard"]["findings"]] == ["a", "c"] and one["filters"]["withheld"] == {"standard": 1, "scriptAware": 1}
    # Many pages go to a folder, never through the driver.
    nodes.union(nodes.withColumn("page_id", F.lit("2"))).write.parquet(f"{tmp_path}/two")
    assert main(["scan", f"{tmp_path}/two"]) == 2 and "more than one page" in capsys.readouterr().err
    assert main(["scan", f"{tmp_path}/two", "--format", "html", "--out", f"{tmp_path}/o"]) == 1
    assert spark.read.parquet(f"{tmp_path}/o/findings").count() == 4 and spark.read.json(f"{tmp_path}/o/reports").where("report LIKE '<!doctype html>%'").count() == 2
