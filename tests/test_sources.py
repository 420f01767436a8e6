import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from glyphaudit.operators import campaign, records, robots
from glyphaudit.sources import files, html, markup

PAGE = """<html lang="ar" dir="rtl"><head><title>t</title><style>p{}</style></head><body id="b"><p>one</p><p hidden>no</p>
<div lang=""><p lang="en" class="a b">two <bdi>three</bdi></p></div><pre>four</pre><script>x</script><p style="display: none">no</p></body></html>"""


def test_text_nodes():
    rows = html.nodes_of("p", PAGE)
    assert [r[3].strip() for r in rows] == ["one", "two", "three", "four"]
    assert rows[0][2] == "#b > p:nth-of-type(1)" and rows[0][5] == "ar" and rows[0][7] == "rtl" and rows[0][8]
    assert rows[1][4] == "en" and rows[1][9] == ["a", "b"]
    assert rows[2][11] and rows[3][12] and all(r[14] == "ar" for r in rows)


def test_limits():
    rows = html.nodes_of("p", "<p>a</p><p>b</p><p>c</p>", most_nodes=2, most_text=1)
    assert len(rows) == 2 and all(r[16] for r in rows)
    assert not html.nodes_of("p", "<p>a</p><p>b</p>", most_nodes=2)[0][16]
    assert html.nodes_of("p", None) == []


def test_end_tags_that_html_leaves_out():
    rows = html.nodes_of("p", "<body><p>one<p>two<div>three</div><ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>x<td>y<tr><td>z</table><dl><dt>t<dd>u<dt>v</dl><select><option>k<option>l</select>")
    paths = {r[3]: r[2].removeprefix("body > ") for r in rows}
    n = lambda *parts: " > ".join(f"{t}:nth-of-type({k})" if k else t for t, k in parts)
    assert paths["two"] == n(("p", 2)) and paths["three"] == "div"
    assert paths["b"] == n(("ul", 0), ("li", 2)) and paths["c"] == n(("ul", 0), ("li", 2), ("ul", 0), ("li", 0)) and paths["d"] == n(("ul", 0), ("li", 3))
    assert paths["y"] == n(("table", 0), ("tr", 1), ("td", 2)) and paths["z"] == n(("table", 0), ("tr", 2), ("td", 0))
    assert paths["u"] == "dl > dd" and paths["v"] == n(("dl", 0), ("dt", 2)) and paths["l"] == n(("select", 0), ("option", 2))


def test_ids_in_selectors():
    names = ["a b", "1x", "-2", "-", "é.b", "x\x01"]
    assert [html.anchor(n) for n in names] == ["#a\\ b", "#\\31 x", "#-\\32 ", "#\\-", "#é\\.b", "#x\\1 "]
    assert html.nodes_of("p", '<html><body><div id="a b"><p>x</p><p>y</p></div></body></html>')[1][2] == "#a\\ b > p:nth-of-type(2)"


ODD = [
    PAGE,
    "<body><p>one<p>two<div>three</div><ul><li>a<li>b<ul><li>c</ul><li>d</ul><br><i></i>after",
    '<html lang="fr"><body dir="RTL"><div lang=" "><code><bdi style="transform: scale(2)"><b dir="">x<span style="transform:none">y</span></b></bdi></code>&nbsp;</div><!-- c --><p>a &amp; b<br>c</p></html>tail',
    '<html><head><title>t</title></head><body hidden><p>no</p></body></html>',
    "no tags", "", None, "<p>" + "😀" * 400 + "</p>", "<div>" * 60 + "deep", "<p>a</p>" * 12,
    '<section id="s"><p id="1">x</p><h1 class=" k  l ">z</h1><p>y</p></section><pre>q</pre>',
]


def test_ancestry_equals_the_parsers_stack(spark):
    """The recursive query over the parent-pointer table finds what the parser's own stack does."""
    pages = spark.createDataFrame(list(enumerate(ODD)), "page_id int, html string")
    ours = html.text_nodes(pages, most_nodes=10)
    theirs = markup.text_rows(markup.markup(pages), most_nodes=10).select(ours.columns)
    key = lambda df: sorted(str(r.asDict()) for r in df.collect())
    assert key(theirs) == key(ours) and ours.where("truncated").count() == 10


def test_markup_in_sql(spark):
    """The table function is called laterally, beside other columns of the page."""
    markup.register(spark)
    spark.createDataFrame([("u", "<ul><li lang=en>a<li>b</ul>")], "url string, html string").createOrReplaceTempView("given_pages")
    rows = spark.sql("SELECT url, m.tag, m.parent, m.lang, m.text FROM given_pages, LATERAL page_markup(html) m ORDER BY m.ord").collect()
    assert [tuple(r) for r in rows] == [("u", "UL", None, None, None), ("u", "LI", 0, "en", None), ("u", None, 1, None, "a"), ("u", "LI", 0, None, None), ("u", None, 3, None, "b")]
    with pytest.raises(Exception, match="RECURSION_LEVEL"):
        markup.ancestry(markup.markup(spark.createDataFrame([(1, "<div>" * 9)], "page_id int, html string")), deepest=3).collect()


def test_robots_files_are_read_up_to_a_limit(spark, monkeypatch):
    monkeypatch.setattr(robots, "MOST_UNITS", 20)
    rows = [("a", "User-agent: *\nDisall"), ("b", "User-agent: *\n" + "😀" * 3), ("c", "User-agent: *\nx" + "😀" * 3)]
    got = {r["u"]: (r["t"], r["b"]) for r in spark.createDataFrame(rows, "u string, b string").select("u", robots.truncated(F.col("b")).alias("t"), robots._read(F.col("b")).alias("b")).collect()}
    assert got == {"a": (False, rows[0][1]), "b": (False, rows[1][1]), "c": (True, "User-agent: *\nx😀😀")}


def test_robots(spark):
    body = "Disallow: /early\nUser-agent: *\nDisallow: /a\nAllow: /a/b$\nCrawl-delay: x\nCrawl-delay: 4\n\nUser-agent: Mine\nUser-agent: other # c\nDisallow: /m*z\nUser-agent: *\nDisallow: /"
    rows = [(f"https://h{i}.example{p}", s, b, None) for i, (p, s, b) in enumerate([("/a/b", 200, body), ("/a/bc", 200, body), ("/early", 200, body), ("/x", 404, None), ("/x", 500, ""), ("/x", None, None), ("/q", 200, "")])]
    df = spark.createDataFrame(rows, "url string, http_status int, body string, error string")
    got = {r["url"][9:10]: (r["allowed"], r["reason"], r["crawl_delay_s"]) for r in robots.decisions(df).collect()}
    assert got["0"] == (True, "robots-allows", 4.0)
    assert got["1"] == (False, "robots-disallows", None)
    assert got["2"][0] and got["3"][1] == "no-robots-file" and got["4"][1] == got["5"][1] == "robots-unreachable" and got["6"][0]
    mine = {r["url"]: r["allowed"] for r in robots.decisions(spark.createDataFrame([("https://h.example/mooz", 200, body, None), ("https://h.example/a", 200, body, None)], df.schema), "MINE").collect()}
    assert mine == {"https://h.example/mooz": False, "https://h.example/a": True}


def test_targets(spark, tmp_path):
    def read(value, mark=""):
        path = tmp_path / "t.json"
        path.write_text(mark + (value if isinstance(value, str) else json.dumps(value)), encoding="utf-8")
        return files.targets(spark, str(path))

    listed = [{"url": "https://a.example/", "script": "thai", "note": "news"}, {"url": "https://A.example", "script": "thai"}, {"url": "x", "script": "y"}, {"url": 5, "script": "thai", "note": 7}, {"url": "https://a.example/A", "script": "thai"}, {"url": "https://a.example/a", "script": "cjk", "note": ""}, {"url": "ftp://a.example", "script": "cjk"}]
    t = read({"targets": listed}, "\ufeff")
    assert [(r["list_ord"], r["url"], r["note"]) for r in t.orderBy("list_ord").collect()][:2] == [(0, "https://a.example/", "news"), (1, "https://A.example", None)]
    problems = {(r["list_ord"], r["problem"]) for r in campaign.target_errors(t).collect()}
    assert problems == {(1, "the address is listed twice"), (2, "the address can't be read"), (2, "the group isn't known"), (3, "an address is needed"), (3, "the note is not text"), (6, "the address is neither http nor https")}
    for wrong, why in ((listed, "array"), ({"targets": []}, "no targets"), ("{", "not valid JSON"), ({"targets": {}}, "array")):
        with pytest.raises(PySparkException, match=why):
            read(wrong).collect()


def test_nested_sites(spark):
    rows = [
        (0, "u0", "thai", "scanned", 5, [("a", "A", None, 2)], [("r", "R", "minor", "high", "thai"), ("r", "R", "serious", "high", "lao")], {"thai": 3, "common": 9}),
        (1, "u1", "hebrew", "scanned", 2, [("a", "A2", "minor", 1)], [], {"latin": 3, "greek": 4}),
        (2, "u2", "thai", "failed", 2, [("a", "A2", "minor", 1)], [], {}),
    ]
    sites = spark.createDataFrame(rows, "list_ord int, url string, target_group string, status string, passes long, standard array<struct<id string, help string, impact string, n_nodes int>>, script_aware array<struct<rule_id string, title string, severity string, confidence string, script string>>, scripts_detected map<string, bigint>")
    std, own, seen = campaign.standard_rows(sites), campaign.script_aware_rows(sites), campaign.detected_rows(sites)
    a = campaign.standard_issues(sites, std).first()
    assert (a["title"], a["severity"], a["n_sites"], a["n_elements"], a["percent_of_sites"]) == ("A", "ungraded", 2, 3, 100.0)
    b = campaign.script_aware_issues(sites, own).first()
    assert (b["severity"], b["n_elements"], b["percent_of_sites"]) == ("serious", 2, 50.0)
    assert [(r["url"], r["detected"]) for r in campaign.label_mismatches(sites, seen).collect()] == [("u1", ["greek", "latin"])]
    assert campaign.measured(sites, seen).first()["n_measured"] == 1
    assert {r["status"]: r["n_sites"] for r in campaign.outcomes(sites).collect()} == {"scanned": 2, "disallowed": 0, "skipped": 0, "failed": 1}
    own_only = campaign.caveats(sites, own).first()
    assert own_only["top_two"] is None and own_only["first_rule"] == "r" and own_only["flagship_sites"] is None and own_only["total"] == own_only["high_confidence"] == 2


def test_the_two_largest_are_the_most_widespread(spark):
    """Rules are ranked by sites before elements."""
    sites = spark.createDataFrame([(i, f"u{i}", "thai", "scanned") for i in range(3)], "list_ord int, url string, target_group string, status string")
    rows = [(i, i, "wide", "W", "minor", "high", "thai") for i in range(3)] + [(0, 10 + i, "deep", "D", "minor", "medium", "thai") for i in range(9)] + [(i, 20 + i, "cursive-script-letter-spacing", "C", "critical", "high", "arabic") for i in range(2)]
    got = campaign.caveats(sites, spark.createDataFrame(rows, "list_ord int, pos int, rule_id string, title string, severity string, confidence string, script string")).first()
    assert (got["first_rule"], got["second_rule"], got["top_two"], got["total"], got["flagship_sites"], got["high_confidence"]) == ("wide", "cursive-script-letter-spacing", 5, 14, 2, 5)


def test_selectors_in_frames_are_joined(spark):
    values = ['"#a"', '["#a", ".b"]', '[["#host", ".in"], "#c", ""]', "5", "null", "[]"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", records.flat_target(F.parse_json("v")).alias("t"))
    assert [r["t"] for r in df.orderBy("i").collect()] == ["#a", "#a .b", "#host .in #c", "", "", ""]


def test_a_reference_without_semicolon(spark):
    """As in browsers, ``&amp`` before a tag is decoded; both ways see the same text."""
    pages = spark.createDataFrame([(1, "<html><body><h1>des&&amp</h1><p>a &ampb &amp; &am</p></body></html>")], "page_id int, html string")
    for rows in (html.text_nodes(pages), markup.text_rows(markup.markup(pages))):
        assert [r["text"] for r in rows.orderBy("node_ord").collect()] == ["des&&", "a &b & &am"]
