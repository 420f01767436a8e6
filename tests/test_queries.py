"""Every query beside its SQL on the smallest test tables."""

import glob
import os

import duckdb
import pytest

from glyphaudit.plans import catalogue, reports, static

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


QUERIES, SQL = catalogue.QUERIES | reports.QUERIES | static.QUERIES, catalogue.SQL | reports.SQL | static.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), db.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours.astype({c: theirs[c].dtype for c in ours.columns if theirs[c].dtype.kind in "if"})) == rows(theirs)


def test_static_pages_have_findings(spark):
    found = static.page_findings_static(spark, DATA).groupBy("rule_id").count().collect()
    assert {"missing-dir-attribute", "lang-script-mismatch"} <= {r["rule_id"] for r in found}


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plan_reads_only_what_it_needs(spark, capsys):
    catalogue.vietnamese_profile_by_lang(spark, DATA).explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<text:string,lang:string>" in plan and "BatchEvalPython" not in plan


@pytest.mark.parametrize("name", ["page_text_nodes", "page_findings_static", "page_text_ancestry"])
def test_references_without_a_semicolon(spark, tmp_path, name):
    """The SQL keeps ``&amp`` as it is written, and so does the query; its letters count for the checks (17 and 3 are 20)."""
    html = ["<html><head></head><body><article><h1>abcdefghijklmnopq &&amp</h1><p>a &amp; b &copy</p><p>&#38 x &amp1; &notit;</p></article></body></html>", "<html><body><article><h1>x &amp;amp</h1></article></body></html>"]
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, 'u', ?)", list(enumerate(html, 1)))
    con.sql(f"COPY pages TO '{tmp_path}/pages.parquet' (FORMAT parquet)")
    ours = static.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert len(ours) and rows(ours.astype({"page_id": str})) == rows(con.sql(static.SQL[name]).df())
