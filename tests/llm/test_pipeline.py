import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DATA = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA).cache()
        assert out.columns == columns, name
        left = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert left <= ids and len(left) > 0.5 * len(ids), name
        docs, ids = out, left
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == ids


@pytest.fixture(scope="module")
def labels(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("labels"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def words(i, n, names="the and with which that house river stone field tower".split()):
    return [names[(i * 13 + k * (2 + i % 7)) % 10] + str((i * 31 + k * k) % 50) for k in range(n)]


def rows_of(spark, texts, **columns):
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("lang_pred", "lang_score", "toxicity", "_toxicity0", "_language0", "part", "others", "component"):
        docs = docs.withColumn(name, F.lit("mine"))
    return docs


def ids(df):
    rows = df.collect()
    assert all(r[c] == "mine" for r in rows for c in ("lang_pred", "lang_score", "toxicity", "_toxicity0", "_language0", "part", "others", "component"))
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows)


def test_language_stage_drops_what_has_no_letter(spark, labels):
    texts = [(i, " ".join(words(i, 30))) for i in range(40)] + [(50, None), (51, ""), (52, "12 34"), (None, "the house"), (3, " ".join(words(3, 30)))]
    out = STAGE["language"](spark, rows_of(spark, texts), labels)
    assert ids(out) == sorted([(True, i) for i in range(40)] + [(True, 3), (False, 0)])


def test_toxicity_stage_drops_toxic_texts(spark, labels):
    texts = [(i, " ".join(["moronic", *words(i, 30), "scumbag"] if i % 4 == 0 else words(i, 30))) for i in range(400)] + [(500, None), (501, ""), (None, " ".join(words(9, 30))), (502, "the moronic scumbag house")]
    kept = {d for there, d in ids(STAGE["toxicity"](spark, rows_of(spark, texts), labels)) if there}
    assert kept & set(range(400)) == {i for i in range(400) if i % 4} and {500, 501} <= kept and 502 not in kept


def test_near_copy_stage_keeps_one_of_each_group(spark, labels):
    base = [words(i, 120) for i in range(4)]
    near = [*base[0]]
    near[60] = "changed"
    texts = [(1, " ".join(base[0])), (2, " ".join(near)), (3, " ".join(base[1])), (9, " ".join(base[1])), (4, " ".join(base[2])), (5, ""), (6, ""), (None, " ".join(base[3])), (7, " ".join(base[3])), (4, " ".join(base[2]))]
    out = STAGE["near_copies"](spark, rows_of(spark, texts), labels)
    assert ids(out) == [(False, 0), (True, 1), (True, 3), (True, 4), (True, 5), (True, 6)]


def test_passage_stage_cuts_what_occurs_earlier(spark, labels):
    long = " ".join(words(5, 60))
    texts = [(1, long + " first"), (2, "own  text\n" + long), (3, long), (4, None), (5, "short"), (None, "")]
    out = STAGE["passages"](spark, rows_of(spark, texts), labels)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got[1][0] == long + " first" and got[2] == ("own text", 8) and 3 not in got and got[5] == ("short", 5) and got[None][0] == ""


def test_packing_stage_packs_every_row(spark, labels):
    texts = [(1, "a b"), (1, "a b"), (None, None), (2, ""), (3, "long words " * 5000)]
    pieces = STAGE["packing"](spark, rows_of(spark, texts), labels).collect()
    assert sum(p["start"] == 0 for p in pieces) == 5 and sum(p["length"] for p in pieces if p["doc_id"] == 3) == next(p["doc_tokens"] for p in pieces if p["doc_id"] == 3)


def test_empty_tables(spark, labels):
    docs = rows_of(spark, [(1, "x")]).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, labels).count() == 0, name
