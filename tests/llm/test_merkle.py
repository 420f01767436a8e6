import hashlib

from pyspark.sql import functions as F

from glyphaudit.llm import merkle


def test_next_goes_round_in_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_BYTES", 64)
    ids = [*range(0, 300, 3), 1000, -5]
    rows = merkle.with_next(docs_of([(i, f"text {i}") for i in ids]).select("doc_id", "text"), ["text"]).collect()
    order = sorted(ids, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    assert {r["doc_id"]: r["next_text"] for r in rows} == {i: f"text {after[i]}" for i in ids}


def test_next_with_ids_that_fill_many_ranges(docs_of, monkeypatch):
    """A doc_id, or null, with a third of all rows is cut by the texts' hashes; repeats and ties go round as one order."""
    monkeypatch.setattr(merkle, "BLOCK_BYTES", 200)
    texts = [(None, f"null {i}") for i in range(60)] + [(7, f"seven {i}") for i in range(60)] + [(i, f"text {i}") for i in range(40, 80)] + [(7, "seven 1"), (None, "null 3"), (-(1 << 63), "least")]
    rows = merkle.with_next(docs_of(texts).select("doc_id", "text"), ["text"])
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["next_text"]) for r in rows.collect()))

    def place(t):
        return (t[0] is not None, t[0] or 0, int(hashlib.md5(t[1].encode()).hexdigest()[:15], 16), t[1])

    order = sorted(texts, key=place, reverse=True)
    want = sorted((d is None, d or 0, t, after) for (d, t), (_, after) in zip(order, order[1:] + order[:1], strict=True))
    assert got == want
    blocks = rows._jdf.queryExecution().toString()
    assert "_piece" in blocks


def test_like_sql(docs_of, same_as_sql):
    texts = ["", None, "One. Two. One. One.\nFour!\n\nOne.", "x" * 400 + "!?", "änderung. Noch ein Satz.\n" * 30, *[f"Line {i}. " * (i % 5) + "\nEnd." for i in range(40)]]
    texts = [(i, t) for i, t in enumerate(texts)] + [(None, "One. Two."), (None, None), (3, "again. again. again."), (3, "again. again. again.")]
    same_as_sql(merkle.digest(merkle.fingerprints(docs_of(texts))), merkle.sql(), texts)


def test_hashes_are_those_of_children(spark):
    """The root can be computed from the sections' hashes, and a section proved against it without the others' text."""
    text = "\n".join(f"Paragraph {i}. It says {i * i}." for i in range(60))
    tree = spark.createDataFrame([(text,)], "t string").select(merkle.fingerprint(F.col("t")).alias("f")).first()["f"]
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    root, sections = tree.split("#")[0], tree.split("#")[1].split("|")
    assert len(sections) > 5
    for section in sections:
        own, body = section.split(":", 1)
        paragraphs = [p.split("=") for p in body.split(";")]
        assert all(md5(leaves)[:16] == h for h, leaves in paragraphs)
        assert own == md5("".join(h for h, _ in paragraphs))[:16]
    assert root == md5("".join(s.split(":")[0] for s in sections))
    body = sections[3].split(":", 1)[1]
    df = spark.createDataFrame([(tree, root, body, body.replace("=", "=0", 1)[:-1] + "9;0123456789abcdef=")], "f string, r string, b string, w string").select("*", merkle.proof(F.col("f"), F.lit(3)).alias("p"))
    got = df.select(merkle.proves(F.col("r"), F.col("b"), F.col("p")).alias("yes"), merkle.proves(F.col("r"), F.col("w"), F.col("p")).alias("no")).first()
    assert got["yes"] and not got["no"]


def test_likeness_counts_repeated_sentences(spark):
    rows = [("Same here. " * 100, "Same here. " * 50 + "Other one."), ("A. B.", "C. D."), ("A. A. B.", "A. B. B.")]
    df = spark.createDataFrame(rows, "a string, b string").select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    first, none, third = (r["l"] for r in df.select(merkle.likeness(F.col("a"), F.col("b")).alias("l")).collect())
    assert 0.6 < first < 0.68 and none == 0.0 and 0.2 < third < 0.8


def test_digest(docs_of):
    texts = ["", None, "One. Two. Three.\nFour!", "One. Two. Three.\nFour!", "word " * 2000, "änderung. Noch ein Satz. Und noch einer, der länger ist."]
    rows = {r["doc_id"]: r for r in merkle.digest(merkle.fingerprints(docs_of([*texts, (None, "x")], extra=True))).collect()}
    assert rows[2]["fingerprint"] == rows[3]["fingerprint"] and rows[3]["near_next"] == 1.0
    assert rows[0]["fingerprint"] == rows[1]["fingerprint"] and rows[0]["n_chars"] == 0
    assert len({rows[i]["fingerprint"] for i in (0, 2, 4, 5)}) == 4
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows.values())


def test_lone_row_and_empty(docs_of):
    row = merkle.digest(merkle.fingerprints(docs_of(["abc def."]))).first()
    assert row["near_next"] == 1.0
    assert merkle.fingerprints(docs_of([])).count() == 0


def test_edits_are_located(spark):
    a = "\n".join(f"Paragraph {i}. It says {i * i}." for i in range(40))
    b = a.replace("It says 49.", "It says more.")
    df = spark.createDataFrame([(a, b)], "a string, b string").select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    found = df.select(merkle.edits(F.col("b"), F.col("a")).alias("e"), merkle.likeness(F.col("a"), F.col("b")).alias("l")).first()
    assert len(found["e"]) == 1 and 0.9 < found["l"] < 1
