"""Phrases beside a plain count in Python integers, and the SQL."""

import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from glyphaudit.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, max_n=3, least=10, share=50, top=2000):
    f, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in range(1, max_n + 1):
                f.update((lang, tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in candidates.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(x == lang and len(q) > len(p) and inside(q) and 100 * b >= share * a for (x, q), b in candidates.items()):
            continue
        score, _, left, right = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for lang, v in out.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:top]))


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "Old", "house", "of", "É", "é", "river\tstone", "new york", "new york city", "x y", "a", "b", "c"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randrange(60)))) for _ in range(n)]
    return rows + [(None, None), ("en", ""), ("en", " .,;\t"), ("fr", "only once here"), ("en", "long road home " * 3000), ("en", "Long ROAD\x1chome"), *[("de", "copy of a line. copy")] * 12]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, la, "x", 1) for i, (la, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, words int")


@pytest.mark.parametrize("max_n", [2, 3, 4])
def test_equals_brute_force(spark, max_n):
    rows = corpus(max_n)
    out = phrases.mine(frame(spark, rows), max_n=max_n).collect()
    assert sorted(map(tuple, out)) == brute(rows, max_n) and out


def test_top_and_ties(spark):
    rows = [("en", f"{x} {y}.") for x in "abcd" for y in "efgh" for _ in range(10)]
    out = sorted(map(tuple, phrases.mine(frame(spark, rows), top=5).collect()))
    assert out == brute(rows, top=5) and [r[2] for r in out] == ["a e", "a f", "a g", "a h", "b e"]


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000
    rows = [("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 7)]
    got = phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, words int, f long"), 3).first()
    assert got["score"] == 1000000 * (big - 7) ** 2 // (big * (big - 1)) == 999999


def test_sql_and_empty(spark):
    rows = corpus(9)
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(rows))), "text": pa.array([t for _, t in rows]), "lang": pa.array([x for x, _ in rows])}))
    assert sorted(con.sql(phrases.sql()).fetchall()) == brute(rows)
    assert phrases.mine(frame(spark, rows).limit(0)).count() == 0


def test_rows_are_generated_code(spark):
    """No function of a lambda, which is interpreted row by row, and each text is cut once."""
    plan = phrases.counts(frame(spark, corpus(1)), 3)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.count("split(translate(") == 1 and "array_remove(split(" in plan and plan.count("array_remove(") == 1
