"""Line dedup beside a plain count, levels of runs, and the SQL."""

import hashlib
import random
from collections import Counter

import pytest

from glyphaudit.llm import lines
from glyphaudit.llm.common import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, least=10, shortest=1):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    docs = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
    n = Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")} if len(k) >= shortest)
    out = []
    for d, t in docs:
        own = (t or "").split("\n")
        kept = [x for x in own if n[key(x)] < least]
        out.append((d, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    common = ["Read more", "  read MORE\t", "© É", "© é", "", " ", "\x1c", "menu", "İ", "ii"]
    texts = ["\n".join(rng.choice(common) if rng.random() < 0.4 else f"line {rng.randrange(400)}" for _ in range(rng.randrange(1, 12))) for _ in range(150)]
    return texts + [None, "", "\n", "\n\n", (None, None), (None, "menu"), *[(7, "same row\nmenu")] * 30, *["a copy\nof lines\r\nx"] * 9, "menu\n" * 5000 + "own", "READ MORE"]


def got(out):
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize(("least", "shortest", "batches", "fan"), [(10, 1, 8, 4), (2, 5, 5, 2), (3, 0, 1, 4)])
def test_equals_brute_force(spark, docs_of, least, shortest, batches, fan):
    texts = corpus(least)
    out = lines.drop_lines(docs_of(texts, extra=True), least, shortest, batches, fan)
    assert got(lines.digest(out)) == brute(texts, least, max(shortest, 1))


def test_sql(docs_of, same_as_sql):
    texts = corpus(1)
    same_as_sql(lines.digest(lines.drop_lines(docs_of(texts))), lines.sql(), texts)


def test_texts_come_out(docs_of):
    out = lines.drop_lines(docs_of(["a\nb\nc", "B \nd"]), least=2).orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(0, "a\nc", 3, 1), (1, "d", 2, 1)]
    assert lines.drop_lines(docs_of([]), least=2).count() == 0


def test_one_text_in_most_rows(docs_of):
    """A hot text is spread over parts, and each row comes back once."""
    texts = ["hot\nown line"] * 400 + [f"hot\nline {i}" for i in range(50)]
    assert got(lines.digest(lines.drop_lines(docs_of(texts)))) == brute(texts)


def test_levels(spark):
    """Runs of a full level become one of the next; settled lines are not added again."""
    runs = lines.LineRuns(Scratch(spark, "runs"), least=3, fan=2)
    batch = lambda *rows: spark.createDataFrame(rows, "line string, n long")
    runs.add(batch(("a", 1), ("b", 3)))
    runs.add(batch(("a", 1), ("b", 5), ("c", 2)))
    assert [len(x) for x in runs.levels] == [0, 1]
    assert sorted(map(tuple, runs._all(list(runs.tables)).collect())) == [("a", 2), ("b", 3), ("c", 2)]
    runs.add(batch(("a", 1), ("d", 1)))
    assert [len(x) for x in runs.levels] == [1, 1]
    assert sorted(r["line"] for r in runs.frequent().collect()) == ["a", "b"]
    runs.add(batch(("a", 9)))
    assert [len(x) for x in runs.levels] == [0, 0, 1]


def test_no_python_on_the_executors(docs_of, capsys):
    lines.drop_lines(docs_of(["a\nb"] * 3)).explain("extended")
    assert "Python" not in capsys.readouterr().out and "Arrow" not in capsys.readouterr().out
