import itertools

import pyarrow as pa
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphaudit.functions import ranges, scalars
from glyphaudit.functions import scripts as S

CASES = {
    "Hi مرحبا": ("arabic", 3),
    "नमस्ते": ("devanagari", 1),
    "مـرحبا": ("arabic", 1),
    "ـabc": ("latin", 2),
    "日本語のテキスト ABC": ("kana", 4),
    "": ("common", 0),
    "  12, !": ("common", 1),
    "বাংলা": ("unknown", 1),
    "ab гд": ("latin", 3),
    "гд ab": ("cyrillic", 3),
    "é́́مر": ("arabic", 2),
}


def runs(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return {r["i"]: r for r in S.with_offsets(S.analysed(df)).collect()}


def test_dominant_and_runs(spark):
    got = runs(spark, list(CASES))
    for i, (text, (dominant, n)) in enumerate(CASES.items()):
        assert got[i]["dominant_script"] == dominant, text
        assert len(got[i]["script_runs"]) == n, text
        assert "".join(r["text"] for r in got[i]["script_runs"]) == text


def test_range_table(spark):
    """Ranges ascend without gaps but for surrogates, and give what the character classes do."""
    rows = ranges.table(spark)
    assert rows[0][0] == 0 and rows[-1][1] == 0x10FFFF and 200 < len(rows) < 3000
    assert all(b[0] == (0xE000 if a[1] == 0xD7FF else a[1] + 1) and a[1] >= a[0] for a, b in zip(rows, rows[1:], strict=False))
    of = lambda c: next(r[2] for r in rows if r[0] <= ord(c) <= r[1])
    assert [of(c) for c in "aéÿ×µ1مहญ日あ한гαܐߊހᠠক\U0001e030\U00010ec2"] == ["latin", "latin", "latin", "common", "unknown", "common", "arabic", "devanagari", "thai", "han", "kana", "hangul", "cyrillic", "greek", "syriac", "nko", "thaana", "mongolian", "unknown", "cyrillic", "arabic"]
    assert ranges.table(spark) is rows


LETTERS = "ab Éß12-.\u2019\u00aa\u00d7مرבثहिन日のカ한гαܐߊހᠠকঅ\U00020000\U0001e030😀𐰀\n"


@settings(max_examples=2, deadline=None)
@given(st.lists(st.text(alphabet=LETTERS, max_size=30), min_size=80, max_size=80))
def test_the_table_finds_what_the_classes_find(spark, texts):
    """Runs of the Arrow pass equal those of clusters that are asked one by one."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(3)
    t = F.col("text")
    asked = df.select("i", S._classified(S.graphemes(t), t).alias("s"), S.graphemes(t).alias("g"), t.rlike(S.CLUSTERED).alias("k"))
    want = {}
    for r in asked.collect():
        want[r["i"]] = [(k, "".join(g for _, g in v), len(v)) for k, v in ((k, list(v)) for k, v in itertools.groupby(zip(r["s"], r["g"], strict=True), key=lambda x: x[0]))]
    for r in S.analysed(df).collect():
        own = [(x["script"], x["text"], x["n"]) for x in r["script_runs"]]
        assert own == want[r["i"]], texts[r["i"]]
        counts = {}
        for script, _, n in own:
            if script != "common":
                counts[script] = counts.get(script, 0) + n
        assert [(c["script"], c["n"]) for c in r["census"]] == list(counts.items())
        assert r["dominant_script"] == max(counts, key=counts.get, default="common")


def test_batches(spark):
    """Slices, nulls, empty texts and batches without any text."""
    table = tuple(ranges.table(spark))
    texts = pa.array(["", None, "ab é", "مر", "e\u0301", "", "x1"])
    want = [([], [], "common"), ([], [], "common"), ([("latin", "ab", 2), ("common", " ", 1), ("latin", "é", 1)], [("latin", 3)], "latin"), ([("arabic", "مر", 2)], [("arabic", 2)], "arabic"), None, ([], [], "common"), ([("latin", "x", 1), ("common", "1", 1)], [("latin", 1)], "latin")]
    shape = lambda v: v and ([tuple(r.values()) for r in v["runs"]], [tuple(c.values()) for c in v["census"]], v["dominant"])
    assert [shape(v) for v in ranges.runs_of(texts, table).to_pylist()] == want
    assert [shape(v) for v in ranges.runs_of(texts.slice(2, 3), table).to_pylist()] == want[2:5]
    assert ranges.runs_of(pa.array([], pa.string()), table).to_pylist() == [] and len(ranges.runs_of(pa.array([None, None], pa.string()), table)) == 2


def test_null_text(spark):
    row = S.analysed(spark.createDataFrame([(None,)], "text string")).first()
    assert row["dominant_script"] == "common" and row["script_runs"] == []


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="aé́ مـرनमस्ते日のʼ𐰀😀-1\n", max_size=40), min_size=60, max_size=60))
def test_runs_are_lossless_and_offsets_are_utf16(spark, texts):
    for i, row in runs(spark, texts).items():
        units = texts[i].encode("utf-16-le")
        for r in row["script_runs"]:
            assert units[2 * r["start"] : 2 * (r["start"] + r["length"])].decode("utf-16-le") == r["text"]
        pairs = [r["script"] for r in row["script_runs"]]
        assert all(a != b for a, b in zip(pairs, pairs[1:], strict=False))


def test_graphemes_like_another_library(spark):
    texts = ["हिन्दी", "ភាសាខ្មែរ", "नमस्ते", "éx", "👨‍👩‍👧", "한국어"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(S.grapheme_count(F.col("t"))).collect()]
    assert got == [len(regex.findall(r"\X", t)) for t in texts]


def test_font_probe(spark):
    rows = [("A, 'B', serif", 5.0, 4.0, [4.0, 5.0, 6.0]), ("A", 4.0, 4.0, [4.0])]
    df = spark.createDataFrame(rows, "f string, d double, b double, w array<double>")
    got = [r["p"] for r in df.select(scalars.font_probe(F.col("f"), F.col("d"), F.col("b"), F.col("w")).alias("p")).collect()]
    assert [tuple(p) for p in got] == [(["A", "B", "serif"], "B", False), (["A"], None, True)]


def test_scalars(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first()["x"]

    assert one(scalars.pixel_length(F.lit(" 1.5px "))) == 1.5
    assert one(scalars.pixel_length(F.lit("normal"))) is None
    assert one(scalars.pixel_length(F.lit("1em"))) is None
    assert one(scalars.rounded(F.lit(2.50))) == "2.5"
    assert one(scalars.rounded(F.lit(100.0), 0)) == "100"
    assert one(scalars.expected_scripts(F.lit(" JA-jp "))) == ["han", "kana", "latin"]
    assert one(scalars.expected_scripts(F.lit("ar-Zzzz"))) == []
    assert one(scalars.expected_scripts(F.lit(None).cast("string"))) == []
    assert one(scalars.reverses_or_turns(F.lit("matrix(-1, 0, 0, 1, 0, 0)"))) is True
    assert one(scalars.reverses_or_turns(F.lit("matrix(1, 0, 0, 1, 9, 9)"))) is False
    assert one(scalars.reverses_or_turns(F.lit("matrix(1, x)"))) is False
    assert one(scalars.percent(F.lit(1), F.lit(3))) == 33.3
    assert one(scalars.percent(F.lit(1), F.lit(0))) == 0.0
    assert one(scalars.error_kind(F.lit("x ERR_CONNECTION_TIMED_OUT"))) == "unreachable-host"
    assert one(scalars.font_stack(F.lit("'Noto Sans', \"A\", , serif"))) == ["Noto Sans", "A", "serif"]
    assert one(S.snippet(F.lit("a" * 61))) == "a" * 60 + "…"
    assert one(scalars.escape_html(F.lit("<a&'\">"))) == "&lt;a&amp;&#39;&quot;&gt;"
