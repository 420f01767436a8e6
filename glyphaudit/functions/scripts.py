"""Writing systems of text, as columns: graphemes, runs, census, dominant script.

Text without combining marks, format characters or letters of several scripts is cut into runs
by a table of code point ranges, in one Arrow pass (``ranges``). Other text is cut into grapheme
clusters first, by built-in functions; letters of several scripts take the script before them, and
only texts that have such a letter are folded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters newer than the JVM's Unicode tables, by script.
_NEWER = {
    "arabic": r"\x{870}-\x{887}\x{889}-\x{88F}\x{8B5}\x{8C8}-\x{8C9}\x{10EC2}-\x{10EC7}",
    "cyrillic": r"\x{1C89}-\x{1C8A}\x{1E030}-\x{1E06D}",
    "latin": r"\x{A7C0}-\x{A7C1}\x{A7CB}-\x{A7DC}\x{A7F1}-\x{A7F4}\x{10780}-\x{10785}\x{10787}-\x{107B0}\x{107B2}-\x{107BA}\x{1DF00}-\x{1DF1E}\x{1DF25}-\x{1DF2A}",
    "kana": r"\x{1AFF0}-\x{1AFF3}\x{1AFF5}-\x{1AFFB}\x{1AFFD}-\x{1AFFE}\x{1B11F}-\x{1B122}\x{1B132}\x{1B155}",
    "han": r"\x{9FFD}-\x{9FFF}\x{16FF2}-\x{16FF3}\x{2A6DE}-\x{2A6DF}\x{2B735}-\x{2B73F}\x{2CEA2}-\x{2CEAD}\x{2EBF0}-\x{2EE5D}\x{31350}-\x{33479}",
}
# Letters whose script extensions name one script that their script property does not.
_EXTENDED = {
    "latin": r"\x{2C7}\x{2C9}\x{2CA}\x{2CB}\x{2CD}",
    "greek": r"\x{374}",
    "devanagari": r"\x{1CE9}-\x{1CEC}\x{1CEE}-\x{1CF3}\x{1CF5}\x{1CF6}",
    "han": r"\x{3006}\x{16FE3}",
    "kana": r"\x{3031}-\x{3035}\x{30FC}\x{FF70}\x{FF9E}\x{FF9F}",
}
# Letters of several scripts.
AMBIGUOUS = {"ʼ": ("latin", "devanagari", "thai", "cyrillic"), "ـ": ("arabic", "syriac"), "〼": ("han", "kana"), "ﷲ": ("arabic", "thaana")}

_NAMES = "latin arabic hebrew devanagari thai lao khmer han kana hangul cyrillic greek syriac nko thaana mongolian".split()
_JAVA = {n: rf"\p{{Is{n.capitalize()}}}" for n in _NAMES} | {"kana": r"\p{IsHiragana}\p{IsKatakana}"}
_AMBIGUOUS_SET = "".join(rf"\x{{{ord(c):X}}}" for c in AMBIGUOUS)
_ANY_LETTER = r"\p{L}" + "".join(_NEWER.values())
LETTER = f"[{_ANY_LETTER}]"


def _letters(name: str) -> str:
    """A character class of a script's letters; the classes of all scripts are disjoint."""
    taken = "".join(v for k, v in _EXTENDED.items() if k != name)
    own = f"[{_JAVA[name]}&&[\\p{{L}}]&&[^{taken}{_AMBIGUOUS_SET}]]"
    # Ranges below 256 are looked up in a table, before the properties are asked.
    table = r"a-zA-Z\x{AA}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}" if name == "latin" else ""
    return f"[{table}{own}{_NEWER.get(name, '')}{_EXTENDED.get(name, '')}]"


CLASSES = {n: _letters(n) for n in _NAMES}

# Consonants and linkers that join clusters, by block.
_LINKED = [
    (r"\x{915}-\x{939}\x{958}-\x{95F}\x{978}-\x{97F}", r"\x{94D}"),
    (r"\x{995}-\x{9A8}\x{9AA}-\x{9B0}\x{9B2}\x{9B6}-\x{9B9}\x{9DC}\x{9DD}\x{9DF}\x{9F0}\x{9F1}", r"\x{9CD}"),
    (r"\x{A95}-\x{AA8}\x{AAA}-\x{AB0}\x{AB2}\x{AB3}\x{AB5}-\x{AB9}\x{AF9}", r"\x{ACD}"),
    (r"\x{B15}-\x{B28}\x{B2A}-\x{B30}\x{B32}\x{B33}\x{B35}-\x{B39}\x{B5C}\x{B5D}\x{B5F}\x{B71}", r"\x{B4D}"),
    (r"\x{C15}-\x{C28}\x{C2A}-\x{C39}\x{C58}-\x{C5A}", r"\x{C4D}"),
    (r"\x{D15}-\x{D3A}", r"\x{D4D}"),
    (r"\x{1780}-\x{17B3}", r"\x{17D2}"),
]
_EXT = r"[\p{Mn}\x{200D}]"
GRAPHEME = "(?:" + "|".join(f"[{c}]{_EXT}*{v}{_EXT}*(?=[{c}])" for c, v in _LINKED) + r")*\X"
#: Text with any of these is cut into grapheme clusters; in other text each code point is one, as far as letters go.
CLUSTERED = rf"[\p{{M}}\p{{Cf}}\x{{E33}}\x{{EB3}}\x{{1100}}-\x{{11FF}}\x{{A960}}-\x{{A97F}}\x{{D7B0}}-\x{{D7FB}}\x{{FF9E}}\x{{FF9F}}\x{{1F3FB}}-\x{{1F3FF}}{_AMBIGUOUS_SET}]"


def _extract(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def graphemes(text: Column) -> Column:
    return _extract(text, GRAPHEME)


def grapheme_count(text: Column) -> Column:
    return F.size(graphemes(text))


def script_of_letter(letter: Column) -> Column:
    """The script of a base letter; ``?x`` for a letter ``x`` of several scripts."""
    out = F.lit("unknown")
    for name in reversed(_NAMES):
        out = F.when(letter.rlike(f"^{CLASSES[name]}"), F.lit(name)).otherwise(out)
    return F.when(letter == "", F.lit("common")).when(letter.isin(*AMBIGUOUS), F.concat(F.lit("?"), letter)).otherwise(out)


def _classified(clusters: Column, text: Column) -> Column:
    """Scripts of clusters, in order; letters of several scripts follow the last real script if they may."""
    first = F.transform(clusters, lambda g: script_of_letter(F.regexp_extract(g, LETTER, 0)))
    allowed = F.create_map(*[F.lit(x) for c, v in AMBIGUOUS.items() for x in ("?" + c, ",".join(v))])

    def step(acc: Column, s: Column) -> Column:
        fits = F.array_contains(F.split(allowed[s], ","), acc["before"])
        now = F.when(s.startswith("?"), F.when(fits, acc["before"]).otherwise(F.lit("unknown"))).otherwise(s)
        before = F.when(now.isin(*_NAMES), now).otherwise(acc["before"])
        return F.struct(before.alias("before"), F.concat(acc["out"], F.array(now)).alias("out"))

    start = F.struct(F.lit("").alias("before"), F.array().cast("array<string>").alias("out"))
    folded = F.aggregate(first, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(f"[{_AMBIGUOUS_SET}]"), folded).otherwise(first)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row however often they are used.

    They are computed in a projection, as generated code. A generator that only passes them on keeps
    the optimizer from copying an expensive expression into every expression, or every lambda, that
    refers to it; inside the generator itself they would be interpreted.
    """
    own = {n: f"_once_{n}" for n in columns}
    made = df.select("*", *[c.alias(own[n]) for n, c in columns.items()])
    return made.select(*[F.col(f"`{c}`") for c in df.columns], F.inline(F.array(F.struct(*[F.col(own[n]).alias(n) for n in columns]))))


def _slow(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``_runs`` of texts that the Arrow pass leaves out, cut into clusters first."""
    t = F.col(text)
    df = once(df, _clusters=F.when(t.isNotNull() & F.col("_dominant").isNull(), graphemes(t)))
    df = once(df, _scripts=F.when(F.col("_clusters").isNotNull(), _classified(F.col("_clusters"), t)))
    change = lambda i: (i == 0) | (F.get("_scripts", i) != F.get("_scripts", i - 1))
    df = once(df, _starts=F.when(F.size("_scripts") > 0, F.filter(F.sequence(F.lit(0), F.size("_scripts") - 1), change)))

    def run(start: Column, k: Column) -> Column:
        n = F.coalesce(F.get("_starts", k + 1), F.size("_scripts")) - start
        return F.struct(F.get("_scripts", start).alias("script"), F.array_join(F.slice("_clusters", start + 1, n), "").alias("text"), n.alias("n"))

    return once(df, _runs=F.when(F.col("_clusters").isNotNull(), F.transform("_starts", run))).drop("_clusters", "_scripts", "_starts")


#: What the checks ask of a text besides: counts of letters, its first arrow, its first unisolated left-to-right run, samples of what is in no known script.
_SIGNS = ["dominant_n", "lettered", "latin_n", "vietnamese", "arrow", "bidi_run", "unknown"]
#: Of text in no known script: how many samples are shown, and their length.
SAMPLES, SAMPLE_LENGTH = 5, 40


def _with_analysis(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``_plain_runs, _plain_census, _dominant`` and signs, what Arrow passes find, and ``_runs`` where these are null.

    Runs and signs come from two functions: what isn't used isn't made.
    """
    from glyphaudit.functions import ranges

    found = df.select("*", ranges.analysis(F.col(text), df.sparkSession).alias("_found"), ranges.signs(F.col(text), df.sparkSession).alias("_signs"))
    flat = found.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_found.runs").alias("_plain_runs"), F.col("_found.census").alias("_plain_census"), F.col("_signs.dominant").alias("_dominant"), *[F.col(f"_signs.{c}").alias(f"_{c}") for c in _SIGNS])
    return _slow(flat, text)


_NONE = "array<struct<script:string,text:string,n:int>>"


def with_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``script_runs array<struct<script, text, n>>``: maximal runs of one script with their clusters; joined they are the text."""
    runs = F.coalesce("_plain_runs", "_runs", F.array().cast(_NONE))
    return _with_analysis(df, text).withColumn("script_runs", runs).drop("_plain_runs", "_plain_census", "_dominant", "_runs", *[f"_{c}" for c in _SIGNS])


_BLOCK = 32


def with_offsets(df: DataFrame) -> DataFrame:
    """``df`` whose ``script_runs`` also have ``length`` and ``start`` in UTF-16 units."""
    add = lambda a, n: a + n
    df = once(df, _sizes=F.transform("script_runs", lambda r: utf16_length(r["text"])))
    blocks = F.when(F.size("_sizes") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size("_sizes") - 1) / _BLOCK).cast("int")), lambda b: F.aggregate(F.slice("_sizes", b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), add)))
    df = once(df, _blocks=blocks)
    df = once(df, _bases=F.transform("_blocks", lambda _, b: F.aggregate(F.slice("_blocks", F.lit(1), b), F.lit(0), add)))

    def run(r: Column, i: Column) -> Column:
        within = F.aggregate(F.slice("_sizes", i - i % _BLOCK + 1, i % _BLOCK), F.lit(0), add)
        start = F.get("_bases", F.floor(i / _BLOCK).cast("int")) + within
        return F.struct(r["script"].alias("script"), r["text"].alias("text"), F.get("_sizes", i).alias("length"), start.alias("start"), r["n"].alias("n"))

    return df.withColumn("script_runs", F.transform("script_runs", run)).drop("_sizes", "_blocks", "_bases")


def census(runs: Column) -> Column:
    """``array<struct<script, n>>`` of the scripts but ``common``, in order of appearance."""
    own = F.filter(runs, lambda r: r["script"] != "common")
    names = F.array_distinct(F.transform(own, lambda r: r["script"]))
    return F.transform(names, lambda s: F.struct(s.alias("script"), F.aggregate(F.filter(own, lambda r: r["script"] == s), F.lit(0).cast("long"), lambda a, r: a + r["n"]).alias("n")))


def lettered(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c["n"])


def count_of(counts: Column, script: Column | str) -> Column:
    return F.aggregate(F.filter(counts, lambda c: c["script"] == script), F.lit(0).cast("long"), lambda a, c: a + c["n"])


def share_of(counts: Column, script: Column | str) -> Column:
    total = lettered(counts)
    return F.when(total == 0, F.lit(0.0)).otherwise(count_of(counts, script) / total)


def dominant(counts: Column) -> Column:
    """The most frequent script, ``unknown`` included; of equal ones the first to appear; ``common`` if there is none."""
    ranked = F.transform(counts, lambda c, i: F.struct(c["n"].alias("n"), (-i).alias("at"), c["script"].alias("script")))
    return F.coalesce(F.array_max(ranked)["script"], F.lit("common"))


#: Letters that Vietnamese writes, some shared with French.
VIETNAMESE = "[Ạ-ỹăâêôơưđĂÂÊÔƠƯĐ]"


def is_vietnamese(text: Column) -> Column:
    return F.coalesce(text.rlike(VIETNAMESE), F.lit(False))


_SPACE = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_BLANKS = " \t\n\x0b\f\r\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(_BLANKS))


def flattened(text: Column) -> Column:
    """White space collapsed, none at the ends."""
    return trimmed(F.regexp_replace(text, f"[{_SPACE}]+", " "))


def shortened(flat: Column, most: int = 60) -> Column:
    """The first clusters of a flattened text, with an ellipsis if there are more. Only texts that have clusters of several code points are cut into them."""
    plain = F.concat(F.substring(flat, 1, most), F.lit("…"))
    cut = F.concat(F.array_join(F.slice(graphemes(flat), 1, most), ""), F.lit("…"))
    return F.when(F.length(flat) <= most, flat).when(~flat.rlike(CLUSTERED), plain).when(grapheme_count(flat) <= most, flat).otherwise(cut)


def snippet(text: Column, most: int = 60) -> Column:
    """White space collapsed, then the first clusters, with an ellipsis if there are more."""
    return shortened(flattened(text), most)


#: A text's beginning that is looked at first for its snippet, and what may join clusters in it.
_BEGINNING = 160
_JOINED = CLUSTERED[:-1] + r"\x{1F1E6}-\x{1F1FF}]"


def with_snippet(df: DataFrame, name: str, text: str = "text", most: int = 60) -> DataFrame:
    """``df`` with a column of snippets.

    Where the text's beginning already has more characters than that, and each is a cluster, the rest isn't looked at.
    """
    begun = once(df, _begun=flattened(F.substring(F.col(text), 1, _BEGINNING)))
    enough = (F.length("_begun") > most) & ~F.col("_begun").rlike(_JOINED)
    begun = once(begun, _flat=F.when(~F.coalesce(enough, F.lit(False)), flattened(F.col(text))))
    cut = F.concat(F.substring("_begun", 1, most), F.lit("…"))
    return once(begun, **{name: F.when(F.col("_flat").isNotNull(), shortened(F.col("_flat"), most)).when(F.col(text).isNotNull(), cut)}).drop("_begun", "_flat")


def analysed(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``script_runs, census, dominant_script, is_vietnamese_profile`` and ``signs``, which the checks read.

    Structs go through the generators field by field and are put together again after them: the
    optimizer loses fields of a struct that it prunes across several generators. A null struct
    comes out as one of nulls.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, T.StructType)}
    names = {(c, f): f"_{i}_{j}" for i, (c, kind) in enumerate(kinds.items()) for j, f in enumerate(kind.names)}
    flat = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in kinds], *[F.col(f"`{c}`").getField(f).alias(n) for (c, f), n in names.items()])
    found = _with_analysis(flat, text)
    counted = once(found, _census=F.when(F.col("_runs").isNotNull(), census(F.col("_runs"))))
    from glyphaudit.operators.rules import signs_by_runs

    slow = F.col("_census").isNotNull()
    other = signs_by_runs(F.col(text), F.col("_runs"), F.col("_census"), dominant(F.col("_census")))
    columns = {
        "script_runs": F.coalesce("_plain_runs", "_runs", F.array().cast(_NONE)),
        "is_vietnamese_profile": F.coalesce("_vietnamese", is_vietnamese(F.col(text))),
        "census": F.coalesce("_plain_census", "_census", F.array().cast("array<struct<script:string,n:bigint>>")),
        "dominant_script": F.coalesce("_dominant", F.when(F.col("_census").isNotNull(), dominant(F.col("_census"))), F.lit("common")),
        "signs": F.struct(*[F.when(slow, v).otherwise(F.col(f"_{k}")).alias(k) for k, v in other.items()]),
    }
    whole = {c: F.struct(*[F.col(names[c, f]).alias(f) for f in kind.names]).alias(c) for c, kind in kinds.items()}
    return counted.select(*[whole.get(c, F.col(f"`{c}`")) for c in df.columns], *[v.alias(k) for k, v in columns.items()])
