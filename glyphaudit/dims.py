"""Reference data: writing systems, languages, target groups, rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Script:
    """What a writing system needs of typography. ``min_line_height`` None: not stated for it."""

    name: str
    label: str
    cursive: bool = False
    caseless: bool = True
    rtl: bool = False
    stacked_marks: bool = False
    segmented: bool = False
    min_line_height: float | None = 1.5
    source: str = "wcag-1.4.12"


# The writing systems and what they need.
SCRIPTS = [
    Script("latin", "Latin", caseless=False),
    Script("arabic", "Arabic", cursive=True, rtl=True, stacked_marks=True),
    Script("hebrew", "Hebrew", rtl=True, stacked_marks=True),
    Script("devanagari", "Devanagari", stacked_marks=True),
    Script("thai", "Thai", stacked_marks=True, segmented=True, min_line_height=1.6, source="estimate"),
    Script("lao", "Lao", stacked_marks=True, segmented=True, min_line_height=1.6, source="estimate"),
    Script("khmer", "Khmer", stacked_marks=True, segmented=True, min_line_height=1.6, source="estimate"),
    Script("han", "Han", segmented=True),
    Script("kana", "Kana", segmented=True),
    Script("hangul", "Hangul"),
    Script("cyrillic", "Cyrillic", caseless=False),
    Script("greek", "Greek", caseless=False),
    Script("syriac", "Syriac", cursive=True, rtl=True, stacked_marks=True),
    Script("nko", "N'Ko", cursive=True, rtl=True, stacked_marks=True),
    Script("thaana", "Thaana", rtl=True, stacked_marks=True),
    Script("mongolian", "Mongolian", cursive=True, stacked_marks=True, min_line_height=None),
]
#: Outcomes that are no writing system.
OUTCOMES = ("common", "unknown")
LABELS = {s.name: s.label for s in SCRIPTS} | {"common": "Common", "unknown": "Unrecognised"}

# Scripts a language is written in.
LANGUAGES: dict[str, list[str]] = {
    **dict.fromkeys("ar fa ur ps ckb sd ug ku".split(), ["arabic"]),
    **dict.fromkeys("he yi".split(), ["hebrew"]),
    **dict.fromkeys("hi mr ne sa bho kok".split(), ["devanagari"]),
    "th": ["thai"],
    "lo": ["lao"],
    "km": ["khmer"],
    "zh": ["han"],
    "ja": ["han", "kana", "latin"],
    "ko": ["hangul", "han"],
    **dict.fromkeys("vi en fr de es pt id tr".split(), ["latin"]),
    **dict.fromkeys("ru uk bg mk".split(), ["cyrillic"]),
    "sr": ["cyrillic", "latin"],
    "el": ["greek"],
    "dv": ["thaana"],
}
# Scripts that ISO 15924 subtags name.
SUBTAGS: dict[str, list[str]] = {
    "latn": ["latin"],
    "arab": ["arabic"],
    "hebr": ["hebrew"],
    "syrc": ["syriac"],
    "thaa": ["thaana"],
    "nkoo": ["nko"],
    "deva": ["devanagari"],
    "thai": ["thai"],
    "laoo": ["lao"],
    "khmr": ["khmer"],
    "mong": ["mongolian"],
    **dict.fromkeys("hani hans hant".split(), ["han"]),
    **dict.fromkeys("hira kana hrkt".split(), ["kana"]),
    "jpan": ["han", "kana"],
    "hang": ["hangul"],
    "kore": ["hangul", "han"],
    "cyrl": ["cyrillic"],
    "grek": ["greek"],
}
# Scripts expected of a target group.
GROUPS: dict[str, list[str]] = {
    "arabic": ["arabic"],
    "persian/urdu": ["arabic"],
    "hebrew": ["hebrew"],
    "thai": ["thai"],
    "devanagari": ["devanagari"],
    "vietnamese": ["latin"],
    "cjk": ["han", "kana", "hangul"],
}

SEVERITIES = ("critical", "serious", "moderate", "minor")
RANK = {s: i for i, s in enumerate(SEVERITIES)}


def where(test) -> list[str]:
    """Names of the scripts for which ``test`` holds, sorted."""
    return sorted(s.name for s in SCRIPTS if test(s))


def scripts_table(spark: SparkSession) -> DataFrame:
    """17 rows: the scripts, and Latin as Vietnamese writes it, which has stacked marks."""
    rows = [(s.name, False, s.label, s.cursive, s.caseless, s.rtl, s.stacked_marks, s.segmented, s.min_line_height, s.source if s.min_line_height else None) for s in SCRIPTS]
    latin = next(r for r in rows if r[0] == "latin")
    rows.append((latin[0], True, *latin[2:6], True, *latin[7:]))
    return spark.createDataFrame(rows, "script string, vietnamese boolean, label string, is_cursive boolean, is_caseless boolean, is_rtl boolean, has_stacked_marks boolean, needs_segmentation boolean, min_line_height double, min_line_height_source string")


def languages_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, s) for k, v in LANGUAGES.items() for s in v], "language string, script string")


def subtags_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, s) for k, v in SUBTAGS.items() for s in v], "subtag string, script string")


def groups_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, s) for i, (k, v) in enumerate(GROUPS.items()) for s in v], "group_ord int, target_group string, script string")
