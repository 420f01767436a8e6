"""The eleven checks, each a condition and a projection over one analysed text node."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphaudit.dims import LABELS, SCRIPTS, where
from glyphaudit.functions.scalars import expected_scripts, pixel_length, reverses_or_turns, rounded, visually_hidden
from glyphaudit.functions.scripts import SAMPLE_LENGTH, count_of, lettered, once, trimmed, with_snippet

RTL = where(lambda s: s.rtl)
CURSIVE = where(lambda s: s.cursive)
CASELESS = where(lambda s: s.caseless)
MARKED = where(lambda s: s.stacked_marks)
SEGMENTED_MARKED = where(lambda s: s.segmented and s.stacked_marks)
SEGMENTED_PLAIN = where(lambda s: s.segmented and not s.stacked_marks)
KNOWN = where(lambda s: True)
CODE_TAGS = ["CODE", "KBD", "PRE", "SAMP"]
CONTROL_TAGS = ["BUTTON", "INPUT", "OPTION", "SELECT", "TEXTAREA"]
# Glyphs and class names that point left or right, neutral marks, direction controls.
ARROWS = "[←→‹›«»⟵⟶⇐⇒◀▶◄►]"
ARROW_CLASS = "(?i)(arrow|chevron|caret|angle)[-_](left|right)"
NEUTRAL = "[.,:;!?()\"'\\[\\]{}]"
CONTROLS = r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]"


@dataclass(frozen=True)
class Rule:
    """A check. ``fires`` is never null; ``says`` gives what is wrong, why it matters and what to do."""

    id: str
    title: str
    severity: str
    confidence: str
    affects: list[str]
    fires: Callable[[], Column]
    says: Callable[[], tuple[Column, Column, Column]]
    wcag: str | None = None
    limits: str = ""
    level: Callable[[], Column] | None = None
    finding_wcag: Callable[[], Column] | None = None
    #: A condition on a node before its text is looked at, without which the check can't hold.
    needs: Callable[[], Column] | None = None


#: What the checks read of a node; fields of structs become columns of their own.
FIELDS = "page_id node_ord selector text own_lang inherited_lang own_dir inherited_dir computed_direction class_names tag_name has_bdi_ancestor has_code_ancestor has_transformed_ancestor dominant_script is_vietnamese_profile".split()
NESTED = "css.letterSpacing css.lineHeight css.fontSize css.textAlign css.textTransform css.transform css.wordBreak css.hyphens css.overflowY css.webkitLineClamp css.clip css.clipPath box.clientHeight box.scrollHeight box.clientWidth font_probe.declaredStack font_probe.fallbackSuspected signs.dominant_n signs.arrow signs.bidi_run signs.unknown".split()


def _flat(name: str) -> str:
    return name.replace(".", "__")


def _c(name: str) -> Column:
    return F.col(_flat(name))


def _word(name: str) -> Column:
    return F.lower(trimmed(_c(name)))


def _dominant() -> Column:
    return _c("dominant_script")


def _count() -> Column:
    return _c("signs.dominant_n")


def _share() -> Column:
    return _c("dominant_share")


def signs_by_runs(text: Column, runs: Column, counts: Column, dominant: Column) -> dict[str, Column]:
    """What an Arrow pass says of texts, from runs and census of others."""
    arrow = F.nullif(F.regexp_extract(text, ARROWS, 0), F.lit(""))
    strange = F.transform(F.filter(runs, lambda r: r["script"] == "unknown"), lambda r: F.substring(trimmed(r["text"]), 1, SAMPLE_LENGTH))
    return {"dominant_n": count_of(counts, dominant), "lettered": lettered(counts), "latin_n": count_of(counts, "latin"), "arrow": arrow, "bidi_run": F.get(runs, bidi_run(runs))["text"], "unknown": F.when(F.size(strange) > 0, F.array_distinct(strange))}


def measured(nodes: DataFrame) -> DataFrame:
    """Analysed nodes with what the checks read as flat columns, and what several of them need."""
    if "signs" not in nodes.columns:
        found = signs_by_runs(F.col("text"), F.col("script_runs"), F.col("census"), F.col("dominant_script"))
        nodes = nodes.withColumn("signs", F.struct(*[v.alias(k) for k, v in found.items()]))
    share = lambda n: F.when(F.col("signs.lettered") == 0, F.lit(0.0)).otherwise(F.col(n) / F.col("signs.lettered"))
    return nodes.select(*FIELDS, *[F.col(n).alias(_flat(n)) for n in NESTED], share("signs.dominant_n").alias("dominant_share"), share("signs.latin_n").alias("latin_share"))


def _label(script: Column | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return table[_dominant() if script is None else script]


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _least_height() -> Column:
    out = F.lit(None).cast("double")
    for h in sorted({s.min_line_height for s in SCRIPTS if s.min_line_height}):
        out = F.when(_dominant().isin(*where(lambda s, h=h: s.min_line_height == h)), F.lit(h)).otherwise(out)
    return out


def _ratio() -> Column:
    size = pixel_length(_c("css.fontSize"))
    return pixel_length(_c("css.lineHeight")) / F.when(size > 0, size)


def _spacing_fires() -> Column:
    px = pixel_length(_c("css.letterSpacing"))
    return _sure(_dominant().isin(*CURSIVE) & (F.abs(px) >= 0.01) & (_count() >= 2))


def _spacing_says() -> tuple[Column, Column, Column]:
    return (
        _text("Letters of ", _label(), " text are set ", rounded(pixel_length(_c("css.letterSpacing"))), "px apart."),
        F.lit("Joined letters come apart or collide, and words stop being words."),
        F.lit("Apply letter-spacing to scripts with separate letters only."),
    )


def _height_fires() -> Column:
    size = pixel_length(_c("css.fontSize"))
    return _sure((_ratio() < _least_height()) & ~_c("tag_name").isin(*CONTROL_TAGS) & (_c("box.clientHeight") >= 2 * size))


def _height_says() -> tuple[Column, Column, Column]:
    return (
        _text(_label(), " text has a line height of ", rounded(_ratio()), "; it needs ", rounded(_least_height()), "."),
        F.when(_least_height() > 1.5, F.lit("Marks above and below the letters touch the next line; the figure is an estimate.")).otherwise(F.lit("Lines this close are hard to follow.")),
        F.lit("Give the text a unitless line-height of at least that."),
    )


def _font_says() -> tuple[Column, Column, Column]:
    stack = F.array_join(_c("font_probe.declaredStack"), ", ")
    return (
        _text("No declared font seems to have ", _label(), " letters: ", F.when(F.coalesce(stack, F.lit("")) == "", F.lit("no font is named")).otherwise(stack), "."),
        F.lit("Readers get whatever font their system falls back to, at another size and weight, or empty boxes."),
        F.lit("Name a font that covers the script."),
    )


def _break_parts() -> Column:
    anywhere, hyphens = _word("css.wordBreak") == "break-all", _word("css.hyphens") == "auto"
    d = _dominant()
    a = _sure(anywhere & d.isin(*sorted(CURSIVE + SEGMENTED_MARKED)))
    h = _sure(hyphens & d.isin(*sorted(CURSIVE + SEGMENTED_PLAIN)))
    return F.concat_ws(" and ", F.when(a, F.lit("word-break: break-all")), F.when(h, F.lit("hyphens: auto")))


def _declared_lang() -> Column:
    return F.coalesce(_c("own_lang"), _c("inherited_lang"))


def _lang_fires() -> Column:
    # What is cheap comes first, and the lookup is evaluated once for what is left.
    other = F.exists(F.array(expected_scripts(_declared_lang())), lambda e: (F.size(e) > 0) & ~F.array_contains(e, _dominant()))
    code = _c("tag_name").isin(*CODE_TAGS) | _c("has_code_ancestor")
    return _sure(F.when((_count() >= 20) & (_share() >= 0.8) & _dominant().isin(*KNOWN) & ~code, other))


def bidi_run(runs: Column) -> Column:
    """Index of the first unisolated left-to-right run within right-to-left text, in one pass; null if there is none.

    Passing over common and left-to-right runs, the nearest other run on each side must be right to left.
    """

    def neutral(r: Column) -> Column:
        return F.coalesce(r["text"].rlike(NEUTRAL), F.lit(False))

    def beside(r: Column) -> Column:
        return F.coalesce((r["script"] == "common") & neutral(r), F.lit(False))

    def state(rtl: Column, open_: Column, found: Column) -> Column:
        return F.struct(rtl.alias("rtl"), open_.alias("open"), found.alias("found"))

    none = F.lit(None).cast("int")

    def step(acc: Column, i: Column) -> Column:
        own = F.get(runs, i)
        real, rtl = ~own["script"].isin("common", "latin"), own["script"].isin(*RTL)
        ltr = (own["script"] == "latin") | ((own["script"] == "common") & own["text"].rlike("[0-9]"))
        fits = acc["rtl"] & acc["open"].isNull() & ltr & (own["n"] >= 2) & (neutral(own) | beside(F.get(runs, i - 1)) | beside(F.get(runs, i + 1)))
        closed = state(rtl, none, F.coalesce(acc["found"], F.when(rtl, acc["open"])))
        return F.when(acc["found"].isNotNull(), acc).when(real, closed).when(F.coalesce(fits, F.lit(False)), state(acc["rtl"], i, acc["found"])).otherwise(acc)

    places = F.when(F.size(runs) > 0, F.sequence(F.lit(0), F.size(runs) - 1))
    return F.aggregate(places, state(F.lit(False), none, none), step, lambda acc: acc["found"])


def _bidi_fires() -> Column:
    return _sure(_dominant().isin(*RTL) & ~_c("has_bdi_ancestor") & _c("signs.bidi_run").isNotNull() & ~_c("text").rlike(CONTROLS))


def _icon_evidence() -> Column:
    return F.coalesce(_c("signs.arrow"), F.get(F.filter(_c("class_names"), lambda n: n.rlike(ARROW_CLASS)), F.lit(0)))


def _icon_fires() -> Column:
    return _sure((_c("computed_direction") == "rtl") & _c("css.transform").isNotNull() & _icon_evidence().isNotNull() & ~reverses_or_turns(_c("css.transform")) & ~_c("has_transformed_ancestor"))


def _clip_fires() -> Column:
    marks = _dominant().isin(*MARKED) | ((_dominant() == "latin") & _c("is_vietnamese_profile")) | _c("text").rlike(r"\p{Mn}")
    hidden = visually_hidden(_c("css.clip"), _c("css.clipPath"), _c("box.clientHeight"), _c("box.clientWidth"))
    return _sure(_dominant().isin(*KNOWN) & marks & _word("css.overflowY").isin("hidden", "clip") & ~hidden & (_c("box.scrollHeight") > _c("box.clientHeight") + 1))


def _clip_says() -> tuple[Column, Column, Column]:
    clamp = trimmed(_c("css.webkitLineClamp"))
    cause = F.when((F.coalesce(clamp, F.lit("")) != "") & (clamp != "none"), _text("a clamp at ", clamp, " lines")).otherwise(_text("overflow: ", _word("css.overflowY")))
    return (
        _text("The box cuts off ", (_c("box.scrollHeight") - _c("box.clientHeight")).cast("string"), "px of its text by ", cause, "."),
        F.lit("Marks that tell letters apart sit at the edges, and go first."),
        F.lit("Let the box grow with its text."),
    )


def _fixed(wrong: str, why: str, fix: str) -> Callable[[], tuple[Column, Column, Column]]:
    """Messages in which ``{script}`` stands for the label of the node's script."""

    def says() -> tuple[Column, Column, Column]:
        parts = wrong.split("{script}")
        first = F.lit(parts[0]) if len(parts) == 1 else _text(parts[0], _label(), parts[1])
        return first, F.lit(why), F.lit(fix)

    return says


RULES = [
    Rule("cursive-script-letter-spacing", "Letter spacing on joined letters", "critical", "high", CURSIVE, _spacing_fires, _spacing_says, limits="Spacing that a reader applies isn't seen."),
    Rule(
        "insufficient-line-height-for-script",
        "Lines too close for the script",
        "moderate",
        "heuristic",
        where(lambda s: s.min_line_height is not None),
        _height_fires,
        _height_says,
        wcag="1.4.8",
        limits="Only text of two lines or more is judged.",
        finding_wcag=lambda: F.when(_ratio() < 1.5, F.lit("1.4.8")),
    ),
    Rule(
        "missing-script-font-coverage",
        "No declared font for the script",
        "serious",
        "heuristic",
        where(lambda s: s.name != "latin"),
        lambda: _sure(_dominant().isin(*where(lambda s: s.name != "latin")) & _c("font_probe.fallbackSuspected") & (_count() >= 2)),
        _font_says,
        limits="A fallback is inferred from text widths.",
        needs=lambda: F.col("font_probe.fallbackSuspected"),
    ),
    Rule(
        "case-transform-on-caseless-script",
        "Case change on letters without case",
        "minor",
        "high",
        CASELESS,
        lambda: _sure(_dominant().isin(*CASELESS) & _word("css.textTransform").isin("uppercase", "lowercase", "capitalize") & (_c("latin_share") < 0.2)),
        _fixed("text-transform is set on {script} text.", "The emphasis meant by capitals doesn't appear.", "Use weight or colour for emphasis in this script."),
    ),
    Rule(
        "missing-dir-attribute",
        "Right-to-left text without a declared direction",
        "serious",
        "medium",
        RTL,
        lambda: _sure(_dominant().isin(*RTL) & (_count() >= 15) & _c("own_dir").isNull() & _c("inherited_dir").isNull()),
        _fixed("{script} text has no dir attribute on or above it.", "Punctuation and numbers land on the wrong side.", 'Put dir="rtl" on the element or the page.'),
        level=lambda: F.when(_c("computed_direction") == "rtl", F.lit("moderate")).otherwise(F.lit("serious")),
    ),
    Rule(
        "lang-script-mismatch",
        "Declared language written in another script",
        "serious",
        "medium",
        KNOWN,
        _lang_fires,
        lambda: (
            _text('The text is declared as "', _declared_lang(), '", which is written in ', F.array_join(F.transform(expected_scripts(_declared_lang()), _label), " or "), ", but ", rounded(_share() * 100, 0), "% of it is ", _label(), "."),
            F.lit("Voices, hyphenation and fonts are chosen by the declared language."),
            F.lit("Declare the language the text is in."),
        ),
    ),
    Rule(
        "physical-css-in-bidi-context",
        "Physical alignment in right-to-left context",
        "moderate",
        "medium",
        RTL,
        lambda: _sure((_c("computed_direction") == "rtl") & _word("css.textAlign").isin("left", "right")),
        lambda: (
            _text("text-align is ", _word("css.textAlign"), " in right-to-left context."),
            F.when(_word("css.textAlign") == "left", F.lit("Lines start at the far edge.")).otherwise(F.lit("It looks right now, and stays there when the direction changes.")),
            F.lit("Use start or end."),
        ),
    ),
    Rule(
        "unisolated-bidi-run",
        "Left-to-right run not isolated",
        "moderate",
        "heuristic",
        RTL,
        _bidi_fires,
        lambda: (
            _text('"', trimmed(_c("signs.bidi_run")), '" stands in ', _label(), " text without isolation."),
            F.lit("Marks beside it may be shown on its other side."),
            F.lit("Wrap it in bdi or give it a dir of its own."),
        ),
    ),
    Rule(
        "unmirrored-directional-icon",
        "Directional icon not mirrored",
        "minor",
        "heuristic",
        RTL,
        _icon_fires,
        lambda: (_text('"', _icon_evidence(), '" points as in left-to-right text.'), F.lit("Back and forward are exchanged for the reader."), F.lit("Mirror the icon in right-to-left context.")),
    ),
    Rule(
        "unsafe-word-break-for-script",
        "Word breaks the script can't have",
        "moderate",
        "medium",
        sorted({*CURSIVE, *SEGMENTED_MARKED, *SEGMENTED_PLAIN}),
        lambda: _sure((_break_parts() != "") & (_count() >= 2)),
        lambda: (_text(_break_parts(), " is set on ", _label(), " text."), F.lit("Words break where the script has no break, and read as other words."), F.lit("Leave breaking to the browser for this script.")),
    ),
    Rule("clipped-stacked-marks", "Marks cut off by the box", "moderate", "heuristic", MARKED, _clip_fires, _clip_says),
]
BY_ID = {r.id: r for r in RULES}


def rules_table(spark: SparkSession) -> DataFrame:
    rows = [(i, r.id, r.title, r.severity, r.confidence, r.affects, r.wcag, r.limits) for i, r in enumerate(RULES)]
    return spark.createDataFrame(rows, "rule_ord int, rule_id string, title string, severity string, confidence string, affected_scripts array<string>, wcag_ref string, limitations string")


FOUND = "page_id node_ord rule_id title severity confidence source script selector snippet what_is_wrong why_it_matters how_to_fix wcag_ref".split()


def found_by(nodes: DataFrame, rules: list[Rule], every: bool = False) -> DataFrame:
    """``page_id, node_ord`` and the finding's columns for analysed nodes; every node is read once, whatever the number of rules.

    Conditions are evaluated once a node; snippets and messages only where one holds. With ``every``
    a node without findings has a row too, ``first`` marks one row of each node, and that has its ``unknown`` samples.
    """
    if not every and all(r.needs for r in rules):
        nodes = nodes.where(_sure(reduce(or_, [_sure(r.needs()) for r in rules])))
    # A bit for each check: a list of them would take the conditions out of generated code.
    fired = F.lit(0)
    for i, r in enumerate(rules):
        fired = fired + F.when(r.fires(), F.lit(1 << i)).otherwise(F.lit(0))
    hit = once(measured(nodes), _fired=fired)
    hit = hit.withColumn("_shown", F.when(F.col("_fired") > 0, F.col("text"))) if every else hit.where("_fired > 0")
    own = F.filter(F.array(*[F.lit(i) for i in range(len(rules))]), lambda k: F.getbit("_fired", k) == 1)
    each = with_snippet(hit, "_snippet", "_shown" if every else "text")
    each = each.select("*", (F.posexplode_outer if every else F.posexplode)(own).alias("_at", "_rule"))
    first = F.coalesce(F.col("_at") == 0, F.lit(True))

    def of(value: Callable[[Rule], Column]) -> Column:
        out = F.lit(None).cast("string")
        for i, r in reversed(list(enumerate(rules))):
            out = F.when(F.col("_rule") == i, value(r)).otherwise(out)
        return out

    return each.select(
        "page_id",
        "node_ord",
        of(lambda r: F.lit(r.id)).alias("rule_id"),
        of(lambda r: F.lit(r.title)).alias("title"),
        of(lambda r: r.level() if r.level else F.lit(r.severity)).alias("severity"),
        of(lambda r: F.lit(r.confidence)).alias("confidence"),
        F.lit("script_aware").alias("source"),
        F.col("dominant_script").alias("script"),
        "selector",
        F.col("_snippet").alias("snippet"),
        of(lambda r: r.says()[0]).alias("what_is_wrong"),
        of(lambda r: r.says()[1]).alias("why_it_matters"),
        of(lambda r: r.says()[2]).alias("how_to_fix"),
        of(lambda r: r.finding_wcag() if r.finding_wcag else F.lit(None).cast("string")).alias("wcag_ref"),
        *([first.alias("first"), F.when(first, _c("signs.unknown")).alias("unknown")] if every else []),
    )
