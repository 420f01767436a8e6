"""Small column functions: CSS values, language tags, URLs, numbers, errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphaudit.dims import LANGUAGES, SUBTAGS
from glyphaudit.functions.scripts import trimmed

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


def pixel_length(css: Column) -> Column:
    """The number of a ``px`` length; null for keywords and other units."""
    v = trimmed(css)
    return F.when(v.endswith("px"), F.regexp_extract(v, _NUMBER, 0).try_cast("double"))


def _table(table: dict[str, list[str]]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, ",".join(v))])


def expected_scripts(tag: Column) -> Column:
    """Scripts a language tag stands for: by its script subtag if it has one, else by its language; empty if unknown."""
    parts = F.filter(F.split(F.lower(trimmed(tag)), "-"), lambda p: p != "")
    second = F.get(parts, 1)
    by_script = F.coalesce(second.rlike("^[a-z]{4}$"), F.lit(False))
    found = F.when(by_script, _table(SUBTAGS)[second]).otherwise(_table(LANGUAGES)[F.get(parts, 0)])
    return F.coalesce(F.split(found, ","), F.array().cast("array<string>"))


def rounded(x: Column, decimals: int = 2) -> Column:
    """Fixed decimals as text, without trailing zeros."""
    fixed = F.format_string(f"%.{decimals}f", x.cast("double"))
    return F.when(fixed.contains("."), F.regexp_replace(fixed, r"\.?0+$", "")).otherwise(fixed)


def percent(part: Column, whole: Column) -> Column:
    """Percent with one decimal, halves up; 0 of nothing is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.floor(part.cast("double") / F.nullif(whole, F.lit(0)) * 1000 + 0.5) / 10)


def reverses_or_turns(transform: Column) -> Column:
    """Whether a CSS transform matrix mirrors horizontally, turns or skews."""
    v = trimmed(transform)
    n = F.transform(F.split(F.regexp_extract(v, r"\((.*)\)", 1), ","), lambda x: trimmed(x).try_cast("double"))
    fine = ~F.exists(n, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    a, b = F.get(n, F.lit(0)), F.get(n, F.lit(1))
    c = F.when(F.size(n) == 16, F.get(n, F.lit(4))).otherwise(F.get(n, F.lit(2)))
    changed = fine & a.isNotNull() & b.isNotNull() & c.isNotNull() & ((a < 0) | (b != 0) | (c != 0))
    return F.coalesce(F.when((v == "") | (v == "none"), F.lit(False)).otherwise(changed), F.lit(False))


def visually_hidden(clip: Column, clip_path: Column, height: Column, width: Column) -> Column:
    """Text kept for screen readers only: clipped to nothing in a box of two pixels at most."""
    clipped = trimmed(clip).rlike(r"^rect\(\s*1px[,\s]+1px[,\s]+1px[,\s]+1px\s*\)$") | trimmed(clip_path).rlike(r"^inset\(\s*100%\s*\)$")
    return F.coalesce(clipped & (height <= 2) & (width <= 2), F.lit(False))


def font_stack(family: Column) -> Column:
    """Names of a font-family list, one quote removed at either end."""
    names = F.transform(F.split(family, ","), lambda x: trimmed(F.regexp_replace(trimmed(x), "^[\"']|[\"']$", "")))
    return F.filter(names, lambda x: x != "")


def font_probe(family: Column, declared: Column, baseline: Column, widths: Column) -> Column:
    """``struct<declaredStack, renderedFamily, fallbackSuspected>`` from measured widths of a text.

    ``declared`` is its width in the declared fonts, ``baseline`` in a family that doesn't exist,
    ``widths`` an array with that in each family of the list alone. A fallback is suspected where
    declared fonts make no difference; the first family that does is the one rendered.
    """
    stack = font_stack(family)
    first = F.filter(F.arrays_zip(stack.alias("name"), widths.alias("width")), lambda x: x["width"] != baseline)
    return F.struct(stack.alias("declaredStack"), F.get(first, F.lit(0))["name"].alias("renderedFamily"), (declared == baseline).alias("fallbackSuspected"))


def escape_html(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def day_of(timestamp: Column) -> Column:
    return F.substring(timestamp, 1, 10)


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)


def robots_url(url: Column) -> Column:
    return F.concat(F.lower(origin(url)), F.lit("/robots.txt"))


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def is_loopback(url: Column) -> Column:
    return host(url).isin("127.0.0.1", "localhost", "[::1]")


def file_safe_host(url: Column) -> Column:
    return F.regexp_replace(host(url), "[^a-z0-9.-]+", "_")


def delay_after(url: Column, configured_ms: Column, crawl_delay_s: Column) -> Column:
    """Milliseconds to wait after a site: two seconds at least unless it is local."""
    floor = F.when(is_loopback(url), F.lit(0)).otherwise(F.lit(2000))
    asked = F.coalesce(F.floor(crawl_delay_s * 1000 + 0.5), F.lit(0))
    return F.greatest(floor.cast("long"), configured_ms.cast("long"), asked.cast("long"))


# Which network error codes mean what, the first match counts.
ERROR_KINDS = [
    ("ERR_NAME_NOT_RESOLVED", "dns-failure"),
    ("ERR_NAME_RESOLUTION_FAILED", "dns-failure"),
    ("ERR_CONNECTION_TIMED_OUT", "unreachable-host"),
    ("ERR_CONNECTION_REFUSED", "unreachable-host"),
    ("ERR_CONNECTION_RESET", "unreachable-host"),
    ("ERR_CONNECTION_CLOSED", "unreachable-host"),
    ("ERR_CONNECTION_FAILED", "unreachable-host"),
    ("ERR_ADDRESS_UNREACHABLE", "unreachable-host"),
    ("ERR_SOCKET_NOT_CONNECTED", "unreachable-host"),
    ("ERR_EMPTY_RESPONSE", "empty-body"),
    ("ERR_TOO_MANY_REDIRECTS", "redirect-loop"),
    ("ERR_SSL_PROTOCOL_ERROR", "invalid-ssl"),
    ("ERR_CERT_", "invalid-ssl"),
    ("ERR_SSL_", "invalid-ssl"),
    ("ERR_UNSAFE_PORT", "blocked-port"),
    ("ERR_TIMED_OUT", "timeout"),
]
ERROR_MESSAGES = {
    "timeout": "Loading took longer than allowed.",
    "dns-failure": "The host name has no address.",
    "unreachable-host": "The host could not be reached.",
    "empty-body": "The answer was empty.",
    "redirect-loop": "The address redirects without end.",
    "invalid-ssl": "The secure connection failed.",
    "blocked-port": "The port is not allowed.",
    "non-html": "The answer is not a web page.",
    "unknown": "Loading failed for an unknown reason.",
}


def error_kind(detail: Column) -> Column:
    out = F.lit("unknown")
    for code, kind in reversed(ERROR_KINDS):
        out = F.when(detail.contains(code), F.lit(kind)).otherwise(out)
    return F.when(detail.contains("Timeout"), F.lit("timeout")).otherwise(out)


def error_message(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in ERROR_MESSAGES.items() for x in kv])[kind]


def href(url: Column) -> Column:
    """An http address as a browser spells it: scheme and host in lower case, no default port, at least the root's slash."""
    bare = F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    authority = F.regexp_extract(bare, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    user = F.regexp_extract(authority, "^(.*@)", 1)
    port = F.when(scheme == "http", F.lit(":(80)?$")).when(scheme == "https", F.lit(":(443)?$")).otherwise(F.lit(":$"))
    host = F.regexp_replace(F.lower(F.regexp_extract(authority, "([^@]*)$", 1)), port, F.lit(""))
    rest = F.regexp_extract(bare, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(.*)$", 1)
    return F.concat(scheme, F.lit("://"), user, host, F.when(rest.startswith("/"), F.lit("")).otherwise(F.lit("/")), rest)
