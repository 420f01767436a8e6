"""Text nodes from raw HTML, for pages without a captured snapshot.

Only what the markup says is known: layout values are null, and the checks that need them stay
silent. ``capture_mode`` is ``static`` on every row, so a page without findings isn't called clean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_NODES, MOST_TEXT = 3000, 500
SILENT = {"SCRIPT", "STYLE", "NOSCRIPT", "TEMPLATE"}
VOID = {"AREA", "BASE", "BR", "COL", "EMBED", "HR", "IMG", "INPUT", "LINK", "META", "SOURCE", "TRACK", "WBR"}
CODE = {"CODE", "PRE", "KBD", "SAMP"}
# What an opening tag closes, and where the search for it ends.
_CELL = {"TD", "TH"}
_ROWS = {"THEAD", "TBODY", "TFOOT"}
CLOSES = {
    "LI": ({"LI"}, {"UL", "OL", "MENU"}),
    **dict.fromkeys(("DT", "DD"), ({"DT", "DD"}, {"DL"})),
    **dict.fromkeys(("OPTION", "OPTGROUP"), ({"OPTION"}, {"SELECT", "DATALIST"})),
    **dict.fromkeys(_CELL, (_CELL, {"TR", "TABLE"})),
    "TR": ({"TR"} | _CELL, _ROWS | {"TABLE"}),
    **dict.fromkeys(_ROWS, (_ROWS | {"TR"} | _CELL, {"TABLE"})),
}
ENDS_PARAGRAPH = set("ADDRESS ARTICLE ASIDE BLOCKQUOTE DETAILS DIV DL FIELDSET FIGCAPTION FIGURE FOOTER FORM H1 H2 H3 H4 H5 H6 HEADER HGROUP HR LI DD DT MAIN MENU NAV OL P PRE SECTION SUMMARY TABLE UL".split())
_SCOPE = {"BUTTON", "CAPTION", "HTML", "OBJECT", "TABLE", "TD", "TH"}
_HIDDEN = re.compile(r"(display\s*:\s*none|visibility\s*:\s*(hidden|collapse))", re.I)
_TRANSFORM = re.compile(r"(?:^|;)\s*transform\s*:\s*([^;]+)", re.I)
NODES = "page_id string, node_ord int, selector string, text string, own_lang string, inherited_lang string, own_dir string, inherited_dir string, ancestor_has_dir_rtl boolean, class_names array<string>, tag_name string, has_bdi_ancestor boolean, has_code_ancestor boolean, has_transformed_ancestor boolean, document_lang string, document_dir string, truncated boolean, capture_mode string"


#: White space of any kind at both ends of a text.
BLANK_ENDS = r"^[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+|[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+$"
_BLANKS = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def anchor(name: str) -> str:
    """The selector of an id: letters, digits, ``-``, ``_`` and all beyond ASCII as they are, other characters escaped."""
    out = []
    for i, c in enumerate(name):
        if c == "\0":
            out.append("\ufffd")
        elif c < " " or c == "\x7f" or (c.isdigit() and c < "\x80" and (i == 0 or (i == 1 and name[0] == "-"))):
            out.append(f"\\{ord(c):x} ")
        elif (c.isalnum() or c in "-_" or c >= "\x80") and name != "-":
            out.append(c)
        else:
            out.append("\\" + c)
    return "#" + "".join(out)


class _Element:
    __slots__ = ("attrs", "children", "hidden", "nth", "ord", "own_hidden", "parent", "siblings", "tag")

    def __init__(self, tag: str, attrs: dict, parent: _Element | None, tops: dict[str, int]):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: dict[str, int] = {}
        #: Elements by tag beside this one; ``tops`` counts those that stand in none.
        self.siblings = tops if parent is None else parent.children
        self.nth = self.siblings[tag] = self.siblings.get(tag, 0) + 1
        self.own_hidden = "hidden" in attrs or bool(_HIDDEN.search(attrs.get("style") or ""))
        self.hidden = self.own_hidden or (parent is not None and parent.hidden)

    def path(self) -> str:
        """From the nearest element with an id, or from the root; numbered where siblings have the same tag."""
        parts, e = [], self
        while e is not None:
            if e.attrs.get("id"):
                parts.append(anchor(e.attrs["id"]))
                break
            alone = e.siblings[e.tag] == 1 or (e.parent is None and e.tag == "HTML")
            parts.append(e.tag.lower() if alone else f"{e.tag.lower()}:nth-of-type({e.nth})")
            e = e.parent
        return " > ".join(reversed(parts))

    def above(self) -> Iterator[_Element]:
        e = self.parent
        while e is not None:
            yield e
            e = e.parent

    def nearest(self, name: str) -> str | None:
        return next((e.attrs[name] for e in self.above() if (e.attrs.get(name) or "").strip()), None)


class TextNodes(HTMLParser):
    """Visible text nodes in document order."""

    def __init__(self, most_nodes: int, most_text: int):
        super().__init__(convert_charrefs=True)
        self.most_nodes, self.most_text = most_nodes, most_text
        self.at: _Element | None = None
        self.root: _Element | None = None
        self.tops: dict[str, int] = {}
        self.rows: list[tuple[_Element, str]] = []
        self.truncated = False

    def _close(self, names: set[str], scope: set[str]) -> None:
        """Ends the open elements of these names, up to one that bounds them."""
        e, last = self.at, None
        while e is not None and e.tag not in scope:
            if e.tag in names:
                last = e
            e = e.parent
        if last is not None:
            self.at = last.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag.upper() in ENDS_PARAGRAPH:
            self._close({"P"}, _SCOPE)
        if tag.upper() in CLOSES:
            self._close(*CLOSES[tag.upper()])
        e = _Element(tag.upper(), {k: ("" if v is None else v) for k, v in reversed(attrs)}, self.at, self.tops)
        self.root = self.root or e
        self.opened(e)
        if e.tag not in VOID:
            self.at = e

    def opened(self, e: _Element) -> None:
        """Called for every element as it begins."""

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        before = self.at
        self.handle_starttag(tag, attrs)
        self.at = before

    def handle_endtag(self, tag: str) -> None:
        e = self.at
        while e is not None and e.tag != tag.upper():
            e = e.parent
        if e is not None:
            self.at = e.parent

    def handle_data(self, data: str) -> None:
        if self.at is None:
            return
        if len(self.rows) >= self.most_nodes:
            self.truncated = True
            return
        text = data.strip(_BLANKS)
        if text and self.at.tag not in SILENT and self.at.tag not in ("HEAD", "TITLE") and not self.at.hidden:
            self.rows.append((self.at, text))


def turned(e: _Element) -> bool:
    """Whether an element's own style has a transform."""
    m = _TRANSFORM.search(e.attrs.get("style") or "")
    return bool(m) and m[1].strip().lower() != "none"


def _utf16_cut(text: str, most: int) -> str:
    return text if len(text) * 2 <= most else text.encode("utf-16-le", "surrogatepass")[: 2 * most].decode("utf-16-le", "ignore")


def utf16_cut(text: str, most: int) -> Column:
    """The first UTF-16 units of a text column, as ``_utf16_cut``."""
    units = F.encode(text, "UTF-16LE")
    # Half a pair at the end goes as well.
    halved = F.hex(F.substring(units, 2 * most, 1)).between("D8", "DB")
    cut = F.substring(units, F.lit(1), F.when(halved, F.lit(2 * most - 2)).otherwise(F.lit(2 * most)))
    return F.when(F.octet_length(units) <= 2 * most, F.col(text)).otherwise(F.decode(cut, "UTF-16LE"))


def nodes_of(page_id: str, html: str | None, most_nodes: int = MOST_NODES, most_text: int = MOST_TEXT) -> list[tuple]:
    parser = TextNodes(most_nodes, most_text)
    parser.feed(html or "")
    parser.close()
    root = parser.root.attrs if parser.root is not None and parser.root.tag == "HTML" else {}
    out = []
    for i, (e, text) in enumerate(parser.rows):
        line = [e, *e.above()]
        out.append(
            (page_id, i, e.path(), _utf16_cut(text, most_text), e.attrs.get("lang"), e.nearest("lang"), e.attrs.get("dir"), e.nearest("dir"), any((x.attrs.get("dir") or "").lower() == "rtl" for x in line),
             (e.attrs.get("class") or "").split(), e.tag, any(x.tag == "BDI" for x in line), any(x.tag in CODE for x in line), any(map(turned, line[1:])), root.get("lang"), root.get("dir"), parser.truncated, "static")
        )
    return out


def text_nodes(pages: DataFrame, most_nodes: int = MOST_NODES, most_text: int = MOST_TEXT) -> DataFrame:
    """Text nodes of ``pages(page_id, html)``, at most so many a page and so many UTF-16 units each."""
    names = [c.split(" ")[0] for c in NODES.split(", ")]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for p, h in zip(frame["page_id"], frame["html"], strict=True) for r in nodes_of(p, h, most_nodes, most_text)]
            yield pd.DataFrame(rows, columns=names)

    return pages.select(F.col("page_id").cast("string"), "html").mapInPandas(work, NODES)


def as_snapshot(nodes: DataFrame) -> DataFrame:
    """Static nodes with the snapshot's other columns: direction from the markup, layout unknown."""
    unknown = {
        "css": "struct<letterSpacing:string,lineHeight:string,fontSize:string,fontFamily:string,textAlign:string,textTransform:string,transform:string,wordBreak:string,hyphens:string,overflowX:string,overflowY:string,webkitLineClamp:string,clip:string,clipPath:string>",
        "box": "struct<clientHeight:int,scrollHeight:int,clientWidth:int,scrollWidth:int>",
        "font_probe": "struct<declaredStack:array<string>,renderedFamily:string,fallbackSuspected:boolean>",
    }
    direction = F.when(F.lower(F.coalesce(F.nullif("own_dir", F.lit("")), "inherited_dir")) == "rtl", F.lit("rtl")).otherwise(F.lit("ltr"))
    return nodes.withColumns({k: F.lit(None).cast(t) for k, t in unknown.items()} | {"computed_direction": direction})
