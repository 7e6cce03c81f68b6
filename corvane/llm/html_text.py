"""Visible text of HTML pages by a tree builder and a layout-aware renderer.

The builder closes what HTML lets authors leave open (paragraphs, list items,
table parts, options) and ignores end tags that match nothing. The renderer
walks the tree without recursion. It leaves out what isn't shown (head, scripts,
styles, templates, comments, elements with `hidden` or an inline style that
hides them), puts blocks on lines of their own with a blank line around
paragraphs, headings, lists and tables, indents list items under their marks,
keeps white space in <pre>, and pads the cells of a table to common columns.

Elements with `visibility: hidden` keep their place; what is visible again inside
them is shown. A closed dialog is hidden; what a <details> holds is shown. Cells
stand in the columns that spans of columns and rows leave them; a cell over
several columns widens the last of them.

Defined cases: null or empty HTML gives empty text. Broken markup never fails:
a "<" that starts no tag is text; a tag with a quote that never closes ends at the next
">"; an open comment, or a tag without any ">" after it, runs to the end. Very
long and very deep pages take time in proportion to their length. Each row is
independent, so that repeated rows and ids have results of their own; an empty
table gives an empty result. Only the two named columns are read, so that other
names can't clash.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_chunks

# Element names of the HTML standard by how they are laid out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title meta link iframe noembed noframes object audio video canvas datalist defs desc metadata symbol annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset".split())
BLOCK = SPACED | frozenset("html body address article aside details dialog dd div dt fieldset figcaption footer form header hgroup legend li main menu nav section summary tr caption center option optgroup search".split())
CLOSES_P = (BLOCK - frozenset("html body tr caption option optgroup dt dd li legend".split())) | frozenset(["li", "dt", "dd"])

#: A start tag of a key ends open elements of its first set, unless one of its second set is nearer.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "optgroup", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset()),
}
P_BARRIER = frozenset(["table", "td", "th", "button", "caption", "object"])
TABLE_PARTS = frozenset(["table", "td", "th", "tr", "caption"])

# A quote begins a value after "=" alone, and only if it closes; anywhere else it is a character like others.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*\"|'[^']*'|(?![\"'])[^\s>]*+))?+)*+)>")
_OPEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|(?![\"'])([^\s>]*+)))?+")
_COMMENT_END = re.compile(r"--!?>")
#: After so many tags with a quote that never closes, the rest of a page is read as if quotes meant nothing, so that each costs its own length.
UNCLOSED = 50
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.attributes = tag, attributes
        self.children: list[Node | str] = []

    def attribute(self, name: str) -> str | None:
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return unescape(m[2] or m[3] or m[4] or "")
        return None

    def style(self) -> dict[str, str]:
        """Properties of the inline style, in lower case."""
        if "style" not in self.attributes.lower():
            return {}
        pairs = (x.split(":", 1) for x in (self.attribute("style") or "").lower().split(";") if ":" in x)
        return {name.strip(): value.replace("!important", "").strip() for name, value in pairs}

    def hidden(self, style: dict[str, str]) -> bool:
        """Whether nothing inside can be seen."""
        if self.tag in UNSEEN or self.tag == "dialog" and self.attribute("open") is None:
            return True
        if "hidden" in self.attributes.lower() and (self.attribute("hidden") is not None or (self.tag == "input" and self.attribute("type") == "hidden")):
            return True
        return style.get("display") == "none" or style.get("content-visibility") == "hidden"


def build(html: str) -> Node:
    """The element tree of a page."""
    root = Node("#root")
    stack, at, size = [root], 0, len(html)
    last_end, unclosed = html.rfind(">"), 0
    depths: dict[str, list[int]] = defaultdict(list)  # of each tag: where in the stack it is open

    def cut(depth: int) -> None:
        for node in stack[depth:]:
            depths[node.tag].pop()
        del stack[depth:]

    def last(tags: frozenset[str]) -> int:
        return max((depths[t][-1] for t in tags if depths[t]), default=0)

    def nearest(wanted: frozenset[str], barrier: frozenset[str]) -> int:
        """Depth of the outermost open element of wanted above the barrier; 0 if there is none."""
        above = last(barrier)
        found = [d[k] for t in wanted if (d := depths[t]) and (k := bisect_right(d, above)) < len(d)]
        return min(found, default=0)

    def put(text: str) -> None:
        if text:
            stack[-1].children.append(unescape(text) if "&" in text else text)

    while at < size:
        start = html.find("<", at)
        if start < 0:
            put(html[at:])
            break
        put(html[at:start])
        if html.startswith("<!--", start):
            end = _COMMENT_END.search(html, start + 4)
            short = next((x for x in ("<!-->", "<!--->") if html.startswith(x, start)), None)
            at = start + len(short) if short else end.end() if end else size
            continue
        if html.startswith(("<!", "<?"), start):
            end = html.find(">", start)
            at = size if end < 0 else end + 1
            continue
        m = _TAG.match(html, start) if unclosed < UNCLOSED else None
        if not m and re.match(r"</?[a-zA-Z]", html[start : start + 3]):
            if start > last_end:
                break  # a tag that never ends
            m = _OPEN_TAG.match(html, start)
            unclosed += 1
        if not m:
            put("<")
            at = start + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag == "p" and not depths["p"]:
                stack[-1].children.append(Node("p"))
            elif depths[tag] and (tag in TABLE_PARTS or depths[tag][-1] >= last(P_BARRIER)):
                cut(depths[tag][-1])
            continue
        if tag in CLOSES_P and depths["p"] and (depth := nearest(frozenset(["p"]), P_BARRIER)):
            cut(depth)
        if tag in IMPLIED and (depth := nearest(*IMPLIED[tag])):
            cut(depth)
        node = Node(tag, m[3].rstrip("/") if m[3] else "")
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            body = html[at : end.start() if end else size]
            node.children.append(unescape(body) if tag in ("textarea", "title") else body)
            at = end.end() if end else size
            continue
        depths[tag].append(len(stack))
        stack.append(node)
    return root


class Page:
    """Lines of output; text runs collapse their white space, blocks begin lines."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.some = False  # whether the line has anything but spaces
        self.blank = False

    def text(self, value: str) -> None:
        value = _SPACE.sub(" ", value)
        if not self.parts or self.parts[-1].endswith(" "):
            value = value.lstrip(" ")
        self.put(value)

    def put(self, value: str) -> None:
        if value:
            self.parts.append(value)
            self.some = self.some or bool(value.strip())

    def verbatim(self, value: str) -> None:
        first, *others = value.replace("\r\n", "\n").split("\n")
        self.put(first)
        for x in others:
            self.break_line()
            self.put(x)

    def break_line(self) -> None:
        """End the line, if only to leave it empty."""
        if self.some:
            self.end_line()
            return
        self.parts.clear()
        if self.lines and self.blank:
            self.lines.append("")
            self.blank = False
        if self.lines:
            self.lines.append("")

    def end_line(self) -> None:
        if self.some:
            if self.blank and self.lines:
                self.lines.append("")
            self.lines.append("".join(self.parts).rstrip())
            self.blank = False
        self.parts.clear()
        self.some = False

    def gap(self) -> None:
        self.end_line()
        self.blank = True

    def add(self, lines: list[str]) -> None:
        """Lines that are laid out already."""
        self.end_line()
        if lines:
            if self.blank and self.lines:
                self.lines.append("")
            self.lines += lines
            self.blank = False

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


#: Lines of a cell, and the columns and rows that it spans; 0 rows: all that follow.
Cell = tuple[list[str], int, int]


def placed(rows: list[list[Cell]]) -> list[list[tuple[int, int, list[str]]]]:
    """(column, columns spanned, lines) of each row's cells; cells of rows before may hold columns."""
    held: dict[int, int] = {}  # column: last row that holds it
    out = []
    for i, row in enumerate(rows):
        at, cells = 0, []
        for lines, span, deep in row:
            while held.get(at, -1) >= i:
                at += 1
            cells.append((at, span, lines))
            if deep != 1:
                held |= dict.fromkeys(range(at, at + span), i + deep - 1 if deep else len(rows))
            at += span
        out.append(cells)
    return out


def aligned(rows: list[list[Cell]]) -> list[str]:
    """Rows of cells as text with common column starts."""
    widths: dict[int, int] = defaultdict(int)
    laid = placed(rows)
    for row in laid:
        for at, span, lines in row:
            if span == 1:
                widths[at] = max([widths[at], *map(len, lines)])
    for row in laid:
        for at, span, lines in row:
            if span > 1:
                room = sum(widths[k] for k in range(at, at + span)) + 2 * (span - 1)
                widths[at + span - 1] += max([0, *(len(x) - room for x in lines)])
    starts, start = {}, 0
    for k in range(max((at + span for row in laid for at, span, _ in row), default=0)):
        starts[k] = start
        start += widths[k] + 2
    out = []
    for row in laid:
        for i in range(max([1, *(len(lines) for _, _, lines in row)])):
            line = ""
            for at, _, lines in row:
                if i < len(lines):
                    line = line.ljust(starts[at]) + lines[i]
            if line.strip():
                out.append(line.rstrip())
    return out


def render(html: str | None) -> str:
    """All visible text of a page."""
    if not html:
        return ""
    pages: list[Page] = [Page()]
    lists: list[list] = []  # of each open list: its tag and next number
    tables: list[list[list[Cell]]] = []
    seen = [True]  # of each open element that says so: whether its text is visible
    pre = 0
    work: list[tuple[Node | str, bool]] = [(build(html), True)]
    while work:
        node, opens = work.pop()
        page = pages[-1]
        if isinstance(node, str):
            if seen[-1]:
                page.verbatim(node) if pre else page.text(node)
            continue
        tag = node.tag
        if opens:
            style = node.style() if node.attributes else {}
            if node.hidden(style):
                continue
            if tag == "br":
                page.break_line()
                continue
            visibility = style.get("visibility", "inherit")
            seen.append(seen[-1] if visibility not in ("visible", "hidden", "collapse") else visibility == "visible")
            if tag in SPACED and not (tag in ("ul", "ol") and lists):
                page.gap()
            elif tag in BLOCK:
                page.end_line()
            if tag in ("ul", "ol", "menu"):
                first = node.attribute("start") if tag == "ol" else None
                lists.append([tag, int(first) if first and re.fullmatch(r"-?\d{1,9}", first) else 1])
            elif tag == "li" or tag in ("td", "th", "caption"):
                pages.append(Page())
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("pre", "textarea"):
                pre += 1
            work.append((node, False))
            work += [(x, True) for x in reversed(node.children)]
            continue
        seen.pop()
        if tag in ("pre", "textarea"):
            pre -= 1
            page.end_line()
        if tag == "li":
            lines = pages.pop().done()
            mark = "- "
            if lists and lists[-1][0] == "ol":
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            if lines:
                pages[-1].add([mark + lines[0], *((" " * len(mark) + x).rstrip() for x in lines[1:])])
            continue
        if tag in ("td", "th", "caption"):
            lines = pages.pop().done()
            if tag == "caption" or not tables:
                pages[-1].add(lines)
            else:
                if not tables[-1]:
                    tables[-1].append([])
                number = lambda name, most: min(int(x), most) if node.attributes and re.fullmatch(r"\d{1,5}", x := node.attribute(name) or "") else 1  # noqa: E731,B023
                tables[-1][-1].append((lines, max(1, number("colspan", 1000)), number("rowspan", 65534)))
            continue
        if tag == "table" and tables:
            page.add(aligned(tables.pop()))
        if tag in ("ul", "ol", "menu") and lists:
            lists.pop()
        if tag in SPACED and not (tag in ("ul", "ol") and lists):
            page.gap()
        elif tag in BLOCK:
            page.end_line()
    return "\n".join(pages[0].done())


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, text) of each row."""
    source = pages.select(pages[id_col].alias(id_col), pages[html_col].alias("_html" if id_col != "_html" else "_html_"))
    html = source.columns[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, html):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([render(x) for x in part.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, text string")
