"""HTML to text by layout-aware rendering.

A tree builder with implied end tags and visibility rules feeds a renderer that keeps block spacing,
numbers or marks list items and pads table cells into aligned columns; a cell of several lines takes
several lines, and head rows come first, foot rows last. Tree and renderer keep their own stacks, as
pages may nest without limit; items deeper than MARGIN lists are marked, but not moved further to
the right, and a table within MARGIN tables gives each cell one line.

Defined results: a null or empty page gives the empty text; unclosed tags close at the end of the
page; unknown tags are inline; a lone `<` is text; very long pages are rendered whole; repeated rows
are rendered each by itself; an empty table gives an empty one; an existing column of the result's
name is replaced, other columns stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, pieces

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACES = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript head title iframe object canvas audio video datalist defs desc metadata annotation annotation-xml".split())
VALUED = frozenset("submit button reset text search email url tel number date".split())  # inputs that show their value
MARGIN = 20
RAW = {"script": re.compile(r"</script\b[^>]*>?", re.I), "style": re.compile(r"</style\b[^>]*>?", re.I), "title": re.compile(r"</title\b[^>]*>?", re.I), "textarea": re.compile(r"</textarea\b[^>]*>?", re.I)}
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup html legend li main menu nav ol pre search section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())

#: An opening tag ends the open elements of the first set, up to the nearest of the second.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tr", "td", "th", "thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
    "thead": (frozenset(["tr", "td", "th", "thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["tr", "td", "th", "thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
#: Any other opening tag ends an open head, and so does text.
IN_HEAD = frozenset("title meta link base basefont bgsound script style noscript noframes template".split())
CLOSES_P = BLOCK | SPACED
STOPS_P = frozenset(["td", "th", "table", "li", "button", "object", "caption", "div", "section", "article", "body", "html"])


class Node:
    """An element; its children are nodes and strings."""

    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(source: str) -> dict[str, str]:
    return {name.lower(): unescape(a or b or c) for name, a, b, c in ATTRIBUTE.findall(source)} if source and not source.isspace() else {}


def parse(page: str) -> Node:
    """The element tree of a page."""
    root = Node("#root", {})
    stack, at, opened = [root], 0, Counter()

    def close(depth: int) -> None:
        """End the open elements from a depth on."""
        for node in stack[depth:]:
            opened[node.tag] -= 1
        del stack[depth:]

    def text(s: str) -> None:
        if stack[-1].tag == "head" and s.strip(" \t\n\r\f"):
            close(len(stack) - 1)
        stack[-1].children.append(s)

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None or m.start() > at:
            text(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[depth].tag == tag:
                    close(depth)
                    break
                if tag not in BLOCK and stack[depth].tag in ("td", "th", "table"):
                    break  # an inline end tag doesn't leave its cell
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            close(len(stack) - 1)
        if tag in CLOSES_P and opened["p"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    close(depth)
                    break
                if stack[depth].tag in STOPS_P:
                    break
        ends, until = IMPLIED.get(tag, ((), ()))
        cut = 0
        for depth in range(len(stack) - 1, 0, -1) if any(opened[x] for x in ends) else ():
            if stack[depth].tag in until:
                break
            if stack[depth].tag in ends:
                cut = depth
        if cut:
            close(cut)
        node = Node(tag, _attributes(m[3]))
        stack[-1].children.append(node)
        if tag in RAW:
            end = RAW[tag].search(page, at)
            node.children.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
            opened[tag] += 1
    return root


def _style(node: Node) -> str:
    return node.attributes.get("style", "").replace(" ", "").lower() if node.attributes else ""


def present(node: Node) -> bool:
    """Whether an element takes part in the layout."""
    if node.tag in HIDDEN:
        return False
    a = node.attributes
    if not a:
        return True
    return "hidden" not in a and a.get("aria-hidden", "").lower() != "true" and "display:none" not in _style(node) and not (node.tag == "input" and a.get("type", "").lower() == "hidden")


def shown(node: Node, before: bool) -> bool:
    """Whether an element's own text is visible, if its parent's is or isn't."""
    style = _style(node)
    return before and "visibility:hidden" not in style and "visibility:collapse" not in style or "visibility:visible" in style


class _Writer:
    """Lines of text with collapsed white space, behind the marks and margins of open list items."""

    def __init__(self, tables: int = 0) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = self.gap = False
        self.margin, self.mark, self.lists, self.tables = "", None, 0, tables

    def text(self, s: str) -> None:
        s = SPACES.sub(" ", s)
        if s == " ":
            self.space = True
            return
        if s.startswith(" ") or self.space:
            s = s.lstrip(" ")
            if self.parts:
                self.parts.append(" ")
        self.space = s.endswith(" ")
        self.parts.append(s.rstrip(" ") if self.space else s)

    def _line(self, line: str) -> None:
        if self.gap and self.lines and self.lines[-1] and not self.lists:
            self.lines.append("")
        self.gap = False
        if line or not self.lists:
            self.lines.append(((self.margin if self.mark is None else self.mark) + line) if line else "")
            self.mark = None

    def verbatim(self, s: str) -> None:
        first, *more = s.replace("\r\n", "\n").split("\n")
        self.parts.append(first)
        for line in more:
            self._line("".join(self.parts).rstrip())
            self.parts = [line]

    def end_line(self, always: bool = False) -> None:
        line = "".join(self.parts)
        if line or always:
            self._line(line)
        self.parts, self.space = [], False

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap |= spaced

    def item(self, mark: str):
        """Open a list item; what comes back closes it."""
        self.end_line()
        held = self.margin, self.mark
        self.mark = (self.margin if self.mark is None else self.mark) + mark
        if self.lists <= MARGIN:
            self.margin += " " * len(mark)

        def close() -> None:
            self.end_line()
            # A mark that no text has followed is left out; one that was used is gone for outer items too.
            self.margin, self.mark = held[0], held[1] if self.mark is not None else None

        return close

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def _render(root: Node) -> list[str]:
    """The lines of a tree."""
    whole = _Writer()
    todo: list = [(root, whole, False, True)]
    while todo:
        item, out, pre, seen = todo.pop()
        if callable(item):
            item()
        elif isinstance(item, str):
            if seen:
                out.verbatim(unescape(item)) if pre else out.text(unescape(item))
        elif present(item):
            tag, seen = item.tag, shown(item, seen)
            within = [(child, out, pre or tag == "pre", seen) for child in item.children]
            if tag == "br":
                out.end_line(always=True)
                continue
            if tag == "hr":
                out.block(True)
                out.parts.append("---" if seen else "")
                out.block(True)
                continue
            if tag in ("img", "input"):
                kind = item.attributes.get("type", "text").lower()
                value = item.attributes.get("value" if tag == "input" and kind in VALUED else "alt" if tag == "img" or kind == "image" else "", "")
                if seen and value:
                    out.text(value)
                continue
            if tag == "table":
                out.block(True)
                within = _table(item, out, pre, seen)
            elif tag in ("ul", "ol", "menu", "dir"):
                out.block(True)
                within = _list(item, out, pre, seen)
            elif tag in SPACED or tag in BLOCK:
                spaced = tag in SPACED
                out.block(spaced)
                within.append((lambda o=out, s=spaced: o.block(s), out, pre, seen))
            todo += reversed(within)
    return whole.done()


def _list(node: Node, out: _Writer, pre: bool, seen: bool) -> list:
    """What is to be rendered of a list: marked or numbered items, with what they hold below."""
    start = node.attributes.get("start", "")
    number = int(start) if node.tag == "ol" and re.fullmatch(r"-?[0-9]{1,9}", start) else 1
    steps: list = [(lambda: setattr(out, "lists", out.lists + 1), out, pre, seen)]
    closers: list = []
    for child in node.children:
        if isinstance(child, str) or child.tag != "li":
            steps.append((child, out, pre, seen))
        elif present(child):
            steps.append((lambda m=f"{number}. " if node.tag == "ol" else "- ": closers.append(out.item(m)), out, pre, seen))
            steps += [(x, out, pre, shown(child, seen)) for x in child.children]
            steps.append((lambda: closers.pop()(), out, pre, seen))
            number += 1

    def close() -> None:
        out.end_line()
        out.lists -= 1
        out.block(not out.lists)

    return [*steps, (close, out, pre, seen)]


def _span(cell: Node, name: str) -> int:
    value = cell.attributes.get(name, "1")
    return min(max(1, int(value)), 1000) if re.fullmatch(r"[0-9]{1,5}", value) else 1


def _table(node: Node, out: _Writer, pre: bool, seen: bool) -> list:
    """What is to be rendered of a table: captions and what stands outside of any cell, then its rows."""
    loose, cells = [], []
    rows: list[tuple[int, list[tuple[Node, _Writer]]]] = []
    todo = [(child, 1, seen) for child in reversed(node.children)]
    while todo:
        child, rank, visible = todo.pop()
        if isinstance(child, str) or child.tag not in ("tr", "td", "th", "thead", "tbody", "tfoot", "colgroup", "col"):
            loose += [(child, out, pre, visible), (out.end_line, out, pre, visible)]
        elif present(child):
            visible = shown(child, visible)
            if child.tag in ("tr", "td", "th"):  # a cell without a row is a row of its own
                row = []
                for cell in child.children if child.tag == "tr" else [child]:
                    if isinstance(cell, str) or cell.tag not in ("td", "th"):
                        loose += [(cell, out, pre, visible), (out.end_line, out, pre, visible)]
                    elif present(cell):
                        row.append((cell, writer := _Writer(out.tables + 1)))
                        cells += [(x, writer, pre, shown(cell, visible)) for x in cell.children]
                rows.append((rank, row))
            else:
                todo += [(x, {"thead": 0, "tfoot": 2}.get(child.tag, 1), visible) for x in reversed(child.children)]

    def close() -> None:
        out.end_line()
        for line in _grid([row for _, row in sorted(rows, key=lambda r: r[0])], out.tables < MARGIN):
            out.parts.append(line)
            out.end_line()
        out.block(True)

    return [*loose, *cells, (close, out, pre, seen)]


def _grid(rows: list[list[tuple[Node, _Writer]]], tall: bool) -> list[str]:
    """The lines of padded cells; cells that span columns or rows leave the others that they cover empty."""
    table: list[list[list[str]]] = []
    covered: dict[int, int] = {}
    for row in rows:
        line: list[list[str]] = []
        below: dict[int, int] = {}

        def skip() -> None:
            while covered.get(len(line), 0):  # noqa: B023
                below[len(line)] = covered[len(line)] - 1  # noqa: B023
                line.append([])  # noqa: B023

        for cell, writer in row:
            skip()
            found = [x for x in writer.done() if x.strip()]
            across, down = _span(cell, "colspan"), _span(cell, "rowspan")
            for k in range(across):
                if down > 1:
                    below[len(line)] = down - 1
                line.append((found if tall else [" ".join(x.strip() for x in found)] if found else []) if k == 0 else [])
        skip()
        covered = {k: n for k, n in below.items() if n}
        if any(line):
            table.append(line)
    widths = [max((len(x) for r in table if k < len(r) for x in r[k]), default=0) for k in range(max(map(len, table), default=0))]
    kept = [k for k, w in enumerate(widths) if w]
    return ["  ".join((r[k][n] if k < len(r) and n < len(r[k]) else "").ljust(widths[k]) for k in kept).rstrip() for r in table for n in range(max(map(len, r)))]


def render(page: str) -> str:
    """The visible text of a page."""
    return "\n".join(_render(parse(page))).strip("\n")


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """Replace the html column by the text it shows; every other column stays."""
    kept = [c for c in pages.columns if c not in (html, into)]
    schema = pages.select(*kept).withColumn(into, F.lit("").cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, html):
            texts = [render(x) if x else "" for x in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, into])

    return map_arrow(pages.select(*kept, html), run, schema)
