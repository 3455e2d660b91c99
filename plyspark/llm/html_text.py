"""Layout-aware text of HTML pages.

A small tree builder follows the rules that pages lean on: void elements, implied start and end tags (p, li,
dt, dd, option, tr, td, th, table sections), raw text in script and style, entities, stray and missing end
tags.  A quote opens a value only behind a =, and one that is never closed ends with its tag.  Elements may
be nested as deep as they are: nothing here calls itself.

Visibility: head, script, style, template, noscript, hidden form data, the hidden attribute, closed details
(but for their summary) and dialogs, and inline display:none show nothing; inline visibility is inherited,
so a visible part of a hidden one shows.  Style sheets are not applied.  Everything else shows.

The renderer keeps block spacing (paragraphs and headings stand apart by an empty line, other blocks by a
line end), list marks with nesting and numbering, preformatted text, no-break spaces, and table cells in
aligned columns: cells stand on a grid that honours colspan and rowspan (limits as in HTML: 1000 columns,
65534 rows), heads first and feet last.  Text astray in a table stands above it.

Defined results: null html gives null text, html without visible text an empty one; rows with equal or
null ids each give a row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes".split())
ESCAPABLE_RAW = frozenset(["title", "textarea"])
UNSEEN = frozenset("head script style noscript template iframe noembed noframes title datalist audio video canvas rp desc defs metadata annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset".split())
BLOCK = SPACED | frozenset("address article aside body dd details dialog div dt figcaption footer form header hgroup html legend li main menu nav optgroup option section summary center tr caption thead tbody tfoot".split())
CLOSES_P = (BLOCK - frozenset("body html option optgroup legend caption tr thead tbody tfoot".split()))
#: A start tag ends these open elements, looking no further out than the scope.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "table", "td", "th"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table", "td", "th"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table", "td", "th"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["table", "thead", "tbody", "tfoot"])),
    "thead": (frozenset(["tr", "td", "th", "thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
    "tbody": (frozenset(["tr", "td", "th", "thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["tr", "td", "th", "thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
#: The parts of a table that a cell or row may stand in.
SECTIONS = frozenset(["thead", "tbody", "tfoot"])
FOREIGN = frozenset(["svg", "math"])
TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<!\[CDATA\[|<[!?/](?![A-Za-z])[^>]*>?|<![^>]*>?"
    r"|</([A-Za-z][^\s/>]*)[^>]*>?"
    r"|<([A-Za-z][^\s/>]*)((?:[^>\"'=]+|=\s*+(?:\"[^\"]*\"|'[^']*')|[=\"'])*+)>?"
    r"|[^<]+|<",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?", re.S)
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
BLANK = " \t\n\r\f"
BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], children: list | None = None):
        self.tag, self.attrs, self.children = tag, attrs, [] if children is None else children


def attributes(source: str) -> dict[str, str]:
    if not source or source.isspace():
        return {}
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


class Opened:
    """The open elements, outermost first, and how many of each name."""

    def __init__(self, root: Node):
        self.nodes, self.names = [root], Counter([root.tag])

    @property
    def last(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.nodes.append(node)
        self.names[node.tag] += 1

    def cut(self, at: int) -> None:
        for node in self.nodes[at:]:
            self.names[node.tag] -= 1
        del self.nodes[at:]

    def any(self, names: frozenset[str]) -> bool:
        return any(self.names[n] for n in names)


def parse(source: str) -> Node:
    root = Node("html", {})
    opened = Opened(root)
    at, end = 0, len(source)
    while at < end:
        m = TOKEN.match(source, at)
        at = m.end()
        text = m[0]
        if m[2]:
            tag = m[2].lower()
            if tag == "html":
                continue
            closing(opened, tag)
            node = Node(tag, attributes(m[3]))
            if tag in ("td", "th") and opened.last.tag in SECTIONS | {"table"}:
                row = Node("tr", {})
                opened.last.children.append(row)
                opened.push(row)
            opened.last.children.append(node)
            if tag == "plaintext":
                node.children.append(source[at:])
                at = end
            elif tag in RAW or tag in ESCAPABLE_RAW:
                close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
                inner = source[at : close.start() if close else end]
                if tag in ESCAPABLE_RAW:
                    node.children.append(html.unescape(inner))
                at = close.end() if close else end
            elif tag not in VOID and not (text.endswith("/>") and opened.any(FOREIGN)):
                opened.push(node)
        elif m[1]:
            ending(opened, m[1].lower())
        elif text == "<![CDATA[":
            close = source.find("]]>" if opened.any(FOREIGN) else ">", at)
            if opened.any(FOREIGN):
                opened.last.children.append(source[at : close if close >= 0 else end])
            at = end if close < 0 else close + (3 if opened.any(FOREIGN) else 1)
        elif not text.startswith(("<!", "<?", "</")):
            value = html.unescape(text)
            if opened.last.tag == "head" and value.strip(BLANK):
                opened.cut(len(opened.nodes) - 1)  # text ends the head
            opened.last.children.append(value)
    return root


def ending(opened: Opened, tag: str) -> None:
    """What an end tag does."""
    if tag == "br":
        opened.last.children.append(Node("br", {}))
    elif not opened.names[tag]:
        if tag == "p":
            opened.last.children.append(Node("p", {}))
    else:
        fence = frozenset(["table", "html"]) if tag not in ("table", "html", "body") else frozenset(["html"])
        nodes = opened.nodes
        for i in range(len(nodes) - 1, 0, -1):
            if nodes[i].tag == tag:
                opened.cut(i)
                break
            if nodes[i].tag in fence or (nodes[i].tag in ("td", "th", "li") and tag not in BLOCK and tag not in ("td", "th")):
                break


def closing(opened: Opened, tag: str) -> None:
    """Ends the elements whose end tag the start tag implies."""
    nodes = opened.nodes
    if opened.last.tag == "head" and tag not in ("title", "meta", "link", "style", "script", "base", "noscript", "template"):
        opened.cut(len(nodes) - 1)
    if tag in CLOSES_P and opened.names["p"]:
        for i in range(len(nodes) - 1, 0, -1):
            if nodes[i].tag == "p":
                opened.cut(i)
                break
            if nodes[i].tag in BLOCK or nodes[i].tag in ("td", "th", "button"):
                break
    if tag in IMPLIED and opened.any(IMPLIED[tag][0]):
        ends, scope = IMPLIED[tag]
        cut = None
        for i in range(len(nodes) - 1, 0, -1):
            if nodes[i].tag in scope:
                break
            if nodes[i].tag in ends:
                cut = i
        if cut:
            opened.cut(cut)


def styles(source: str) -> dict[str, str]:
    """The declarations of a style attribute; of two for one property the last counts, but for important ones."""
    found: dict[str, tuple[bool, str]] = {}
    for part in COMMENT.sub(" ", source).split(";"):
        name, colon, value = part.partition(":")
        if colon:
            value, mark, _ = value.lower().partition("!")
            key = name.strip().lower()
            if key not in found or mark or not found[key][0]:
                found[key] = bool(mark), value.strip()
    return {k: v for k, (_, v) in found.items()}


def visibility(node: Node, inherited: bool) -> bool | None:
    """None: the element makes no boxes; else whether its own text is visible."""
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden") or (node.tag == "dialog" and "open" not in a):
        return None
    if "style" in a:
        own = styles(a["style"])
        if own.get("display") == "none":
            return None
        if own.get("visibility") in ("visible", "hidden", "collapse"):
            return own["visibility"] == "visible"
    return inherited


def width(text: str) -> int:
    """Columns of a monospaced line: wide characters take two, marks none."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Page:
    """Collects lines: inline text runs on, blocks ask for line ends before more text comes."""

    def __init__(self):
        self.lines: list[str] = []
        self.run: list[str] = []
        self.gap = 0  # line ends wanted: 1 a new line, 2 an empty line
        self.space = False
        self.indent, self.mark = "", ""

    def text(self, value: str) -> None:
        words = BLANKS.sub(" ", value).strip(" ")
        if not words:
            self.space = self.space or bool(value)
            return
        if self.run and (self.space or value[0] in BLANK):
            self.run.append(" ")
        self._open()
        self.run.append(words)
        self.space = value[-1] in BLANK

    def preformatted(self, value: str) -> None:
        first, *more = value.replace("\r\n", "\n").split("\n")
        if first:
            self._open()
            self.run.append(first)
        for line in more:
            self.end_line()
            if line:
                self._open()
                self.run.append(line)

    def end_line(self) -> None:
        """Ends the line, even an empty one."""
        if self.run:
            self.flush()
        elif self.lines:
            self.gap = max(self.gap, 1) + 1

    def _open(self) -> None:
        if not self.run:
            if self.lines:
                self.lines += [""] * (max(self.gap, 1) - 1 if self.lines[-1] or self.gap > 2 else 0)
            self.run.append(self.indent + self.mark if self.mark else self.indent)
            if self.mark:
                self.indent, self.mark = self.indent + " " * len(self.mark), ""
        self.gap = 0

    def line(self, value: str) -> None:
        self.block(1)
        self._open()
        self.run.append(value)
        self.flush()

    def flush(self) -> None:
        if self.run:
            self.lines.append("".join(self.run).rstrip(BLANK))
            self.run = []
        self.space = False

    def block(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)

    def result(self) -> str:
        self.flush()
        return "\n".join(self.lines).strip("\n")


def ordinal(n: int, kind: str) -> str:
    """The mark of item n of an ordered list."""
    if kind in ("a", "A") and n > 0:
        out = ""
        while n:
            n, letter = divmod(n - 1, 26)
            out = chr(97 + letter) + out
        return out if kind == "a" else out.upper()
    if kind in ("i", "I") and 0 < n < 4000:
        out = ""
        for value, letters in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split()):
            out += letters * (n // value)
            n %= value
        return out if kind == "i" else out.upper()
    return str(n)


def whole(value: str | None) -> int | None:
    return int(value) if value and re.fullmatch(r"\s*[+-]?\d{1,9}\s*", value, re.A) else None


def span(node: Node, name: str, most: int) -> int:
    return min(max(whole(node.attrs.get(name)) or 1, 1), most)


def numbering(node: Node) -> tuple[int, int]:
    """The first number of a list, and the step."""
    start = whole(node.attrs.get("start"))
    if "reversed" in node.attrs:
        return (sum(1 for c in node.children if not isinstance(c, str) and c.tag == "li") if start is None else start), -1
    return 1 if start is None else start, 1


def flow(node: Node, page: Page, visible: bool, kept: bool = False) -> Iterator[Iterator]:
    """Renders the children of a node.  Yields the renderers of what is nested, which `run` carries out before
    it goes on here; so depth is a list's length, not calls.  kept: white space is preformatted."""
    number, step = numbering(node) if node.tag == "ol" else (1, 1)
    told = False  # whether closed details have shown their summary
    for child in node.children:
        if node.tag == "details" and "open" not in node.attrs:
            if told or isinstance(child, str) or child.tag != "summary":
                continue
            told = True
        if isinstance(child, str):
            if visible:
                (page.preformatted if kept else page.text)(child)
            continue
        tag, shown = child.tag, visibility(child, visible)
        if shown is None:
            continue
        if tag == "br":
            if kept:
                page.end_line()
            elif page.run:
                page.flush()
            else:
                page.gap = max(page.gap, 1 + bool(page.lines))
        elif tag == "hr":
            page.block(2)
        elif tag in ("pre", "textarea", "listing", "plaintext"):
            page.block(2 if tag != "textarea" else 1)
            if child.children and isinstance(child.children[0], str):
                child.children[0] = child.children[0].removeprefix("\r").removeprefix("\n")
            yield flow(child, page, shown, True)
            page.block(2 if tag != "textarea" else 1)
        elif tag in ("img", "area"):
            if shown and child.attrs.get("alt", "").strip():
                page.text(f" {child.attrs['alt']} ")
        elif tag == "input":
            kind = child.attrs.get("type", "text").lower()
            if shown and kind in ("text", "search", "button", "submit", "reset", "email", "tel", "url") and child.attrs.get("value"):
                page.text(f" {child.attrs['value']} ")
        elif tag == "table":
            page.block(2)
            yield table(child, page, shown)
            page.block(2)
        elif tag == "li":
            page.block(1)
            indent, waiting = page.indent, page.mark
            if node.tag == "ol":
                value = whole(child.attrs.get("value"))
                number = number if value is None else value
                page.mark = f"{ordinal(number, child.attrs.get('type', node.attrs.get('type', '1')))}. "
                number += step
            else:
                page.mark = "- "
            yield flow(child, page, shown, kept)
            page.block(1)
            page.indent, page.mark = indent, waiting
        elif tag in BLOCK:
            nested = tag in ("ul", "ol", "menu") and node.tag in ("li", "ul", "ol", "menu")
            gap = 2 if tag in SPACED and not nested else 1
            page.block(gap)
            indent = page.indent
            if tag in ("dd", "blockquote") or (nested and node.tag != "li"):
                page.indent += "  "
            yield flow(child, page, shown, kept)
            page.block(gap)
            page.indent = indent
        else:
            yield flow(child, page, shown, kept)


def run(first: Iterator[Iterator]) -> None:
    """Carries a renderer out, and those it yields."""
    todo = [first]
    while todo:
        inner = next(todo[-1], None)
        if inner is None:
            todo.pop()
        else:
            todo.append(inner)


def table_parts(node: Node, visible: bool) -> tuple[list[tuple[Node, bool]], list]:
    """The rows of a table as they stand from top to bottom, and what stands above them."""
    parts: dict[str, list[tuple[Node, bool]]] = {"thead": [], "tbody": [], "tfoot": []}
    above: list = []
    for child in node.children:
        if isinstance(child, str):
            above.append((child, visible))
            continue
        shown = visibility(child, visible)
        if shown is None:
            continue
        if child.tag == "tr":
            parts["tbody"].append((child, shown))
        elif child.tag in SECTIONS:
            for row in child.children:
                if isinstance(row, str):
                    above.append((row, shown))
                elif (inner := visibility(row, shown)) is not None:
                    (parts[child.tag] if row.tag == "tr" else above).append((row, inner))
        elif child.tag not in ("col", "colgroup"):
            above.append((child, shown))
    rows = parts["thead"] + parts["tbody"] + parts["tfoot"]
    above += [(c, shown) for row, shown in rows for c in row.children if isinstance(c, str)]
    return rows, [(c, shown) for c, shown in above if not isinstance(c, str) or c.strip(BLANK)]


def table(node: Node, page: Page, visible: bool) -> Iterator[Iterator]:
    rows, above = table_parts(node, visible)
    for part, shown in above:
        page.block(1)
        yield flow(Node("div", {}, [part]), page, shown)
    page.block(1)
    grid: list[list[tuple[list[str], int, int, int]]] = []
    taken: list[tuple[int, int, int]] = []  # (from column, to column, up to row) of cells that reach further down
    for at, (row, shown) in enumerate(rows):
        taken = sorted(t for t in taken if t[2] > at)
        cells, column, more = [], 0, iter(taken)
        busy = next(more, None)
        for cell in row.children:
            seen = None if isinstance(cell, str) else visibility(cell, shown)
            if seen is None:
                continue
            while busy and column >= busy[0]:
                column = max(column, busy[1])
                busy = next(more, None)
            inner = Page()
            yield flow(cell if cell.tag in ("td", "th") else Node("td", {}, [cell]), inner, seen)
            wide, high = span(cell, "colspan", 1000), span(cell, "rowspan", 65534)
            if whole(cell.attrs.get("rowspan")) == 0:
                high = len(rows) - at
            if busy:
                wide = min(wide, busy[0] - column)
            cells.append((inner.result().split("\n"), column, column + wide, high))
            column += wide
        taken += [(a, b, at + high) for _, a, b, high in cells if high > 1]
        grid.append(cells)
    for line in aligned(grid):
        page.line(line)


def aligned(grid: list[list[tuple[list[str], int, int, int]]]) -> Iterator[str]:
    """Lines of rows of cells (lines, from column, to column, rows): columns are as wide as their widest cell."""
    starts = sorted({a for cells in grid for _, a, _, _ in cells})  # columns in which no cell begins take no room
    place = {a: i for i, a in enumerate(starts)}
    rows = [[(lines, place[a], max(place[a] + 1, _first(starts, b))) for lines, a, b, _ in cells] for cells in grid]
    widths = [0] * len(starts)
    for lines, a, b in sorted((c for cells in rows for c in cells), key=lambda c: c[2] - c[1]):
        room = sum(widths[a:b]) + 3 * (b - a - 1)
        widths[b - 1] += max(0, max(map(width, lines)) - room)
    for cells in rows:
        for k in range(max([len(lines) for lines, _, _ in cells], default=0)):
            parts, at = [], 0
            for lines, a, b in cells:
                parts += [" " * widths[i] for i in range(at, a)]
                value = lines[k] if k < len(lines) else ""
                parts.append(value + " " * (sum(widths[a:b]) + 3 * (b - a - 1) - width(value)))
                at = b
            line = " | ".join(parts).rstrip(BLANK)
            if line.strip(" |"):
                yield line


def _first(starts: list[int], column: int) -> int:
    """How many columns begin before this one."""
    return bisect.bisect_left(starts, column)


def html_to_text(source: str | None) -> str | None:
    if source is None:
        return None
    page = Page()
    run(flow(parse(source), page, True))
    return page.result()


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and the visible text of every row."""
    prepare(pages.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "text": pa.array([html_to_text(x) for x in batch.column(1).to_pylist()], pa.string())})

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(extract, "page_id long, text string")
