"""HTML extraction by layout-aware rendering (operator 8).

A tokenizer and a tree builder with implied tags make a tree of elements; a renderer
walks it and emits all visible text as a page would show it:

* block elements stand on lines of their own, paragraphs, headings, lists, tables and
  quotes with a blank line around them; runs of white space become one blank, except
  in ``pre`` and ``textarea``;
* ``br`` ends a line and ``hr`` draws one of dashes;
* list items get a bullet or their number and are indented by nesting;
* the cells of a table are aligned in columns by their widest line, with ``colspan`` and
  ``rowspan``; cells that hold block content keep their lines;
* an image shows its ``alt``, an input its value; the text of ``script``, ``style``,
  ``head`` and the like, of hidden elements (``hidden``, ``aria-hidden="true"``,
  ``display:none``, ``type=hidden``) and of comments is not shown; ``visibility`` is
  inherited, so that a visible element in a hidden one shows.

The tokenizer goes through a page once: every search starts where the last one ended, and
what was not found is not looked for again, so that its time is linear in the page.

Defined cases: null or empty HTML renders as empty text; unclosed, stray and wrongly
nested tags are repaired as the tree builder meets them, an unclosed quote ends at its
tag's next ``>``, and a broken tag at the end is dropped; elements nested deeper than
``MAX_DEPTH`` (as in browsers) give their text to the deepest one, unless they are hidden;
NUL is dropped; numeric references outside Unicode become U+FFFD; repeated rows are
rendered each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

MAX_DEPTH = 512
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
UNSEEN = frozenset("head script style template noscript iframe object audio video canvas svg math datalist noembed noframes title meta link".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure menu".split())
BLOCK = PARAGRAPH | frozenset(
    "html body address article aside caption center dd details dialog dir div dt fieldset figcaption footer form header hgroup hr legend li main nav optgroup option search section summary tbody td tfoot th thead tr".split()
)
#: opening a tag first closes open elements of these names, up to the nearest boundary
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th", "caption"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tbody": (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}), frozenset({"table"})),
    "thead": (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}), frozenset({"table"})),
    "tfoot": (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
}
#: an end tag does not reach beyond these
_SCOPE = frozenset({"table", "td", "th", "caption", "template", "html"})
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)", re.I)
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "name", "shows")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []
        self.shows = False  # whether it or an element in it asks to be visible


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(next((g for g in m.groups()[1:] if g is not None), "")))
    return out


class Tokens:
    """Walks a page: text up to the next tag, then the tag."""

    def __init__(self, source: str):
        self.source, self.at, self.n = source, 0, len(source)
        self.gone: set[str] = set()  # characters that are known not to come any more

    def _find(self, what: str, start: int) -> int:
        if what in self.gone:
            return -1
        found = self.source.find(what, start)
        if found < 0:
            self.gone.add(what)
        return found

    def next(self) -> tuple[str, str, str, str] | None:
        """(text before, "start", "end", "other" or "" for none, name, attributes); None at the end of the page."""
        source, start = self.source, self.at
        if start >= self.n:
            return None
        look = start
        while True:
            i = self._find("<", look)
            if i < 0:
                self.at = self.n
                return source[start:], "", "", ""
            follow = source[i + 1 : i + 2]
            if follow in ("!", "?") and follow:
                if source.startswith("<!--", i):
                    end = self._find("-->", i + 4)
                    self.at = self.n if end < 0 else end + 3
                else:
                    end = self._find(">", i)
                    self.at = self.n if end < 0 else end + 1
                return source[start:i], "other", "", ""
            closing = follow == "/"
            name = _NAME.match(source, i + 1 + closing)
            if name:
                break
            look = i + 1  # a bare < is text
        end = self._find(">", name.end()) if closing else self._end_of_start(name.end())
        if end < 0:  # a broken tag at the end of the page
            self.at = self.n
            return source[start:i], "", "", ""
        self.at = end + 1
        return source[start:i], "end" if closing else "start", name[0].lower(), source[name.end() : end]

    def _end_of_start(self, at: int) -> int:
        """Where a start tag ends; > in quotes does not end it."""
        if ">" in self.gone:
            return -1
        while True:
            m = _STOP.search(self.source, at)
            if not m:
                self.gone.add(">")
                return -1
            if m[0] == ">":
                return m.start()
            close = self._find(m[0], m.end())
            if close < 0:
                return self._find(">", m.end())
            at = close + 1

    def raw(self, name: str) -> str:
        """The text up to the end tag of a raw text element, which is passed."""
        start = self.at
        if f"</{name}" not in self.gone:
            m = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(self.source, start)
            if m:
                end = self._find(">", m.end())
                self.at = self.n if end < 0 else end + 1
                return self.source[start : m.start()]
            self.gone.add(f"</{name}")
        self.at = self.n
        return self.source[start:]


def build_tree(source: str) -> Node:
    """The element tree of a page; children are nodes and strings."""
    tokens = Tokens(source.replace("\0", ""))
    root = Node("html", {})
    stack = [root]
    unplaced: dict[str, int] = {}  # open elements beyond the depth
    buried = 0  # of a hidden element beyond the depth, the open ones of its name

    def close_implied(names: frozenset[str], until: frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in until:
                cut = i + 1
                break
        else:
            cut = 1
        for i in range(cut, len(stack)):
            if stack[i].name in names:
                del stack[i:]
                return

    while (token := tokens.next()) is not None:
        before, kind, name, raw = token
        if before:
            stack[-1].children.append(html.unescape(before))
        if buried and kind in ("start", "end"):
            if name == stack[-1].name:
                buried += 1 if kind == "start" and name not in RAW else -1 if kind == "end" else 0
                if not buried:
                    stack.pop()
            elif kind == "start" and name in RAW:
                tokens.raw(name)
            continue
        if kind == "end":
            if unplaced.get(name):
                unplaced[name] -= 1
                continue
            if name == "br":
                stack[-1].children.append(Node("br", {}))
            elif name == "p" and not any(e.name == "p" for e in stack[1:]):
                stack[-1].children.append(Node("p", {}))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
                if stack[i].name in _SCOPE and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
            if len(stack) < MAX_DEPTH:
                unplaced.clear()
        elif kind == "start":
            attrs = _attributes(raw) if raw else {}
            if name == "html":
                continue
            if name == "body":
                for i in range(1, len(stack)):
                    if stack[i].name == "head":
                        del stack[i:]
                        break
            if name in _ENDS_P:
                close_implied(frozenset({"p"}), frozenset({"td", "th", "table", "button", "li", "caption"}))
            if re.fullmatch("h[1-6]", name) and re.fullmatch("h[1-6]", stack[-1].name):
                stack.pop()
            if rule := IMPLIED.get(name):
                close_implied(*rule)
            if name in ("td", "th") and stack[-1].name in ("table", "tbody", "thead", "tfoot"):
                row = Node("tr", {})
                stack[-1].children.append(row)
                stack.append(row)
            node = Node(name, attrs)
            stack[-1].children.append(node)
            if visibility(node):
                for e in reversed(stack):
                    if e.shows:
                        break
                    e.shows = True
            if name in VOID:
                continue
            if name in RAW:
                text = tokens.raw(name)
                node.children.append(html.unescape(text) if name in ("textarea", "title") else text)
            elif raw.rstrip().endswith("/") and name in ("svg", "path", "use"):
                continue
            elif len(stack) < MAX_DEPTH:
                stack.append(node)
            elif hidden(node) or visibility(node) is False:
                stack.append(node)
                buried = 1
            else:
                unplaced[name] = unplaced.get(name, 0) + 1
    return root


def visibility(node: Node) -> bool | None:
    """What an element's style says of its visibility, if anything."""
    style = node.attrs.get("style") if node.attrs else None
    m = _VISIBILITY.search(style) if style else None
    return None if m is None else m[1].lower() == "visible"


def hidden(node: Node) -> bool:
    a = node.attrs
    if node.name in UNSEEN:
        return True
    if not a:
        return False
    if visibility(node) is False and not node.shows:
        return True
    return "hidden" in a or a.get("aria-hidden", "").lower() == "true" or (node.name == "input" and a.get("type", "").lower() == "hidden") or bool(_HIDDEN.search(a.get("style", "")))


def width(text: str) -> int:
    """Columns that a text takes: none for combining marks, two for wide letters."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Collects lines; remembers how much blank space has to come before the next text."""

    def __init__(self, visible: bool = True):
        self.lines: list[str] = []
        self.current: list[str] = []
        self.space = False
        self.gap = False
        self.visible = visible

    def text(self, raw: str) -> None:
        if not self.visible:
            return
        words = _SPACES.sub(" ", raw)
        if words[:1] == " ":
            self.space = True
            words = words[1:]
        if not words:
            return
        tail = words[-1:] == " "
        if tail:
            words = words[:-1]
        if self.space and self.current:
            self.current.append(" ")
        self._open()
        self.current.append(words)
        self.space = tail

    def _open(self) -> None:
        if not self.current and self.gap and self.lines:
            self.lines.append("")
        self.gap = False

    def end_line(self, forced: bool = False) -> None:
        if self.current or forced:
            self._open()
            self.lines.append("".join(self.current))
            self.current = []
        self.space = False

    def blank(self) -> None:
        self.end_line()
        self.gap = True

    def take(self, lines: list[str]) -> None:
        """Whole lines as they are, of a part that has been rendered."""
        self.end_line()
        if lines:
            self._open()
            self.lines.extend(lines)


def render_children(node: Node, out: Lines, depth: int) -> None:
    for child in node.children:
        if isinstance(child, str):
            out.text(child)
        elif not hidden(child):
            render(child, out, depth)


def _inner(node: Node, depth: int, visible: bool) -> list[str]:
    own = Lines(visible if visibility(node) is None else bool(visibility(node)))
    render_children(node, own, depth)
    own.end_line()
    return own.lines


def render(node: Node, out: Lines, depth: int = 0) -> None:
    own = visibility(node)
    if own is None or own == out.visible:
        _render(node, out, depth)
        return
    out.visible = own
    _render(node, out, depth)
    out.visible = not own


def _render(node: Node, out: Lines, depth: int) -> None:
    name = node.name
    if name == "br":
        out.end_line(forced=True)
    elif name == "hr":
        out.take(["-" * 20] if out.visible else [])
    elif name == "img":
        out.text(node.attrs.get("alt", ""))
    elif name == "input":
        if node.attrs.get("type", "text").lower() not in ("checkbox", "radio", "password", "file"):
            out.text(node.attrs.get("value", ""))
    elif name in ("pre", "textarea"):
        out.blank()
        out.take(_verbatim(node, out.visible).strip("\n").split("\n"))
        out.blank()
    elif name in ("ul", "ol", "menu", "dir"):
        if depth == 0:
            out.blank()
        else:
            out.end_line()
        _list(node, out, depth)
        if depth == 0:
            out.blank()
        else:
            out.end_line()
    elif name == "table":
        out.blank()
        _table(node, out)
        out.blank()
    elif name == "blockquote":
        out.blank()
        out.take([f"> {line}".rstrip() for line in _inner(node, 0, out.visible)])
        out.blank()
    elif name == "dd":
        out.take([f"    {line}".rstrip() for line in _inner(node, depth, out.visible)])
    elif name == "q":
        out.text("“")
        render_children(node, out, depth)
        out.text("”")
    elif name in PARAGRAPH:
        out.blank()
        render_children(node, out, depth)
        out.blank()
    elif name in BLOCK:
        out.end_line()
        render_children(node, out, depth)
        out.end_line()
    else:
        render_children(node, out, depth)


def _verbatim(node: Node, visible: bool) -> str:
    parts = []
    for child in node.children:
        if isinstance(child, str):
            if visible:
                parts.append(child.replace("\r\n", "\n").replace("\r", "\n"))
        elif child.name == "br":
            parts.append("\n")
        elif not hidden(child):
            own = visibility(child)
            parts.append(_verbatim(child, visible if own is None else own))
    return "".join(parts)


def _list(node: Node, out: Lines, depth: int) -> None:
    start = node.attrs.get("start", "1")
    number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                out.text(child)
            continue
        if hidden(child):
            continue
        if child.name != "li":
            render(child, out, depth + 1)
            continue
        mark = "* "
        if node.name == "ol":
            value = child.attrs.get("value", "")
            if re.fullmatch(r"-?\d{1,9}", value):
                number = int(value)
            mark, number = f"{number}. ", number + 1
        lines = _inner(child, depth + 1, out.visible)
        pad = " " * len(mark)
        out.take([(mark if i == 0 else pad) + line if line else "" for i, line in enumerate(lines)] if lines else [mark.rstrip()] if out.visible else [])


def _span(cell: Node, name: str, most: int) -> int:
    """A cell's colspan or rowspan; a rowspan of 0 goes to the end of the table."""
    raw = cell.attrs.get(name, "1").strip()
    n = int(raw) if re.fullmatch(r"\d{1,6}", raw) else 1
    return most if not n and name == "rowspan" else max(1, min(most, n))


def _rows(node: Node) -> Iterator[Node]:
    for child in node.children:
        if isinstance(child, Node) and not hidden(child):
            if child.name == "tr":
                yield child
            elif child.name in ("thead", "tbody", "tfoot"):
                yield from _rows(child)


def _table(node: Node, out: Lines) -> None:
    outside = Lines(out.visible)
    for child in node.children:  # captions and text that is in no cell
        if isinstance(child, str):
            outside.text(child)
        elif not hidden(child) and child.name not in ("tr", "thead", "tbody", "tfoot", "colgroup", "col"):
            render(child, outside)
    outside.end_line()
    out.take(outside.lines)
    grid: list[list[tuple[int, int, list[str]]]] = []  # rows of (column, span, lines)
    below: dict[int, int] = {}  # columns that cells of earlier rows reach down into, and for how many rows more
    for row in _rows(node):
        own = visibility(row)
        visible = out.visible if own is None else own
        cells, column, taken, reach = [], 0, False, {}

        def skip() -> None:
            nonlocal column
            while below.get(column):
                cells.append((column, 1, [""]))
                column += 1

        for child in row.children:
            if isinstance(child, str):
                if child.strip() and visible:
                    skip()
                    cells.append((column, 1, [_SPACES.sub(" ", child).strip()]))
                    column, taken = column + 1, True
            elif not hidden(child):
                skip()
                lines = _inner(child, 0, visible)
                is_cell = child.name in ("td", "th")
                span = _span(child, "colspan", 100) if is_cell else 1
                rows = _span(child, "rowspan", 65_534) if is_cell else 1
                cells.append((column, span, lines or [""]))
                if rows > 1:
                    reach.update({c: rows - 1 for c in range(column, column + span)})
                column, taken = column + span, True
        skip()
        below = {c: n - 1 for c, n in below.items() if n > 1} | reach
        if taken:
            grid.append(cells)
    columns = max((c[0] + c[1] for cells in grid for c in cells), default=0)
    widths = [0] * columns
    for cells in grid:
        for column, span, lines in cells:
            if span == 1:
                widths[column] = max(widths[column], *map(width, lines))
    for cells in grid:  # a spanning cell widens its last column if need be
        for column, span, lines in cells:
            if span > 1:
                room = sum(widths[column : column + span]) + 3 * (span - 1)
                widths[column + span - 1] += max(0, max(map(width, lines)) - room)
    for cells in grid:
        for i in range(max(len(c[2]) for c in cells)):
            parts = []
            for column, span, lines in cells:
                text = lines[i] if i < len(lines) else ""
                room = sum(widths[column : column + span]) + 3 * (span - 1)
                parts.append(text + " " * (room - width(text)))
            out.take([" | ".join(parts).rstrip()])


def extract(source: str | None) -> str:
    """All visible text of a page, laid out."""
    if not source:
        return ""
    out = Lines()
    # a level of nesting takes a few Python frames
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 10 * MAX_DEPTH))
    try:
        render_children(build_tree(source), out, 0)
    finally:
        sys.setrecursionlimit(limit)
    out.end_line()
    lines = [line.rstrip() for line in out.lines]
    while lines and not lines[0]:
        lines.pop(0)
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


def _render_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], names=["page_id", "text"])


def render_pages(pages: DataFrame) -> DataFrame:
    """page_id and the visible text of every row of ``pages`` (page_id, html)."""
    bounded_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(_render_batches, "page_id long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    found = render_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.withColumn("n_lines", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))))
