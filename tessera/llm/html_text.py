"""Layout-aware text of HTML pages.

A tokenizer and a tree builder with implied tags make a tree; a renderer walks it by visibility rules and emits all
visible text with block spacing, list markers and aligned table cells. All steps take time in proportion to a page's
length, and both walks hold their stacks themselves, so neither long nor deep pages are a case of their own.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the HTML standard: elements without content, of raw text, that aren't shown, and that are blocks.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = set("head script style template noscript iframe object svg canvas audio video datalist math noembed noframes title select".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
LISTS, CELLS, GROUPS = {"ul", "ol", "menu"}, {"td", "th"}, {"thead", "tbody", "tfoot"}
MOST_COLUMNS, MOST_ROWS = 1000, 65_534  # that a cell may span
#: An opening tag closes the open elements named, up to one of the others.
IMPLIED = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
}
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
GAP = re.compile(r"[\s/]*")
ATTRIBUTE = re.compile(r"=?[^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
BARE = re.compile(r"[^\s>]*")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
#: Columns that lists may indent by, and the characters that a table may take for each of its text and each cell.
MOST_INDENT, MOST_PADDING, CELL = 128, 16, 16


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def attributes(html: str, at: int) -> tuple[dict[str, str] | None, int]:
    """The attributes of a tag from its name's end on, and where it ends; None if the page ends first."""
    found: dict[str, str] = {}
    while True:
        at = GAP.match(html, at).end()
        if at >= len(html):
            return None, at
        if html[at] == ">":
            return found, at + 1
        name = ATTRIBUTE.match(html, at)
        at, value = name.end(), ""
        if equals := EQUALS.match(html, at):
            at = equals.end()
            if html[at : at + 1] in ("'", '"'):
                end = html.find(html[at], at + 1)
                if end < 0:
                    return None, len(html)
                value, at = html[at + 1 : end], end + 1
            else:
                bare = BARE.match(html, at)
                value, at = bare[0], bare.end()
        found.setdefault(name[0].lower(), unescape(value))


class Open:
    """The open elements, and for each tag the places where it is open, so that none has to be searched for."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, tags: set[str], until: set[str]) -> None:
        """Close the outermost of the open elements named, within the innermost of ``until``."""
        bound = self.last(until)
        first = [p[i] for p in (self.places.get(t, ()) for t in tags) if (i := bisect_right(p, bound)) < len(p)]
        if first:
            self.cut(min(first))


def tree(html: str) -> Node:
    """The element tree; text is held as strings. Unclosed and stray tags never fail; a tag that the page's end cuts off is dropped."""
    root = Node("#root")
    open_, at, text = Open(root), 0, 0
    while (at := html.find("<", at)) >= 0:
        name = NAME.match(html, at + 1)
        end = NAME.match(html, at + 2) if html.startswith("/", at + 1) else None
        if name is None and end is None and html[at + 1 : at + 2] not in ("!", "?", "/"):
            at += 1
            continue
        if at > text:
            open_.nodes[-1].children.append(unescape(html[text:at]))
        if name is None and end is None:
            mark = "-->" if html.startswith("!--", at + 1) else ">"
            stop = html.find(mark, at + (4 if mark == "-->" else 2))
            at = text = stop + len(mark) if stop >= 0 else len(html)
            continue
        attrs, stop = attributes(html, (name or end).end())
        at = text = stop
        if attrs is None:
            break
        if end:
            ended(open_, end[0].lower())
        else:
            at = text = begun(open_, name[0].lower(), attrs, html, at)
    if text < len(html):
        open_.nodes[-1].children.append(unescape(html[text:]))
    return root


def ended(open_: Open, tag: str) -> None:
    if tag in ("p", "br") and not open_.places.get(tag):
        open_.nodes[-1].children.append(Node(tag))
        return
    place = open_.last({tag})
    outer = 0 if tag in GROUPS | {"tr", "table"} else open_.last(CELLS | {"table"})
    if place and place >= outer:
        open_.cut(place)


def begun(open_: Open, tag: str, attrs: dict[str, str], html: str, at: int) -> int:
    """Open an element whose tag ends at ``at``; where to go on."""
    if tag in BLOCK and tag not in ("html", "body"):
        open_.close({"p"}, CELLS | {"button", "table", "caption"})
    if tag in IMPLIED:
        open_.close(*IMPLIED[tag])
    if tag in CELLS and open_.nodes[-1].tag in GROUPS | {"table"}:
        row = Node("tr")
        open_.nodes[-1].children.append(row)
        open_.push(row)
    node = Node(tag, attrs)
    open_.nodes[-1].children.append(node)
    if tag in RAW:
        end = RAW_END[tag].search(html, at)
        stop = end.start() if end else len(html)
        node.children.append(unescape(html[at:stop]) if tag in ("textarea", "title") else html[at:stop])
        after = html.find(">", stop)
        return after + 1 if after >= 0 else len(html)
    if tag not in VOID:
        open_.push(node)
    return at


def shown(node: Node) -> bool:
    if node.tag in HIDDEN:
        return False
    attrs = node.attrs
    return not attrs or not ("hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or UNSEEN.search(attrs.get("style", "")))


class Layout:
    """Lines of text in the making: white space is folded, blocks begin lines, spaced blocks leave one line free outside lists.

    ``indent`` has the widths of the list items around, ``marks`` the markers that no line has yet.
    """

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.indent: list[int] = []
        self.marks: list[str] = []
        self.width = 0
        self.gap = self.pending = False

    def text(self, text: str) -> None:
        words = text.split()
        if not words:
            self.pending |= bool(text)
            return
        if self.now and (self.pending or text[0].isspace()):
            self.now.append(" ")
        self.now.append(" ".join(words))
        self.pending = text[-1].isspace()

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        marks = "".join(self.marks)
        self.lines.append((" " * min(self.width - len(marks), MOST_INDENT) + marks + line).rstrip() if self.width else line)
        self.marks = []

    def line(self, gap: bool = False) -> None:
        if self.now:
            self.put("".join(self.now))
            self.now = []
        self.gap |= gap and not self.indent
        self.pending = False

    def block(self, lines: list[str], gap: bool = False) -> None:
        self.line(gap)
        for x in lines:
            self.put(x)
        self.line(gap)

    def item(self, mark: str) -> None:
        self.line()
        self.indent.append(len(mark))
        self.width += len(mark)
        self.marks.append(mark)

    def close_item(self) -> None:
        self.line()
        if self.marks:
            self.put("")
        self.width -= self.indent.pop()


class Table:
    """Cells by row as (first column, columns, text), columns that cells of earlier rows reach into left free."""

    def __init__(self):
        self.rows: list[list[tuple[int, int, str]]] = []
        self.held: dict[int, tuple[int, int]] = {}
        self.column = 0

    def row(self) -> None:
        self.held = {c: (end, last) for c, (end, last) in self.held.items() if last >= len(self.rows)}
        self.rows.append([])
        self.column = 0

    def place(self, columns: int, rows: int) -> int:
        while self.column in self.held:
            self.column = self.held[self.column][0]
        first, self.column = self.column, self.column + columns
        if rows > 1:
            self.held[first] = self.column, len(self.rows) + rows - 2
        return first

    def lines(self) -> list[str]:
        """Rows whose cells begin at the same column in all; cells that no alignment can hold in proportion to the table's text overflow."""
        at = {c: i for i, c in enumerate(sorted({c for r in self.rows for c, _, _ in r}))}
        starts = list(at)
        placed = [[(at[c], bisect_right(starts, c + n - 1), text) for c, n, text in r] for r in self.rows]
        widths = [0] * len(starts)
        for cells in placed:
            for i, j, text in cells:
                if j == i + 1:
                    widths[i] = max(widths[i], len(text))
        for cells in placed:
            for i, j, text in cells:
                if j > i + 1:
                    widths[j - 1] += max(0, len(text) - sum(widths[i:j]) - 3 * (j - i - 1))
        room = MOST_PADDING * sum(len(t) + CELL for cells in placed for _, _, t in cells)
        most = max(widths, default=0)
        while most and len(placed) * sum(min(w, most) + 3 for w in widths) > room:
            most //= 2
        begins = [0]
        for w in widths:
            begins.append(begins[-1] + (min(w, most) + 3 if most else 0))
        out = []
        for cells in placed:
            parts, length = [], 0
            for i, j, text in cells:
                if i:
                    pad = max(0, begins[i] - 3 - length)
                    parts.append(" " * pad + " | ")
                    length += pad + 3
                parts.append(text)
                length += len(text)
            if line := "".join(parts).rstrip(" |"):
                out.append(line)
        return out


def number_of(node: Node, name: str, most: int) -> int:
    value = node.attrs.get(name, "").strip()
    return min(max(int(value), 1), most) if re.fullmatch(r"\d{1,9}", value) else 1


def plain(node: Node) -> str:
    """The text of a node as it stands, ``br`` as line ends, without hidden elements."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append("\n")
        elif x is node or shown(x):
            todo += reversed(x.children)
    return "".join(out)


class Renderer:
    """Walks a tree; ``outs`` has the layouts of the page and of the cells around, ``numbers`` the next item of the lists around."""

    def __init__(self):
        self.outs, self.tables, self.numbers = [Layout()], [], []

    def run(self, root: Node) -> list[str]:
        stack = [(root, iter(root.children))]
        while stack:
            parent, rest = stack[-1]
            x = next(rest, None)
            if x is None:
                stack.pop()
                if stack:
                    self.leave(parent, stack[-1][0])
            elif isinstance(x, str):
                self.string(x, parent)
            elif shown(x) and self.enter(x, parent):
                stack.append((x, iter(x.children)))
        self.outs[0].line()
        return self.outs[0].lines

    def in_row(self, parent: Node) -> bool:
        return parent.tag == "tr" and bool(self.tables) and bool(self.tables[-1].rows)

    def string(self, text: str, parent: Node) -> None:
        if not self.in_row(parent):
            self.outs[-1].text(text)
        elif words := " ".join(text.split()):
            table = self.tables[-1]
            table.rows[-1].append((table.place(1, 1), 1, words))

    def enter(self, node: Node, parent: Node) -> bool:
        """Begin an element; whether its children are to be walked."""
        tag = node.tag
        if self.in_row(parent):
            self.outs.append(Layout())
        out = self.outs[-1]
        if tag == "br":
            if out.now:
                out.line()
        elif tag == "hr":
            out.line(True)
        elif tag == "img":
            out.text(node.attrs.get("alt", ""))
        elif tag == "pre":
            text = plain(node).strip("\n")
            out.block([x.rstrip() for x in text.split("\n")] if text else [], True)
        elif tag == "textarea":
            out.text(plain(node))
        elif tag in LISTS:
            out.line(True)
            start = node.attrs.get("start", "")
            self.numbers.append(int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1)
            return True
        elif tag == "li" and parent.tag in LISTS:
            out.item(f"{self.numbers[-1]}. " if parent.tag == "ol" else "- ")
            self.numbers[-1] += 1
            return True
        elif tag == "table":
            out.line(True)
            self.tables.append(Table())
            self.outs.append(Layout())
            return True
        elif tag == "tr" and self.tables and parent.tag in GROUPS | {"table"}:
            self.tables[-1].row()
            return True
        else:
            if tag in BLOCK:
                out.line(tag in SPACED)
            return True
        if self.in_row(parent):
            self.cell(node)
        return False

    def leave(self, node: Node, parent: Node) -> None:
        tag, out = node.tag, self.outs[-1]
        if tag in LISTS:
            self.numbers.pop()
            out.line(True)
        elif tag == "li" and parent.tag in LISTS:
            out.close_item()
        elif tag == "table":
            out.line()
            lines = self.outs.pop().lines + self.tables.pop().lines()
            self.outs[-1].block(lines, True)
        elif tag in BLOCK:
            out.line(tag in SPACED)
        elif tag == "caption":
            out.line()
        if self.in_row(parent):
            self.cell(node)

    def cell(self, node: Node) -> None:
        out, table = self.outs.pop(), self.tables[-1]
        out.line()
        wide, high = (number_of(node, "colspan", MOST_COLUMNS), number_of(node, "rowspan", MOST_ROWS)) if node.tag in CELLS else (1, 1)
        table.rows[-1].append((table.place(wide, high), wide, " ".join(filter(None, out.lines))))


def html_to_text(html: str | None) -> str:
    return "\n".join(Renderer().run(tree(html or "")))


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """All columns of ``pages`` but the HTML, with its visible text. Null and empty pages give an empty text, an empty table no rows;
    repeated rows stay and give equal texts. A column named ``text_col`` is replaced.

    Pages of any length and depth are rendered whole. Two rules keep the layout in proportion to the text: lists indent by
    128 columns at most, and a column of a table is as wide as its longest cell unless padding to that would make the
    table more than 16 times as long as its text; cells that are wider than their column then overflow.
    """
    kept = [c for c in pages.columns if c not in (html_col, text_col)]
    render_all = F.pandas_udf(work, "string")
    return pages.select(*[F.col(f"`{c}`") for c in kept], render_all(F.coalesce(F.col(f"`{html_col}`"), F.lit(""))).alias(text_col))


def work(html: pd.Series) -> pd.Series:
    return html.map(html_to_text)
