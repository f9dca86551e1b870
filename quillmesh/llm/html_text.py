"""HTML extraction by layout-aware rendering.

`parse` builds a tree: void and raw-text elements, end tags that the markup leaves out,
and table sections and rows that it implies. `render` walks the tree under visibility
rules and lays out all visible text: blocks on lines of their own, a blank line around
paragraphs and headings, list items with their markers, preformatted text as it stands,
and table cells padded to the width of their columns, over column and row spans. Both are
loops that go over the page once; a line is laid out once for each table around it, and
NESTED tables deep rows and cells become plain blocks, so depth and broken markup cost no
more than text does. The layout has bounds, which drop no text: NESTED, DEEP, WIDE and SPANNED.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Names of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
HIDDEN = set("head script style template title noscript iframe noembed noframes object audio video canvas svg math datalist".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset hr menu".split())
BLOCK = SPACED | set("html body address article aside center dd details dialog dir div dt figcaption footer form header hgroup legend li main nav optgroup option search section summary tr caption select".split())
CLOSES_P = (BLOCK - set("html body tr caption option optgroup select legend".split())) | {"table"}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
SECTIONS = {"thead", "tbody", "tfoot"}
#: An element's start ends open elements of these names, up to the names after the bar.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table", *SECTIONS}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}),
    "th": ({"td", "th", "caption"}, {"table", "tr"}),
    **{s: ({"td", "th", "tr", "caption", "colgroup", *SECTIONS}, {"table"}) for s in SECTIONS},
    "caption": ({"caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: Elements whose content an end tag outside cannot reach into.
WALLS = {"table", "td", "th", "caption", "html", "template", "button", "object"}

#: Nested prefixes of lists and quotations are written so many characters deep; text below stays at that depth.
DEEP = 80
#: A cell is padded to so many characters at most; wider cells push the rest of their line to the right.
WIDE = 160
#: Tables within so many others have their cells laid out as blocks, one below the other.
NESTED = 6
#: Columns that a cell spans, and columns in which a cell may reach into later rows.
SPANNED = 100

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)", re.S)
#: One attribute and its sign of equality; what ends a tag is left.
NAME = re.compile(r"[\s/]*(=?[^\s/>=]*)(\s*=\s*)?")
BARE = re.compile(r"[^\s>]*")
UNSEEN = re.compile(r"display\s*:\s*none|content-visibility\s*:\s*hidden", re.I)
VISIBILITY = re.compile(r"(?<![-\w])visibility\s*:\s*(visible|hidden|collapse)", re.I)
BLANKS = re.compile(r"[ \t\n\r\f]+")
NO_ATTRS: dict[str, str] = {}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] = NO_ATTRS):
        self.tag, self.attrs, self.children = tag, attrs, []


class Tags:
    """Reads the attributes of a page's tags, each character once."""

    def __init__(self, text: str):
        self.text, self.none_left = text, set()

    def _find(self, what: str, at: int) -> int:
        """Where `what` comes next, -1 if it does not; a page is searched once for one that it has no more of."""
        if what in self.none_left:
            return -1
        found = self.text.find(what, at)
        if found < 0:
            self.none_left.add(what)
        return found

    def attributes(self, at: int) -> tuple[dict[str, str], bool, int]:
        """Attributes from `at`, whether the tag ends in a slash, and where text goes on.

        The first of equal names counts. A quotation mark that is never closed ends at the next ">".
        """
        text, out = self.text, {}
        while True:
            m = NAME.match(text, at)
            at = m.end()
            value = ""
            if m[2]:
                quote = text[at : at + 1]
                if quote in ('"', "'") and quote:
                    close = self._find(quote, at + 1)
                    if close < 0:
                        close = self._find(">", at + 1)
                        close = len(text) if close < 0 else close
                        value, at = text[at + 1 : close], close
                    else:
                        value, at = text[at + 1 : close], close + 1
                else:
                    bare = BARE.match(text, at)
                    value, at = bare[0], bare.end()
            if m[1]:
                out.setdefault(m[1].lower(), html.unescape(value))
            if at >= len(text):
                return out, False, at
            if text[at] == ">":
                return out, text[at - 1] == "/", at + 1


class Stack:
    """The open elements, and where those of each name stand."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], {root.tag: [0]}

    @property
    def top(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, size: int) -> None:
        while len(self.nodes) > size:
            self.at[self.nodes.pop().tag].pop()

    def wall(self, names: set[str]) -> int:
        """The place of the innermost of `names`, 0 (the root) if none is open."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def outermost(self, names: set[str], above: int) -> int:
        """The place of the outermost of `names` above a place, 0 if there is none."""
        found = 0
        for n in names:
            places = self.at.get(n)
            if places and places[-1] > above:
                place = places[bisect.bisect_right(places, above)]
                found = min(found, place) if found else place
        return found

    def close(self, names: set[str], walls: set[str]) -> None:
        """End the outermost open element of `names` within the nearest of `walls`."""
        if any(self.at.get(n) for n in names) and (place := self.outermost(names, self.wall(walls))):
            self.cut(place)

    def end(self, names: set[str], walls: set[str]) -> None:
        """End the innermost open element of `names` within the nearest of `walls`."""
        place = self.wall(names)
        if place and place > self.wall(walls - names):
            self.cut(place)


def parse(text: str) -> Node:
    """The tree of a page; any text gives one."""
    root = Node("html")
    stack, tags = Stack(root), Tags(text)
    at, end = 0, len(text)
    while at < end:
        m = TOKEN.search(text, at)
        if m is None or m.start() > at:
            stop = m.start() if m else end
            stack.top.children.append(html.unescape(text[at:stop]))
            if m is None:
                break
        at = m.end()
        if m[0].startswith("<![CDATA["):
            stack.top.children.append(m[0][9:].removesuffix("]]>"))
        elif m[1]:
            tag = m[1].lower()
            if tag == "br" or tag == "p" and not stack.at.get("p"):
                stack.top.children.append(Node(tag))
            elif tag in HEADINGS:
                stack.end(HEADINGS, WALLS)
            elif tag in SECTIONS or tag in ("tr", "table"):
                stack.end({tag}, {"table"})
            else:
                stack.end({tag}, {"table", "tr"} if tag in ("td", "th", "caption") else WALLS)
        elif m[2]:
            tag = m[2].lower()
            attrs, slash, at = tags.attributes(at)
            if tag == "html":
                root.attrs = root.attrs or attrs
                continue
            if tag in CLOSES_P:
                stack.close({"p"}, WALLS)
            if tag in HEADINGS and stack.top.tag in HEADINGS:
                stack.cut(len(stack.nodes) - 1)
            if tag in ENDS:
                stack.close(*ENDS[tag])
            if tag in ("td", "th") and stack.top.tag in SECTIONS | {"table"}:
                row = Node("tr")
                stack.top.children.append(row)
                stack.push(row)
            node = Node(tag, attrs)
            stack.top.children.append(node)
            if tag in VOID:
                continue
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(text, at)
                raw = text[at : stop.start() if stop else end]
                node.children.append(html.unescape(raw) if tag in ("textarea", "title") else raw)
                at = stop.end() if stop else end
            elif not slash or tag not in ("svg", "math", "path", "use", "circle", "rect"):
                stack.push(node)
    return root


def displayed(node: Node) -> bool:
    """Whether an element takes part at all; nothing in one that does not is visible."""
    tag, attrs = node.tag, node.attrs
    if tag in HIDDEN or (tag == "dialog" and "open" not in attrs):
        return False
    if not attrs:
        return True
    if "hidden" in attrs or (tag == "input" and attrs.get("type", "").lower() == "hidden"):
        return False
    style = attrs.get("style")
    return not (style and UNSEEN.search(style))


def seen_in(node: Node, seen: bool) -> bool:
    """Whether text in an element is seen: by its own visibility, else by that around it."""
    style = node.attrs.get("style")
    found = VISIBILITY.findall(style) if style else None
    return found[-1].lower() == "visible" if found else seen


class Sheet:
    """Lines of the page or of a cell, as they are laid out."""

    __slots__ = ("lines", "open", "gap", "prefix", "floor", "markers")

    def __init__(self):
        self.lines: list[str] = []
        self.open: list[str] = []
        self.gap = False
        self.prefix = ""
        self.floor = 0  # characters of the prefix that hold from the last line to the next
        self.markers: list[tuple[int, str]] = []

    def end_line(self, pre: bool = False) -> None:
        if not self.open:
            return
        line = "".join(self.open)
        self.open.clear()
        if pre:
            self.put(line.replace("\xa0", " ").split("\n"))
        elif line := BLANKS.sub(" ", line).strip(" \t\n\r\f"):
            self.put([line.replace("\xa0", " ")])

    def put(self, lines: list[str]) -> None:
        if self.lines and self.gap:
            self.lines.append(self.prefix[: self.floor].rstrip())
        self.gap = False
        for line in lines:
            head = self.prefix
            for at, marker in self.markers:
                head = head[:at] + marker + head[at + len(marker) :]
            self.markers.clear()
            self.lines.append(head + line if line else head.rstrip())
        self.floor = len(self.prefix)

    def indent(self, more: str) -> int:
        """Deepen the prefix; how long it was."""
        before = len(self.prefix)
        if before + len(more) <= DEEP:
            self.prefix += more
        return before

    def back(self, size: int) -> None:
        self.prefix = self.prefix[:size]
        self.floor = min(self.floor, size)


#: Lines of a cell, columns and rows that it spans (0 rows: all that follow).
Cell = tuple[list[str], int, int]


def grid(rows: list[list[Cell]]) -> list[str]:
    """Lines of a table's rows, cells padded to the width of their columns."""
    placed: list[list[tuple[int, int, list[str]]]] = []
    reach: dict[int, int] = {}  # columns that a cell of an earlier row still covers, and for how many rows
    for row in rows:
        out, at = [], 0
        for lines, span, down in row:
            while reach.get(at):
                at += 1
            out.append((at, at + span, lines))
            if down != 1 and at + span <= SPANNED:
                for c in range(at, at + span):
                    reach[c] = -1 if down == 0 else down
            at += span
        for c, left in list(reach.items()):
            if left == 1:
                del reach[c]
            elif left > 1:
                reach[c] = left - 1
        placed.append(out)
    # columns at which no cell begins take no room
    number = {c: i for i, c in enumerate(sorted({at for out in placed for at, _, _ in out}))}
    starts = list(number)
    width = [0] * len(starts)
    cells = [[(number[at], bisect.bisect_left(starts, end), lines) for at, end, lines in out] for out in placed]
    wide = lambda lines: min(WIDE, max(map(len, lines), default=0))
    for out in cells:
        for at, end, lines in out:
            if end == at + 1:
                width[at] = max(width[at], wide(lines))
    for out in cells:  # a wide cell widens its last column
        for at, end, lines in out:
            if end > at + 1:
                width[end - 1] += max(0, wide(lines) - sum(width[at:end]) - 3 * (end - at - 1))
    result = []
    for out in cells:
        for i in range(max((len(lines) for _, _, lines in out), default=0)):
            parts, col = [], 0
            for at, end, lines in out:
                parts += [" " * width[c] for c in range(col, at)]
                parts.append((lines[i] if i < len(lines) else "").ljust(sum(width[at:end]) + 3 * (end - at - 1)))
                col = end
            result.append(" | ".join(parts).rstrip())
    return result


def spans(node: Node) -> tuple[int, int]:
    def number(name: str, least: int, most: int) -> int:
        m = re.fullmatch(r"\s*(\d{1,6})\s*", node.attrs.get(name, ""))
        return min(most, max(least, int(m[1]))) if m else 1

    return number("colspan", 1, SPANNED), number("rowspan", 0, 65_534)


class Frame:
    """An open element: where its children and their lines go, and what to undo at its end."""

    __slots__ = ("node", "at", "sheet", "pre", "seen", "rows", "stray", "before", "count", "tables")

    def __init__(self, node: Node, sheet: Sheet, pre: bool, seen: bool, rows: list[list[Cell]]):
        self.node, self.at, self.sheet, self.pre, self.seen, self.rows = node, 0, sheet, pre, seen, rows
        self.stray: Sheet | None = None  # the sheet around, where an element has one of its own
        self.before = self.count = self.tables = 0


TABULAR = {"td", "th", "tr", "table", *SECTIONS}


def render(root: Node) -> str:
    """All visible text of a tree, laid out."""
    page = Sheet()
    stack = [Frame(root, page, False, seen_in(root, True), [])]
    while True:
        frame = stack[-1]
        sheet = frame.sheet
        if frame.at < len(frame.node.children):
            child = frame.node.children[frame.at]
            frame.at += 1
            if isinstance(child, str):
                if frame.seen:
                    sheet.open.append(child)
                continue
            tag = child.tag
            if not displayed(child):
                continue
            seen = seen_in(child, frame.seen)
            if tag == "br":
                if frame.pre:
                    sheet.open.append("\n")
                elif any(not x.isspace() and x for x in sheet.open):
                    sheet.end_line()
                else:
                    sheet.open.clear()
                    sheet.gap = sheet.gap or bool(sheet.lines)
            elif tag == "hr":
                sheet.end_line(frame.pre)
                if seen:
                    sheet.put(["---"])
            elif tag == "input":
                if seen and child.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text"):
                    sheet.open.append(child.attrs.get("value", ""))
            elif tag not in VOID:
                inner = Frame(child, sheet, frame.pre or tag == "pre", seen, frame.rows)
                inner.tables = frame.tables + (tag == "table")
                stack.append(inner)
                if tag in TABULAR and inner.tables > NESTED:
                    sheet.end_line(frame.pre)
                    if tag == "table":
                        sheet.gap = sheet.gap or bool(sheet.lines)
                    inner.rows = []
                    inner.before = len(sheet.prefix)
                elif tag in TABULAR:
                    if tag == "table":
                        sheet.end_line(frame.pre)
                        sheet.gap = sheet.gap or bool(sheet.lines)
                    inner.stray, inner.sheet = sheet, Sheet()
                    if tag in ("tr", "table"):
                        inner.rows = []
                elif tag in BLOCK:
                    sheet.end_line(frame.pre)
                    sheet.gap |= tag in SPACED and not (tag in ("ul", "ol") and frame.node.tag == "li")
                    inner.rows = []
                    inner.before = len(sheet.prefix)
                    if tag == "li":
                        marker = "- "
                        frame.count += 1
                        if frame.node.tag == "ol":
                            if frame.count == 1:
                                start = re.fullmatch(r"\s*([+-]?\d{1,9})\s*", frame.node.attrs.get("start", ""))
                                frame.count = int(start[1]) if start else 1
                            marker = f"{frame.count}. "
                        if seen and len(sheet.prefix) + len(marker) <= DEEP:
                            sheet.markers.append((len(sheet.prefix), marker))
                        sheet.indent(" " * len(marker))
                    elif tag in ("dd", "blockquote"):
                        sheet.indent("    " if tag == "dd" else "> ")
            continue
        stack.pop()
        node, tag = frame.node, frame.node.tag
        if not stack:
            sheet.end_line()
            if frame.rows:  # of rows and cells outside of any table and block
                sheet.put(grid(frame.rows))
            return "\n".join(page.lines).strip("\n")
        above = stack[-1]
        if tag in TABULAR and frame.tables > NESTED:
            sheet.end_line(frame.pre)
            sheet.back(frame.before)
            if tag == "table":
                sheet.gap = bool(sheet.lines)
        elif tag in ("td", "th"):
            sheet.end_line(frame.pre)
            cell = (sheet.lines, *spans(node))
            if above.node.tag == "tr":
                above.rows.append(cell)
            else:  # a cell outside of rows is one of its own
                above.rows.append([cell])
        elif tag == "tr":
            sheet.end_line(frame.pre)
            cells = [c if isinstance(c, tuple) else c[0] for c in frame.rows]
            if sheet.lines:  # text outside of cells
                cells.insert(0, (sheet.lines, 1, 1))
            if cells:
                above.rows.append(cells)
        elif tag in SECTIONS:
            sheet.end_line(frame.pre)
            frame.stray.end_line()
            frame.stray.lines += sheet.lines
        elif tag == "table":
            sheet.end_line(frame.pre)
            lines = sheet.lines + grid(frame.rows)
            if lines:
                frame.stray.put(lines)
                frame.stray.gap = True
        elif tag in BLOCK:
            sheet.end_line(frame.pre)
            if frame.rows:
                sheet.put(grid(frame.rows))
            if tag == "li" and sheet.markers and sheet.markers[-1][0] == frame.before:
                sheet.put([""])
            sheet.back(frame.before)
            sheet.gap |= tag in SPACED and not (tag in ("ul", "ol") and above.node.tag == "li") and bool(sheet.lines)


def extract(page: str | None) -> str:
    return render(parse(page)) if page else ""


def page_texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per row: page_id, text, n_chars, text_sha256.

    A null or empty page gives the empty text; plain text gives itself, laid out. Any
    markup gives a tree, however broken or deep. Rows with null or repeated ids are each
    rendered for itself; other columns are not read. Widths count characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(1)]
            shas = [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(shas, pa.string())], names=["page_id", "text", "n_chars", "text_sha256"])

    return pages.selectExpr(f"cast(`{id_col}` as bigint) page_id", f"`{html_col}`").mapInArrow(run, "page_id long, text string, n_chars long, text_sha256 string")
