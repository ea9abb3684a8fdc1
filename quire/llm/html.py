"""HTML to text by layout: a tree builder with implied tags, visibility rules, and a renderer.

The builder closes what a new tag closes (paragraphs, list items, table parts, options), adds
table rows that are only implied, and ignores end tags without a start. The renderer leaves out
what a browser doesn't show, keeps the spacing of blocks, numbers and indents lists, and sets
table cells in aligned columns. It works along an explicit stack; only tables call it again,
to a bounded depth.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.runtime import map_arrow

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head script style title template noscript noframes noembed iframe datalist object audio video canvas area param source track link meta base rp".split())
#: Blocks with a blank line around them, and blocks that only start a line of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr fieldset form".split())
BLOCK = SPACED | frozenset(
    "html body div article section nav aside header footer main address li dt dd tr td th caption tbody thead tfoot figcaption details summary dialog legend center optgroup option menu search hgroup text foreignobject".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open paragraph.
_ENDS_P = (SPACED | frozenset("div article section nav aside header footer main address center details dialog menu li dt dd hgroup search figcaption summary".split())) - {"table"}
#: For a start tag: the open tags that it ends, and the tags that keep it from looking further out.
_LISTS = frozenset("ul ol menu".split())
_ENDS = {
    "li": (frozenset({"li"}), _LISTS | {"table", "td", "th"}),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl", "table", "td", "th"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl", "table", "td", "th"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist", "optgroup"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "tr": (frozenset({"tr", "caption", "colgroup"}), frozenset({"table", "tbody", "thead", "tfoot"})),
    "tbody": (frozenset({"tbody", "thead", "tfoot", "caption", "colgroup"}), frozenset({"table"})),
    "thead": (frozenset({"tbody", "thead", "tfoot", "caption", "colgroup"}), frozenset({"table"})),
    "tfoot": (frozenset({"tbody", "thead", "tfoot", "caption", "colgroup"}), frozenset({"table"})),
    "rt": (frozenset({"rt", "rp"}), frozenset({"ruby"})),
    "rp": (frozenset({"rt", "rp"}), frozenset({"ruby"})),
}
#: What may stand in a head; anything else ends it.
_IN_HEAD = frozenset("head base link meta noframes noscript script style template title".split())
#: Start tags that end an open svg or math, since they can't stand in one.
_ENDS_FOREIGN = _ENDS_P | frozenset("b big body br code em embed i img meta nobr s small span strong strike sub sup table tt u var".split())
#: In svg, texts are shown only in these, and not in the others; in math not in annotations.
_SVG_SHOWN = ("text", "foreignobject")
_SVG_UNSEEN = ("desc", "metadata", "defs", "symbol", "clippath", "mask", "pattern", "marker")
_MATH_UNSEEN = ("annotation", "annotation-xml")
#: End tags don't look beyond these.
_WALLS = frozenset("table td th caption template html".split())
_END_WALLS = {t: _WALLS - {t} for t in _WALLS} | {t: _WALLS - {"td", "th", "caption"} for t in ("tr", "tbody", "thead", "tfoot")} | {t: frozenset({"html"}) for t in ("table", "template")}
_P, _P_WALLS = frozenset({"p"}), _WALLS | {"button"}
#: What is nested deeper belongs to the element at this depth.
MAX_DEPTH = 512
MAX_SPAN = 1000
#: Cells that are wider don't widen their column.
MAX_COLUMN = 60
#: Tables within so many others are set as plain blocks.
MAX_TABLES = 16
#: Rows of a batch that are rendered before the result goes on.
OUT_ROWS = 500

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_SPACE = " \t\n\r\f\v"
_BLANKS = re.compile("[ \t\n\r\f\v]+")
#: Blanks beyond ASCII, which stay as they are.
_WIDE_BLANK = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*([a-z-]+)", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
#: Style sheets: comments, and selectors of one element by tag, classes and ids. Others, and rules within at-rules, have no effect.
_COMMENT = re.compile(r"/\*.*?(?:\*/|$)|<!--|-->", re.S)
_SELECTOR = re.compile(r"([a-z][a-z0-9]*|\*)?((?:[.#][\w-]+)*)$", re.I)
_PART = re.compile(r"([.#])([\w-]+)")


class Node:
    __slots__ = ("attributes", "css", "kids", "tag")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.attributes, self.kids = tag, attributes, []
        #: display and visibility as the page's style sheets have them, or None.
        self.css: dict[str, str] | None = None

    def get(self, name: str) -> str | None:
        """An attribute's value; empty if it has none, None if it isn't there."""
        if name not in self.attributes.lower():
            return None
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return html.unescape((m[2] or "").strip("\"'"))
        return None


class _Open(list):
    """The open elements, innermost last, with how many there are of each tag."""

    def __init__(self, root: Node) -> None:
        super().__init__([root])
        self.count: dict[str, int] = {}

    def put(self, node: Node) -> None:
        """A child of the innermost element; it is open from now on, unless it is void or too deep."""
        self[-1].kids.append(node)
        if node.tag not in VOID and len(self) < MAX_DEPTH:
            self.append(node)
            self.count[node.tag] = self.count.get(node.tag, 0) + 1

    def cut(self, k: int) -> None:
        for node in self[k:]:
            self.count[node.tag] -= 1
        del self[k:]

    def close(self, ends: frozenset[str], walls: frozenset[str]) -> None:
        """Close the innermost open tag of ``ends``, if no tag of ``walls`` is further in."""
        count = self.count
        for tag in ends:
            if count.get(tag):
                break
        else:
            return
        for k in range(len(self) - 1, 0, -1):
            if self[k].tag in ends:
                self.cut(k)
                return
            if self[k].tag in walls:
                return


def _tag_end(page: str, at: int, spent: set[str]) -> int:
    """The place of the ``>`` that ends a tag, skipping quoted values; -1 if there is none."""
    while True:
        end = page.find(">", at)
        if end < 0:
            return -1
        quotes = [q for q in (page.find(c, at, end) for c in "\"'" if c not in spent) if q >= 0]
        if not quotes or "=" not in page[at : min(quotes)]:
            return end
        first = min(quotes)
        close = page.find(page[first], first + 1)
        if close < 0:
            spent.add(page[first])  # no such quote closes any more
            return end
        at = close + 1


def parse(page: str) -> Node:
    """The tree of a page; every text is a str among the children of its element."""
    root = Node("html")
    stack = _Open(root)
    spent: set[str] = set()
    at, size = 0, len(page)
    while at < size:
        open_at = page.find("<", at)
        if open_at < 0:
            open_at = size
        if open_at > at:
            _text(stack, page[at:open_at])
        if open_at == size:
            break
        at = open_at
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = size if end < 0 else end + 1
        elif m := _NAME.match(page, at + 2 if page.startswith("</", at) else at + 1):
            end = _tag_end(page, m.end(), spent)
            if end < 0:
                break  # a tag that never ends hides the rest, as in a browser
            tag = m[0].lower()
            at_next = end + 1
            if page[at + 1] == "/":
                _end(stack, tag)
            else:
                own = page[m.end() : end]
                _start(stack, tag, own)
                if tag in RAW and not (own.endswith("/") and _foreign(stack)):
                    close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at_next)
                    raw = page[at_next : close.start() if close else size]
                    if raw and stack[-1].tag == tag:
                        stack[-1].kids.append(html.unescape(raw) if tag in ("textarea", "title") and "&" in raw else raw)
                        stack.cut(len(stack) - 1)
                    at_next = close.start() if close else size
            at = at_next
        else:
            _text(stack, "<")
            at += 1
    return root


def _foreign(stack: _Open) -> bool:
    """Whether svg or math is open, and no HTML within it."""
    count = stack.count
    return bool((count.get("svg") or count.get("math")) and not count.get("foreignobject"))


def _text(stack: _Open, text: str) -> None:
    if "&" in text:
        text = html.unescape(text)
    count = stack.count
    if count.get("svg") and (not any(map(count.get, _SVG_SHOWN)) or any(map(count.get, _SVG_UNSEEN))):
        return
    if count.get("math") and any(map(count.get, _MATH_UNSEEN)):
        return
    if stack[-1].tag == "head" and text.strip(_SPACE + "\0"):
        stack.cut(len(stack) - 1)  # the body is implied
    stack[-1].kids.append(text)


def _start(stack: _Open, tag: str, attributes: str) -> None:
    if tag in _ENDS_FOREIGN and _foreign(stack):
        stack.cut(next(k for k, node in enumerate(stack) if node.tag in ("svg", "math")))
    if tag == "body" and stack[-1].tag == "head":
        stack.cut(len(stack) - 1)
    if tag in ("html", "body"):
        return
    if tag in _ENDS_P:
        stack.close(_P, _P_WALLS)
    if tag in _HEADINGS and stack[-1].tag in _HEADINGS:
        stack.cut(len(stack) - 1)
    if tag in _ENDS:
        stack.close(*_ENDS[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            stack.put(Node("tr"))  # cells stand in rows; one that isn't there is implied
    if stack[-1].tag == "head" and tag not in _IN_HEAD:
        stack.cut(len(stack) - 1)  # the body is implied
    if attributes.endswith("/") and (tag in ("svg", "math") or _foreign(stack)):
        stack[-1].kids.append(Node(tag, attributes))  # empty; only svg and math have such tags
        return
    stack.put(Node(tag, attributes))


def _end(stack: _Open, tag: str) -> None:
    if tag == "br":
        stack.put(Node("br"))
    elif tag in _HEADINGS:
        stack.close(_HEADINGS, _WALLS)
    elif tag == "p" and not stack.count.get("p"):
        stack[-1].kids.append(Node("p"))
    elif tag not in ("html", "body"):
        stack.close(frozenset((tag,)), _END_WALLS.get(tag, _WALLS))


def hidden(node: Node) -> bool:
    """Whether the element takes no place at all."""
    if node.tag in HIDDEN:
        return True
    own = node.attributes
    if not own or own.isspace():
        return node.tag == "dialog" or bool(node.css) and node.css.get("display") == "none"
    own = own.lower()
    if "hidden" in own and node.get("hidden") not in (None, "until-found"):
        return True
    shown = _DISPLAY.findall(node.get("style") or "") if "display" in own else None
    if shown:
        return shown[-1].lower() == "none"
    if node.css and node.css.get("display") == "none":
        return True
    return node.tag == "dialog" and node.get("open") is None


def _invisible(node: Node, outer: bool) -> bool:
    """Visibility is handed down and may be turned on again further in."""
    if node.attributes and "visibility" in node.attributes.lower():
        found = _VISIBILITY.findall(node.get("style") or "")
        if found:
            return found[-1].lower() != "visible"
    if node.css and "visibility" in node.css:
        return node.css["visibility"] != "visible"
    return outer


def _rules(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of a sheet's rules that stand in no other block."""
    sheet, at = _COMMENT.sub(" ", sheet), 0
    while (opens := sheet.find("{", at)) >= 0:
        head, depth, end = sheet[at:opens].rpartition(";")[2], 1, opens + 1
        for m in re.finditer("[{}]", sheet[end:]) if "@" in head else ():
            depth += 1 if m[0] == "{" else -1
            if not depth:
                end += m.end()
                break
        else:
            if "@" in head:
                return
            end = sheet.find("}", end) + 1
            if not end:
                return
            yield head, sheet[opens + 1 : end - 1]
        at = end


def _styled(root: Node) -> Node:
    """The tree, its elements with what the page's style sheets say about their visibility."""
    sheets, nodes, todo = [], [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        if node.tag == "style":
            sheets += [k for k in node.kids if isinstance(k, str)]
        todo += [k for k in reversed(node.kids) if isinstance(k, Node)]
    known: dict[tuple[str, str], list[tuple[int, int, str, set, dict]]] = {}
    order = 0
    for sheet in sheets:
        for head, body in _rules(sheet) if "display" in sheet or "visibility" in sheet else ():
            says = {k: v[-1].lower() for k, v in (("display", _DISPLAY.findall(body)), ("visibility", _VISIBILITY.findall(body))) if v}
            for selector in head.split(",") if says else ():
                m = _SELECTOR.match(selector.strip())
                if m and m[0]:
                    order += 1
                    parts = set(_PART.findall(m[2]))
                    tag = (m[1] or "*").lower()
                    key = max(parts) if parts else ("", tag)
                    weight = sum(100 if kind == "#" else 10 for kind, _ in parts) + (tag != "*")
                    known.setdefault(key, []).append((weight, order, tag, parts, says))
    for node in nodes if known else ():
        own: set[tuple[str, str]] = set()
        if node.attributes:
            own = {(".", c) for c in (node.get("class") or "").split()} | {("#", i) for i in [node.get("id")] if i}
        some = [r for key in (*own, ("", node.tag), ("", "*")) for r in known.get(key, ()) if r[2] in ("*", node.tag) and r[3] <= own]
        if some:
            node.css = {}
            for *_, says in sorted(some, key=lambda r: r[:2]):
                node.css |= says
    return root


class _Page:
    """Lines of text as they are laid out."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.words: list[str] = []
        self.space = False
        self.gap = False
        self.indent = [""]
        self.mark = ""

    def text(self, s: str, exact: bool) -> None:
        if exact:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self.words.append(first)
            for line in rest:
                self.flush(True)
                self.words.append(line)
            return
        if "\0" in s:
            s = s.replace("\0", "")
        if not s:
            return
        some = s.split() if s.isascii() or not _WIDE_BLANK.search(s) else [w for w in _BLANKS.split(s) if w]
        if some:
            if self.words and (self.space or s[0] in _SPACE):
                self.words.append(" ")
            self.words.append(" ".join(some))
            self.space = s[-1] in _SPACE
        else:
            self.space = True

    def flush(self, keep_empty: bool = False) -> None:
        line = "".join(self.words)
        self.words, self.space = [], False
        if not (line or keep_empty):
            return
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        head, self.mark = self.indent[-1][: len(self.indent[-1]) - len(self.mark)] + self.mark if self.mark else self.indent[-1], ""
        self.lines.append((head + line).rstrip())

    def block(self, spaced: bool) -> None:
        self.flush()
        self.gap = self.gap or spaced

    def line_break(self) -> None:
        if self.words:
            self.flush()
        else:
            self.gap = bool(self.lines)

    def done(self) -> list[str]:
        self.flush()
        return self.lines




def _number(text: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return int(m[1]) if m else default


def render(root: Node, tables: int = 0) -> list[str]:
    """The lines of an element's visible text."""
    page = _Page()
    # Frames: the element, its children left, invisible, preformatted, list state [kind, next number, depth].
    stack: list[tuple[Node, Iterator, bool, bool, list | None]] = [(root, iter(root.kids), False, root.tag in ("pre", "textarea"), None)]
    while stack:
        node, kids, unseen, exact, listed = stack[-1]
        kid = next(kids, None)
        if kid is None:
            stack.pop()
            if stack:
                _leave(page, node)
            continue
        if isinstance(kid, str):
            if not unseen:
                page.text(kid, exact)
            continue
        if hidden(kid):
            continue
        tag = kid.tag
        if tag == "br":
            page.line_break()
        elif tag == "hr":
            page.block(True)
        elif tag == "input":
            kind = (kid.get("type") or "text").lower()
            if kind in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number") and (value := kid.get("value")) and not unseen:
                page.text(value, False)
        elif tag in VOID:
            continue
        elif tag == "table" and tables < MAX_TABLES and not unseen:
            page.block(True)
            for line in _table(kid, tables + 1):
                page.words.append(line)
                page.flush(True)
            page.block(True)
        elif tag == "details" and kid.get("open") is None:
            summary = [k for k in kid.kids if isinstance(k, Node) and k.tag == "summary"][:1]
            page.block(False)
            stack.append((kid, iter(summary), _invisible(kid, unseen), exact, listed))
        else:
            if tag in BLOCK:
                page.block(tag in SPACED and not (tag in _LISTS and listed))
            below = listed
            if tag in _LISTS:
                step = -1 if tag == "ol" and kid.get("reversed") is not None else 1
                items = sum(isinstance(k, Node) and k.tag == "li" for k in kid.kids) if step < 0 else 1
                below = [tag, _number(kid.get("start"), items), step]
            elif tag == "li":
                _item(page, kid, listed)
            elif tag in ("dd", "blockquote"):
                page.indent.append(page.indent[-1] + "    ")
            stack.append((kid, iter(kid.kids), _invisible(kid, unseen), exact or tag in ("pre", "textarea"), below))
    return page.done()


def _item(page: _Page, item: Node, listed: list | None) -> None:
    if listed and listed[0] == "ol":
        number = _number(item.get("value"), listed[1])
        listed[1] = number + listed[2]
        mark = f"{number}. "
    else:
        mark = "- "
    page.mark = mark
    page.indent.append(page.indent[-1] + " " * len(mark))


def _leave(page: _Page, node: Node) -> None:
    if node.tag in BLOCK:
        page.block(node.tag in SPACED and not (node.tag in _LISTS and len(page.indent) > 1))
    if node.tag in ("li", "dd", "blockquote"):
        page.indent.pop()
        page.mark = ""


def _width(text: str) -> int:
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _rows(table: Node) -> tuple[list[Node], list[Node], list]:
    """Captions, rows in the order head, body, foot, and what else stands in the table."""
    captions, head, body, foot, other = [], [], [], [], []
    for part in table.kids:
        if isinstance(part, str):
            if part.strip():
                other.append(part)
        elif hidden(part):
            continue
        elif part.tag == "caption":
            captions.append(part)
        elif part.tag == "tr":
            body.append(part)
        elif part.tag in ("thead", "tbody", "tfoot"):
            rows = {"thead": head, "tbody": body, "tfoot": foot}[part.tag]
            for row in part.kids:
                if isinstance(row, Node) and row.tag == "tr":
                    if not hidden(row):
                        rows.append(row)
                elif isinstance(row, Node) or row.strip():
                    other.append(row)
        elif part.tag not in ("col", "colgroup"):
            other.append(part)
    rows = head + body + foot
    for row in rows:  # what isn't in a cell stands before the table, as a browser shows it
        other += [k for k in row.kids if (k.tag not in ("td", "th") and not hidden(k) if isinstance(k, Node) else k.strip())]
    return captions, rows, other


def _joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Neighbouring or overlapping spans that end in the same row, as one."""
    out: list[tuple[int, int, int]] = []
    for a, b, row in spans:
        if out and out[-1][2] == row and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), row)
        else:
            out.append((a, b, row))
    return out


def _table(table: Node, depth: int) -> list[str]:
    captions, rows, other = _rows(table)
    lines = []
    for extra in [*captions, other] if other else captions:
        if isinstance(extra, list):
            box = Node("div")
            box.kids = extra
            extra = box
        lines += render(extra, depth)
    grid: list[list[tuple[int, int, list[str]]]] = []  # (column, columns, lines) of each row
    taken: list[tuple[int, int, int]] = []  # (column, end, row) that cells from above cover up to a row, by column, apart from each other
    for at, row in enumerate(rows):
        cells, column, turn, new = [], 0, 0, []
        taken = _joined([t for t in taken if t[2] > at])
        for cell in row.kids:
            if not isinstance(cell, Node) or cell.tag not in ("td", "th") or hidden(cell):
                continue
            while turn < len(taken) and taken[turn][0] <= column:
                column = max(column, taken[turn][1])
                turn += 1
            wide = min(MAX_SPAN, max(1, _number(cell.get("colspan"), 1)))
            tall = min(len(rows) - at, max(1, _number(cell.get("rowspan"), 1)))
            cells.append((column, wide, render(cell, depth)))
            if tall > 1:
                new.append((column, column + wide, at + tall))
            column += wide
        taken = sorted(taken + new)
        grid.append(cells)
    width: dict[int, int] = {}
    for cells in grid:
        for column, wide, text in cells:
            own = max(map(_width, text), default=0)
            if wide == 1 and own <= MAX_COLUMN:
                width[column] = max(width.get(column, 0), own)
    used = sorted(width | {c: 0 for cells in grid for c, _, text in cells if text})
    start, x = {}, 0
    for column in used:
        start[column] = x
        x += width.get(column, 0) + 2
    for cells in grid:
        height = max((len(text) for _, _, text in cells), default=0)
        for k in range(height):
            line = ""
            for column, _, text in cells:
                if k < len(text) and text[k]:
                    at = start[column]
                    have = _width(line)
                    line += " " * max(at - have, 2 if have else 0) + text[k]
            lines.append(line)
    return lines


def to_text(page: str | None) -> str:
    """The visible text of a page; empty for null, empty and invisible ones."""
    if not page:
        return ""
    root = parse(page)
    return "\n".join(render(_styled(root) if "<style" in page or "<STYLE" in page else root)).replace("\u00a0", " ")


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, OUT_ROWS):
            part = batch.slice(at, OUT_ROWS)
            texts = [to_text(p) for p in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, type=pa.string())], ["page_id", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id and text, the visible text of ``html``.

    Null and empty pages have an empty text; broken markup is repaired, never an error. Pages of
    any length come out whole, in time that grows with their length. Null and repeated page_ids are
    rows like others, other columns are ignored. An empty table gives an empty result. Elements
    nested deeper than MAX_DEPTH are laid out as children of the one at that depth, tables within
    more than MAX_TABLES others as plain blocks, and a cell wider than MAX_COLUMN doesn't widen its
    column; their text comes out all the same.
    """
    return map_arrow(pages.select(F.col("page_id").cast("long"), "html"), _rendered, "page_id long, text string")


def op3_html_text(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "text", F.length("text").cast("long").alias("n_chars"))
