"""Visible text of web pages by layout.

A page is read once into a tree: unknown nesting is mended by implied end tags, void elements have no content, scripts and styles
are raw text.  The tree is then laid out: blocks stand on lines of their own, paragraphs have a blank line between them, list
items are marked and indented, rows of a table are lines whose cells are padded to their column.  What a browser would not show is
left out: head, scripts, templates, comments, hidden attributes and styles.  All else is emitted, navigation and footers too.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frisk.llm.rows import slices

#: fixed values: element names by their role in HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
UNSEEN = frozenset("head script style template title meta link base noscript iframe noframes object audio video canvas datalist select".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
BLOCK = PARAGRAPH | frozenset("html body div section article aside header footer nav main form fieldset address details summary li dt dd tr caption "
                              "figcaption center legend thead tbody tfoot td th hgroup menu dir".split())
#: an opening tag ends these open elements, up to the nearest of the fences
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "thead": (("tr", "td", "th", "thead", "tbody", "tfoot", "caption"), ("table",)), "tbody": (("tr", "td", "th", "thead", "tbody", "tfoot", "caption"), ("table",)),
    "tfoot": (("tr", "td", "th", "thead", "tbody", "tfoot", "caption"), ("table",)), "option": (("option",), ("select", "datalist")),
    "body": (("head",), ()),
}
_FENCES = frozenset("table td th caption html button object".split())  # no end tag reaches over these unless it names one further out
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SPECIAL = re.compile("[>\"']")
#: an ordinary tag in one step; bounded, so that a failure costs little, and what it finds is what _Tags.tag finds
_ORDINARY = re.compile(r"""([a-zA-Z][^\s/>"']{0,30}+)(?=[\s/>])((?:[^>"']{1,60}+|"[^"]{0,100}+"|'[^']{0,100}+'){0,8}+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?|"[^"]*"|'[^']*'""")
_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
_INTEGER = re.compile(r"\s*([+-]?\d+)")
#: what no browser draws inside drawings and formulas: descriptions, and definitions where they stand; elsewhere these are unknown names
UNDRAWN = frozenset("desc metadata defs symbol clippath mask annotation annotation-xml".split())
MAX_DEPTH = 250  # layout takes up to three frames a level; deeper elements lay their content out in the one at this depth
MAX_COLSPAN = 100  # a wider cell takes so many columns


def attributes(raw: str) -> dict[str, str]:
    """Names in lower case and values of a tag's attributes; of a repeated name the first counts, a name alone has the empty value."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(raw):
        if name:
            out.setdefault(name.lower(), unescape("".join(values)))
    return out


class Node:
    __slots__ = ("name", "attrs", "children", "drawn")

    def __init__(self, name: str, attrs: str = ""):
        self.name, self.attrs, self.children, self.drawn = name, attributes(attrs) if attrs else {}, [], True

    def number(self, attribute: str, default: int) -> int:
        found = _INTEGER.match(self.attrs.get(attribute, ""))
        return int(found[1][:9]) if found else default


class _Tags:
    """Where tags end, in time linear in the page: what a place outside quotes leads to is looked up once."""

    def __init__(self, html: str):
        self.html, self.last, self.known = html, html.rfind(">"), {}
        self.near = self.name = (0, -1)  # a place, and the next special character or name's end from there on

    def _special(self, at: int) -> int:
        if not self.near[0] <= at <= self.near[1]:
            found = _SPECIAL.search(self.html, at)
            self.near = at, found.start() if found else len(self.html)
        return self.near[1]

    def close(self, at: int) -> int:
        """The ``>`` that ends a tag whose attributes start at ``at``; -1 without one, or where a quote stays open."""
        path, end = [], None
        while end is None:
            at = self._special(at)
            if at in self.known:
                end = self.known[at]
            elif at >= len(self.html):
                end = -1
            elif self.html[at] == ">":
                end = at
            else:
                path.append(at)
                shut = self.html.find(self.html[at], at + 1)
                if shut < 0:
                    end = -1
                at = shut + 1
        self.known.update(dict.fromkeys(path, end))
        return end

    def tag(self, at: int) -> tuple[str, int, int] | None:
        """(name, start of the attributes, place of the end) of a tag whose name starts at ``at``."""
        plain = _ORDINARY.match(self.html, at)
        if plain:
            return plain[1].lower(), plain.start(2), plain.end(2)
        if at > self.last or not (self.html[at].isascii() and self.html[at].isalpha()):
            return None
        if not self.name[0] <= at <= self.name[1]:
            self.name = at, _NAME.match(self.html, at).end()
        stop = self.name[1]
        end = self.close(stop)
        if end < 0:  # quotes inside the name may pair with later ones
            stop = self._special(at)
            if stop >= self.name[1] or stop == at:
                return None
            end = self.close(stop)
        return None if end < 0 else (self.html[at:stop].lower(), stop, end)


class _Open:
    """The open elements, and at which places of the stack each name stands."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            node = self.stack.pop()
            self.places[node.name].pop()
            if node.name in BLOCK and node.children is self.stack[-1].children:  # beyond MAX_DEPTH: what follows is apart
                node.children.append(Node("p" if node.name in PARAGRAPH else "div"))

    def nearest(self, names) -> int:
        """The innermost place of any of ``names``, 0 without one."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def close(self, names, fences=()) -> None:
        """Ends all elements of ``names`` inside the innermost fence."""
        fence = self.nearest(fences)
        while (k := self.nearest(names)) > fence:
            self.cut(k)

    def end(self, name: str) -> None:
        k = self.nearest((name,))
        if k and (name in BLOCK or k >= self.nearest(_FENCES)):
            self.cut(k)


def tree(html: str) -> Node:
    """The page as nodes and strings; never fails, whatever the tags, in time linear in the page."""
    root = Node("html")
    tags, opened = _Tags(html), _Open(root)
    at = look = 0

    def text(upto: int) -> None:
        if upto > at:
            opened.stack[-1].children.append(unescape(html[at:upto]))

    while (start := html.find("<", look)) >= 0:
        if html.startswith(("<!--", "<![CDATA["), start):
            raw = html[start + 2] == "["
            shut = html.find("]]>" if raw else "-->", start + (9 if raw else 4))
            text(start)
            if raw:
                opened.stack[-1].children.append(html[start + 9:shut if shut >= 0 else len(html)])
            at = look = shut + 3 if shut >= 0 else len(html)
            continue
        if html.startswith(("<!", "<?"), start):
            if start < tags.last:
                text(start)
                at = look = html.find(">", start) + 1
            else:
                look = start + 1
            continue
        ending = html.startswith("/", start + 1)
        found = tags.tag(start + 1 + ending)
        if found is None:
            look = start + 1
            continue
        text(start)
        name, stop, end = found
        at = look = end + 1
        if ending:
            if name in ("p", "br") and not opened.nearest((name,)):
                opened.stack[-1].children.append(Node(name))
            else:
                opened.end(name)
            continue
        if name in IMPLIED:
            opened.close(*IMPLIED[name])
        elif name in BLOCK:
            opened.close(("p",), _FENCES)
        if name in BLOCK and name != "head" and opened.stack[-1].name == "head" and len(opened.stack) > 1:
            opened.cut(len(opened.stack) - 1)
        node = Node(name, html[stop:end])
        node.drawn = name not in UNDRAWN or not opened.nearest(("svg", "math"))
        parent = opened.stack[-1]
        parent.children.append(node)
        if name in RAW:
            after = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at, tags.last + 1)
            body = html[at:after.start()] if after else html[at:]
            node.children.append(unescape(body) if name in ("textarea", "title") else body)
            at = look = after.end() if after else len(html)
        elif name not in VOID and not html[stop:end].rstrip().endswith("/"):
            if len(opened.stack) >= MAX_DEPTH and _seen(node):
                node = Node(name)  # its content stands behind the element itself
                node.children = parent.children
            opened.push(node)
    text(len(html))
    return root


class _Lines:
    """Text under construction: words are joined, breaks are remembered until a word follows."""

    def __init__(self):
        self.out: list[str] = []
        self.line: list[str] = []
        self.gap = 0  # line breaks wanted before the next word
        self.space = False

    def words(self, text: str, keep: bool = False) -> None:
        if keep:
            rows = text.replace("\r\n", "\n").split("\n")
            for k, row in enumerate(rows):
                if k:
                    self.flush()
                    self.gap += 1 if self.out else 0
                if row:
                    self._before()
                    self.line.append(row)
            return
        parts = text.split()
        if not parts:
            self.space |= bool(text)
            return
        self._before()
        if self.line and (self.space or text[0].isspace()):
            self.line.append(" ")
        self.line.append(" ".join(parts))
        self.space = text[-1].isspace()

    def _before(self) -> None:
        if self.gap and not self.line:
            self.out += [""] * min(self.gap - 1, 1) if self.out else []
            self.gap = 0

    def flush(self) -> None:
        if self.line:
            self.out.append("".join(self.line).rstrip())
        self.line, self.space = [], False

    def blank(self, breaks: int) -> None:
        self.flush()
        self.gap = max(self.gap, breaks)

    def lines(self) -> list[str]:
        self.flush()
        return self.out


def _seen(node: Node) -> bool:
    if node.name in UNSEEN or not node.drawn:
        return False
    a = node.attrs
    return not a or not ("hidden" in a or a.get("aria-hidden", "").strip().lower() == "true" or _styled_away(a.get("style", "")))


def _styled_away(style: str) -> bool:
    """Of repeated declarations the last important one counts, or else the last."""
    said = {}
    for part in _COMMENT.sub("", style).lower().split(";"):
        name, _, value = part.partition(":")
        value, mark, _ = value.partition("!")
        if mark or not said.get(name.strip(), ("", ""))[1]:
            said[name.strip()] = value.strip(), mark
    return said.get("display", ("",))[0] == "none" or said.get("visibility", ("",))[0] == "hidden"


def _inner(node: Node, keep: bool = False) -> list[str]:
    inside = _Lines()
    _lay(node, inside, keep)
    return inside.lines()


def _emit(to: _Lines, rows: list[str]) -> None:
    for k, row in enumerate(rows):
        if k:
            to.flush()
            to.gap = max(to.gap, 1)
        if row:
            to._before()
            to.line.append(row)
        else:
            to.gap = 2
    to.flush()


def _lay(node: Node, to: _Lines, keep: bool = False) -> None:
    number = node.number("start", 1)
    for child in node.children:
        if isinstance(child, str):
            to.words(child, keep)
            continue
        if not _seen(child):
            continue
        name = child.name
        if name == "br":
            to.flush()
            to.gap = min(to.gap + 1, 2) if to.out else 0
        elif name == "hr":
            to.blank(2)
        elif name == "img":
            to.words(child.attrs.get("alt", ""))
        elif name == "table":
            to.blank(2)
            _emit(to, _table(child))
            to.blank(2)
        elif name == "li":
            number = child.number("value", number)
            mark = f"{number}. " if node.name == "ol" else "- "
            number += 1
            to.blank(1)
            rows = _inner(child, keep) or [""]
            _emit(to, [(mark if not k else " " * len(mark)) + row if row or not k else "" for k, row in enumerate(rows)])
            to.blank(1)
        elif name in BLOCK:
            wide = 2 if name in PARAGRAPH and not (name in ("ul", "ol") and node.name == "li") else 1
            to.blank(wide)
            if name in ("dd", "blockquote"):
                _emit(to, ["  " + row if row else "" for row in _inner(child, keep)])
            else:
                _lay(child, to, keep or name == "pre")
            to.blank(wide)
        else:
            apart = name in ("text", "foreignobject")  # of a drawing: each stands at a place of its own
            if apart:
                to.words(" ")
            _lay(child, to, keep)
            if apart or name in ("td", "th"):
                to.words(" ")


def _rows(node: Node) -> tuple[list[Node], list[Node]]:
    """Rows of a table, those inside its sections too, and what is not a row (captions and stray content)."""
    rows, other = [], []
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                other.append(child)
        elif _seen(child):
            if child.name == "tr":
                rows.append(child)
            elif child.name in ("thead", "tbody", "tfoot"):
                more, rest = _rows(child)
                rows += more
                other += rest
            elif child.name in ("td", "th"):
                if not rows or rows[-1].name != "row":
                    rows.append(Node("row"))
                rows[-1].children.append(child)
            else:
                other.append(child)
    return rows, other


def _table(node: Node) -> list[str]:
    """Caption, then one block of lines per row; a cell starts where its column starts, cells of several lines stay in their column."""
    rows, other = _rows(node)
    holder = Node("div")
    holder.children = other
    out = _inner(holder)
    grid, taken = [], {}  # columns that cells of earlier rows reach into, and for how many rows more
    for row in rows:
        cells, below = [], {c: n - 1 for c, n in taken.items() if n > 1}
        for cell in row.children:
            if isinstance(cell, str) and not cell.strip() or isinstance(cell, Node) and not _seen(cell):
                continue
            while len(cells) in taken:
                cells.append([])
            if isinstance(cell, str):
                cells.append([cell.strip()])
                continue
            wrap = Node("div")
            wrap.children = cell.children if cell.name in ("td", "th") else [cell]
            first = len(cells)
            cells.append(_inner(wrap))
            cells += [[] for _ in range(min(cell.number("colspan", 1), MAX_COLSPAN) - 1)]
            down = cell.number("rowspan", 1) or len(rows)  # 0: to the end of the table
            if down > 1:
                below.update(dict.fromkeys(range(first, len(cells)), down - 1))
        taken = below
        if any(cells):
            grid.append(cells)
    width = [max((len(line) for row in grid if c < len(row) for line in row[c]), default=0) for c in range(max(map(len, grid), default=0))]
    for row in grid:
        for k in range(max(map(len, row))):
            cells = [(cell[k] if k < len(cell) else "").ljust(width[c]) for c, cell in enumerate(row)]
            out.append(" | ".join(cells).rstrip() if len(cells) > 1 else cells[0].rstrip())
    return out


def render(html: str | None) -> str:
    """The visible text of a page; null and empty pages have none."""
    if not html:
        return ""
    return "\n".join(_inner(tree(html))).strip("\n")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) per row; repeated rows, null ids and null pages give a row each, an empty table none."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html"))

    def run(batches):
        for batch in slices(batches, "html", 8 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(render, batch.column(1).to_pylist()), pa.string())], names=["page_id", "text"])
    return rows.mapInArrow(run, "page_id long, text string")
