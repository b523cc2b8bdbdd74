"""HTML extraction by layout-aware rendering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEAD = set("base link meta noscript script style template title".split())
UNSEEN = set("head title script style template noframes audio video canvas iframe object map datalist rp".split())
#: Blocks begin and end a line; those with a margin also leave an empty line.
MARGIN = set("p h1 h2 h3 h4 h5 h6 ul ol menu dl table pre blockquote figure hr fieldset".split())
BLOCK = MARGIN | set("html body address article aside center dd details dialog dir div dt figcaption footer form header hgroup legend li listing main nav noscript optgroup option search section summary caption".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
SECTIONS = {"tbody", "thead", "tfoot"}
CELLS = {"td", "th"}
TABLE_PARTS = SECTIONS | CELLS | {"tr", "caption", "colgroup", "col"}
#: Start tag: the open elements it closes, up to the nearest of its scope.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "a": ({"a"}, {"table", "td", "th"}),
    "button": ({"button"}, {"table", "td", "th"}),
}
#: Columns are padded to their widest line of at most so many characters, so that one long cell doesn't widen every row.
PAD = 80
#: Levels of lists and quotations that are indented; deeper ones stand below the last.
LEVELS = 50
#: No cell is moved further to the right than so many characters, so that blanks stay in proportion to a table's cells.
REACH = 1000
_SPACES = re.compile(r"[ \t\n\f\r]+")
_STYLE = re.compile(r"(?<![\w-])(display|visibility)\s*:\s*([a-z-]+)")
_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
_MARK = re.compile(r"[@{};]")
_SELECTOR = re.compile(r"(\*|[a-z][a-z0-9]*)?((?:[.#][\w-]+)*)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


class Tree(HTMLParser):
    """Builds the element tree; start and end tags that HTML lets authors leave out are implied.

    The places of the open elements are kept by name, so that no tag walks the
    whole stack: time is linear in the page, however deep it nests.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.styles: list[str] = []
        self._enter(self.root)
        end = html.rfind("<", html.rfind(">") + 1)
        end = html.rfind(">") + 1 if end >= 0 else len(html)
        self.feed(html[:end])
        if end < len(html) and not self.rawdata and self.cdata_elem is None:
            self.handle_data(unescape(html[end:]))  # no tag ends here: text, read once instead of tag by tag
        else:
            self.feed(html[end:])
        self.close()

    def _enter(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def _cut(self, at: int) -> None:
        """Closes the open elements from place ``at`` on."""
        for node in reversed(self.open[at:]):
            self.places[node.tag].pop()
        del self.open[at:]

    def _innermost(self, names: set[str]) -> int:
        """The place of the innermost open element among names, but for the root; -1 if there is none."""
        return max((p[-1] for n in names if (p := self.places.get(n)) and p[-1] > 0), default=-1)

    def _pop_to(self, names: set[str], scope: set[str]) -> bool:
        """Closes the innermost open element among names, if it is open inside the scope."""
        at = self._innermost(names)
        if at < 0 or at < self._innermost(scope - names):
            return False
        self._cut(at)
        return True

    def _pop_until(self, names: set[str]) -> bool:
        """Closes what is open inside the innermost element among names."""
        at = self._innermost(names)
        if at < 0:
            return False
        self._cut(at + 1)
        return True

    def _add(self, child: Node | str) -> None:
        """Appends where the parser stands; what can't stand between a table's parts goes before the table."""
        parent = self.open[-1]
        part = isinstance(child, Node) and (child.tag in TABLE_PARTS or child.tag in HEAD)
        if parent.tag in SECTIONS | {"table", "tr"} and not part:
            outer = self.open[self.places["table"][-1] - 1].children
            outer.insert(len(outer) - 1, child)
        else:
            parent.children.append(child)

    def _push(self, tag: str, attrs: dict[str, str | None]) -> None:
        node = Node(tag, attrs)
        self._add(node)
        if tag not in VOID:
            self._enter(node)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = dict(reversed(attrs))
        if tag == "html":
            return
        if tag in ("head", "body"):
            if self.places.get("body"):
                return
            self._pop_to({"head"}, set())
        elif tag not in HEAD:
            self._pop_to({"head"}, set())
        if tag in TABLE_PARTS:
            if not self.places.get("table"):
                return
            if tag in CELLS:
                self._pop_until({"tr", "table"} | SECTIONS)
                if self.open[-1].tag == "table":
                    self._push("tbody", {})
                if self.open[-1].tag != "tr":
                    self._push("tr", {})
            elif tag == "tr":
                self._pop_until(SECTIONS | {"table"})
                if self.open[-1].tag == "table":
                    self._push("tbody", {})
            else:
                self._pop_until({"colgroup", "table"} if tag == "col" else {"table"})
        elif tag in CLOSES:
            self._pop_to(*CLOSES[tag])
        if tag in BLOCK and tag not in TABLE_PARTS:
            self._pop_to({"p"}, {"button", "table", "td", "th", "caption"})
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._cut(len(self.open) - 1)
        self._push(tag, own)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self._push("br", {})
        elif tag in HEADINGS:
            self._pop_to(HEADINGS, {"table"} | CELLS)
        elif tag == "table":
            self._pop_to({"table"}, set())
        elif tag in TABLE_PARTS:
            self._pop_to({tag}, {"table"})
        elif not self._pop_to({tag}, {"table", "caption"} | CELLS) and tag == "p":
            self._add(Node("p", {}))

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "style":
            self.styles.append(data)
        if self.open[-1].tag == "head":
            if not data.strip():
                return
            self._cut(len(self.open) - 1)
        if data.strip(" \t\n\f\r") or self.open[-1].tag not in SECTIONS | {"table", "tr", "colgroup"}:
            self._add(data)


class Box:
    """Lines of text under construction."""

    def __init__(self, levels: int) -> None:
        self.levels = levels
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = self.space = False
        self.indents: list[str] = []
        self.marker = ""

    def text(self, data: str, pre: bool) -> None:
        if pre:
            for i, part in enumerate(data.replace("\r\n", "\n").split("\n")):
                if i:
                    self.end(True)
                if part:
                    self.line.append(part)
            return
        words = _SPACES.split(data)
        if not words[0]:
            self.space = True
        body = " ".join(w for w in words if w)
        if body:
            if self.line and self.space and not self.line[-1].endswith(" "):
                self.line.append(" ")
            self.line.append(body)
            self.space = not words[-1]

    def _lead(self) -> str:
        lead = "".join(self.indents[: self.levels])
        if self.marker:
            lead = lead[: len(lead) - len(self.marker)] + self.marker if len(self.indents) <= self.levels else lead + self.marker
            self.marker = ""
        return lead

    def end(self, forced: bool = False) -> None:
        """Ends the line; an empty one counts only if it is forced."""
        if self.line or forced:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append((self._lead() + "".join(self.line)).rstrip() if self.line else "")
        self.line, self.space = [], False

    def block(self, margin: bool) -> None:
        self.end()
        self.gap |= margin

    def whole(self, lines: list[str]) -> None:
        for x in lines:
            self.line = [x] if x else []
            self.end(True)


class Table:
    """Rows of cells, each with its lines and spans."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, list[str]]]] = []

    def lines(self, pad: int, reach: int) -> list[str]:
        placed, busy = [], {}
        for cells in self.rows:
            row, at = [], 0
            below = {c: n - 1 for c, n in busy.items() if n > 1}
            for across, down, lines in cells:
                while at in busy:
                    at += 1
                row.append((at, across, lines))
                if down > 1:
                    below |= dict.fromkeys(range(at, at + across), down - 1)
                at += across
            placed.append(row)
            busy = below
        width: dict[int, int] = {}
        for row in placed:
            for at, across, lines in row:
                if across == 1:
                    width[at] = max([width.get(at, 0), *(len(x) for x in lines if len(x) <= pad)])
        ends, out = [0], []
        for c in range(min(1000, max(width, default=-1) + 1)):
            ends.append(ends[-1] + width.get(c, 0) + 2)
        for row in placed:
            for i in range(max([1, *(len(lines) for _, _, lines in row)]) if row else 0):
                text = ""
                for at, _, lines in row:
                    left = ends[at] if at < len(ends) else ends[-1] + 2 * (at - len(ends) + 1) if at < 1000 else len(text)
                    apart, left = 2 * (left > reach), min(left, reach)
                    if i < len(lines) and lines[i]:
                        text = text.ljust(left) if len(text) + apart <= left else f"{text}  "
                        text += lines[i]
                out.append(text)
        return out


def _number(node: Node, name: str, most: int) -> int:
    value = node.attrs.get(name) or ""
    return min(most, max(1, int(value))) if value.isdecimal() and len(value) < 9 else 1


def _flat(css: str) -> str:
    """Style text without at-rules and their blocks, in one pass; an @ whose statement doesn't end is plain text."""
    flat, start, depth, rule = [], 0, 0, None
    for m in _MARK.finditer(css):
        mark, at = m[0], m.start()
        if depth:
            depth += {"{": 1, "}": -1}.get(mark, 0)
            start = at + 1
        elif mark == "@":
            rule = at if rule is None else rule
        elif rule is not None:
            if mark != "}":
                flat.append(css[start:rule])
                start, depth = at + 1, int(mark == "{")
            rule = None
    return "".join([*flat, "" if depth else css[start:]])


class Styles:
    """Rules of a page's style elements that set display or visibility.

    Selectors of one element are honoured: a tag, classes and an id, alone or
    together (``p``, ``.a``, ``#x``, ``p.a.b``), also in lists. Others
    (descendants, attributes, pseudo-classes) and at-rules are passed over.
    """

    def __init__(self, texts: list[str]):
        self.rules: dict[str, list[tuple]] = {}
        css = _flat(_COMMENT.sub("", "\n".join(texts)))
        for at, part in enumerate(css.split("}")[:-1]):
            *_, selectors, body = ["", *part.rsplit("{", 2)]
            if "{" not in part:
                continue
            found = dict(_STYLE.findall(body.lower()))
            for one in selectors.split(",") if found else ():
                m = _SELECTOR.fullmatch(one.strip())
                if not m or not m[0]:
                    continue
                tag = (m[1] or "*").lower()
                marks = re.findall(r"[.#][\w-]+", m[2])
                weight = (sum(x[0] == "#" for x in marks), sum(x[0] == "." for x in marks), tag != "*", at)
                # Filed under its rarest part, so that an element looks at few rules.
                key = next((x for x in marks if x[0] == "#"), next(iter(marks), tag))
                self.rules.setdefault(key, []).append((weight, tag, set(marks), found))

    def of(self, node: Node) -> list[tuple[str, str]]:
        """(property, value) for an element, the weightiest last: rules, then its own style."""
        out = []
        if self.rules:
            marks = {f".{c}" for c in (node.attrs.get("class") or "").split()} | ({f"#{node.attrs['id']}"} if node.attrs.get("id") else set())
            fit = [r for key in (*marks, node.tag, "*") for r in self.rules.get(key, ()) if r[1] in ("*", node.tag) and r[2] <= marks]
            out = [x for r in sorted(fit, key=lambda r: r[0]) for x in r[3].items()]
        return out + _STYLE.findall((node.attrs.get("style") or "").lower())


def _hidden(node: Node, hidden: bool, styles: Styles) -> tuple[bool, bool]:
    """(not rendered at all, text is invisible) for an element inside one whose text is ``hidden``."""
    if node.tag in UNSEEN or node.tag == "dialog" and "open" not in node.attrs:
        return True, hidden
    gone = "hidden" in node.attrs
    for name, value in styles.of(node):
        if name == "display":
            gone = value == "none"
        else:
            hidden = hidden if value == "inherit" else value in ("hidden", "collapse")
    return gone, hidden


def _shown_option(select: Node) -> list[Node]:
    """The option that a closed list shows: the selected one, else the first."""
    found, todo = [], [select]
    while todo:
        node = todo.pop()
        if node.tag == "option":
            found.append(node)
        else:
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return [n for n in found if "selected" in n.attrs][:1] or found[:1]


def render(html: str | None, pad: int = PAD, levels: int = LEVELS, reach: int = REACH) -> str:
    """All visible text of a page, with line breaks, blank lines, list markers and aligned table cells as it would be laid out.

    Visibility follows element types, the hidden attribute, inline styles and
    the rules of style elements (see ``Styles``; no linked sheets or scripts).
    A table's columns are as wide as their widest line of at most ``pad``
    characters: longer lines push what follows in their row, but lose nothing.
    Cells of columns farther than ``reach`` characters from the left begin
    there, or after what stands there. Time is linear in style text and in tags
    that never end, and blanks grow with the number of cells. ``levels`` of lists and quotations are indented. Null or empty: ''.
    """
    if not html:
        return ""
    tree = Tree(html)
    styles = Styles(tree.styles)
    boxes: list[Box] = [Box(levels)]
    tables: list[Table] = []
    lists: list[list] = []
    # (node or text, text is invisible, white space is kept); None for the node: leave the element
    todo: list[tuple] = [(tree.root, False, False, False)]
    while todo:
        node, hidden, pre, leave = todo.pop()
        box = boxes[-1]
        if isinstance(node, str):
            if not hidden:
                box.text(node, pre)
            continue
        tag = node.tag
        if leave:
            if tag in CELLS:
                boxes.pop().end()
                lines = box.lines
                if tables[-1].rows:
                    tables[-1].rows[-1].append((_number(node, "colspan", 1000), _number(node, "rowspan", 65534), lines))
            elif tag == "table":
                lines = tables.pop().lines(pad, reach)
                box.whole(lines)
                box.block(True)
            elif tag in BLOCK:
                box.block(tag in MARGIN and not (tag in ("ul", "ol", "menu") and len(lists) > 1))
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            if tag in ("li", "blockquote", "dd"):
                box.indents.pop()
                box.marker = ""
            continue
        gone, hidden = _hidden(node, hidden, styles)
        if gone:
            continue
        pre = pre or tag in ("pre", "textarea", "listing")
        if tag == "br":
            box.end(True)
            continue
        if tag == "input":
            if (node.attrs.get("type") or "text").lower() in ("text", "search", "submit", "button", "reset", "email", "url", "tel", "number") and not hidden:
                box.text(node.attrs.get("value") or "", False)
            continue
        children = node.children
        if tag == "select":
            children = [c for o in _shown_option(node) for c in o.children]
        elif tag == "details" and "open" not in node.attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        if tag in CELLS:
            boxes.append(Box(levels))
        elif tag == "tr" and tables:
            tables[-1].rows.append([])
        elif tag in BLOCK or tag == "table":
            box.block(tag in MARGIN and not (tag in ("ul", "ol", "menu") and lists))
        if tag == "table":
            tables.append(Table())
        elif tag in ("ul", "ol", "menu", "dir"):
            lists.append([tag == "ol", _number(node, "start", 10**8)])
        elif tag == "li":
            ordered = bool(lists) and lists[-1][0]
            marker = f"{lists[-1][1]}. " if ordered else "- "
            if ordered:
                lists[-1][1] += 1
            box.indents.append(" " * len(marker))
            box.marker = "" if hidden else marker
        elif tag in ("blockquote", "dd"):
            box.indents.append("  ")
        todo.append((node, hidden, pre, True))
        todo += [(c, hidden, pre, False) for c in reversed(children)]
    boxes[0].end()
    return "\n".join(boxes[0].lines).strip("\n")


def extract(pages: DataFrame, pad: int = PAD) -> DataFrame:
    """pages with the column text: everything visible on the whole page (see ``render``).

    Null or empty html: empty text. Repeated rows and rows with null ids are
    kept; an empty table gives an empty result. A column text of pages is
    replaced, other columns are kept.
    """

    @F.pandas_udf("string")
    def rendered(htmls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in htmls:
            yield part.map(lambda html: render(html, pad))

    return pages.withColumn("text", rendered(F.coalesce(F.col("html").cast("string"), F.lit(""))))


def op7_html_extraction(spark, sf_dir):
    """The text of every page; edge cases as in ``extract``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).drop("html")
