"""HTML to text, laid out: a tree with implied tags, visibility rules, then rendering.

``parse`` builds a tree: elements whose end tags may be left out are closed by
what follows them (p, li, dt, dd, option, table parts), rows and cells get the
row or table part they imply, and void elements have no children. ``render``
walks it and emits all visible text: nothing from scripts, styles, templates,
head, or elements hidden by attribute or style. Blocks stand on lines of their
own, paragraphs, headings, lists and tables between blank lines; list items
have bullets or numbers and are indented by level; table cells are padded so
that columns line up; pre keeps its white space.

A page is one row, worked on by itself; pages never shuffle. What visible
elements nested deeper than DEPTH hold hangs on their ancestor at that depth, so
no text is lost; they are opened, closed and hidden like any other.

Defined cases: NULL and empty pages give an empty text; broken markup is read
as far as it makes sense, a "<" that starts no tag is text; numbers in
attributes are read as the standard says (ASCII digits, what follows them does
not count), others and those out of range stand for the default or the limit;
repeated rows give equal texts; other columns are carried by ``with_text``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kasaflow.llm.common import table

DEPTH = 150
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes title object datalist".split())
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())  # others end an open head
# block elements and the blank lines around them
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr fieldset".split())
BLOCK = SPACED | frozenset("html body div section article header footer nav main aside address form li dt dd figcaption "
                           "tr td th thead tbody tfoot caption legend details summary center option select hgroup dir menu".split())
# a start tag of the key closes an open element of the value, unless a fence lies between
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
          "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          **{t: {"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"} for t in ("thead", "tbody", "tfoot")},
          "body": {"head"}}
FENCE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}, "optgroup": {"select"}}
TABLE_FENCE = {"table"}

TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>", re.S)
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
HIDING = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
WHITE = re.compile(r"[ \t\n\r\f\v]+")
NUMBER = re.compile(r"[ \t\n\r\f]*([+-]?)0*([0-9]+)", re.A)
MOST_DIGITS = 9
MOST_COLUMNS, MOST_ROWS = 1_000, 65_534


def number(text: str | None, default: int, lo: int, hi: int) -> int:
    """An attribute's whole number within its limits; the default if it is none or below ``lo``."""
    m = NUMBER.match(text) if text else None
    if not m:
        return default
    value = int(m.group(2)) if len(m.group(2)) <= MOST_DIGITS else 10 ** MOST_DIGITS
    value = -value if m.group(1) == "-" else value
    return default if value < lo else min(value, hi)


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.kids = tag, attrs, []


def _attributes(text: str) -> dict:
    return {k.lower(): unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(text)} if text else {}


class Open:
    """The open elements, innermost last, with the places of every tag. ``holder`` takes what an element holds:
    the element itself, or beyond DEPTH the holder of the one around it (a hidden element keeps its own)."""

    def __init__(self, root: Node):
        self.nodes, self.holders, self.places = [root], [root], {"html": [0]}

    def push(self, node: Node) -> None:
        deep = len(self.nodes) >= DEPTH and visible(node)
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)
        self.holders.append(self.holders[-1] if deep else node)

    def cut(self, k: int) -> None:
        """Close the element at place ``k`` and all inside it."""
        for node in self.nodes[k:]:
            self.places[node.tag].pop()
        del self.nodes[k:], self.holders[k:]

    def innermost(self, names) -> int:
        """Place of the innermost open element of ``names`` (below the root), or 0."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    @property
    def tag(self) -> str:
        return self.nodes[-1].tag

    def add(self, kid) -> None:
        self.holders[-1].kids.append(kid)


def parse(html: str) -> Node:
    root = Node("html", {})
    open_ = Open(root)

    def end_head() -> None:
        """What does not belong in a head that is still open ends it."""
        if open_.tag == "head":
            open_.cut(len(open_.nodes) - 1)

    def add_text(s: str) -> None:
        if s:
            if WHITE.sub("", s):
                end_head()
            open_.add(unescape(s) if "&" in s else s)

    def close_to(names: set, fence: set) -> bool:
        """Close the innermost open element of ``names`` (and what it holds), not crossing ``fence``."""
        k = open_.innermost(names)
        if k <= open_.innermost(fence - names):
            return False
        open_.cut(k)
        return True

    def start(tag: str, attrs: dict) -> None:
        if tag in BLOCK or tag == "body":
            close_to({"p"}, {"td", "th", "table", "button", "caption", "object", "html"} if tag != "p" else {"td", "th", "table", "button", "li", "div"})
        if tag in CLOSES:
            while close_to(CLOSES[tag], FENCE.get(tag, TABLE_FENCE)):  # a row closes the cell before it and the row before it
                pass
        if tag in ("td", "th") and open_.tag in ("table", "thead", "tbody", "tfoot"):
            start("tr", {})
        if tag not in IN_HEAD:
            end_head()
        node = Node(tag, attrs)
        open_.add(node)
        if tag not in VOID:
            open_.push(node)

    at = 0
    while True:
        lt = html.find("<", at)
        if lt < 0:
            add_text(html[at:])
            return root
        m = TAG.match(html, lt) or PLAIN_TAG.match(html, lt)
        if not m:
            add_text(html[at:lt + 1])
            at = lt + 1
            continue
        add_text(html[at:lt])
        at = m.end()
        if m.re is TAG and m.group(3) is None:
            if m.group(1):
                end_head()
                open_.add(m.group(1))
            continue
        end, tag, rest = m.groups()[-3:]
        tag = tag.lower()
        if end:
            if tag == "p" and not open_.places.get("p"):
                open_.add(Node("p", {}))
            elif tag == "br":
                end_head()
                open_.add(Node("br", {}))
            elif tag not in ("html", "body"):
                close_to({tag}, TABLE_FENCE if tag not in BLOCK else TABLE_FENCE - {tag})
            continue
        if tag == "html":
            root.attrs |= _attributes(rest)
            continue
        start(tag, _attributes(rest))
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            body = html[at:stop.start() if stop else len(html)]
            open_.nodes[-1].kids.append(unescape(body) if tag in ("textarea", "title") else body)
            open_.cut(len(open_.nodes) - 1)
            at = stop.end() if stop else len(html)


def visible(node: Node) -> bool:
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a:
        return False
    return not ("style" in a and HIDING.search(a["style"]))


class Lines:
    """Finished lines and the line being filled; ``gap`` is the blank lines due before the next."""

    def __init__(self):
        self.done: list[str] = []
        self.line = ""
        self.gap = 0

    def text(self, s: str, raw: bool = False) -> None:
        if raw:
            self.line += s
        else:
            s = WHITE.sub(" ", s)
            self.line += s.lstrip(" ") if not self.line or self.line[-1] == " " else s

    def end_line(self, keep_empty: bool = False) -> None:
        s = self.line.rstrip(" ")
        self.line = ""
        if s or keep_empty:
            self.put([s])

    def put(self, lines: list[str]) -> None:
        if self.done and self.gap and lines:
            self.done += [""] * self.gap
        if lines:
            self.gap = 0
        self.done += lines

    def margin(self, n: int) -> None:
        self.end_line()
        self.gap = max(self.gap, n)


def lines_of(node: Node, raw: bool = False) -> list[str]:
    out = Lines()
    fill(out, node, raw)
    out.end_line()
    return out.done


def fill(out: Lines, node: Node, raw: bool) -> None:
    count = number(node.attrs.get("start"), 1, -10 ** MOST_DIGITS, 10 ** MOST_DIGITS) - 1  # of an ordered list
    for kid in node.kids:
        if isinstance(kid, str):
            if not raw:
                out.text(kid)
            else:
                first, *more = kid.replace("\r\n", "\n").split("\n")
                out.text(first, True)
                for s in more:
                    out.end_line(True)
                    out.text(s, True)
            continue
        tag = kid.tag
        if not visible(kid):
            continue
        if tag == "br":
            out.end_line(True)
        elif tag == "hr":
            out.margin(1)
        elif tag == "table":
            out.margin(1)
            out.put(table_lines(kid))
            out.margin(1)
        elif tag == "li":
            out.margin(0)
            if node.tag == "ol":
                count += 1
                mark = f"{count}. "
            else:
                mark = "- "
            body = lines_of(kid)
            if body:
                out.put([mark + body[0]] + [" " * len(mark) + s if s else s for s in body[1:]])
        elif tag in ("ul", "ol", "menu", "dir"):
            out.margin(0 if node.tag == "li" else 1)
            fill(out, kid, raw)
            out.margin(0 if node.tag == "li" else 1)
        elif tag in ("dd", "blockquote"):
            out.margin(1 if tag == "blockquote" else 0)
            out.put(["  " + s if s else s for s in lines_of(kid, raw)])
            out.margin(1 if tag == "blockquote" else 0)
        elif tag in BLOCK:
            n = 1 if tag in SPACED else 0
            out.margin(n)
            fill(out, kid, raw or tag == "pre")
            out.margin(n)
        elif tag == "input":
            if kid.attrs.get("type", "text").lower() in ("submit", "button", "reset"):
                out.text(kid.attrs.get("value", ""))
        else:
            fill(out, kid, raw or tag in ("textarea", "xmp"))


def table_lines(node: Node) -> list[str]:
    """A table's caption, then its rows with every column as wide as its widest cell. A cell of several rows
    keeps its columns in them, up to the end of its table part."""
    above: list[str] = []
    rows: list[list[tuple[list[str], int, int]]] = []        # lines, column, columns, of each cell

    def gather(n: Node) -> None:
        taken: dict[int, int] = {}                           # column -> rows it is still taken for
        for kid in n.kids:
            if isinstance(kid, str):
                if kid.strip():
                    above.append(WHITE.sub(" ", kid).strip())
            elif not visible(kid):
                continue
            elif kid.tag in ("thead", "tbody", "tfoot"):
                taken.clear()
                gather(kid)
            elif kid.tag == "tr":
                rows.append(row(kid, taken))
            else:
                holder = Node("div", {})
                holder.kids.append(kid)
                above.extend(lines_of(holder))

    def row(tr: Node, taken: dict[int, int]) -> list[tuple[list[str], int, int]]:
        cells, k, new = [], 0, {}
        for c in tr.kids:
            if isinstance(c, str):
                if c.strip():
                    above.append(WHITE.sub(" ", c).strip())
            elif visible(c):
                while taken.get(k):
                    k += 1
                holder = c if c.tag in ("td", "th") else Node("td", {})
                if holder is not c:
                    holder.kids.append(c)
                span = number(c.attrs.get("colspan"), 1, 1, MOST_COLUMNS)
                down = number(c.attrs.get("rowspan"), 1, 0, MOST_ROWS) or MOST_ROWS  # 0: to the end of the part
                cells.append((lines_of(holder), k, span))
                if down > 1:
                    new |= dict.fromkeys(range(k, k + span), down - 1)
                k += span
        for col in [c for c, left in taken.items() if left <= 1]:
            del taken[col]
        for col in taken:
            taken[col] -= 1
        taken |= new
        return cells

    gather(node)
    width: dict[int, int] = {}
    for cells in rows:
        for lines, k, span in cells:
            if span == 1:
                width[k] = max(width.get(k, 0), max(map(len, lines), default=0))
    out = above
    for cells in rows:
        for i in range(max((len(c[0]) for c in cells), default=0)):
            line, upto = "", 0
            for lines, k, span in cells:
                line += " " * sum(width.get(j, 0) + 2 for j in range(upto, k))
                wide = sum(width.get(j, 0) for j in range(k, k + span)) + 2 * (span - 1)
                line += (lines[i] if i < len(lines) else "").ljust(wide) + "  "
                upto = k + span
            out.append(line.rstrip())
    return out


def page_text(html) -> str:
    return "\n".join(lines_of(parse(html))).strip("\n") if html else ""


def with_text(pages: DataFrame, html: str = "html", column: str = "text") -> DataFrame:
    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([page_text(h) for h in s], index=s.index, dtype=object)

    return pages.withColumn(column, text(F.col(html)))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
