"""Layout-aware text of web pages.

A tree builder opens and closes elements with the implied tags of HTML; a renderer walks the visible part of the tree and
lays out its text: paragraphs, headings, lists and tables are parted by a blank line, other blocks by a line break;
list items are marked with a dash or a number and indented by depth; cells of a table stand in aligned columns; preformatted
text keeps its white space, other text has it collapsed. Scripts, styles, templates, comments, the head, closed details
and what is hidden by an attribute or an inline style is not visible. All visible text is given, at any depth.

Defined results: a null or empty page gives an empty text; a page cut off in a tag or comment loses that tag or comment only;
unknown tags are inline; unclosed elements end with the page; repeated rows are rendered each; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import lean, table

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes datalist object audio video canvas svg".split())
PARTED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote hr figure fieldset article aside nav footer header main".split())
BLOCK = PARTED | frozenset("html body div section li dt dd tr td th thead tbody tfoot caption figcaption form address details summary center hgroup legend option optgroup search dialog menu dir".split())
CLOSES_P = (BLOCK - frozenset("td th tr thead tbody tfoot caption option optgroup html body legend".split())) | {"xmp"}
#: An open element of the left kind is ended by a start tag of the right kind, if none of the barriers is open in between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"td", "th", "tr", "caption"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
}
#: What an end tag does not reach beyond.
BARRIERS = frozenset("table td th caption button".split())
#: Columns of a table are aligned up to this width; longer cells push the rest of their line.
WIDTH = 60
#: Characters of text after which a worker hands out what it has.
PART = 1 << 24

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<odd>[a-zA-Z][^\s/>]*)(?P<more>[^>]*)(?:>|\Z)",
    re.S,
)
#: A name and, unless it has none, its value.
_ATTR = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]*+)))?+")
_MAY_HIDE = re.compile("hidden|style", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_DECLARATION = re.compile(r"(?:[^;\"'(]++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|\([^)]*+(?:\)|\Z))++")
_SPACE = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("tag", "attrs", "items", "unseen")

    def __init__(self, tag: str, attrs: str, unseen: bool):
        self.tag, self.attrs, self.items, self.unseen = tag, attrs, [], unseen

    def get(self, name: str) -> str | None:
        return attributes(self.attrs).get(name)


def attributes(source: str) -> dict[str, str]:
    """Names and values of a start tag, the first of each name; a name alone has an empty value."""
    found: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        if (name := m[1].lower()) not in found:
            found[name] = unescape(m[2] or m[3] or m[4] or "")
    return found


def hides(source: str) -> bool:
    """Whether attributes hide their element: hidden, or display or visibility in the style as its last declaration has it."""
    if not _MAY_HIDE.search(source):
        return False
    found = attributes(source)
    if "hidden" in found:
        return True
    last: dict[str, tuple[bool, str]] = {}
    for part in _DECLARATION.findall(_COMMENT.sub(" ", found.get("style", ""))):
        name, _, value = part.partition(":")
        name, (value, mark, rest) = name.strip().lower(), value.lower().partition("!")
        important = bool(mark) and rest.strip() == "important"
        if name in ("display", "visibility") and value.strip() and important >= last.get(name, (False, ""))[0]:
            last[name] = important, value.strip()
    return last.get("display", (0, ""))[1] == "none" or last.get("visibility", (0, ""))[1] in ("hidden", "collapse")


def parse(html: str) -> Node:
    """The tree of a page."""
    root = Node("html", "", False)
    stack = [root]
    count: dict[str, int] = {}  # open elements by tag

    def pop() -> None:
        count[stack.pop().tag] -= 1

    def close_to(tags: set[str], barriers) -> None:
        if not any(count.get(t) for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                while len(stack) > i:
                    pop()
                return
            if stack[i].tag in barriers:
                return

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            stack[-1].items.append(unescape(html[at:]))
            break
        if m.start() > at:
            stack[-1].items.append(unescape(html[at : m.start()]))
        at = m.end()
        if m["end"]:
            tag = m["end"].lower()
            if tag == "br":
                stack[-1].items.append(Node("br", "", False))
            elif tag == "p" and not count.get("p"):
                stack[-1].items.append(Node("p", "", False))
            elif count.get(tag):
                heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
                close_to({tag} if not heading else {f"h{i}" for i in range(1, 7)}, BARRIERS - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else {"table"} - {tag})
            continue
        tag = m["tag"] or m["odd"]
        if not tag:
            continue
        if m["tag"] is None and not m[0].endswith(">"):
            break  # cut off in a tag
        tag, attrs = tag.lower(), (m["attrs"] if m["tag"] else m["more"]) or ""
        if tag in ("html", "body"):
            if tag == "body":
                close_to({"head"}, ())
            continue
        if tag in CLOSES_P and count.get("p"):
            close_to({"p"}, BARRIERS)
        if tag not in ("head", "title", "meta", "link", "style", "script", "base", "noscript", "template") and count.get("head"):
            close_to({"head"}, ())
        while tag in ENDS and any(count.get(t) for t in ENDS[tag][0]):
            before = len(stack)
            close_to(*ENDS[tag])
            if len(stack) == before:
                break
        if tag == "tr" and stack[-1].tag == "table" or tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            if tag != "tr":
                implied = Node("tr", "", False)
                stack[-1].items.append(implied)
                stack.append(implied)
                count["tr"] = count.get("tr", 0) + 1
        node = Node(tag, attrs, tag in UNSEEN or hides(attrs) or (tag == "input"))
        stack[-1].items.append(node)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK and tag not in RAW and tag not in ("a", "b", "i", "span", "em", "strong"):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            body = html[at : stop.start() if stop else end]
            node.items.append(unescape(body) if tag in ("textarea", "title") else body)
            at = stop.end() if stop else end
            continue
        stack.append(node)
        count[tag] = count.get(tag, 0) + 1
    return root


class Flow:
    """Lines of text as blocks come and go."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.kept = False
        self.gap = 0
        self.indent: list[str] = []
        self.mark = ""

    def text(self, s: str, pre: bool) -> None:
        if pre:
            parts = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            for i, part in enumerate(parts):
                if i:
                    self.end(True)
                if part:
                    self.line.append(part)
                    self.kept = True
            return
        words = _SPACE.sub(" ", s)
        if words[:1] == " ":
            self.space, words = True, words[1:]
        if words:
            if self.space and self.line:
                self.line.append(" ")
            self.space = words[-1] == " "
            self.line.append(words[:-1] if self.space else words)

    def end(self, always: bool = False) -> None:
        """Ends the line; an empty one counts only if always."""
        if self.line or always:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = 0
            lead = "".join(self.indent)
            if self.mark:
                lead, self.mark = lead[: len(lead) - len(self.mark)] + self.mark, ""
            self.lines.append((lead + "".join(self.line)).rstrip() if not self.kept else lead + "".join(self.line))
        self.line, self.space, self.kept = [], False, False

    def block(self, parted: bool) -> None:
        self.end()
        if parted:
            self.gap = 1

    def put(self, lines: list[str]) -> None:
        self.end()
        for x in lines:
            self.line = [x]
            self.kept = True
            self.end(True)

    def done(self) -> list[str]:
        self.end()
        return self.lines


def _aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table; a cell is (lines, columns, rows). Spans stay numbers: a column counts only where a cell with text begins in it. Every
    table is aligned, so rows that spans push to the right have as many places as there are columns before them."""
    grid: list[list[tuple[int, list[str]]]] = []  # (column, lines) of the cells with text
    below = np.empty((0, 3), np.int64)  # (first column, end, end of rows) of cells that reach into later rows, by first column
    starts = ends = below[:, 0]  # what they take together, in parts that don't touch
    change = 0  # the row in which the first of them ends
    for r, row in enumerate(rows):
        if len(below) and r >= change:
            below, starts, ends, change = _open(below, r)
        out, c, reach = [], 0, []
        for lines, wide, high in row:
            if len(starts) and (k := int(starts.searchsorted(c, "right"))):
                c = max(c, int(ends[k - 1]))
            if lines:
                out.append((c, lines))
            if high > 1:
                reach.append((c, c + wide, r + high))
            c += wide
        if reach:
            below, starts, ends, change = _open(np.concatenate([below, np.array(reach, np.int64)]), r + 1)
        grid.append(out)
    columns = {c: i for i, c in enumerate(sorted({c for row in grid for c, _ in row}))}
    wide = [0] * len(columns)
    for row in grid:
        for c, lines in row:
            wide[columns[c]] = max(wide[columns[c]], min(WIDTH, max(map(len, lines))))
    blank, at = " | ".join(" " * w for w in wide), [0]  # a line without text, and where its columns begin
    for w in wide:
        at.append(at[-1] + w + 3)
    out = []
    for row in grid:
        cells = [(columns[c], lines) for c, lines in row]
        for i in range(max((len(lines) for _, lines in cells), default=0)):
            parts, done = [], 0
            for c, lines in cells:
                parts += blank[done : at[c]], (lines[i] if i < len(lines) else "").ljust(wide[c])
                done = at[c] + wide[c]
            out.append("".join(parts).rstrip())
    return out


def _open(below: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of spans (first column, end, end of rows) those that reach row r, by first column; starts and ends of the parts that they take; and the
    row in which the first of them ends."""
    below = below[below[:, 2] > r]
    below = below[np.argsort(below[:, 0], kind="stable")]
    if not len(below):
        return below, below[:, 0], below[:, 0], 0
    far = np.maximum.accumulate(below[:, 1])
    first = np.flatnonzero(np.concatenate([[True], below[1:, 0] > far[:-1]]))
    return below, below[first, 0], far[np.append(first[1:], len(far)) - 1], int(below[:, 2].min())


def _span(node: Node, name: str, most: int) -> int:
    value = node.get(name) or "1"
    return min(most, max(1, int(value))) if value.isascii() and value.isdigit() and len(value) < 9 else 1


def render(root: Node) -> str:
    flows, tables, lists = [Flow()], [], []
    # the way through the tree is kept in a list, not in calls, so that depth has no limit
    todo: list[tuple] = [(root, False, False)]
    while todo:
        node, leave, pre = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            flow.text(node, pre)
            continue
        tag = node.tag
        if not leave:
            if node.unseen or tag == "dialog" and node.get("open") is None:
                continue
            if tag == "br":
                flow.end(True)
                continue
            if tag == "wbr":
                continue
            if tag == "img":
                alt = node.get("alt")
                if alt:
                    flow.text(alt, False)
                continue
            if tag in ("td", "th") and tables:
                flows.append(Flow())
            elif tag == "caption" and tables:
                flows.append(Flow())
            elif tag == "table":
                flow.block(True)
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in BLOCK or tag == "hr":
                flow.block(tag in PARTED and not (tag in ("ul", "ol") and lists))
            if tag in ("ul", "ol", "menu", "dir"):
                start = node.get("start") if tag == "ol" else None
                lists.append([tag, int(start) if start and re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1]
                mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                flow.indent.append(" " * len(mark))
                flow.mark = mark
            elif tag in ("dd", "blockquote"):
                flow.indent.append("  ")
            elif tag == "hr":
                flow.line.append("---")
                flow.block(True)
                continue
            pre_here = pre or tag in ("pre", "xmp", "textarea")
            items = node.items
            if tag == "pre" and items and isinstance(items[0], str) and items[0][:1] == "\n":
                items = [items[0][1:], *items[1:]]
            if tag == "details" and node.get("open") is None:
                items = [x for x in items if not isinstance(x, str) and x.tag == "summary"]
            todo.append((node, True, pre))
            todo.extend((x, False, pre_here) for x in reversed(items))
            continue
        if tag in ("td", "th") and tables:
            lines = flows.pop().done()
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((lines, _span(node, "colspan", 1000), _span(node, "rowspan", 65534)))
        elif tag == "caption" and tables:
            lines = flows.pop().done()
            flows[-1].put(lines)
        elif tag == "table":
            flow.put(_aligned(tables.pop()))
            flow.block(True)
        elif tag == "li":
            flow.end()
            flow.mark = ""
            flow.indent.pop()
        elif tag in ("dd", "blockquote"):
            flow.block(tag in PARTED)
            flow.indent.pop()
        elif tag in BLOCK:
            flow.block(tag in PARTED and not (tag in ("ul", "ol") and len(lists) > 1))
        if tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
    return "\n".join(flows[0].done()).replace("\xa0", " ").strip("\n")


def page_text(html: str | None) -> str:
    return render(parse(html)) if html else ""


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns in keep, text and n_chars of every page; where keep has a name of these, they are called page_text and page_n_chars."""
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(html).alias("html")) if keep else pages.select(F.lit(0).alias("row"), F.col(html).alias("html"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, a, size = [], 0, 0
            for i, h in enumerate(batch.column(1), 1):
                texts.append(page_text(h.as_py()))
                size += len(texts[-1])
                if len(texts) == 256 or size > PART or i == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, i - a), pa.array(texts, pa.string())], names=["row", "text"])
                    texts, a, size = [], i, 0

    lean(pages.sparkSession)
    out = rows.mapInArrow(of, StructType([rows.schema["row"], StructField("text", StringType())]))
    new, taken = [], {c.lower() for c in keep}
    for name, column in (("text", F.col("text")), ("n_chars", F.char_length("text").cast("long"))):
        while name in taken:  # a column of the page keeps its name
            name = f"page_{name}"
        new.append(column.alias(name))
    return out.select(*(["row.*"] if keep else []), *new)


def op4_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
