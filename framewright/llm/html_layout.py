"""Layout-aware rendering of HTML to text.

A tree builder closes implied end tags and adds implied rows; a renderer walks the tree, skips what isn't shown and keeps block
spacing, list markers and indents, preformatted lines and tables with aligned cells. Both use explicit stacks that know how often a tag
is open, so that deep nesting and stray tags take linear time.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from framewright.llm.common import batches_by_bytes

# Element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style title head template noscript iframe object embed audio video canvas svg noembed noframes datalist param source track area base link meta".split())
#: Unseen inside ``math`` only.
UNSEEN_MATH = frozenset("annotation annotation-xml mphantom".split())
#: What a head may hold; anything else ends one that is open.
HEAD = frozenset("head base basefont bgsound link meta title noscript noframes style script template".split())
PRE = frozenset(["pre", "xmp"])
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre xmp ul ol dl table figure fieldset menu".split())
BLOCK = SPACED | frozenset("address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li main nav optgroup option search section summary caption tr thead tbody tfoot hr".split())
CELL = frozenset(["td", "th"])
SECTIONS = frozenset(["thead", "tbody", "tfoot"])
#: Start tag: which open elements it closes, up to which ancestor.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: Layout only, no text depends on them. Deeper indents stay at this column; tables inside so many others are set cell by cell, as blocks.
MAX_INDENT, TABLES = 64, 16
#: A table whose aligned lines would take more than this many times its text and tags (four characters a cell) has two spaces between cells.
STRETCH = 32
#: So many cells reach down into later rows at once; more don't.
MAX_DOWN = 1000
#: What an open paragraph isn't closed through.
AROUND_P = BLOCK | CELL | {"button"}

TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE = re.compile(r"</?([a-zA-Z][^\s/>]*+)([^>]*+)>")
HEAD_END = re.compile(r"</head(?=[\s/>])|<body(?=[\s/>])", re.I)
HINT = re.compile(r"hidden|style\s*=", re.I)
ATTRIBUTE = re.compile(r"""([^\s/=>][^\s/=>]*+)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s>]++))?""")
DECLARATION = re.compile(r"""(?:[^;"'()]++|"[^"]*+"|'[^']*+'|\([^()]*+\)|["'()])++""")
REMARK = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
START = re.compile(r"""\bstart\s*=\s*["']?(-?\d{1,9})""", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")
FOLDED = re.compile(r"[\t\n\r\f]|  ")


def unescape(s: str) -> str:
    """Character references resolved. No reference reaches across ``&amp;``, the most frequent one, so that is split at first."""
    return "&".join([html.unescape(p) if "&" in p else p for p in s.split("&amp;")])


def attributes(source: str) -> dict[str, str]:
    """Values by name in lower case, references resolved; the first of a name counts, one without a value is empty."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        value = m[2] or ""
        if value[:1] in ("'", '"'):
            value = value[1:-1] if len(value) > 1 and value[-1] == value[0] else value[1:]
        out.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
    return out


def shown_as(source: str) -> str:
    """What the attributes of a tag say of its visibility: ``none`` (with all it holds), ``hidden`` or ``visible`` (unless what it holds
    says otherwise), or nothing. ``hidden`` counts as none; of a ``style`` the last declarations count."""
    if not HINT.search(source):
        return ""
    named = attributes(source)
    if "hidden" in named and named["hidden"].strip().lower() != "until-found":
        return "none"
    style: dict[str, tuple[bool, str]] = {}
    for declaration in DECLARATION.findall(REMARK.sub(" ", named.get("style", ""))):
        name, _, value = declaration.partition(":")
        name, (value, mark, _) = name.strip().lower(), value.lower().partition("!")
        if value.strip() and bool(mark) >= style.get(name, (False, ""))[0]:
            style[name] = bool(mark), value.strip()
    shown = {name: value for name, (_, value) in style.items()}
    if shown.get("display") == "none":
        return "none"
    return {"hidden": "hidden", "collapse": "hidden", "visible": "visible"}.get(shown.get("visibility", ""), "")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


class Open(list):
    """Open elements, the outermost first, with the places of each tag and of what bounds a paragraph."""

    def __init__(self, root: Node) -> None:
        super().__init__()
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.around_p: list[int] = []
        self.push(root)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self))
        if node.tag in AROUND_P:
            self.around_p.append(len(self))
        self.append(node)

    def cut(self, i: int) -> None:
        """Closes all from place ``i`` on."""
        for node in self[i:]:
            self.places[node.tag].pop()
            if node.tag in AROUND_P:
                self.around_p.pop()
        del self[i:]

    def last(self, tag: str) -> int:
        """The place of the innermost open ``tag``, -1 if none is open."""
        places = self.places.get(tag)
        return places[-1] if places else -1


def parse(source: str) -> Node:
    """The tree of a page; text nodes are strings with character references resolved. Any input gives a tree.

    A tag ends at the first ``>`` outside quotes. From the first tag on whose quotes don't close, quotes aren't minded.
    """
    root = Node("html")
    stack, at, n = Open(root), 0, len(source)
    last, quotes, unclosed = source.rfind(">"), True, set()

    def text(a: int, b: int) -> None:
        if a < b:
            s = source[a:b]
            if "&" in s:
                s = unescape(s)
            if stack[-1].tag == "head" and s.strip(" \t\n\r\f"):
                _end_head(stack)
            stack[-1].children.append(s)

    start = 0  # of text not yet added
    while (lt := source.find("<", at)) >= 0:
        kind = source[lt + 1 : lt + 2]
        if kind == "!" or kind == "?":
            text(start, lt)
            mark = "-->" if source.startswith("<!--", lt) else ">"
            close = source.find(mark, lt + 4 if mark == "-->" else lt)
            at = start = n if close < 0 else close + len(mark)
            continue
        if lt > last:
            break  # no tag ends any more
        m = TAG.match(source, lt) if quotes else None
        if not m and (m := LOOSE.match(source, lt)):
            quotes = False
        if not m:
            at = lt + 1
            continue
        text(start, lt)
        at = start = m.end()
        tag, attrs = m[1].lower(), m[2]
        if kind == "/":
            _end(stack, tag)
            continue
        _imply(stack, tag)
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            close = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            if not close:  # it ends with an open head, else with the page
                unclosed.add(tag)
                ends = HEAD_END.search(source, at) if stack.last("head") >= 0 else None
                stop = ends.start() if ends else n
            else:
                stop = close.start()
            if tag in ("textarea", "title"):
                node.children.append(unescape(source[at:stop]))
            elif tag == "xmp":
                node.children.append(source[at:stop])
            at = start = close.end() if close else stop
            continue
        if attrs.endswith("/") and stack.last("math") >= 0:
            continue
        stack.push(node)
    text(start, n)
    return root


def _end(stack: Open, tag: str) -> None:
    """Closes the nearest open ``tag``; a cell's or table's end isn't crossed by others. One that isn't open is ignored."""
    at = stack.last(tag)
    if at < 1 or stack.last("table") > at:
        return
    if tag not in ("table", "tr", "thead", "tbody", "tfoot") and max(map(stack.last, CELL)) > at:
        return
    stack.cut(at)


def _end_head(stack: Open) -> None:
    """Closes a head on top of the stack."""
    while stack[-1].tag == "head":
        stack.cut(len(stack) - 1)


def _imply(stack: Open, tag: str) -> None:
    """Closes what the start of ``tag`` ends by implication, and opens the row that a cell needs."""
    if stack[-1].tag == "head" and tag not in HEAD:
        _end_head(stack)
    if (tag in BLOCK or tag in CELL) and stack.last("p") > 0 and stack.around_p[-1] == stack.last("p"):
        stack.cut(stack.last("p"))
    if tag in CLOSES:
        closes, bounds = CLOSES[tag]
        bound = max(0, *map(stack.last, bounds))  # the root stays open
        inside = [p[i] for t in closes if (p := stack.places.get(t)) and (i := bisect_right(p, bound)) < len(p)]
        if inside:
            stack.cut(min(inside))
    if tag in CELL and (stack[-1].tag == "table" or stack[-1].tag in SECTIONS):
        row = Node("tr")
        stack[-1].children.append(row)
        stack.push(row)


class Page:
    """Lines of text under construction: collapsed white space, block margins, indents."""

    def __init__(self) -> None:
        self.lines, self.words, self.space, self.margin, self.indent, self.marker = [], [], False, 0, 0, ""
        self.size = 0  # characters of text, without layout

    def text(self, s: str) -> None:
        if FOLDED.search(s):
            s = SPACE.sub(" ", s)
        body = s.strip(" ")
        self.space |= s[:1] == " "
        if body:
            if self.space and self.words:
                self.words.append(" ")
            self.words.append(body)
            self.size += len(body)
            self.space = s[-1] == " "

    def line(self) -> None:
        """Ends the line that has begun, if any; a list marker waits for its text."""
        if self.words:
            self._put("".join(self.words))
        self.words, self.space = [], False

    def mark(self, marker: str = "") -> None:
        """Sets a list marker; one that still waits gets a line of its own."""
        if self.marker:
            self._put("")
        self.marker = marker

    def _put(self, s: str) -> None:
        if self.margin and self.lines:
            self.lines.extend([""] * self.margin)
        self.margin = 0
        pad = " " * max(0, min(self.indent, MAX_INDENT) - len(self.marker))
        self.lines.append((pad + self.marker + s).rstrip() if s else (pad + self.marker).rstrip())
        self.marker = ""

    def block(self, margin: int) -> None:
        self.line()
        if not self.marker:
            self.margin = max(self.margin, margin)

    def rows(self, lines: list[str]) -> None:
        self.line()
        for s in lines:
            self._put(s)

    def finish(self) -> list[str]:
        self.line()
        self.mark()
        return self.lines


def span(attrs: str, name: str, most: int) -> int:
    """Columns or rows that a cell takes, 1 to ``most`` as browsers bound them; 0 for a rowspan means to the end."""
    if name not in attrs.lower():
        return 1
    value = attributes(attrs).get(name, "").strip()
    n = int(value[:9]) if value[:9].isascii() and value[:9].isdigit() else 1
    return most if n == 0 and name == "rowspan" else min(max(1, n), most)


def aligned(rows: list[list[tuple[list[str], int, int]]], size: int) -> list[str]:
    """Lines of a table of cells (lines, columns, rows): columns start at the same place, two spaces apart from what ends there.

    Cells that reach down from rows above take their columns, as in a browser. ``size``: characters of text and tags; if aligned lines would take more
    than ``STRETCH`` times as many, cells are two spaces apart instead.
    """
    placed, down = [], {}  # down: by first column, the end and the rows left of a cell from above
    for row in rows:
        col, cells = 0, []
        held = {c: (end, n) for c, (end, n) in down.items() if n > 0}
        down = {c: (end, n - 1) for c, (end, n) in held.items()}
        ends = sorted((c, end) for c, (end, _) in held.items())
        for lines, wide, deep in row:
            while ends and col >= ends[0][0]:
                col = max(col, ends.pop(0)[1])
            cells.append((col, col + wide, lines))
            if deep > 1 and len(down) < MAX_DOWN:
                down[col] = (col + wide, deep - 1)
            col += wide
        placed.append(cells)
    reach: dict[int, list[tuple[int, int]]] = {}  # by end column: the starts and widths of cells that end there
    for cells in placed:
        for first, end, lines in cells:
            reach.setdefault(end, []).append((first, max(map(len, lines), default=0) + 2))
    at, x = {0: 0}, 0
    for col in sorted({first for cells in placed for first, _, _ in cells} | reach.keys()):
        x = at[col] = max([x, *(at[first] + width for first, width in reach.get(col, []))])
    room = STRETCH * size
    for cells in placed:
        last: dict[int, int] = {}  # by line of the row: where its last cell begins
        for first, _, lines in cells:
            last.update((k, at[first] + len(x)) for k, x in enumerate(lines) if x)
        room -= sum(last.values())
    out = []
    for cells in placed:
        held: list[list[str]] = [[] for _ in range(max((len(lines) for _, _, lines in cells), default=0))]
        wide = [0] * len(held)
        for first, _, lines in cells:
            for k, x in enumerate(lines):
                if x:
                    gap = 2 if held[k] and (room < 0 or wide[k] + 2 > at[first]) else 0 if room < 0 else at[first] - wide[k]
                    held[k] += [" " * gap, x]
                    wide[k] += gap + len(x)
        out.extend("".join(parts).rstrip() for parts in held)
    return out


def render(root: Node) -> str:
    """All visible text of a tree."""
    page = Page()
    pages, tables, sizes, lists, pre, maths = [page], [], [], [], 0, 0
    work: list[tuple[Node | str, bool, bool]] = [(root, False, True)]
    while work:
        node, leaving, shown = work.pop()
        page = pages[-1]
        if isinstance(node, str):
            if not shown:
                page.space = True
            elif pre:
                first, *rest = node.expandtabs(8).replace("\r\n", "\n").replace("\r", "\n").split("\n")
                page.size += len(node)
                page.words.append(first)
                for s in rest:
                    page._put("".join(page.words))
                    page.words = [s]
            else:
                page.text(node)
            continue
        tag = node.tag
        if not leaving:
            if tag in UNSEEN or maths and tag in UNSEEN_MATH:
                continue
            if node.attrs and (way := shown_as(node.attrs)):
                if way == "none":
                    continue
                shown = way == "visible"
            if tag == "br":
                if page.words:
                    page.line()
                elif page.marker:
                    page.mark()
                elif page.lines and not page.margin:
                    page.margin = 1
                continue
            if tag in VOID and tag != "hr":
                continue
            if tag in CELL and tables and len(tables) <= TABLES:
                pages.append(Page())
                if not tables[-1]:
                    tables[-1].append([])
            elif tag in CELL and tables:
                page.block(0)
            elif tag in BLOCK:
                nested = tag in ("ul", "ol", "menu", "dir") and lists
                page.block(1 if tag in SPACED and not nested else 0)
                if tag == "table":
                    tables.append([])
                    sizes.append(0)
                elif tag == "tr" and tables:
                    tables[-1].append([])
                elif tag in ("ul", "ol", "menu", "dir"):
                    m = START.search(node.attrs) if tag == "ol" else None
                    lists.append((page, int(m[1]) if m else 1 if tag == "ol" else None))
                elif tag == "li":
                    i = None
                    if lists and lists[-1][0] is page:
                        _, i = lists[-1]
                        lists[-1] = (page, None if i is None else i + 1)
                    page.mark("- " if i is None else f"{i}. ")
                    page.indent += 4 if len(page.marker) > 2 else 2
                elif tag in ("dd", "blockquote"):
                    page.indent += 4
                elif tag in PRE:
                    pre += 1
                elif tag == "hr":
                    continue
            elif tag in ("input", "select", "mtr", "mtd"):
                page.space = True
            elif tag == "math":
                maths += 1
            work.append((node, True, shown))
            work.extend((c, False, shown) for c in reversed(node.children))
            continue
        if tag == "math":
            maths -= 1
        elif tag in CELL and len(tables) > TABLES:
            page.block(0)
        elif tag in CELL and tables:
            pages.pop()
            lines = page.finish()
            sizes[-1] += page.size + 4
            tables[-1][-1].append((lines, span(node.attrs, "colspan", 1000), span(node.attrs, "rowspan", 65534)))
        elif tag in BLOCK:
            if tag in PRE:
                pre -= 1
            page.line()
            if tag == "table":
                size = sizes.pop()
                page.size += size
                page.rows(aligned([r for r in tables.pop() if r], size))
            elif tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            elif tag == "li":
                page.mark()
                numbered = lists and lists[-1][0] is page and lists[-1][1] is not None
                page.indent -= 4 if numbered and page.indent >= 4 else 2
            elif tag in ("dd", "blockquote"):
                page.indent -= 4
            nested = tag in ("ul", "ol", "menu", "dir") and lists
            page.block(1 if tag in SPACED and not nested else 0)
    return "\n".join(pages[0].finish()).strip("\n")


def plain_lines(root: Node) -> str:
    """The visible text of a tree without its layout: a line for each block, cell and line break, white space collapsed."""
    lines, words = [], []
    work: list[tuple[Node | str | None, bool]] = [(root, True)]
    while work:
        node, shown = work.pop()
        if isinstance(node, str):
            words.append(node if shown else " ")
            continue
        if node is None or node.tag == "br" or node.tag in BLOCK or node.tag in CELL:
            lines.append("".join(words))
            words = []
        if node is None or node.tag in UNSEEN or node.tag in VOID:
            continue
        if node.attrs and (way := shown_as(node.attrs)):
            if way == "none":
                continue
            shown = way == "visible"
        if node.tag in BLOCK or node.tag in CELL:
            work.append((None, True))
        work.extend((c, shown) for c in reversed(node.children))
    lines.append("".join(words))
    return "\n".join(filter(None, (" ".join(line.split()) for line in lines)))


def elements(root: Node) -> Iterator[Node]:
    """All elements of a tree in order."""
    work = [root]
    while work:
        node = work.pop()
        yield node
        work.extend(c for c in reversed(node.children) if isinstance(c, Node))


def html_text(source: str | None) -> str:
    """The visible text of a page; empty for null or empty input."""
    return render(parse(source)) if source else ""


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` without ``column``, with its visible ``text``.

    Null and empty pages give an empty text; repeated rows each give a row; a page of any length is read whole, in linear time; an
    empty table gives an empty table. Other columns are kept, a column ``text`` is replaced.
    """
    kept = [c for c in pages.columns if c not in (column, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches_by_bytes(batches, len(kept)):
            texts = [html_text(s) for s in part.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(texts, pa.string())], [*kept, "text"])

    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept)
    return pages.select(*kept, column).mapInArrow(run, f"{fields + ', ' if kept else ''}text string")


def op10_html_layout(spark, sf_dir: str) -> DataFrame:
    """The visible text of all ``pages``: ``page_id, text``."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))
