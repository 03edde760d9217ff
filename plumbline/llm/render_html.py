"""HTML to text by layout: a tree with implied tags, visibility rules, and a renderer for blocks, lists and tables.

Method: a page is cut into tags and text by one pattern; a tree builder supplies end tags that HTML lets authors leave out
(``p`` before a block, ``li``, ``dt``, ``dd``, ``option``, table parts) and ignores end tags without a start. The renderer walks the
tree and emits every visible text once: blocks on lines of their own, with an empty line around paragraphs, headings,
lists and tables; list items with bullets or numbers, indented by level; table cells padded to their column's width,
row and column spans kept; ``pre`` as it is; other white space folded.

Not visible: scripts, styles, templates, the document head, embedded media with their fallbacks, closed dialogs, elements
with ``hidden``, ``display: none`` or ``visibility: hidden`` (until a descendant says ``visible``), and comments.

Defined results: null stays null; empty or text-less pages give an empty text; broken markup never fails (an unclosed tag
is text, elements nested deeper than ``DEPTH`` become children of the one at that depth); pages of any length are rendered
whole; repeated rows are rendered alike; columns of other names are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.frames import slices

DEPTH = 120
#: Cells wider than this are not padded to, so that one long cell cannot blow up its whole column.
WIDEST = 60

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|</([a-zA-Z][^\s/>]*+)[^>]*+>"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*+)([^>]*+)>|[^<]++|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_HIDDEN = frozenset("script style template title head iframe noscript noembed noframes object canvas audio video svg math datalist".split())
_MARGIN = dict.fromkeys("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr".split(), 1) | dict.fromkeys(
    "html body div section article aside header footer main nav address form fieldset li dt dd tr caption center details summary figcaption legend dir menu dialog option optgroup select".split(), 0)
_CLOSES_P = frozenset(k for k in _MARGIN if k not in ("html", "body", "li", "dt", "dd", "tr", "caption", "option", "optgroup", "select", "legend"))
_CELLS, _GROUPS = frozenset(("td", "th")), frozenset(("thead", "tbody", "tfoot"))
#: A start tag ends the nearest open element of the first set, unless one of the second set lies between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}), "dt": ({"dt", "dd"}, {"dl", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"optgroup", "option"}, {"select"}),
    "td": (_CELLS, {"table", "tr"}), "th": (_CELLS, {"table", "tr"}), "tr": ({"tr"}, {"table"}),
    **dict.fromkeys(_GROUPS, (_GROUPS | {"caption", "colgroup"}, {"table"})), "body": ({"head"}, set()),
}


class Element:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.attributes, self.children = tag, attributes, []

    def attribute(self, name: str) -> str | None:
        if name not in self.attributes.lower():
            return None
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return None


def parse(page: str) -> Element:
    """The page's tree; text nodes are strings with character references resolved."""
    stack = [Element("#root")]
    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        end, tag = m[1], m[2] or m[4]
        if end:
            _close(stack, end.lower())
        elif tag:
            tag = tag.lower()
            _imply(stack, tag)
            node = Element(tag, (m[3] or m[5] or "").strip())
            stack[-1].children.append(node)
            if tag in _RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                at = close.start() if close else len(page)
                if tag == "textarea":
                    node.children.append(html.unescape(page[m.end() : at]))
                if close:
                    stack.append(node)
            elif tag not in _VOID and not node.attributes.endswith("/") and len(stack) < DEPTH:
                stack.append(node)
        elif not m[0].startswith(("<!", "<?")):
            stack[-1].children.append(html.unescape(m[0]) if "&" in m[0] else m[0])
    return stack[0]


def _close(stack: list[Element], tag: str) -> None:
    if tag == "br":
        stack[-1].children.append(Element("br"))
        return
    wall = () if tag in ("table", "body", "html") or tag in _CELLS or tag == "tr" or tag in _GROUPS else ("td", "th", "table")
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if stack[i].tag in wall or tag != "table" and stack[i].tag == "table":
            return


def _imply(stack: list[Element], tag: str) -> None:
    if tag in _CLOSES_P:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "p":
                del stack[i:]
                break
            if stack[i].tag in _CELLS or stack[i].tag in ("table", "button", "caption"):
                break
    if tag in ("tr", *_GROUPS):
        _end(stack, _CELLS, {"table"})
        if tag in _GROUPS:
            _end(stack, {"tr"}, {"table"})
    if tag in _ENDS:
        _end(stack, *_ENDS[tag])


def _end(stack: list[Element], tags, walls) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in walls:
            return


class Flow:
    """Lines of one block, with a line in the making and empty lines owed before the next one."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.owed = 0

    def brk(self, margin: int = 0) -> None:
        line = _SPACE.sub(" ", "".join(self.inline)).strip(" ")
        self.inline = []
        if line:
            self.put([line])
        self.owed = max(self.owed, margin)

    def put(self, lines: list[str]) -> None:
        if self.lines:
            self.lines += [""] * self.owed
        self.owed = 0
        self.lines += lines


def _visible(node: Element, shown: bool) -> tuple[bool, bool]:
    """Whether the element is rendered at all, and whether its own text shows."""
    if node.tag in _HIDDEN:
        return False, shown
    if not node.attributes:
        return node.tag != "dialog", shown
    style = re.sub(r"\s+", "", (node.attribute("style") or "").lower())
    if node.attribute("hidden") is not None or "display:none" in style or node.tag == "dialog" and node.attribute("open") is None:
        return False, shown
    return True, "visibility:visible" in style or shown and not re.search(r"visibility:(hidden|collapse)", style)


def _walk(node: Element, flow: Flow, shown: bool, pre: bool, level: int) -> None:
    for child in node.children:
        if isinstance(child, str):
            if shown and pre:
                first, *rest = child.split("\n")
                flow.inline.append(first.replace(" ", "\xa0"))
                for line in rest:
                    flow.brk()
                    flow.inline.append(line.replace(" ", "\xa0").replace("\t", "\xa0" * 4))
            elif shown:
                flow.inline.append(child)
            continue
        rendered, inner = _visible(child, shown)
        if not rendered:
            continue
        tag = child.tag
        margin = _MARGIN.get(tag)
        if tag == "br":
            flow.brk()
        elif margin is None:
            if tag in _CELLS and flow.inline:
                flow.inline.append(" ")
            _walk(child, flow, inner, pre, level)
        else:
            if tag in ("ul", "ol") and level:
                margin = 0
            flow.brk(margin)
            if tag == "table":
                flow.put(lines) if (lines := _table(child, inner, level)) else None
            elif tag in ("ul", "ol", "menu", "dir"):
                _list(child, flow, inner, level)
            elif tag in ("blockquote", "dd"):
                if lines := _lines(child, inner, pre, level):
                    flow.put([("  " + x).rstrip() for x in lines])
            else:
                _walk(child, flow, inner, pre or tag == "pre", level)
            flow.brk(margin)


def _lines(node: Element, shown: bool, pre: bool = False, level: int = 0) -> list[str]:
    flow = Flow()
    _walk(node, flow, shown, pre, level)
    flow.brk()
    return flow.lines


def _list(node: Element, flow: Flow, shown: bool, level: int) -> None:
    start = node.attribute("start") or ""
    number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    loose = Element("#loose")
    for child in [*node.children, Element("li")]:
        if isinstance(child, str) or child.tag != "li":
            loose.children.append(child)
            continue
        if lines := _lines(loose, shown, level=level + 1):
            flow.put(["  " + x for x in lines])
        loose.children = []
        rendered, inner = _visible(child, shown)
        if not rendered:
            continue
        value = child.attribute("value") or ""
        number = int(value) if re.fullmatch(r"-?\d{1,9}", value) else number
        mark = f"{number}. " if node.tag == "ol" else "* "
        if lines := _lines(child, inner, level=level + 1):
            flow.put([mark + lines[0], *[(" " * len(mark) + x).rstrip() for x in lines[1:]]])
        number += 1


def _span(cell: Element, name: str) -> int:
    value = cell.attribute(name) or "1"
    return min(100, int(value)) if re.fullmatch(r"\d{1,4}", value) and value.strip("0") else 1


def _rows(node: Element, shown: bool, stray: list) -> Iterator[tuple[Element, bool]]:
    """The table's rows; what stands in the table but in no cell goes to ``stray``."""
    for child in node.children:
        if isinstance(child, str) or child.tag not in ("tr", "caption", "colgroup", *_GROUPS):
            stray.append(child)
            continue
        rendered, inner = _visible(child, shown)
        if rendered and child.tag == "tr":
            stray += [c for c in child.children if isinstance(c, str) or c.tag not in _CELLS]
            yield child, inner
        elif rendered and child.tag in _GROUPS:
            yield from _rows(child, inner, stray)


def _table(node: Element, shown: bool, level: int) -> list[str]:
    out, grid, busy, stray = [], [], {}, Element("#stray")
    for child in node.children:
        if isinstance(child, Element) and child.tag == "caption" and _visible(child, shown)[0]:
            out += _lines(child, _visible(child, shown)[1])
    for row, inner in _rows(node, shown, stray.children):
        line: dict[int, tuple[list[str], bool]] = {}
        at = 0
        for cell in row.children:
            if not isinstance(cell, Element) or cell.tag not in _CELLS:
                continue
            while busy.get(at, 0):
                at += 1
            rendered, show = _visible(cell, inner)
            style = (cell.attribute("style") or "").lower() + (cell.attribute("align") or "").lower()
            line[at] = (_lines(cell, show, level=level) if rendered else [], "right" in style)
            for k in range(_span(cell, "colspan")):
                busy[at + k] = max(busy.get(at + k, 0), _span(cell, "rowspan"))
            at += _span(cell, "colspan")
        busy = {k: v - 1 for k, v in busy.items() if v > 1}
        grid.append(line)
    width: dict[int, int] = {}
    for line in grid:
        for at, (lines, _) in line.items():
            width[at] = max(width.get(at, 0), *[len(x) for x in lines if len(x) <= WIDEST], 0)
    for line in grid:
        for k in range(max((len(lines) for lines, _ in line.values()), default=0)):
            parts = []
            for at in range(max(line) + 1):
                lines, right = line.get(at, ([], False))
                text = lines[k] if k < len(lines) else ""
                parts.append(text.rjust(width.get(at, 0)) if right else text.ljust(width.get(at, 0)))
            out.append("  ".join(p for i, p in enumerate(parts) if i in width).rstrip())
    return _lines(stray, shown) + out


def render(page: str | None) -> str | None:
    if page is None:
        return None
    lines = _lines(parse(page), True)
    return "\n".join(lines).replace("\xa0", " ")


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text): the visible text of every whole page."""
    rows = pages.select(pages[id_col].cast("long").alias("id"), pages[html_col].cast("string").alias("html"))
    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([render(h) for h in part.column("html").to_pylist()], pa.string())], schema=schema)

    return rows.mapInArrow(run, "id long, text string")
