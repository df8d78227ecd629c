"""HTML to text by layout-aware rendering.

A tolerant reader builds the element tree: void elements have no content, raw-text elements run to their
end tag, and tags that HTML implies are supplied (a new ``li`` ends an open ``li``, a block ends an open
``p``, a ``td`` ends the cell before it, and so on).  Visibility rules drop what no browser shows: scripts,
styles, the head, templates, and whatever the ``hidden`` attribute or an inline style hides.  Rendering
walks the tree: inline text flows with collapsed blanks, blocks stand on lines of their own with a blank line
around paragraphs, headings, lists and tables, list items have their bullet or number and are indented,
the cells of a table are aligned in columns (also under a cell that spans rows), ``pre`` keeps its blanks.  What is
visible inside of something with ``visibility: hidden`` is shown.

A page is rendered in one task.  Elements nest as deep as the page has them: the open ones are found by name and
place, and the tree is walked without recursion.  A line that begins with ``FARTHEST`` blanks is moved in no
further, so that a page's text does not grow with the square of its depth; a column of a table is aligned up to
``WIDEST`` characters.

Defined cases: null and empty pages give the empty text; unclosed and stray tags, and a ``<`` that begins no
tag, never fail; a quote opens an attribute's value only right after ``=`` and if it is closed again; a cell spans at most
``MOST_COLUMNS`` columns and ``MOST_ROWS`` rows, as the standard has it; repeated rows each give a row; all visible text is kept whole, at any length.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Generator, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_document

FARTHEST = 300
WIDEST = 80

# The element names of the HTML standard that the rules speak of.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset(
    "script style head title template noscript iframe object embed noembed noframes datalist area audio video canvas svg"
    .split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre figure table fieldset hr menu".split())
BLOCKS = SPACED | frozenset(
    "address article aside body caption center details dd div dt figcaption footer form header hgroup html legend li "
    "main nav option optgroup search section summary tbody td tfoot th thead tr".split()
)
#: An element that begins ends the open ones of these names, up to the nearest element of the second set.
ENDS = {
    "li": ("li", "ul ol menu"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "option": ("option", "select datalist"),
    "optgroup": ("option optgroup", "select"),
    "tr": ("tr td th caption colgroup", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "thead": ("caption colgroup thead tbody tfoot tr td th", "table"),
    "tbody": ("caption colgroup thead tbody tfoot tr td th", "table"),
    "tfoot": ("caption colgroup thead tbody tfoot tr td th", "table"),
    "body": ("head", "html"),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
ENDS_P = SPACED | frozenset("address article aside center details div footer form header hgroup main nav search section".split())
P_SCOPE = frozenset("td th caption button object body html".split())

#: What follows a tag's name: blanks and slashes, and attributes.  A quote opens a value only right after "=" (and only if
#: it is closed again); anywhere else it is part of a name or of an unquoted value.
VALUE = r"""(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]++)"""
REST = rf"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{VALUE}?+)?+)*+"""
TAG = re.compile(
    r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<other>[!?][^>]*>)"
    rf"|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>{REST})(?:>|(?P<unended>\Z)))",
    re.DOTALL,
)
ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+({VALUE})?+)?+")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.IGNORECASE)
VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.IGNORECASE)
#: The most columns and rows that a cell can span.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
FAR = " " * FARTHEST
BLANKS = re.compile(r"[ \t\n\r\f]+")


class Element:
    """``seen``: not under ``visibility: hidden``; ``holds``: not seen itself, but something in it is."""

    __slots__ = ("name", "rest", "children", "seen", "holds")

    def __init__(self, name: str, rest: str = "") -> None:
        self.name, self.rest, self.children, self.seen, self.holds = name, rest, [], True, False

    def attributes(self) -> dict[str, str]:
        found = {}
        for key, value in ATTRIBUTE.findall(self.rest):
            found.setdefault(key.lower(), html.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
        return found

    def _may_hide(self) -> bool:
        if not self.rest or self.rest.isspace():
            return False
        low = self.rest.lower()
        return "hidden" in low or "style" in low

    def visible(self, inherited: bool) -> bool:
        """Visibility as its own style sets it, or as inherited."""
        if not self._may_hide():
            return inherited
        set_to = VISIBILITY.findall(self.attributes().get("style", ""))
        return set_to[-1].lower() == "visible" if set_to else inherited

    def hidden(self) -> bool:
        if self.name in UNSEEN or not (self.seen or self.holds):
            return True
        if not self._may_hide():
            return False
        a = self.attributes()
        return "hidden" in a or bool(NO_DISPLAY.search(a.get("style", "")))

    def number(self, name: str, default: int) -> int:
        """A whole number that an attribute begins with."""
        m = re.match(r"\s*([+-]?\d{1,9})", self.attributes().get(name, "")) if self.rest else None
        return int(m[1]) if m else default


class Open:
    """The open elements, outermost first, and the positions of each name and of what bounds a ``p``."""

    def __init__(self, root: Element) -> None:
        self.elements = [root]
        self.at: dict[str, list[int]] = defaultdict(list)
        self.bounds: list[int] = []

    def top(self) -> Element:
        return self.elements[-1]

    def add(self, element: Element) -> None:
        """Append to the innermost element, whose visibility it inherits."""
        top = self.top()
        element.seen = element.visible(top.seen)
        top.children.append(element)
        if element.seen and not top.seen:
            for above in reversed(self.elements):
                if above.seen or above.holds:
                    break
                above.holds = True

    def push(self, element: Element) -> None:
        self.at[element.name].append(len(self.elements))
        if element.name in BLOCKS or element.name in P_SCOPE:
            self.bounds.append(len(self.elements))
        self.elements.append(element)

    def cut(self, k: int) -> None:
        """End the elements from position k on."""
        while len(self.elements) > k:
            self.at[self.elements.pop().name].pop()
        while self.bounds and self.bounds[-1] >= k:
            self.bounds.pop()

    def last(self, names: Iterable[str]) -> int:
        """The position of the innermost element of these names; 0, that of the root, if there is none."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)


def tree(page: str) -> Element:
    """The element tree of a page; text is a child of type str."""
    root = Element("#root")
    stack, at = Open(root), 0

    def text(s: str) -> None:
        if s and stack.top().seen:
            stack.top().children.append(html.unescape(s) if "&" in s else s)

    while True:
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            return root
        text(page[at:start])
        m = TAG.match(page, start)
        if m and m["unended"] is not None:  # the page ends within a tag
            return root
        if m is None:  # a stray sign is text
            text("<")
            at = start + 1
            continue
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if m["end"]:
            _close(stack, name)
            continue
        _imply(stack, name)
        element = Element(name, m["rest"])
        stack.add(element)
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            inner = page[at : end.start()] if end else page[at:]
            if name == "textarea" and inner and element.seen:
                element.children.append(html.unescape(inner))
            at = end.end() if end else len(page)
        elif name not in VOID:
            stack.push(element)


def _close(stack: Open, name: str) -> None:
    """An end tag closes the nearest element of its name; a cell or table bounds what it can reach."""
    bound = () if name in ("table", "body", "html") else ("table",) if name in ("tr", "td", "th", "tbody", "thead", "tfoot") else ("td", "th", "table")
    k = stack.last((name,))
    if k and k >= stack.last(bound):
        stack.cut(k)
    elif name == "p":
        stack.add(Element("p"))


def _imply(stack: Open, name: str) -> None:
    """End what the beginning element ends, and supply the row of a cell."""
    if name in ENDS_P and stack.bounds and stack.elements[stack.bounds[-1]].name == "p":
        stack.cut(stack.bounds[-1])
    if name in CLOSES:
        ends, scope = CLOSES[name]
        bound = stack.last(scope)
        ended = [at[k] for n in ends if (at := stack.at.get(n)) and (k := bisect_right(at, bound)) < len(at)]
        if ended:
            stack.cut(min(ended))
    if name in ("td", "th") and stack.top().name in ("table", "tbody", "thead", "tfoot"):
        row = Element("tr")
        stack.add(row)
        stack.push(row)


class Lines:
    """Rendered lines; a gap of one blank line is pending between spaced blocks."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.open: list[str] = []
        self.gap = False
        self.blank = False

    def write(self, text: str) -> None:
        """Inline text: runs of blanks count as one, none at the start of a line."""
        text = BLANKS.sub(" ", text)
        if text == " " or not text:
            self.blank = self.blank or bool(text)
            return
        if (text[0] == " " or self.blank) and self.open:
            self.open.append(" ")
        self.blank = text[-1] == " "
        self.open.append(text.strip(" "))

    def end(self) -> None:
        if self.open:
            line, self.open = "".join(self.open), []
            self.line(line)
        self.blank = False

    def line(self, text: str) -> None:
        if self.gap and self.done:
            self.done.append("")
        self.gap = False
        self.done.append(text)

    def space(self) -> None:
        self.gap = True


#: A step of the walk: it yields the steps that it needs, is sent their results, and returns its own.
Step = Generator


def _walked(step: Step):
    """The result of a step; the steps under way are a list, so depth is bounded by memory only."""
    steps, result = [step], None
    while steps:
        try:
            step = steps[-1].send(result)
        except StopIteration as end:
            steps.pop()
            result = end.value
        else:
            steps.append(step)
            result = None
    return result


def _moved(line: str, by: str) -> str:
    return by + line if line and not line.startswith(FAR) else line


def _lines(children: list, keep: bool = False) -> Step:
    out = Lines()
    yield _flow(children, out, keep)
    out.end()
    return out.done


def _flow(children: list, out: Lines, keep: bool) -> Step:
    for child in children:
        if isinstance(child, str):
            if keep:
                first, *more = child.split("\n")
                out.open.append(first)
                for line in more:
                    out.line("".join(out.open).rstrip())
                    out.open = [line]
            else:
                out.write(child)
            continue
        name = child.name
        if child.hidden():
            continue
        if name == "br":
            if out.open:
                out.end()
            else:
                out.line("")
            continue
        if name not in BLOCKS:
            if name == "input":
                a = child.attributes()
                if a.get("type", "text").lower() in ("submit", "button", "reset", "text") and a.get("value"):
                    out.write(a["value"])
            if child.children:
                yield _flow(child.children, out, keep)
            if name in ("button", "select", "textarea"):
                out.blank = True
            continue
        out.end()
        spaced = name in SPACED
        if spaced:
            out.space()
        if name == "hr":
            out.line("---")
        elif name == "table":
            for line in (yield _table(child)):
                out.line(line)
        elif name in ("ul", "ol", "menu"):
            for line in (yield _list(child)):
                out.line(line)
        elif name == "pre":
            block = yield _lines(child.children, True)
            while block and not block[0].strip():
                block.pop(0)
            while block and not block[-1].strip():
                block.pop()
            for line in block:
                out.line(line or " ")  # an empty line of its own, not a gap
        elif name in ("blockquote", "dd"):
            for line in (yield _lines(child.children, keep)):
                out.line(_moved(line, "  "))
        elif name == "li":  # outside of a list
            _item(out, "- ", (yield _lines(child.children, keep)))
        else:
            yield _flow(child.children, out, keep)
            out.end()
        if spaced:
            out.space()


def _item(out: Lines, mark: str, lines: list[str]) -> None:
    for k, line in enumerate(lines or [""]):
        out.line(mark + line if k == 0 else _moved(line, " " * len(mark)))


def _list(element: Element) -> Step:
    out, number = Lines(), element.number("start", 1)
    loose: list = []

    def rest() -> Step:
        for line in (yield _lines(loose)):
            out.line(_moved(line, "  "))
        loose.clear()

    for child in element.children:
        if isinstance(child, Element) and child.name == "li":
            yield rest()
            if not child.hidden():
                number = child.number("value", number)
                mark = f"{number}. " if element.name == "ol" else "- "
                lines = [x for x in (yield _lines(child.children)) if x]
                _item(out, mark, lines)
                number += 1
        else:
            loose.append(child)
    yield rest()
    return out.done


#: Marks the end of a section among a table's children.
SECTION = Element("#section")


def _table(element: Element) -> Step:
    """Captions and loose content first, then the rows with their cells in columns two blanks apart."""
    rows: list[list[list[str]]] = []
    head: list[str] = []
    todo = list(reversed(element.children))
    reach: dict[int, int] = {}  # columns that cells of rows above still span, and for how many rows
    while todo:
        child = todo.pop()
        if isinstance(child, str):
            if child.strip():
                head += yield _lines([child])
        elif child is SECTION:
            reach = {}
        elif child.hidden():
            continue
        elif child.name in ("thead", "tbody", "tfoot"):
            # Cells do not span beyond their section.
            reach = {}
            todo += [SECTION, *reversed(child.children)]
        elif child.name == "tr":
            cells: list[list[str]] = []
            below: dict[int, int] = {}
            for cell in child.children:
                if isinstance(cell, str):
                    if not cell.strip():
                        continue
                    lines, wide, high = (yield _lines([cell])), 1, 1
                elif cell.hidden():
                    continue
                elif cell.name in ("td", "th"):
                    lines = yield _lines(cell.children)
                    wide = min(max(cell.number("colspan", 1), 1), MOST_COLUMNS)
                    high = min(cell.number("rowspan", 1), MOST_ROWS)
                    high = MOST_ROWS if high == 0 else max(high, 1)
                else:
                    lines, wide, high = (yield _lines([cell])), 1, 1
                while reach.get(len(cells), 0):
                    cells.append([])
                if high > 1:
                    below |= {len(cells) + k: high - 1 for k in range(wide)}
                cells += [lines] + [[]] * (wide - 1)
            rows.append(cells)
            reach = {k: n - 1 for k, n in reach.items() if n > 1} | below
        else:
            head += yield _lines([child])
    widths: list[int] = []
    for cells in rows:
        for k, cell in enumerate(cells):
            if k == len(widths):
                widths.append(0)
            widths[k] = max([widths[k], *(len(line) for line in cell if len(line) <= WIDEST)])
    out = head
    for cells in rows:
        for i in range(max([len(c) for c in cells], default=0)):
            line = "  ".join((c[i] if i < len(c) else "").ljust(w) for c, w in zip(cells, widths)).rstrip()
            if line:
                out.append(line)
    return out


def render(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    lines = _walked(_lines(tree(page).children))
    return "\n".join(line.rstrip() for line in lines).strip("\n")


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_lines of every row."""

    def work(batch: pa.RecordBatch) -> list:
        texts = [render(p) for p in batch.column("html").to_pylist()]
        lines = pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())
        return [batch.column("page_id"), batch.column("url"), texts, lines]

    columns = {"page_id": "long", "url": "string", "html": "string"}
    return per_document(pages, columns, "page_id long, url string, text string, n_lines long", work)
