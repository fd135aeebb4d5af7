"""Layout-aware rendering of HTML to text: all visible text, with the spacing a reader would see.

A tokenizer and a tree builder with implied end tags give properly nested events; a stack machine
renders them, without recursion, so depth and length are bounded by memory alone.

* Hidden: comments, ``head`` and what lies in it, script, style, template and other elements that
  show no text, anything with ``hidden`` or ``display:none``, closed ``details`` but for their
  summary, and closed ``dialog``. Scripts don't run: noscript shows. What has
  ``visibility:hidden`` keeps its place but shows no text; ``visibility:visible`` inside it does.
* Formulas show the text of their tokens, set apart by spaces, but no annotations. Drawings show
  their ``text`` elements and ``foreignObject``, set apart too, but no titles, descriptions and
  definitions (copies of definitions that ``use`` draws aren't followed).
* White space collapses outside ``pre`` and ``textarea``. Paragraphs, headings, lists, tables,
  quotes and ``pre`` stand between blank lines; other blocks begin a line; ``br`` ends one.
* List items have ``-`` or their number, nested lists and quotes are indented.
* Cells of a table's column are aligned; a cell wider than ``pad`` characters keeps its text but
  isn't padded to. colspan and rowspan are followed, columns without a cell's begin or end between
  them being one; a table in a cell is laid out inside it.

Null and empty pages give an empty text. Malformed markup gives whatever text it holds; a lone
``<`` is text. Character references are decoded; no-break spaces become spaces at the end.
Repeated rows are rendered each; other columns are kept as they are.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from heapq import merge
from html import unescape
from itertools import accumulate

from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
TEXT_ONLY = frozenset(("title", "textarea"))
HIDDEN = frozenset("head script style template title noframes noembed iframe object audio video canvas datalist area base link meta param source track rp".split())
#: Inside svg and math: elements that aren't rendered, and those whose content is HTML again.
UNDRAWN = frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter annotation annotation-xml".split())
POINTS = ("foreignobject", "desc", "annotation-xml", "mi", "mo", "mn", "ms", "mtext")
TOKENS = frozenset("mi mo mn ms mtext".split())
#: Start tags of HTML that end an unclosed svg or math.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset form menu dir hr xmp".split())
BLOCK = PARAGRAPH | frozenset("address article aside body center dd details dialog div dt figcaption footer header hgroup html legend li main nav optgroup option search section summary caption tr thead tbody tfoot".split())
CLOSES_P = (BLOCK - frozenset("body html option optgroup caption tr thead tbody tfoot".split())) | {"plaintext"}
#: start tag -> open elements that it ends, and what stops the search for them.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption"}, {"table"}), "th": ({"td", "th", "caption"}, {"table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"body"}),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
SCOPE = frozenset("table td th caption button template body html".split())
_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(/?)>|!--(?:>|->|.*?(?:--!?>|\Z))|[!?/][^>]*(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WS = re.compile(r"[ \t\n\f\r]+")
_NONE = re.compile(r"(?<![\w-])display\s*:\s*none|content-visibility\s*:\s*hidden", re.I)
_VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*([a-z]+)\s*(!\s*important)?", re.I)


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def visibility(tag: str, attrs: dict[str, str], before: bool, drawn: bool) -> bool:
    """Whether an element's text shows, as its own style or else its parent's tells."""
    told = _VISIBILITY.findall(attrs.get("style", ""))
    told = [v for v, important in told if important] or [v for v, _ in told]
    if not told and drawn and "visibility" in attrs:
        told = [attrs["visibility"].strip()]
    if told and told[-1].lower() in ("hidden", "collapse"):
        return False
    if told and told[-1].lower() in ("visible", "initial"):
        return True
    return before and tag != "mphantom"


def events(html: str) -> Iterator[tuple[str, str, dict | None]]:
    """("start", tag, attributes), ("end", tag, None) and ("text", data, None), properly nested."""
    stack: list[str] = []
    places: dict[str, list[int]] = {}  # where on the stack each tag is open
    scopes: list[int] = []
    at, size, last = 0, len(html), html.rfind(">")

    def end_to(k: int) -> Iterator[tuple[str, str, None]]:
        while len(stack) > k:
            tag = stack.pop()
            places[tag].pop()
            if tag in SCOPE:
                scopes.pop()
            yield "end", tag, None

    def highest(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    while at < size:
        m = _TAG.search(html, at) if at <= last or "<!--" in html[at : at + 4] else None
        stop = m.start() if m else size
        if stop > at:
            yield "text", unescape(html[at:stop]), None
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            k = highest((tag,))
            shut = scopes and scopes[-1] > k and tag not in SCOPE and tag not in ("tr", "thead", "tbody", "tfoot", "select")
            if k >= 0 and not shut:
                yield from end_to(k)
            elif tag == "br":
                yield from (("start", "br", {}), ("end", "br", None))
            continue
        point = foreign = -1
        if places.get("svg") or places.get("math"):
            point, foreign = highest(POINTS), highest(("svg", "math"))
            if foreign > point and (tag in BREAKOUT or tag == "font" and {"color", "face", "size"} & attributes(m[3]).keys()):
                yield from end_to(min(p[bisect_right(p, point)] for t in ("svg", "math") if (p := places.get(t)) and p[-1] > point))
                foreign = -1
        inside = foreign > point or tag in ("svg", "math")
        if not inside and tag in CLOSES_P and (k := highest(("p",))) > point and (not scopes or k > scopes[-1]):
            yield from end_to(k)
        if not inside and tag in IMPLIED:
            ends, bound = IMPLIED[tag]
            floor = max(highest(bound), point)
            above = [p[i] for t in ends if (p := places.get(t)) and (i := bisect_right(p, floor)) < len(p)]
            if above:
                yield from end_to(min(above))
        yield "start", tag, attributes(m[3]) if m[3] else {}
        if tag in VOID or m[4] and inside:
            yield "end", tag, None
            continue
        if tag in RAW or tag in TEXT_ONLY:
            close = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(html, at)
            body = html[at : close.start() if close else size]
            at = close.end() if close else size
            if body:
                yield "text", unescape(body) if tag in TEXT_ONLY else body, None
            yield "end", tag, None
            continue
        places.setdefault(tag, []).append(len(stack))
        if tag in SCOPE:
            scopes.append(len(stack))
        stack.append(tag)
    yield from end_to(0)


class Flow:
    """Lines of text under way: collapsed white space, pending gaps, indents and markers."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space, self.gap = False, 0
        self.indent, self.marker = "", None

    def text(self, data: str, keep: bool) -> None:
        if keep:
            first, *rest = data.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self._put(first)
            for line in rest:
                self.line()
                self._put(line)
            return
        words = _WS.split(data)
        if len(words) == 1:
            self._word(words[0])
            return
        self._word(words[0])
        for w in words[1:]:
            self.space = True
            self._word(w)

    def _put(self, data: str) -> None:
        if data:
            self._open()
            self.now.append(data)

    def _word(self, w: str) -> None:
        if not w:
            return
        if self.now and self.space:
            self.now.append(" ")
        self.space = False
        self._open()
        self.now.append(w)

    def _open(self) -> None:
        if not self.now:
            if self.gap > 1 and self.lines:
                self.lines.append("")
            self.gap = 0
            self.now.append(self.indent if self.marker is None else self.marker)
            self.marker = None

    def line(self) -> None:
        """End the line, even an empty one (``br`` and line feeds of ``pre``)."""
        if not self.now:
            self._open()
        self.edge(0)

    def edge(self, gap: int) -> None:
        """End the line if one is begun; ``gap`` 2 asks for a blank line before what follows."""
        if self.now:
            self.lines.append("".join(self.now).rstrip(" "))
            self.now = []
        self.space = False
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.edge(0)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def number(n: int, kind: str) -> str:
    if kind in ("a", "A") and n > 0:
        out = ""
        while n:
            n, r = divmod(n - 1, 26)
            out = chr(97 + r) + out
        return out.upper() if kind == "A" else out
    if kind in ("i", "I") and 0 < n < 4000:
        out = ""
        for v, s in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            while n >= v:
                out, n = out + s, n - v
        return out.upper() if kind == "I" else out
    return str(n)


def integer(text: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return int(m[1]) if m else default


class _Taken:
    """The columns that cells of earlier rows reach into, as runs; what lasts to the end is merged."""

    def __init__(self, rows: int):
        self.rows = rows
        self.lasting: list[list[int]] = []  # disjoint [begin, end), sorted
        self.passing: list[tuple[int, int, int]] = []  # (begin, end, first row without it), sorted

    def at(self, row: int) -> list[tuple[int, int]]:
        """Sorted runs that are taken in a row; they may touch or overlap."""
        self.passing = [x for x in self.passing if x[2] > row]
        return list(merge(((a, b) for a, b in self.lasting), ((a, b) for a, b, _ in self.passing)))

    def add(self, cells: list[tuple[int, int, int]]) -> None:
        """Cells (begin, end, first row without it) of one row, sorted."""
        self.passing = list(merge(self.passing, (x for x in cells if x[2] < self.rows)))
        joined: list[list[int]] = []
        for a, b in merge((tuple(x) for x in self.lasting), ((a, b) for a, b, stop in cells if stop >= self.rows)):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        self.lasting = joined


def lay_out(rows: list[list[tuple[list[str], int, int]]], pad: int) -> list[str]:
    """Lines of a table; a cell is (lines, colspan, rowspan).

    Columns that no cell begins or ends between are one, so the work follows the number of cells,
    whatever their spans say.
    """
    taken = _Taken(len(rows))
    placed: list[list[tuple[int, int, list[str]]]] = []  # of each row: begin, end, lines
    edges: set[int] = set()
    for r, row in enumerate(rows):
        busy, k, c = taken.at(r), 0, 0
        cells, here = [], []
        for lines, across, down in row:
            while k < len(busy) and busy[k][0] <= c:
                c = max(c, busy[k][1])
                k += 1
            here.append((c, c + across, lines))
            cells.append((c, c + across, r + max(1, down)))
            edges.update((c, c + across))
            c += across
        taken.add([x for x in cells if x[2] > r + 1])
        placed.append(here)
    order = {c: k for k, c in enumerate(sorted(edges))}
    width = [0] * len(order)
    grid = [[(order[a], order[b], lines) for a, b, lines in row] for row in placed]
    for row in grid:
        for a, b, lines in row:
            if b == a + 1:
                width[a] = max(width[a], max((len(x) for x in lines if len(x) <= pad), default=0))
    start = list(accumulate((w + 2 for w in width), initial=0))
    for row in grid:
        for a, b, lines in row:
            if b > a + 1:
                need = max((len(x) for x in lines if len(x) <= pad), default=0) - (start[b] - start[a] - 2)
                if need > 0:
                    width[b - 1] += need
                    for k in range(b, len(start)):
                        start[k] += need
    out: list[str] = []
    for row in grid:
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            parts, size = [], 0
            for a, _, lines in row:
                text = lines[k] if k < len(lines) else ""
                if text:
                    gap = max(start[a] - size, 2 if size else 0)
                    parts += [" " * gap, text]
                    size += gap + len(text)
            out.append("".join(parts).rstrip(" "))
    return out


def render(html: str | None, pad: int = 80) -> str:
    """The visible text of a page."""
    if not html:
        return ""
    flow, flows = Flow(), []
    hidden = 0  # depth inside a hidden element
    keep = 0  # depth of pre and textarea
    lists: list[list] = []  # [ordered, next number, kind]
    shown = True  # as visibility tells
    drawing = ""  # "svg" inside a drawing, "text" in one of its texts, "math" in a formula between tokens
    formula = 0  # parts of the line when the formula began
    opened: list[tuple[str, object, tuple]] = []  # what to undo at the end tag
    tables: list[list] = []
    for kind, name, attrs in events(html):
        if kind == "text":
            shut = opened and opened[-1][:2] == ("details", True)
            if drawing == "math" and not name.strip():
                continue
            if not hidden and shown and not shut and drawing != "svg" and not (tables and tables[-1][2] == 0 and not name.strip()):
                flow.text(name, keep > 0)
            continue
        if kind == "start":
            before = shown, drawing
            hides = hidden or name in HIDDEN or (attrs and ("hidden" in attrs or _NONE.search(attrs.get("style", "")) is not None or (name == "input" and attrs.get("type", "").lower() == "hidden")))
            if not hides and opened and opened[-1][0] == "details" and opened[-1][1] and name != "summary":
                hides = True
            if not hides and name == "dialog" and "open" not in attrs:
                hides = True
            drawn = drawing or name == "svg"
            if not hides and drawn:
                hides = name in UNDRAWN or attrs.get("display", "").strip().lower() == "none"
            if hides:
                hidden += 1
                opened.append((name, None, before))
                continue
            shown = visibility(name, attrs, shown, bool(drawn)) if attrs or name == "mphantom" else shown
            undo: object = ()
            if name == "svg":
                drawing, undo, flow.space = "svg", "apart", True
            elif name == "math":
                alone = attrs.get("display", "").lower() == "block"
                if alone:
                    flow.edge(0)
                drawing, formula, undo = "math", len(flow.now), "alone" if alone else flow.space
            elif name == "foreignobject" and drawing or name == "text" and drawing == "svg":
                drawing, undo, flow.space = "" if name == "foreignobject" else "text", "apart", True
            elif name in TOKENS and drawing == "math":
                drawing, undo = "", "apart"
                flow.space |= len(flow.now) > formula
            elif drawing == "text" and name == "tspan" and {"x", "y", "dx", "dy"} & attrs.keys():
                flow.space = True
            elif drawing:
                pass
            elif name == "br":
                if shown:
                    flow.line()
                else:
                    flow.edge(0)
            elif name == "table":
                flow.edge(2)
                tables.append([[], None, 0])  # rows, cell's spans, depth of cells
            elif name == "tr" and tables:
                tables[-1][0].append([])
            elif name in ("td", "th") and tables:
                if not tables[-1][0]:
                    tables[-1][0].append([])
                tables[-1][2] += 1
                undo = (max(1, min(1000, integer(attrs.get("colspan"), 1))), max(1, min(65534, integer(attrs.get("rowspan"), 1))))
                flows.append(flow)
                flow = Flow()
            elif name in BLOCK:
                flow.edge(2 if name in PARAGRAPH and not (name in ("ul", "ol", "menu", "dir") and lists) else 0)
                if name in ("ul", "ol", "menu", "dir"):
                    lists.append([name == "ol", integer(attrs.get("start"), 1), attrs.get("type", "1")])
                elif name == "li":
                    undo = flow.indent
                    mark = "- "
                    if lists and lists[-1][0]:
                        lists[-1][1] = n = integer(attrs.get("value"), lists[-1][1])
                        mark = number(n, lists[-1][2]) + ". "
                        lists[-1][1] += 1
                    flow.marker = flow.indent + mark if shown else None
                    flow.indent += " " * len(mark)
                elif name in ("blockquote", "dd"):
                    undo = flow.indent
                    flow.indent += "  "
                elif name == "pre":
                    keep += 1
                elif name == "details":
                    undo = "open" not in attrs
            elif name == "textarea":
                keep += 1
            opened.append((name, undo, before))
            continue
        _, undo, (shown, drawing) = opened.pop()
        if undo is None:
            hidden -= 1
        elif undo == "apart":
            flow.space = True
        elif undo == "alone":
            flow.edge(0)
        elif name == "math":
            flow.space = undo and len(flow.now) == formula
        elif drawing:
            pass
        elif name == "table":
            rows = tables.pop()[0]
            flow.edge(2)
            for line in lay_out(rows, pad):
                flow._put(line or " ")
                flow.edge(0)
            flow.edge(2)
        elif name in ("td", "th") and tables and undo:
            lines, flow = flow.done(), flows.pop()
            tables[-1][2] -= 1
            tables[-1][0][-1].append((lines, *undo))
        elif name in BLOCK:
            gap = 2 if name in PARAGRAPH else 0
            if name in ("ul", "ol", "menu", "dir"):
                lists.pop()
                gap = 0 if lists else 2
            elif name == "li":
                if flow.marker is not None:  # an empty item still shows its mark
                    flow._open()
                flow.indent = undo
            elif name in ("blockquote", "dd"):
                flow.indent = undo
            elif name == "pre":
                keep -= 1
            flow.edge(gap)
        elif name == "textarea":
            keep -= 1
    return "\n".join(flow.done()).replace("\xa0", " ")


def render_pages(pages: DataFrame, *, html_col: str = "html", pad: int = 80, text_col: str = "text") -> DataFrame:
    """``pages`` with ``html_col`` replaced by the rendered text (an existing column of that name too)."""
    rest = [c for c in pages.columns if c.lower() not in (html_col.lower(), text_col.lower())]
    kinds = ", ".join(f"`{c}` {t}" for c, t in pages.dtypes if c in rest)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [render(x, pad) for x in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(rest))], pa.array(texts, pa.string())], names=[*rest, text_col])

    return pages.select(*rest, html_col).mapInArrow(run, (kinds + ", " if rest else "") + f"`{text_col}` string")
