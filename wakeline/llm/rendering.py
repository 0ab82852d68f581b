"""HTML extraction: all visible text of a page, laid out as blocks, lists and aligned tables.

A tree builder reads the tags, supplies the ones that may be left out, and opens and closes boxes; each box
collects its text by its layout rule. Nothing recurses, so nesting may be of any depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element groups of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("head script style template noscript title datalist iframe object svg audio video canvas select".split())
RAW = {"script", "style", "iframe", "title", "textarea", "noscript", "template"}
SPACED = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset hr".split())
BLOCK = SPACED | set(
    "address article aside body center dd details dialog dir div dt figcaption footer form header hgroup html legend li "
    "main menu nav search section summary caption optgroup option tr td th thead tbody tfoot".split()
)
CLOSES_P = BLOCK - set("html body caption option optgroup legend tr td th thead tbody tfoot".split())
HEAD_PARTS = set("base link meta title style script noscript template".split())
# start tag -> open elements that it ends, and elements that stop the search
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "td", "th", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "td", "th", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "td", "th", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
}

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[/a-zA-Z][^<>]*\Z|([^<]+|<)""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
GAP = re.compile(r"[ \t\n\f\r]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)|content-visibility\s*:\s*hidden", re.I)


class Box:
    """Text of one formatting context: finished lines, and the line that is being filled."""

    def __init__(self, pre: bool = False):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False  # a collapsed blank is due before the next word
        self.gap = False  # an empty line is due before the next line
        self.pre = pre
        self.columns = 1

    def text(self, data: str) -> None:
        if self.pre:
            *full, rest = data.split("\n")
            for part in full:
                self.now.append(part)
                self.end_line(True)
            self.now.append(rest)
            return
        parts = GAP.sub(" ", data)
        if parts == " ":
            self.space = bool(self.now)
            return
        if (self.space or parts[0] == " ") and self.now and not self.now[-1].endswith(" "):
            self.now.append(" ")
        self.now.append(parts.strip(" "))
        self.space = parts[-1] == " "

    def end_line(self, always: bool = False) -> None:
        line = "".join(self.now)
        self.now, self.space = [], False
        line = line.rstrip() if not self.pre else line
        if line.strip() or (always and self.lines):
            self.add([line])

    def add(self, lines: list[str]) -> None:
        if self.gap and self.lines and self.lines[-1] != "":
            self.lines.append("")
        self.gap = False
        self.lines += lines

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
        return self.lines


class Page:
    """The open elements of a page and the boxes they write to."""

    def __init__(self) -> None:
        self.open: list[str] = []
        self.count: dict[str, int] = {}
        self.unseen = 0  # how many open elements hide their content
        self.hides: list[bool] = []
        self.boxes = [Box()]
        self.lists: list[list] = []  # marker kind and number of the open lists
        self.tables: list[list[list[tuple[str, int]]]] = []

    # --- tree building ---

    def start(self, name: str, attributes: str) -> None:
        if name in ("html", "body") and self.count.get(name):
            return
        if self.count.get("head") and name not in HEAD_PARTS and name != "head":
            self.end("head")
        if name in CLOSES_P and self.count.get("p"):
            self.close_within({"p"}, {"td", "th", "table", "button", "caption"})
        if name in ENDS and any(self.count.get(x) for x in ENDS[name][0]):
            self.close_within(*ENDS[name])
        if name in ("td", "th") and self.count.get("table") and not self.in_row():
            self.push("tr", False)
        if name in VOID:
            self.void(name)
            return
        hidden = name in UNSEEN
        if attributes.strip():
            has = {k.lower(): unescape((v or "").strip("\"'")) for k, v in ATTRIBUTE.findall(attributes)}
            hidden = hidden or "hidden" in has or bool(HIDDEN.search(has.get("style", "")))
            self.push(name, hidden, has)
        else:
            self.push(name, hidden)

    def in_row(self) -> bool:
        for x in reversed(self.open):
            if x in ("tr", "table"):
                return x == "tr"
        return False

    def close_within(self, names: set[str], stops: set[str]) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at] in names:
                self.pop_to(at)
                return
            if self.open[at] in stops:
                return

    def end(self, name: str) -> None:
        if name == "br":
            self.void("br")
        if not self.count.get(name):
            if name == "p":
                self.gap()
            return
        # an inline end tag does not reach out of the cell it stands in
        if name not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body", "html"):
            self.close_within({name}, {"td", "th", "caption"})
        else:
            self.close_within({name}, {"table"} - {name})

    def pop_to(self, at: int) -> None:
        while len(self.open) > at:
            name = self.open.pop()
            self.count[name] -= 1
            if self.unseen == 0:
                self.leave(name)
            self.unseen -= self.hides.pop()

    def push(self, name: str, hidden: bool, has: dict[str, str] | None = None) -> None:
        self.open.append(name)
        self.count[name] = self.count.get(name, 0) + 1
        self.unseen += hidden
        self.hides.append(hidden)
        if self.unseen == 0:
            self.enter(name, has or {})

    # --- layout ---

    def gap(self) -> None:
        box = self.boxes[-1]
        box.end_line()
        box.gap = True

    def void(self, name: str) -> None:
        if self.unseen:
            return
        if name == "br":
            self.boxes[-1].end_line(True)
        elif name == "hr":
            self.gap()

    def enter(self, name: str, has: dict[str, str]) -> None:
        box = self.boxes[-1]
        if name in BLOCK:
            box.end_line()
        if name in SPACED and not (name in ("ul", "ol") and self.lists):
            box.gap = True
        if name in ("ul", "menu", "ol"):
            first = has.get("start", "1")
            self.lists.append(["ol" if name == "ol" else "ul", int(first) if re.fullmatch(r"-?[0-9]{1,9}", first) else 1])
        elif name in ("li", "dd", "blockquote", "td", "th", "caption"):
            self.boxes.append(Box())
            if name in ("td", "th"):
                span = has.get("colspan", "1")
                self.boxes[-1].columns = min(max(int(span), 1), 1000) if re.fullmatch("[0-9]{1,6}", span) else 1
        elif name == "pre":
            self.boxes.append(Box(pre=True))
        elif name == "table":
            self.tables.append([])
        elif name == "tr" and self.tables:
            self.tables[-1].append([])

    def leave(self, name: str) -> None:
        if name in ("li", "dd", "blockquote", "td", "th", "caption", "pre"):
            box = self.boxes.pop()
            lines, outer = box.done(), self.boxes[-1]
            if name == "li":
                kind = self.lists[-1] if self.lists else ["ul", 1]
                mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                lines = [(mark if i == 0 else " " * len(mark) if x else "") + x for i, x in enumerate(lines)]
            elif name in ("dd", "blockquote"):
                lines = [("    " if name == "dd" else "> ") + x if x else x for x in lines]
            elif name in ("td", "th") and self.tables:
                if not self.tables[-1]:
                    self.tables[-1].append([])
                self.tables[-1][-1].append((lines, box.columns))
                lines = []
            if lines:
                outer.add(lines)
        elif name in ("ul", "ol", "menu"):
            self.boxes[-1].end_line()
            self.lists.pop()
        elif name == "table":
            rows = self.tables.pop()
            self.boxes[-1].end_line()
            lines = aligned([row for row in rows if row])
            if lines:
                self.boxes[-1].add(lines)
        elif name in BLOCK:
            self.boxes[-1].end_line()
        if name in SPACED and not (name in ("ul", "ol") and self.lists):
            self.boxes[-1].gap = True


def aligned(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Lines of a table whose columns are as wide as their widest cell; spanning cells take several columns."""
    width: dict[int, int] = {}
    for row in rows:
        at = 0
        for lines, columns in row:
            if columns == 1:
                width[at] = max(width.get(at, 0), *map(len, lines), 0)
            at += columns
    out = []
    for row in rows:
        for k in range(max(len(lines) for lines, _ in row)):
            parts, at = [], 0
            for lines, columns in row:
                room = sum(width.get(c, 0) for c in range(at, at + columns)) + 2 * (columns - 1)
                parts.append((lines[k] if k < len(lines) else "").ljust(room))
                at += columns
            out.append("  ".join(parts).rstrip())
    return out


def render(html: str | None) -> str:
    """The visible text of a page."""
    page, at, html = Page(), 0, html or ""
    while at < len(html):
        m = TOKEN.match(html, at)
        at = m.end()
        if m[4] is not None:
            if not page.unseen and (m[4].strip() or page.boxes[-1].now or page.boxes[-1].pre):
                page.boxes[-1].text(unescape(m[4]))
        elif m[2]:
            name = m[2].lower()
            if m[1]:
                page.end(name)
                continue
            page.start(name, m[3])
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
                if name == "textarea" and not page.unseen:
                    page.boxes[-1].text(unescape(html[at : close.start() if close else len(html)]))
                at = close.end() if close else len(html)
                page.end(name)
    page.pop_to(0)
    return "\n".join(page.boxes[0].done())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text (visible, laid out) of every row of ``pages``.

    Not visible: head, scripts, styles, templates, noscript, select and embedded content, elements with the
    hidden attribute or an inline style of display:none or visibility:hidden. A null or empty page has an
    empty text. A tag that the page breaks off in is dropped, any other stray < is text. Repeated rows give repeated rows; an
    empty table gives an empty result.
    """
    rows = pages.select("page_id", F.col("url"), "html")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([render(t.as_py()) for t in b.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), text], ["page_id", "url", "text"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string")
