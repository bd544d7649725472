"""Layout-aware text of web pages.

A tree builder with implied tags (html's optional end tags, void and raw-text elements, table parts without a table
section) and visibility rules (unrendered elements, `hidden`, inline display:none, inline visibility, which children
inherit and may set anew, closed dialogs, closed details but for their summary, inputs); a renderer that gives all visible text: blocks on lines of their own, paragraphs and headings
parted by an empty line, bulleted and numbered lists with indentation, preformatted text as it stands, and tables whose
cells are aligned in columns, with colspan and rowspan. Style sheets are not applied, only `style` attributes.

Defined results: null or empty html gives an empty text; elements nested deeper than MAX_DEPTH become siblings there, so
that no visible text is lost and hidden text stays hidden; unclosed tags, comments and quotes end with the page; a cell wider than MAX_PAD pads no other;
repeated rows stay repeated; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import byte_rows, pieces

MAX_DEPTH, MAX_PAD = 200, 60

# The sets of the HTML standard that the rules below need.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = frozenset("area base head link meta noscript param rp script style template title datalist iframe noembed noframes object audio video canvas source track defs desc metadata annotation annotation-xml".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary ul xmp table caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure fieldset menu dir".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: An opening tag closes an open element of these names, unless one of the second set lies between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
}
FOREIGN = frozenset(("svg", "math"))
SCOPES = frozenset("table td th caption template button html".split())

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)([^>"']*+(?:>|\Z)?)""", re.S
)
QUOTE_OR_END = re.compile("[>\"']")
SPACE = re.compile(r"[ \t\n\r\f]+")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]*)))?""")
#: What of a style attribute is no declaration: comments, strings, and what stands in parentheses.
NO_DECLARATION = re.compile(r"""/\*.*?(?:\*/|$)|"[^"]*"|'[^']*'|\([^()]*\)""", re.S)
WHOLE = re.compile(r"\s*(-?\d{1,6})")


def attributes(raw: str) -> dict[str, str]:
    """The attributes of a tag by lower-case name; of equal names the first counts."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(raw):
        value = next(filter(None, values), "")
        found.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return found


def declared(style: str) -> dict[str, str]:
    """The declarations of a style attribute; the last one of a name counts, but an important one goes first."""
    found: dict[str, tuple[bool, str]] = {}
    for part in NO_DECLARATION.sub("", style).lower().split(";"):
        name, _, value = part.partition(":")
        value, mark, _ = value.partition("!")
        if name.strip() and (mark or not found.get(name.strip(), (False, ""))[0]):
            found[name.strip()] = (bool(mark), value.strip())
    return {k: v for k, (_, v) in found.items()}


class Node:
    """An element. `gone`: it is not rendered at all; `shown`: text right in it is visible; `closed`: only its summary is rendered."""

    __slots__ = ("name", "kids", "attrs", "gone", "shown", "closed")

    def __init__(self, name: str, attrs: str = "", shown: bool = True):
        self.name, self.attrs, self.kids = name, attrs, []
        self.gone, self.shown, self.closed = name in UNSEEN or name == "input", shown, name == "details"
        # Few tags have one of the attributes that matter here.
        given = attributes(attrs) if len(attrs) > 4 and (name in ("dialog", "details") or "hidden" in (low := attrs.lower()) or "style" in low) else {}
        if name in ("dialog", "details"):
            self.closed = name == "details" and "open" not in given
            self.gone |= name == "dialog" and "open" not in given
        if given:
            style = declared(given.get("style", ""))
            display = style.get("display", "")
            self.gone |= display == "none" or not display and "hidden" in given and given["hidden"].lower() != "until-found"
            seen = style.get("visibility", "")
            self.shown = shown if seen in ("", "inherit", "unset") else seen not in ("hidden", "collapse")

    def number(self, key: str, default: int) -> int:
        m = WHOLE.match(attributes(self.attrs).get(key, "")) if key in self.attrs.lower() else None
        return int(m[1]) if m else default


class Quotes:
    """Where tags with quotes end. Opening quotes from which no end was found are remembered, so all searches together are linear."""

    def __init__(self, page: str):
        self.page, self.failed = page, set()

    def tag_end(self, first: int) -> int:
        """The place behind the tag whose first quote is at `first`: its first '>' outside quotes, or the first of all if there is none."""
        page, at, opened = self.page, first, []
        while (m := QUOTE_OR_END.search(page, at)) and m.start() not in self.failed:
            if m[0] == ">":
                return m.end()
            opened.append(m.start())
            at = page.find(m[0], m.end()) + 1
            if not at:
                break
        self.failed.update(opened)
        return (page.find(">", first) + 1) or len(page)


def tree(page: str) -> Node:
    """The page's elements as a browser would nest them, as far as the text's layout needs it."""
    root = Node("body")
    stack, names = [root], ["body"]
    over: list[Node] = []  # the open elements deeper than MAX_DEPTH; a gone one has only gone ones in it
    at, end, quotes = 0, len(page), Quotes(page)

    def cut(k: int) -> None:
        """Closes the open elements from the k-th on."""
        del stack[k:], names[k:], over[max(0, k - MAX_DEPTH) :]

    while at < end:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else end]
        inner = over[-1] if over else stack[-1]
        if text and inner.shown and not (over and (inner.gone or inner.closed)):
            stack[-1].kids.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if m[2] and at < end and page[at - 1] != ">" and page[at] in "\"'":
            at = quotes.tag_end(at)
        if m[1]:
            name = m[1].lower()
            if name == "p" and "p" not in names:
                stack[-1].kids.append(Node("p"))
            elif name == "br":
                stack[-1].kids.append(Node("br"))
            elif name not in ("body", "html"):
                for k in range(len(names) - 1, 0, -1):
                    if names[k] == name:
                        cut(k)
                        break
                    if names[k] in ("td", "th", "table") and name not in ("td", "th", "tr", "thead", "tbody", "tfoot", "table"):
                        break
            continue
        if not m[2]:
            continue
        name, attrs = m[2].lower(), page[m.start(3) : at]
        if name in ("html", "body", "head"):
            if name == "head" or not Node(name, attrs).gone:
                continue
        if name in IMPLIED:
            closes, stops = IMPLIED[name]
            low = None
            for k in range(len(names) - 1, 0, -1):
                if names[k] in closes:
                    low = k
                    if name not in ("tr", "thead", "tbody", "tfoot"):
                        break
                elif names[k] in stops:
                    break
            if low is not None:
                cut(low)
        elif name in ENDS_P and "p" in names:
            for k in range(len(names) - 1, 0, -1):
                if names[k] == "p":
                    cut(k)
                    break
                if names[k] in SCOPES:
                    break
        inner = over[-1] if over else stack[-1]
        node = Node(name, attrs, inner.shown)
        if over and (inner.gone or inner.closed and name != "summary"):
            node.gone = True
        else:
            stack[-1].kids.append(node)
        if name in VOID or attrs.endswith("/>") and any(x in FOREIGN for x in (name, *names)):  # only there a slash closes
            continue
        if name in RAW:
            close = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            raw = page[at : close.start() if close else end]
            if node.shown:
                node.kids.append(html.unescape(raw) if name in ("textarea", "title") and "&" in raw else raw)
            at = close.start() if close else end
            if close:
                m = TAG.search(page, at)
                at = m.end() if m else end
            continue
        names.append(name)
        if len(stack) < MAX_DEPTH:
            stack.append(node)
        else:
            over.append(node)
    return root


class Lines:
    """Lines under construction: inline text with collapsed blanks, and the empty lines owed before the next one."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = False

    def text(self, s: str) -> None:
        s = SPACE.sub(" ", s)
        if s and (s != " " or self.inline):
            self.inline.append(s)

    def end(self) -> None:
        if self.inline:
            line = SPACE.sub(" ", "".join(self.inline)).strip(" ")
            self.inline.clear()
            if line:
                self.put([line])

    def space(self) -> None:
        self.end()
        self.gap = bool(self.lines)

    def put(self, lines: list[str]) -> None:
        if lines:
            if self.gap:
                self.lines.append("")
                self.gap = False
            self.lines += lines


def _list(node: Node, deep: int) -> list[str]:
    ordered, number, out = node.name == "ol", node.number("start", 1), []
    for kid in node.kids:
        if isinstance(kid, str):
            if kid.strip():
                out.append(SPACE.sub(" ", kid).strip())
            continue
        if kid.gone:
            continue
        if kid.name != "li":
            sub = Lines()
            _render(kid, sub, deep + 1)
            sub.end()
            out += ["  " + x if x else x for x in sub.lines]
            continue
        number = kid.number("value", number)
        mark = f"{number}. " if ordered else "- "
        number += 1
        sub = Lines()
        for x in kid.kids:
            _one(x, sub, deep + 1)
        sub.end()
        pad = " " * len(mark)
        if sub.lines:
            out += [(mark if kid.shown else pad) + sub.lines[0], *(pad + x if x else x for x in sub.lines[1:])]
        elif kid.shown:
            out.append(mark.rstrip())
    return out


def _rows(node: Node) -> Iterator[tuple[Node, bool]]:
    """The rows of a table, and whether each begins a section."""
    first = True
    for kid in node.kids:
        if isinstance(kid, Node) and not kid.gone:
            if kid.name == "tr":
                yield kid, first
                first = False
            elif kid.name in ("thead", "tbody", "tfoot"):
                yield from _rows(kid)
                first = True


def _cells(row: Node, deep: int) -> Iterator[tuple[list[str], int, int]]:
    """(lines, columns, rows) of each cell; no rows: as far as the section goes. Spans are as large as the HTML standard lets them be."""
    for cell in row.kids:
        if isinstance(cell, str):
            if cell.strip():
                yield [SPACE.sub(" ", cell).strip()], 1, 1
        elif not cell.gone:
            sub = Lines()
            for x in cell.kids if cell.name in ("td", "th") else [cell]:
                _one(x, sub, deep + 1)
            sub.end()
            yield sub.lines, max(1, min(cell.number("colspan", 1), 1000)), max(0, min(cell.number("rowspan", 1), 65534))


def _table(node: Node, out: Lines, deep: int) -> None:
    for kid in node.kids:  # captions and stray content come first
        if isinstance(kid, str) or kid.name not in ("tr", "thead", "tbody", "tfoot", "colgroup", "col"):
            _one(kid, out, deep + 1)
    out.end()
    grid: list[list[tuple[int, list[str], int]]] = []  # the cells of each row: column, lines, columns
    taken: list[tuple[int, int, float]] = []  # from and behind which column cells of earlier rows still stand, and for how many rows
    for row, begins in _rows(node):
        if begins:
            taken = []
        cells, k, passed, new = [], 0, 0, []
        for lines, wide, high in _cells(row, deep):
            while passed < len(taken) and taken[passed][0] <= k:
                k = max(k, taken[passed][1])
                passed += 1
            cells.append((k, lines, wide))
            if high != 1:
                new.append((k, k + wide, high - 1 if high else float("inf")))
            k += wide
        taken = sorted([(a, b, n - 1) for a, b, n in taken if n > 1] + new) if taken or new else taken
        if any(lines for _, lines, _ in cells):
            grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for k, lines, wide in cells:
            if wide == 1:
                widths[k] = max(widths.get(k, 0), *(len(x) if len(x) <= MAX_PAD else 0 for x in lines or [""]))
    for cells in grid:
        high = max(len(lines) for _, lines, _ in cells)
        for i in range(high):
            line, behind, want = "", 0, 0
            for k, lines, wide in cells:
                want += sum(widths.get(j, 0) + 2 for j in range(behind, k))
                line = line.ljust(want) + (lines[i] if i < len(lines) else "")
                behind = k + wide
                want = max(want + sum(widths.get(j, 0) + 2 for j in range(k, behind)), len(line) + 2 if i < len(lines) else 0)
            out.put([line.rstrip()])


def _one(node, out: Lines, deep: int) -> None:
    if isinstance(node, str):
        out.text(node)
    elif not node.gone:
        _render(node, out, deep)


def _render(node: Node, out: Lines, deep: int = 0) -> None:
    name = node.name
    if name == "br":
        out.inline.append("\x00") if not out.inline else None
        line = "".join(out.inline).strip(" ")
        out.inline.clear()
        out.put([SPACE.sub(" ", line).strip(" ") if line != "\x00" else ""])
        return
    if name in ("pre", "listing", "xmp", "textarea"):
        out.space()
        flat = _verbatim(node).strip("\n")
        out.put([x.rstrip() for x in flat.split("\n")] if flat.strip() else [])
        out.space()
        return
    block = name in BLOCKS
    if block:
        out.space() if name in SPACED and not deep_list(name, out) else out.end()
    if name in ("ul", "ol", "menu", "dir"):
        out.put(_list(node, deep))
    elif name == "table":
        _table(node, out, deep)
    elif name == "li":
        out.put(_list(_wrapped(node), deep))
    else:
        if name == "dd":
            sub = Lines()
            for kid in node.kids:
                _one(kid, sub, deep + 1)
            sub.end()
            out.put(["  " + x if x else x for x in sub.lines])
        elif name == "q":
            out.text('"' * node.shown)
            for kid in node.kids:
                _one(kid, out, deep + 1)
            out.text('"' * node.shown)
        elif node.closed:
            for kid in [x for x in node.kids if isinstance(x, Node) and x.name == "summary"][:1]:
                _one(kid, out, deep + 1)
        else:
            for kid in node.kids:
                _one(kid, out, deep + 1)
            if name in ("td", "th", "button", "text", "math"):
                out.text(" ")
    if block:
        out.space() if name in SPACED else out.end()


def deep_list(name: str, out: Lines) -> bool:
    """A list right under an item's first line follows it without an empty line."""
    if name in ("ul", "ol", "menu", "dir") and len(out.lines) + bool(out.inline) <= 1 and not out.gap:
        out.end()
        return True
    return False


def _wrapped(item: Node) -> Node:
    whole = Node("ul")
    whole.kids.append(item)
    return whole


def _verbatim(node: Node) -> str:
    parts = []
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x.replace("\r\n", "\n"))
        elif x.name == "br":
            parts.append("\n")
        elif x is node or not x.gone:
            todo += reversed(x.kids)
    return "".join(parts)


def visible_text(page: str) -> str:
    out = Lines()
    _render(tree(page), out)
    out.end()
    lines = [x for k, x in enumerate(out.lines) if x or k and out.lines[k - 1]]
    return "\n".join(lines).strip("\n").replace("\x00", "")


def extracted(pages: DataFrame, html_col: str, keep: list[str]) -> DataFrame:
    """The columns `keep` and the visible text of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, html_col):
            rows = byte_rows(batch.column(batch.schema.get_field_index(html_col)))
            texts = [visible_text(bytes(r).decode("utf-8", "replace")) for r in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(texts, pa.string())], [*keep, "visible_text"])

    kinds = dict(pages.dtypes)
    return pages.select(*dict.fromkeys([*keep, html_col])).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "visible_text string"]))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"), "html", ["page_id"])
    return found.select("page_id", F.col("visible_text").alias("text"), F.length("visible_text").cast("bigint").alias("n_chars"), F.size(F.split("visible_text", "\n")).cast("bigint").alias("n_lines"))
