"""HTML extraction by layout: tree builder, visibility rules, text as it would stand on a page."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset({
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
})
#: Elements whose content is text up to their own end tag.
RAW = frozenset({"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"})
HIDDEN = frozenset({
    "head", "script", "style", "template", "noscript", "iframe", "noembed", "noframes", "object", "audio", "video", "canvas", "datalist", "title",
    "area", "map",
})
BLOCK = frozenset({
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li",
    "listing", "main", "menu", "nav", "ol", "optgroup", "option", "p", "plaintext", "pre", "search", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul", "xmp",
})
#: Blocks with an empty line before and after.
SPACED = frozenset({
    "blockquote", "dl", "fieldset", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "listing", "ol", "p", "pre", "table", "ul", "menu", "dir",
    "plaintext", "xmp",
})
PRE = frozenset({"pre", "textarea", "listing", "plaintext", "xmp"})
#: Start tags that end an open p.
ENDS_P = BLOCK - frozenset({
    "body", "caption", "dd", "dt", "html", "li", "legend", "optgroup", "option", "summary", "tbody", "td", "tfoot", "th", "thead", "tr",
})
#: A start tag ends the nearest open one of these, unless one of the others stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"optgroup", "option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "caption": ({"caption"}, {"table"}),
}
#: Deeper elements become siblings of those at this depth; their text stays.
MAX_DEPTH = 120

#: As in the HTML tokenizer, a quote opens a value only right after "="; elsewhere it is a character like any other.
_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[\s/]+|[^\s/>][^\s/>=]*(?:\s*=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*)?)?)*)>?", re.S)
_ATTR = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>\"'][^\s>]*))?)?")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_BRACE = re.compile(r"[{}]")
_INTEGER = re.compile(r"\s*([+-]?)0*([0-9]{1,10})([0-9]*)")
_SIMPLE = re.compile(r"(?:[a-zA-Z][\w-]*)?(?:[.#][\w-]+)?$")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def parse(source: str) -> tuple[Node, list[str]]:
    """The tree, and the text of the style elements. Stray end tags are ignored, what is open at the end is closed."""
    root = Node("#root", {})
    stack, styles, at = [root], [], 0
    find = _TOKEN.search
    while m := find(source, at):
        if m.start() > at:
            stack[-1].children.append(html.unescape(source[at : m.start()]))
        at = m.end()
        end, start = m[1], m[2]
        if end:
            tag = end.lower()
            if tag == "p" and not any(n.tag == "p" for n in stack):
                stack[-1].children.append(Node("p", {}))
            elif tag == "br":
                stack[-1].children.append(Node("br", {}))
            else:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if stack[i].tag in ("td", "th", "table") and tag not in BLOCK:
                        break  # an inline end tag does not leave its cell
        elif start:
            tag = start.lower()
            if tag in ENDS_P and stack[-1].tag != "#root":
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        del stack[i:]
                        break
                    if stack[i].tag in ("td", "th", "table", "button", "object"):
                        break
            if tag in IMPLIED:
                closes, scope = IMPLIED[tag]
                cut = 0
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in scope:
                        break
                    if stack[i].tag in closes:
                        cut = i
                if cut:
                    del stack[cut:]
            raw = m[3]
            attrs = {}
            if raw and not raw.isspace():
                for a in _ATTR.finditer(raw):
                    attrs.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or ""))
            node = Node(tag, attrs)
            stack[-1].children.append(node)
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
                text = source[at : close.start() if close else len(source)]
                at = close.end() if close else len(source)
                if tag == "style":
                    styles.append(text)
                node.children.append(html.unescape(text) if tag in ("textarea", "title") else text)
            elif tag not in VOID and len(stack) <= MAX_DEPTH:
                stack.append(node)
    if at < len(source):
        stack[-1].children.append(html.unescape(source[at:]))
    return root, styles


def _declared(css: str) -> dict[str, str]:
    out = {}
    for d in css.split(";"):
        name, _, value = d.partition(":")
        out[name.strip().lower()] = value.replace("!important", "").strip().lower()
    return out


def _uncommented(css: str) -> str:
    parts, at = [], 0
    while (begin := css.find("/*", at)) >= 0:
        parts.append(css[at:begin])
        end = css.find("*/", begin + 2)
        if end < 0:
            return "".join(parts)
        at = end + 2
    return "".join([*parts, css[at:]])


def _rules(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of every innermost block, in one pass."""
    at, selectors = 0, None
    for m in _BRACE.finditer(css):
        held, at = css[at : m.start()], m.end()
        if m[0] == "{":
            selectors = held
        elif selectors is not None:
            yield selectors.rpartition(";")[2], held
            selectors = None


def _sheet(styles: list[str]) -> dict[str, dict[str, str]]:
    """display and visibility of rules with simple selectors: a tag, .class, #id or tag with one of them."""
    rules: dict[str, dict[str, str]] = {}
    for text in styles:
        for selectors, body in _rules(_uncommented(text)):
            d = {k: v for k, v in _declared(body).items() if k in ("display", "visibility")}
            for s in selectors.split(",") if d else ():
                if _SIMPLE.match(s := s.strip()) and s:
                    rules.setdefault(s, {}).update(d)
    return rules


def _integer(text: str, default: int, least: int, most: int) -> int:
    """The whole number that text begins with, as HTML reads it, within least and most; default where it begins with none."""
    if not (m := _INTEGER.match(text)):
        return default
    n = most if m[3] else int(m[2])
    return max(least, min(most, -n if m[1] == "-" else n))


def _style(node: Node, sheet: dict[str, dict[str, str]]) -> dict[str, str]:
    out: dict[str, str] = {}
    if sheet:
        tag, names = node.tag, [f".{c}" for c in node.attrs.get("class", "").split()] + [f"#{i}" for i in [node.attrs.get("id", "")] if i]
        for s in (tag, *names, *(tag + n for n in names)):
            out.update(sheet.get(s, {}))
    if "style" in node.attrs:
        out.update(_declared(node.attrs["style"]))
    return out


class Flow:
    """Lines being set: inline text is gathered, blocks break it, empty lines stand only between lines."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self.now.append(first)
            for x in rest:
                self.put("".join(self.now).rstrip())
                self.now = [x]
        else:
            self.now.append(_SPACE.sub(" ", s))

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append(line)

    def flush(self, pre: bool = False) -> None:
        if self.now:
            line = "".join(self.now)
            line = line.rstrip() if pre else _SPACE.sub(" ", line).strip(" ")
            self.now = []
            if line:
                self.put(line)

    def block(self, lines: list[str], first: str = "", rest: str = "") -> None:
        for i, line in enumerate(lines):
            self.put(((first if not i else rest) + line).rstrip())


class Renderer:
    def __init__(self, sheet: dict[str, dict[str, str]]):
        self.sheet = sheet

    def inside(self, node: Node, seen: bool, pre: bool) -> list[str]:
        out = Flow()
        self.flow(node, out, seen, pre)
        out.flush(pre)
        return out.lines

    def flow(self, node: Node, out: Flow, seen: bool, pre: bool) -> None:
        for c in node.children:
            if isinstance(c, str):
                if seen:
                    out.text(c, pre)
            else:
                self.element(c, out, seen, pre)

    def state(self, node: Node, seen: bool) -> tuple[bool, bool, dict[str, str]]:
        """Whether an element takes part in the layout, whether its text is seen, and its style: the one place that decides on either."""
        tag, attrs = node.tag, node.attrs
        style = _style(node, self.sheet) if self.sheet or "style" in attrs else {}
        out = tag in HIDDEN or "hidden" in attrs or style.get("display") == "none" or tag == "dialog" and "open" not in attrs
        if "visibility" in style:
            seen = style["visibility"] not in ("hidden", "collapse")
        return not out, seen, style

    def element(self, node: Node, out: Flow, seen: bool, pre: bool) -> None:
        tag, attrs = node.tag, node.attrs
        there, seen, style = self.state(node, seen)
        if not there:
            return
        display = style.get("display", "")
        if tag == "details" and "open" not in attrs:  # closed: its first summary alone
            shown = next((c for c in node.children if isinstance(c, Node) and c.tag == "summary"), None)
            node = Node(tag, attrs)
            node.children = [shown] if shown else []
        if tag == "br":
            line = "".join(out.now).strip(" ")
            out.now = []
            out.put(line)
            return
        if tag == "input":
            if attrs.get("type", "").lower() in ("submit", "button", "reset") and seen:
                out.text(attrs.get("value", ""), False)
            return
        if tag == "table":
            out.flush(pre)
            out.gap = True
            self.table(node, out, seen)
            out.gap = True
            return
        if tag in ("ul", "ol", "menu", "dir"):
            out.flush(pre)
            nested = getattr(out, "in_list", False)
            out.gap = out.gap or not nested
            self.items(node, out, seen, pre)
            out.gap = out.gap or not nested
            return
        if tag == "hr":
            out.flush(pre)
            out.gap = True
            return
        pre = pre or tag in PRE or style.get("white-space", "").startswith("pre")
        if (tag in BLOCK and display != "inline") or display in ("block", "flex", "grid", "list-item"):
            out.flush()
            spaced = tag in SPACED
            out.gap = out.gap or spaced
            if tag in ("blockquote", "dd"):
                out.block(self.inside(node, seen, pre), "  ", "  ")
            else:
                self.flow(node, out, seen, pre)
                out.flush(pre)
            out.gap = out.gap or spaced
        elif tag in ("td", "th"):
            out.text("  ", False)
            self.flow(node, out, seen, pre)
        else:
            self.flow(node, out, seen, pre)

    def items(self, node: Node, out: Flow, seen: bool, pre: bool) -> None:
        n = _integer(node.attrs.get("start", ""), 1, -(2**31), 2**31 - 1)
        for c in node.children:
            if isinstance(c, str):
                if seen:
                    out.text(c, pre)
                continue
            if c.tag != "li":
                self.element(c, out, seen, pre)
                continue
            out.flush(pre)
            inner = Flow()
            inner.in_list = True
            holder = Node("#item", {})
            holder.children = [c]
            self.flow(holder, inner, seen, pre)
            inner.flush(pre)
            mark = f"{n}. " if node.tag == "ol" else "- "
            n += node.tag == "ol"
            if inner.lines:
                out.block(inner.lines, mark, " " * len(mark))
        out.flush(pre)

    def table(self, node: Node, out: Flow, seen: bool) -> None:
        rows: list[tuple[Node, bool]] = []

        def loose(c, seen: bool) -> None:
            if isinstance(c, str):
                if seen and c.strip():
                    out.text(c, False)
            else:
                self.element(c, out, seen, False)

        def gather(parent: Node, seen: bool) -> None:
            for c in parent.children:
                if isinstance(c, str) or c.tag not in ("tr", "tbody", "thead", "tfoot") or (c.tag != "tr" and parent is not node):
                    loose(c, seen)
                    continue
                there, own, _ = self.state(c, seen)
                if there and c.tag == "tr":
                    rows.append((c, own))
                elif there:
                    gather(c, own)

        gather(node, seen)
        grid: list[list[tuple[list[str], int, int]]] = []
        spans: list[tuple[int, int, int]] = []  # columns [from, to) that cells of rows above take up to a row, in order
        for r, (tr, own) in enumerate(rows):
            spans = [s for s in spans if s[2] > r]
            cells, below, col, at = [], [], 0, 0
            for c in tr.children:
                if isinstance(c, str) or c.tag not in ("td", "th"):
                    loose(c, own)
                    continue
                there, cell_seen, style = self.state(c, own)
                if not there:
                    continue
                while at < len(spans) and spans[at][0] <= col:
                    col, at = max(col, spans[at][1]), at + 1
                holder = Flow()
                pre = style.get("white-space", "").startswith("pre")
                self.flow(c, holder, cell_seen, pre)
                holder.flush(pre)
                wide, high = _integer(c.attrs.get("colspan", ""), 1, 1, 1000), _integer(c.attrs.get("rowspan", ""), 1, 0, 65534)
                cells.append((holder.lines, col, wide))
                until = min(r + high, len(rows)) if high else len(rows)
                if until > r + 1:
                    below.append((col, col + wide, until))
                col += wide
            if below:
                merged: list[tuple[int, int, int]] = []
                for s in sorted(spans + below):
                    if merged and merged[-1][2] == s[2] and merged[-1][1] >= s[0]:
                        merged[-1] = (merged[-1][0], max(merged[-1][1], s[1]), s[2])
                    else:
                        merged.append(s)
                spans = merged
            grid.append(cells)
        out.flush()
        # a column is a place where a cell begins; a cell that spans more of them only pushes what comes after
        columns = sorted({col for cells in grid for _, col, _ in cells})
        number = {col: i for i, col in enumerate(columns)}
        widths, over = [0] * len(columns), [[] for _ in columns]
        for cells in grid:
            for lines, col, wide in cells:
                i, end = number[col], bisect_left(columns, col + wide)
                size = max(map(len, lines), default=0)
                if end == i + 1:
                    widths[i] = max(widths[i], size)
                else:
                    over[end - 1].append((i, size))
        starts = [0] * (len(columns) + 1)
        for i in range(len(columns)):
            starts[i + 1] = max([starts[i] + widths[i] + 2, *(starts[k] + size + 2 for k, size in over[i])])
        for cells in grid:
            for i in range(max([0, *(len(lines) for lines, _, _ in cells)])):
                line = ""
                for lines, col, _ in cells:
                    if i < len(lines) and lines[i]:
                        line = line.ljust(starts[number[col]]) + lines[i]
                out.put(line.rstrip())


def render(source: str | None) -> str:
    """All visible text of one page; "" for null and for pages without any."""
    if not source:
        return ""
    root, styles = parse(source)
    lines = Renderer(_sheet(styles)).inside(root, True, False)
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


@F.pandas_udf(T.StringType())
def _render(pages: pd.Series) -> pd.Series:
    return pd.Series([render(p) for p in pages], dtype=object)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and text for every row of pages.

    Hidden: HIDDEN elements, the hidden attribute, closed dialogs, what a closed
    details has beside its summary, display:none and visibility:hidden, inline
    or by simple selectors of the page's own style sheets, for table rows and
    cells as for all others. Numbers in attributes are read as HTML does:
    what is no number counts as absent, what is out of range as the nearest. Blocks stand on lines of their own, SPACED ones with empty
    lines around, list items behind their mark, nested ones indented, cells of
    a table in aligned columns; white space folds except in pre. A null page
    gives an empty text; null ids and repeated rows are rendered like any row;
    other columns are not read. No shuffle; the memory needed is one batch.
    """
    return pages.select(F.col(id_col).alias("page_id"), _render(F.col(html_col)).alias("text"))
