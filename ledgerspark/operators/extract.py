"""Documents -> tables: inline HTML tables as grids, with a delimited-text fallback."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.functions.numbers import detect_unit
from ledgerspark.functions.text import fold, normalize_text

_TABLE = re.compile(r"<table[^>]*>(.*?)</table>", re.I | re.S)
_ROW = re.compile(r"<tr[^>]*>(.*?)(?=</tr>|<tr[\s>]|\Z)", re.I | re.S)
_CELL = re.compile(r"<t[dh]([^>]*)>(.*?)(?=</t[dh]>|<t[dh][\s>]|\Z)", re.I | re.S)
_SPAN = re.compile(r"\b(row|col)span\s*=\s*[\"']?(\d+)", re.I)
_TAG = re.compile(r"<[^>]+>")
_PAGE = re.compile(r"=====\s*PAGE\s+(\d+)\s*=====", re.I)
_GLUED = re.compile(r"\(?-?\d{1,3}(?:\.\d{3})+(?:,\d+)?\)?|-")
_FIGURE = re.compile(r"\d{1,3}(?:\.\d{3})+")
_NUMBER = re.compile(r"[(\-]?[\d\s.,OoIlSsBZzQgD]+[)%]?\Z")

# Fixed values, accents folded when compared.
TITLE_HINTS = (
    "bảng cân đối kế toán", "báo cáo kết quả", "lưu chuyển tiền tệ", "tình hình tài chính", "thuyết minh", "chỉ tiêu", "tài sản",
    "nguồn vốn", "tổng cộng", "đơn vị tính", "balance sheet", "income statement", "cash flow",
)
SECTIONS = (
    ("can doi ke toan", "balance_sheet"), ("tinh hinh tai chinh", "balance_sheet"), ("balance sheet", "balance_sheet"),
    ("ket qua hoat dong", "income_statement"), ("ket qua kinh doanh", "income_statement"), ("income statement", "income_statement"),
    ("luu chuyen tien te", "cash_flow"), ("cash flow", "cash_flow"), ("thuyet minh", "notes"),
)
STITCH_GAP, CONTEXT_CHARS, MIN_ROWS, MIN_COLS = 30, 400, 2, 2
JUNK_LINES = 2

_TABLES = T.ArrayType(
    T.StructType(
        [T.StructField(n, t) for n, t in (("position", T.IntegerType()), ("rows", T.ArrayType(T.ArrayType(T.StringType()))), ("start", T.IntegerType()), ("end", T.IntegerType()), ("page", T.IntegerType()), ("context", T.StringType()), ("gap", T.IntegerType()))]
    )
)


def split_glued(text: str) -> list[str]:
    """The parts of a cell that holds several figures, else the cell alone; nothing for a blank one."""
    t = text.strip()
    if not t:
        return []
    parts = _GLUED.findall(t)
    return parts if len(parts) > 1 and "".join(parts) == "".join(t.split()) else [t]


def clean_cell(raw: str) -> str:
    return html.unescape(_TAG.sub(" ", raw)).replace("\xa0", " ").strip()


def decode_grid(inner: str) -> list[list[str]]:
    """The rectangle of cells that rows with spans describe.

    What a spanning cell puts below itself is written down when the cell is
    met, so later rows simply step over places that are taken: figures glued
    together go one to a row, one figure stays on its first row, words repeat.
    A column span leaves empty cells.
    """
    taken: dict[tuple[int, int], str] = {}
    rows = _ROW.findall(inner)
    for r, raw in enumerate(rows):
        c = 0
        for attrs, body in _CELL.findall(raw):
            while (r, c) in taken:
                c += 1
            spans = {k.lower(): max(1, min(int(v), 1000)) for k, v in _SPAN.findall(attrs)}
            high, text = min(spans.get("row", 1), len(rows) - r), clean_cell(body)
            declared = spans.get("row", 1)
            parts = split_glued(text) if declared > 1 else [text]
            if declared > 1 and len(parts) != declared:
                parts = [text] + [""] * (declared - 1) if _FIGURE.search(text) else [text] * declared
            for i in range(high):
                taken[r + i, c] = parts[i] if i < len(parts) else ""
            for i in range(1, spans.get("col", 1)):
                taken[r, c + i] = ""
            c += spans.get("col", 1)
    width = max((c + 1 for _, c in taken), default=0)
    return [[taken.get((r, c), "") for c in range(width)] for r in range(len(rows))]


def html_tables(text: str | None, min_rows: int = MIN_ROWS, min_cols: int = MIN_COLS) -> list[dict]:
    """Every table of a document that is large enough; position counts all of them from 1."""
    t = text or ""
    pages = [(m.start(), int(m[1])) for m in _PAGE.finditer(t)]
    offsets, out, last_end = [o for o, _ in pages], [], None
    for position, m in enumerate(_TABLE.finditer(t), 1):
        rows = decode_grid(m[1])
        if len(rows) < min_rows or max(map(len, rows), default=0) < min_cols:
            continue
        before = t[max(0, m.start() - CONTEXT_CHARS) : m.start()]
        before = before[(before.lower().rfind("</table>") + 8) if "</table>" in before.lower() else 0 :]
        lines = [x.strip() for x in _PAGE.sub("", _TAG.sub(" ", before)).split("\n")]
        at = bisect_right(offsets, m.start())
        gap = None if last_end is None else len(_PAGE.sub("", _TAG.sub(" ", t[last_end : m.start()])).strip())
        out.append({"position": position, "rows": rows, "start": m.start(), "end": m.end(), "page": pages[at - 1][1] if at else None, "context": "\n".join(filter(None, lines)), "gap": gap})
        last_end = m.end()
    return out


def _cells(line: str, dialect: str) -> list[str]:
    if dialect == "pipe":
        return [c.strip() for c in line.strip().strip("|").split("|")]
    return [c.strip() for c in (line.split("\t") if dialect == "tab" else re.split(r"\s{2,}", line.strip()))]


def _dialect(line: str) -> str:
    return "pipe" if line.count("|") >= 2 else "tab" if "\t" in line.strip() else "space"


def _numeric(cell: str) -> bool:
    return bool(_NUMBER.match(cell.strip())) and any(c.isdigit() for c in cell)


def text_tables(text: str | None, min_rows: int = MIN_ROWS, min_cols: int = MIN_COLS) -> list[dict]:
    """Tables set in plain lines: the dialect most tabular lines speak, blocks with up to JUNK_LINES other lines inside."""
    lines = (text or "").split("\n")
    rule = re.compile(r"[\s|:+=_\-]*\Z")
    header = re.compile("|".join(map(re.escape, (normalize_py(h) for h in TITLE_HINTS))))

    def tabular(line: str) -> bool:
        cells = [c for c in _cells(line, _dialect(line)) if c]
        return len(cells) >= min_cols and any(map(_numeric, cells)) and not rule.match(line)

    def heading(line: str) -> bool:
        return len(line.split()) >= min_cols and bool(header.search(normalize_py(line))) and len([c for c in _cells(line, _dialect(line)) if c]) >= min_cols

    votes = Counter(_dialect(x) for x in lines if tabular(x))
    if not votes:
        return []
    dialect = max(("pipe", "tab", "space"), key=lambda d: votes[d])
    blocks, now, junk = [], [], 0
    for i, line in enumerate([*lines, *[""] * (JUNK_LINES + 1)]):
        if tabular(line) or heading(line) or (now and rule.match(line) and line.strip()):
            now += [*range(now[-1] + 1, i), i] if now else [i]
            junk = 0
        elif now:
            junk += 1
            if junk > JUNK_LINES:
                blocks.append(now)
                now, junk = [], 0
    out = []
    for block in blocks:
        rows = [[c for c in _cells(lines[i], dialect)] for i in block if lines[i].strip() and not rule.match(lines[i])]
        rows = [r for r in rows if len([c for c in r if c]) >= min_cols]
        if len(rows) >= min_rows:
            context = "\n".join(x.strip() for x in lines[max(0, block[0] - 6) : block[0]] if x.strip())
            out.append({"position": len(out) + 1, "rows": rows, "start": block[0], "end": block[-1] + 1, "page": None, "context": context, "gap": None})
    return out


def normalize_py(s: str) -> str:
    import unicodedata

    s = unicodedata.normalize("NFD", s.replace("đ", "d").replace("Đ", "D"))
    return "".join(c for c in s if unicodedata.category(c) != "Mn").lower()


@F.pandas_udf(_TABLES)
def find_tables(texts: pd.Series) -> pd.Series:
    """HTML tables, or where there is none what the lines themselves lay out."""
    return pd.Series([html_tables(t) or text_tables(t) for t in texts])


def count_html_tables(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?i)<table[\s>]"))


def table_ref(doc_id: Column, position: Column) -> Column:
    return F.concat_ws("|", doc_id, position.cast("string"))


def title_of(context: Column) -> Column:
    """The lowest line with a title hint that names no unit; else the lowest unit line, else the last line."""
    lines = F.reverse(F.filter(F.split(context, "\n"), lambda x: F.trim(x) != ""))
    hints = F.array(*[F.lit(normalize_py(h)) for h in TITLE_HINTS])
    hinted = F.filter(lines, lambda x: F.exists(hints, lambda h: F.contains(normalize_text(x), h)))
    unit = lambda x: normalize_text(x).rlike("don vi|dvt")
    return F.coalesce(F.get(F.filter(hinted, lambda x: ~unit(x)), F.lit(0)), F.get(F.filter(lines, unit), F.lit(0)), F.get(lines, F.lit(0)))


def section_of(context: Column) -> Column:
    flat, out = fold(F.coalesce(context, F.lit(""))), F
    for needle, label in SECTIONS:
        out = out.when(F.contains(flat, F.lit(needle)), F.lit(label))
    return out


def stitch(tables: DataFrame) -> DataFrame:
    """Neighbours of equal width with less than STITCH_GAP characters between them become one: a gaps-and-islands window."""
    order = Window.partitionBy("doc_id").orderBy("position")
    width = F.size(F.get("rows", F.lit(0)))
    breaks = F.coalesce((F.lag(width).over(order) != width) | (F.col("gap") >= STITCH_GAP) | F.col("gap").isNull(), F.lit(True))
    marked = tables.withColumn("_break", breaks.cast("int"))
    island = marked.withColumn("_island", F.sum("_break").over(order))
    keep = [c for c in tables.columns if c not in ("doc_id", "rows", "end", "gap")]
    return (
        island.groupBy("doc_id", "_island")
        .agg(*[F.min_by(c, "position").alias(c) for c in keep], F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("position", "rows"))).alias("_parts"))
        .withColumn("rows", F.flatten(F.transform("_parts", lambda p: p["rows"])))
        .drop("_parts", "_island")
    )


def extract_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, position, page, rows, title, section, unit, unit_scale, context, table_ref of every table."""
    found = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.explode(find_tables(F.col(text_col))).alias("t")).select("doc_id", "t.*")
    unit = detect_unit(F.col("context"))
    return (
        stitch(found)
        .withColumn("title", title_of(F.col("context")))
        .withColumn("section", section_of(F.col("context")))
        .withColumn("_unit", unit)
        .select("doc_id", "position", "page", "rows", "title", "section", F.col("_unit.label").alias("unit"), F.col("_unit.scale").alias("unit_scale"), "context", table_ref(F.col("doc_id"), F.col("position")).alias("table_ref"))
    )


def page_asof(marks: DataFrame, events: DataFrame, part: str, at: str, value: str) -> DataFrame:
    """As-of join, backward: the last mark at or before each event, in one window over both."""
    both = marks.select(part, at, F.lit(0).alias("_kind"), F.col(value)).unionByName(events.drop(value).withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(part).orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last(F.when(F.col("_kind") == 0, F.col(value)), ignorenulls=True).over(w)).where("_kind = 1").drop("_kind")
