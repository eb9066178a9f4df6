"""Tables -> facts: header, column roles, unpivot, hierarchy, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.numbers import is_numeric_like, with_number
from ledgerspark.functions.periods import YEAR, parse_period
from ledgerspark.functions.terms import map_one
from ledgerspark.functions.text import let, normalize_ws

COLUMNS = ("ticker", "year", "period", "source_date", "section", "item", "item_code", "row_idx", "column_label", "metric", "value", "unit", "table_ref")
SCHEMA = "year int, period string, source_date string, section string, item string, item_code string, row_idx int, column_label string, metric string, value double, unit string, table_ref string, ticker string"
# Fixed values.
ITEM_HINTS = ("chi tieu", "chỉ tiêu", "khoan muc", "khoản mục", "item", "noi dung")
CODE_HINTS = ("ma so", "mã số", "code", "ma")
SKIP_HINTS = ("thuyet minh", "thuyết minh", "ghi chu", "ghi chú", "note", "v.v")
HEADER_SCAN = 3


def _hinted(label: Column, hints: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(F.lower(label), h))


def header_row(rows: Column) -> Column:
    """Index of the header among the first HEADER_SCAN rows: least numeric, years in its favour; null if all are figures."""

    def score(row: Column, i: Column) -> Column:
        filled = F.filter(row, lambda c: F.trim(c) != "")
        figures = F.size(F.filter(filled, lambda c: is_numeric_like(c) & ~F.trim(c).rlike(rf"^{YEAR}$")))
        year = F.exists(filled, lambda c: c.rlike(YEAR))
        return F.when(F.size(filled) >= 2, F.struct((figures / F.size(filled) - F.when(year, 0.3).otherwise(0.0)).alias("score"), i.alias("i")))

    return let(F.array_min(F.array_compact(F.transform(F.slice(rows, 1, HEADER_SCAN), score))), lambda b: F.when(b["score"] < 0.6, b["i"]))


def clean_columns(header: Column) -> Column:
    """Names squeezed; blanks named by place, repeats numbered."""
    names = F.transform(header, lambda c, i: F.when(normalize_ws(c) == "", F.concat(F.lit("col_"), i.cast("string"))).otherwise(normalize_ws(c)))

    def numbered(all_: Column) -> Column:
        def one(name: Column, i: Column) -> Column:
            before = F.size(F.filter(F.slice(all_, F.lit(1), i), lambda x: x == name))
            return F.when(before > 0, F.concat(name, F.lit("_"), before.cast("string"))).otherwise(name)

        return F.transform(all_, one)

    return let(names, numbered)


def frames(tables: DataFrame) -> DataFrame:
    """tables with columns (clean header) and body (rows under it, padded to its width); rows above the header go."""
    at = header_row(F.col("rows"))
    t = tables.withColumn("_at", at).withColumn("_width", F.array_max(F.transform("rows", lambda r: F.size(r))))
    padded = F.transform("rows", lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(F.col("_width") - F.size(r), F.lit(0)))), F.lit(1), F.col("_width")))
    t = t.withColumn("rows", padded)
    body = F.slice("rows", F.col("_at") + 2, F.greatest(F.size("rows") - F.col("_at") - 1, F.lit(0)))
    usable = F.col("_at").isNotNull() & (F.col("_at") + 1 < F.size("rows"))
    synthetic = F.transform(F.sequence(F.lit(0), F.col("_width") - 1), lambda i: F.concat(F.lit("col_"), i.cast("string")))
    return (
        t.withColumn("columns", F.when(usable, clean_columns(F.get("rows", F.col("_at")))).otherwise(synthetic))
        .withColumn("body", F.when(usable, body).otherwise(F.col("rows")))
        .drop("_at", "_width", "rows")
    )


def cells(framed: DataFrame) -> DataFrame:
    """One row a cell: table_ref, row_idx, col_idx, column_label, p (the label's period), cell and the table's own columns.

    Labels are parsed once a table, before its cells are parted.
    """
    dated = framed.withColumn("_p", F.transform("columns", lambda c: parse_period(c, F.col("fallback_year"))))
    rows = dated.select("*", F.posexplode("body").alias("row_idx", "_row"))
    zipped = F.arrays_zip(F.col("columns").alias("label"), F.col("_p").alias("p"), F.col("_row").alias("cell"))
    out = rows.select("*", F.posexplode(zipped).alias("col_idx", "_c"))
    kept = [c for c in framed.columns if c not in ("columns", "body")]
    return out.select(*kept, "row_idx", "col_idx", F.col("_c.label").alias("column_label"), F.col("_c.p").alias("p"), F.trim(F.coalesce("_c.cell", F.lit(""))).alias("cell"))


def column_roles(eav: DataFrame) -> DataFrame:
    """eav with figure (its cell as a number) and role (item, code, period, category or null).

    All statistics are windows within one table_ref, so cells are shuffled once
    by it and nothing is joined; a window holds one table, never a corpus.
    """
    filled = F.col("cell") != ""
    column, table = Window.partitionBy("table_ref", "col_idx"), Window.partitionBy("table_ref")
    s = with_number(eav, "figure", F.col("cell")).withColumns(
        {
            "_n": F.count_if(filled).over(column),
            "_text": F.avg(F.when(filled, F.col("figure").isNull().cast("int"))).over(column),
            "_length": F.avg(F.when(filled, F.length("cell"))).over(column),
            "_codes": F.avg(F.when(filled, F.col("cell").rlike(r"^\d{2,3}$").cast("int"))).over(column),
        }
    )
    s = s.withColumn("_item_score", F.when(_hinted(F.col("column_label"), ITEM_HINTS), 2.0).otherwise(F.col("_text") * F.least(F.col("_length") / 10, F.lit(1.0))))
    s = s.withColumn("_item", F.max_by(F.when(F.col("_item_score") > 0.3, F.col("col_idx")), F.struct(F.coalesce("_item_score", F.lit(-1.0)), -F.col("col_idx"))).over(table))
    by_stats = (F.col("_n") >= 3) & (F.col("_codes") > 0.7) & F.col("p").isNull()
    code_score = F.when(_hinted(F.col("column_label"), CODE_HINTS), 2).when(by_stats, 1).otherwise(0)
    s = s.withColumn("_code_score", F.when(F.col("col_idx").eqNullSafe(F.col("_item")), 0).otherwise(code_score))
    s = s.withColumn("_code", F.max_by(F.when(F.col("_code_score") > 0, F.col("col_idx")), F.struct("_code_score", -F.col("col_idx"))).over(table))
    s = s.withColumn("_free", ~F.col("col_idx").eqNullSafe(F.col("_item")) & ~F.col("col_idx").eqNullSafe(F.col("_code")))
    same = Window.partitionBy("table_ref", F.when(F.col("_free"), F.col("p.year")), F.when(F.col("_free"), F.col("p.period")))
    first = F.col("col_idx") == F.min(F.when(F.col("_free"), F.col("col_idx"))).over(same)
    role = (
        F.when(F.col("col_idx").eqNullSafe(F.col("_item")), "item")
        .when(F.col("col_idx").eqNullSafe(F.col("_code")), "code")
        .when(F.col("p").isNotNull() & first, "period")
        .when(F.col("p").isNull() & (1 - F.col("_text") >= 0.6) & ~_hinted(F.col("column_label"), SKIP_HINTS), "category")
    )
    return s.select(*eav.columns, "figure", role.alias("role"))


def to_facts(tables: DataFrame) -> DataFrame:
    """tables (table_ref, rows, section, unit, unit_scale, ticker, fallback_year) -> the 13 fact columns.

    Period columns give (year, period); category columns give the fallback year
    and their label; a table with neither gives each row's first figure. Rows
    without figures are headings: numerals or capitals open a section, others a
    category, and both prefix the items below.
    """
    slim = frames(tables.select("table_ref", "rows", "section", "unit", "unit_scale", "ticker", "fallback_year"))
    e = column_roles(cells(slim)).withColumn("value", F.col("figure") * F.col("unit_scale"))
    e = e.withColumn("_axis", F.max(F.col("role").isin("period", "category").cast("int")).over(Window.partitionBy("table_ref")) == 1)
    data = F.when(F.col("_axis"), F.col("role").isin("period", "category")).otherwise(F.coalesce(~F.col("role").isin("item", "code"), F.lit(True)))
    e = e.withColumn("_data", F.coalesce(data, F.lit(False)) & F.col("value").isNotNull())
    row = Window.partitionBy("table_ref", "row_idx")
    e = e.withColumns(
        {
            "raw_item": F.max(F.when(F.col("role") == "item", F.col("cell"))).over(row),
            "item_code": F.max(F.when((F.col("role") == "code") & (F.col("cell") != ""), F.col("cell"))).over(row),
            "_has_value": F.max(F.col("_data").cast("int")).over(row),
            "_first_col": F.min(F.when(F.col("_data"), F.col("col_idx"))).over(row),
        }
    ).where("raw_item <> ''")
    heading = F.trim(F.regexp_replace("raw_item", r"^[-+*\s]+", ""))
    letters = F.regexp_replace(heading, r"[^\p{L}]", "")
    is_section = heading.rlike(r"^[IVXLCDM]+\b") | ((F.upper(heading) == heading) & (letters != "") & (F.length(heading) > 3))
    # all cells of a row carry the same mark, so their order within the row does not matter
    down = Window.partitionBy("table_ref").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.withColumn("_mark", F.when(F.col("_has_value") == 0, F.struct(is_section.alias("is_section"), heading.alias("text"))))
    e = e.withColumns({"_section": F.last(F.when(F.col("_mark.is_section"), F.col("_mark.text")), ignorenulls=True).over(down), "_last": F.last("_mark", ignorenulls=True).over(down)})
    prefix = F.concat_ws(" - ", "_section", F.when(~F.col("_last.is_section"), F.col("_last.text")))
    item = let(prefix, lambda p: F.when((p == "") | F.contains(F.col("raw_item"), p), F.col("raw_item")).otherwise(F.concat_ws(" - ", p, F.col("raw_item"))))
    values = e.where(F.col("_data") & (F.col("_axis") | (F.col("col_idx") == F.col("_first_col"))))
    return values.withColumn("item", item).select(
        "ticker", F.coalesce("p.year", "fallback_year").alias("year"), F.coalesce("p.period", F.lit("unknown")).alias("period"), F.col("p.source_date").alias("source_date"), "section", "item", "item_code",
        "row_idx", F.when(F.col("_axis"), F.col("column_label")).otherwise("").alias("column_label"), F.coalesce(map_one(F.col("item")), map_one(F.col("raw_item"))).alias("metric"), "value", "unit", "table_ref",
    )
