"""Text cards of tables: what retrieval indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEMS, METRICS, CATEGORIES = 30, 15, 12


def first_distinct(value: Column, order: Column, n: int) -> Column:
    """The first n different values in order, as an aggregate: each value's first place is taken before anything is gathered."""
    return F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_set(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))), lambda x: x["v"])), 1, n)


def cards(facts: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """table_ref, card, n_rows: labelled lines of company, years, section, unit, items, metrics and categories."""
    years = facts.where("year is not null").groupBy("table_ref", "year").agg(first_distinct(F.when(F.col("period") != "unknown", F.col("period")), F.col("row_idx"), 5).alias("periods"))
    label = F.when(F.size("periods") > 0, F.concat(F.col("year").cast("string"), F.lit(" ("), F.array_join("periods", ", "), F.lit(")"))).otherwise(F.col("year").cast("string"))
    years = years.groupBy("table_ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("year", label.alias("label")))), lambda x: x["label"]), ", ").alias("years"))
    dated = F.col("source_date").isNotNull() | F.col("column_label").rlike(r"(?:19|20)\d{2}")
    body = facts.groupBy("table_ref").agg(
        F.first("ticker", ignorenulls=True).alias("ticker"), F.min("section").alias("section"), F.min("unit").alias("unit"), F.count_distinct("row_idx").alias("n_rows"),
        first_distinct(F.col("item"), F.col("row_idx"), ITEMS).alias("items"), first_distinct(F.col("metric"), F.col("row_idx"), METRICS).alias("metrics"),
        first_distinct(F.when(~dated & (F.col("column_label") != ""), F.col("column_label")), F.col("row_idx"), CATEGORIES).alias("categories"),
    )
    t = body.join(years, "table_ref", "left")
    if names is not None:
        t = t.join(names.select(F.col("code").alias("ticker"), "name"), "ticker", "left")
    else:
        t = t.withColumn("name", F.lit(None).cast("string"))

    def line(title: str, value: Column) -> Column:
        return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(title + ": "), value))

    text = F.concat_ws(
        "\n", line("company", F.concat_ws(" ", "ticker", "name")), line("section", F.col("section")), line("unit", F.col("unit")), line("years", F.col("years")),
        line("items", F.array_join("items", "; ")), line("metrics", F.array_join("metrics", ", ")), line("categories", F.array_join("categories", "; ")), line("ref", F.col("table_ref")),
    )
    return t.select("table_ref", text.alias("card"), "n_rows")
