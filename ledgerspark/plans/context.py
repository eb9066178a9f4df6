"""What a writer of queries is told about the tables of a question: schemas, ambiguous items, anchors, formulas, period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions import terms
from ledgerspark.functions.text import let, normalize_text, tokenize
from ledgerspark.operators.evaluate import ambiguous
from ledgerspark.plans.cards import first_distinct

ITEMS, LABELS, AMBIGUOUS, PER_TABLE = 20, 10, 4, 2
PERIOD_HINTS = {
    "opening": "asked: figures at the start; filter period = 'opening'",
    "closing": "asked: figures at the end; filter period = 'closing', or 'annual' where a table has none",
    "annual": "asked: figures over the year; filter period = 'annual', or 'closing' where a table has none",
}


def ambiguity_notes(facts: DataFrame, most: int = AMBIGUOUS) -> DataFrame:
    """(table_ref, item, n_values, codes, labels): items with several values for one year and period, and what tells them apart; the first `most` of a table."""
    keys = ["table_ref", "item", "year", "period"]
    twice = ambiguous(facts, by=keys).groupBy("table_ref", "item").agg(F.max("n_values").alias("n_values"))
    told = facts.groupBy("table_ref", "item").agg(
        F.min("row_idx").alias("_o"), first_distinct(F.when(F.trim("item_code") != "", F.col("item_code")), F.col("row_idx"), 6).alias("codes"), first_distinct(F.when(F.trim("column_label") != "", F.col("column_label")), F.col("row_idx"), 6).alias("labels")
    )
    both = twice.join(told, ["table_ref", "item"])
    return both.withColumn("_k", F.row_number().over(Window.partitionBy("table_ref").orderBy("_o", "item"))).where(F.col("_k") <= most).select("table_ref", "item", "n_values", "codes", "labels")


def schemas(facts: DataFrame) -> DataFrame:
    """(table_ref, schema): labelled lines of a table's size, items, years, periods, labels and ambiguous items."""
    body = facts.groupBy("table_ref").agg(
        F.count("*").alias("n"), first_distinct(F.col("item"), F.col("row_idx"), ITEMS).alias("items"), F.array_sort(F.collect_set("year")).alias("years"),
        F.array_sort(F.collect_set("period")).alias("periods"), first_distinct(F.when(F.trim("column_label") != "", F.col("column_label")), F.col("row_idx"), LABELS).alias("labels"),
        F.count_distinct(F.when(F.trim("column_label") != "", F.col("column_label"))).alias("n_labels"), F.min("section").alias("section"),
    )
    hint = F.concat_ws("; ", F.when(F.size("codes") > 1, F.concat(F.lit("item_code in "), F.array_join("codes", ", "))), F.when(F.size("labels") > 1, F.concat(F.lit("column_label in "), F.array_join("labels", ", "))))
    line = F.concat(F.col("item"), F.lit(": "), F.when(hint != "", hint).otherwise("rows differ by row_idx alone"))
    notes = ambiguity_notes(facts).groupBy("table_ref").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n  ").alias("notes"))
    text = F.concat_ws(
        "\n", F.concat(F.lit("table "), F.col("table_ref"), F.lit(" ("), F.coalesce("section", F.lit("no section")), F.lit("), rows: "), F.col("n")), F.concat(F.lit("items: "), F.array_join("items", "; ")),
        F.concat(F.lit("years: "), F.array_join(F.col("years").cast("array<string>"), ", ")), F.concat(F.lit("periods: "), F.array_join("periods", ", ")),
        F.when(F.col("n_labels") > 1, F.concat(F.lit("labels ("), F.col("n_labels"), F.lit("): "), F.array_join("labels", ", "))), F.when(F.col("notes").isNotNull(), F.concat(F.lit("ambiguous:\n  "), F.col("notes"))),
    )
    return body.join(notes, "table_ref", "left").select("table_ref", text.alias("schema"))


def anchor_score(question: Column, item: Column) -> Column:
    """Words of the question in the item, 4 a phrase of two or three words, less 0.02 a character; null without any word. Both sides folded."""

    def scored(w: Column, flat: Column) -> Column:
        def grams(n: int, least: int) -> Column:
            made = F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
            return F.size(F.filter(made, lambda g: (F.length(g) >= least) & F.contains(flat, g)))

        hits = F.size(F.filter(F.array_distinct(w), lambda x: (F.length(x) >= 2) & F.contains(flat, x)))
        return F.when(hits > 0, hits + 4 * (grams(2, 5) + grams(3, 8)) - 0.02 * F.length(flat))

    bare = F.regexp_replace(item, r"^\s*\d+[.)]\s*", "")
    return let(tokenize(question), lambda w: let(normalize_text(bare), lambda flat: scored(w, flat)))


def anchors(questions: DataFrame, chosen: DataFrame, facts: DataFrame, per_table: int = PER_TABLE) -> DataFrame:
    """(question_id, table_ref, item, keyword, score, best): the items of each chosen table that match a question best; best marks the table to use first."""
    items = facts.where("item is not null").select("table_ref", "item").distinct()
    pairs = chosen.select("question_id", "table_ref").distinct().join(questions.select("question_id", "question"), "question_id").join(items, "table_ref")
    scored = pairs.withColumn("score", F.round(anchor_score(F.col("question"), F.col("item")), 6)).where("score is not null")
    ranked = scored.withColumn("_k", F.row_number().over(Window.partitionBy("question_id", "table_ref").orderBy(F.col("score").desc(), "item"))).where(F.col("_k") <= per_table)
    first = F.first("table_ref").over(Window.partitionBy("question_id").orderBy(F.col("score").desc(), "table_ref", "item"))
    keyword = F.trim(F.regexp_replace(F.regexp_replace(F.element_at(F.split("item", " - "), -1), r"^\s*\d+[.)]\s*", ""), r"\s*\{.*?\}", ""))
    return ranked.select("question_id", "table_ref", "item", keyword.alias("keyword"), "score", (F.col("table_ref") == first).alias("best"))


def formulas(metrics: list[str] = ()) -> str:
    """Lines of the ratios named, or of all."""

    def line(m: str) -> str:
        top, less, below, factor = terms.FORMULAS[m]
        return f"{m} = {f'({top} - {less})' if less else top} / {below}" + (f" * {factor:g}" if factor != 1 else "")

    named = [m for m in metrics if m in terms.FORMULAS]
    return "\n".join(map(line, named or terms.FORMULAS))


def period_hint(requested: str | None) -> str:
    return PERIOD_HINTS.get(requested or "", "")


def variables(refs: list[str]) -> dict[str, str]:
    """df1 ... dfN of the tables chosen, in order."""
    return {f"df{i}": r for i, r in enumerate(refs, 1)}


def frames_of(facts: DataFrame, refs: list[str]) -> dict[str, DataFrame]:
    """A DataFrame a variable; each is one filter on table_ref, which reaches the scan."""
    return {v: facts.where(F.col("table_ref") == r) for v, r in variables(refs).items()}
