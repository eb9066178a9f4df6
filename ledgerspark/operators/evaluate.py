"""Scores of answers and rankings, submission rules, corpus integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REL_TOL, ABS_TOL = 0.01, 1e-6


def prf2(pred: Column, gold: Column) -> Column:
    """STRUCT<precision, recall, f2> of two sets; an empty gold set is met by an empty answer alone."""
    p, g = F.array_distinct(F.coalesce(pred, F.array().cast("array<string>"))), F.array_distinct(F.coalesce(gold, F.array().cast("array<string>")))
    hit = F.size(F.array_intersect(p, g)).cast("double")
    made = lambda a, b, c: F.struct(F.lit(a).cast("double").alias("precision") if not isinstance(a, Column) else a.alias("precision"), (b if isinstance(b, Column) else F.lit(float(b))).alias("recall"), (c if isinstance(c, Column) else F.lit(float(c))).alias("f2"))
    precision, recall = hit / F.size(p), hit / F.size(g)
    return (
        F.when((F.size(g) == 0) & (F.size(p) == 0), made(1, 1, 1)).when(F.size(g) == 0, made(0, 1, 0)).when((F.size(p) == 0) | (hit == 0), made(0, 0, 0))
        .otherwise(made(precision, recall, 5 * precision * recall / (4 * precision + recall)))
    )


def mrr(ranked: Column, relevant: Column, k: int = 5) -> Column:
    """1 / place of the first relevant among the first k different ones, 0 without."""
    first = F.slice(F.array_distinct(ranked), 1, k)
    places = F.filter(F.transform(relevant, lambda r: F.array_position(first, r)), lambda p: p > 0)
    return F.coalesce(1.0 / F.array_min(places), F.lit(0.0))


def answer_correct(pred: Column, gold: Column, rel: float = REL_TOL, absolute: float = ABS_TOL) -> Column:
    close = F.when(gold == 0, F.abs(pred) <= absolute).otherwise(F.abs(pred - gold) <= F.greatest(F.lit(absolute), rel * F.abs(gold)))
    return F.when(pred.isNull() & gold.isNull(), True).when(pred.isNull() | gold.isNull() | F.isnan(pred) | F.isnan(gold), False).otherwise(close)


def failure_tags(table_recall: Column, doc_recall: Column, table_mrr: Column, doc_mrr: Column, has_code: Column, executed: Column, right: Column) -> Column:
    tags = F.array_compact(
        F.array(
            F.when(table_recall == 0, "TABLE_MISS"), F.when(doc_recall == 0, "DOC_MISS"), F.when((table_recall > 0) & (table_mrr < 1), "TABLE_BAD_RANK"), F.when((doc_recall > 0) & (doc_mrr < 1), "DOC_BAD_RANK"),
            F.when(~has_code, "QUERY_NO_CODE"), F.when(has_code & ~executed, "EXECUTION_ERROR"), F.when(executed & ~right, "ANSWER_MISMATCH"),
        )
    )
    return F.when(F.size(tags) == 0, F.array(F.lit("SUCCESS"))).otherwise(tags)


def evaluate(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """gold left join pred by id: one row of metrics a question; a missing answer scores zero."""
    p = pred.select("id", F.col("answer").alias("p_answer"), F.col("relevant_docs").alias("p_docs"), F.col("relevant_tables").alias("p_tables"), F.col("query").alias("p_query"))
    both = gold.join(p, "id", "left")
    d, t = prf2(F.col("p_docs"), F.col("relevant_docs")), prf2(F.col("p_tables"), F.col("relevant_tables"))
    none = F.array().cast("array<string>")
    rows = both.select(
        "id", d.alias("doc"), t.alias("table"), mrr(F.coalesce("p_docs", none), F.col("relevant_docs")).alias("doc_mrr5"), mrr(F.coalesce("p_tables", none), F.col("relevant_tables")).alias("table_mrr5"),
        answer_correct(F.col("p_answer"), F.col("answer")).cast("int").alias("answer_accuracy"), F.col("p_answer").isNotNull().cast("int").alias("execution_accuracy"), (F.coalesce(F.trim("p_query"), F.lit("")) != "").alias("has_code"),
    )
    rows = rows.select("id", *[F.col(f"{x}.{m}").alias(f"{x}_{m}") for x in ("doc", "table") for m in ("precision", "recall", "f2")], "doc_mrr5", "table_mrr5", "answer_accuracy", "execution_accuracy", "has_code")
    tags = failure_tags(F.col("table_recall"), F.col("doc_recall"), F.col("table_mrr5"), F.col("doc_mrr5"), F.col("has_code"), F.col("execution_accuracy") == 1, F.col("answer_accuracy") == 1)
    return rows.withColumn("tags", tags)


def macro(rows: DataFrame) -> DataFrame:
    """One row: every metric's mean, and overall = (table F2 + answer + execution) / 3."""
    names = [c for c in rows.columns if c not in ("id", "tags", "has_code")]
    out = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in names])
    return out.withColumn("overall", (F.col("table_f2") + F.col("answer_accuracy") + F.col("execution_accuracy")) / 3)


def tag_histogram(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def worst(rows: DataFrame, n: int = 15) -> DataFrame:
    return rows.orderBy("table_f2", "id").limit(n)


def funnel(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("asked"), F.count_if(F.col("doc_recall") > 0).alias("doc_found"), F.count_if(F.col("table_recall") > 0).alias("table_found"), F.count_if("has_code").alias("with_code"), F.count_if(F.col("execution_accuracy") == 1).alias("executed"), F.count_if(F.col("answer_accuracy") == 1).alias("right"))


def check_submission(items: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(id, level, message) for every rule that a row breaks; with expected ids also those missing and those extra."""
    repeated = F.count("*").over(Window.partitionBy("id")) > 1

    def rule(cond: Column, level: str, message: str) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(message).alias("message")))

    rules = F.array_compact(
        F.array(
            rule(F.col("id").isNull(), "error", "id is missing"), rule(repeated, "error", "id is repeated"), rule(F.col("answer").isNull() | F.isnan("answer") | (F.abs("answer") == float("inf")), "error", "answer is not a finite number"),
            rule(F.exists("relevant_docs", lambda d: F.endswith(d, F.lit(".txt"))), "error", "document with .txt suffix"), rule(F.exists("relevant_tables", lambda t: ~F.contains(t, F.lit("|"))), "error", "table without |"),
            rule(F.exists("relevant_tables", lambda t: F.contains(t, F.lit("|")) & ~t.rlike(r"\|\d+$")), "error", "table position is not a number"),
            rule(F.exists("csv_paths", lambda p: F.contains(p, F.lit("\\")) | F.startswith(p, F.lit("/")) | F.contains(p, F.lit(".."))), "error", "path is not relative"),
            rule(F.size("relevant_tables") == 0, "warning", "no table"), rule(F.trim(F.coalesce("query", F.lit(""))) == "", "warning", "no query"),
        )
    )
    out = items.withColumn("_rules", rules).select("id", F.explode("_rules").alias("r")).select("id", "r.level", "r.message")
    if expected is not None:
        missing = expected.select("id").join(items.select("id"), "id", "left_anti").select("id", F.lit("error").alias("level"), F.lit("id is not answered").alias("message"))
        extra = items.select("id").distinct().join(expected.select("id"), "id", "left_anti").select("id", F.lit("error").alias("level"), F.lit("id was not asked").alias("message"))
        out = out.unionByName(missing).unionByName(extra)
    return out


def upsert(old: DataFrame, new: DataFrame, key: str = "table_ref") -> DataFrame:
    """New rows win, untouched ones stay; an anti join, so the old table is read once."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def integrity(manifest: DataFrame, files: DataFrame, key: str = "table_ref", max_orphans: float = 0.05) -> DataFrame:
    """One row: counts of entries, files, missing, orphans and repeated keys; ok if none is missing or repeated and orphans are few."""
    m, f = manifest.groupBy(key).agg(F.count("*").alias("m")), files.select(key).distinct().withColumn("f", F.lit(1))
    both = m.join(f, key, "full_outer")
    out = both.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("entries"), F.count("f").alias("files"), F.count_if(F.col("f").isNull()).alias("missing"), F.count_if(F.col("m").isNull()).alias("orphans"), F.count_if(F.col("m") > 1).alias("repeated"))
    return out.withColumn("ok", (F.col("missing") == 0) & (F.col("repeated") == 0) & (F.col("orphans") <= max_orphans * F.col("files")))


def ambiguous(facts: DataFrame, by: list[str] | tuple[str, ...] = ("item", "year", "period")) -> DataFrame:
    """(item, year, period) with more than one value; null keys group together."""
    return facts.groupBy(*by).agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")
