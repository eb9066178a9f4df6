"""Declarative queries over the facts: one pass of conditional aggregation, then unit conversion."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions import terms
from ledgerspark.functions.phrases import first_said, said, words
from ledgerspark.functions.text import let
from ledgerspark.functions.units import convert

KINDS = ("select", "sum", "mean", "median", "max", "min", "difference", "ratio", "growth", "cagr", "share_above_median")


@dataclass(frozen=True)
class Query:
    """What a question asks: kind over a metric or an item keyword, for tickers and years."""

    id: int
    kind: str = "select"
    metric: str | None = None
    keyword: str | None = None
    tickers: tuple[str, ...] = ()
    years: tuple[int, ...] = ()
    period: str | None = None
    unit: str = "none"
    sections: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"{self.kind} is none of {KINDS}")
        if self.kind == "ratio" and self.metric not in terms.FORMULAS:
            raise ValueError(f"no formula for {self.metric}")


def scope(facts: DataFrame, q: Query) -> DataFrame:
    """The facts a query may use; every condition reaches the scan."""
    f = facts
    if q.tickers:
        f = f.where(F.col("ticker").isin(*q.tickers))
    if q.years:
        f = f.where(F.col("year").between(min(q.years), max(q.years)) if q.kind in ("growth", "cagr") else F.col("year").isin(*q.years))
    if q.sections:
        f = f.where(F.col("section").isin(*q.sections))
    if q.keyword is not None:
        f = f.where(F.coalesce(F.contains(F.lower("item"), F.lower(F.lit(q.keyword))), F.lit(False)))
    if q.metric is not None and q.kind != "ratio":
        f = f.where(F.col("metric") == q.metric)
    return f


def points(facts: DataFrame, period: str | None) -> DataFrame:
    """One value for each ticker, metric and year: the asked period first, else closing, annual, any; then the first row."""
    asked = F.when(F.col("period") == F.lit(period), 0).when(F.col("period") == "closing", 1).when(F.col("period") == "annual", 2).when(F.col("period") == "unknown", 4).otherwise(3)
    best = F.min_by("value", F.struct(asked.alias("a"), "table_ref", "row_idx", "column_label"))
    return facts.groupBy("ticker", "year", "metric").agg(best.alias("value"))


def answer(facts: DataFrame, q: Query) -> DataFrame:
    """id, value (in the asked unit), n: one row a query; value is null where the facts hold nothing."""
    f = scope(facts, q)
    n = F.count("value").alias("n")
    if q.kind == "ratio":
        parts = [m for m in terms.FORMULAS[q.metric][:3] if m]
        p = points(f.where(F.col("metric").isin(*parts)), q.period)
        value = lambda m: F.avg(F.when(F.col("metric") == m, F.col("value")))
        out = p.agg(terms.ratio(q.metric, value).alias("raw"), n)
    elif q.kind in ("growth", "cagr"):
        p = points(f, q.period).groupBy("year").agg(F.sum("value").alias("value"))
        first, last, years = F.min_by("value", "year"), F.max_by("value", "year"), F.max("year") - F.min("year")
        out = p.agg((terms.growth(last, first) if q.kind == "growth" else terms.cagr(first, last, years)).alias("raw"), n)
    elif q.kind == "share_above_median":
        p = points(f, q.period).crossJoin(F.broadcast(points(f, q.period).agg(F.median("value").alias("mid"))))
        out = p.agg((F.try_divide(F.sum(F.when(F.col("value") > F.col("mid"), F.col("value"))), F.sum("value")) * 100).alias("raw"), n)
    else:
        p = points(f, q.period)
        agg: dict[str, Column] = {"select": F.min_by("value", F.struct("ticker", -F.col("year"))), "sum": F.sum("value"), "mean": F.avg("value"), "difference": F.max("value") - F.min("value"), "median": F.median("value"), "max": F.max("value"), "min": F.min("value")}
        out = p.agg(agg[q.kind].alias("raw"), n)
    return out.select(F.lit(q.id).alias("id"), convert(F.col("raw"), F.lit(q.unit)).alias("value"), "n")


def relaxed(facts: DataFrame, q: Query) -> DataFrame:
    """answer(), and where that finds nothing the same without the period, then without the year, then with a shorter keyword; the first that finds wins."""
    tries = [q]
    if q.period:
        tries.append(replace(q, period=None))
    if q.years:
        tries.append(replace(q, period=None, years=()))
    if q.keyword and " " in q.keyword:
        tries.append(replace(q, period=None, years=(), keyword=q.keyword.rsplit(" ", 1)[0]))
    out = None
    for i, t in enumerate(tries):
        row = answer(facts, t).withColumn("tries", F.lit(i + 1))
        out = row if out is None else out.unionByName(row)
    return out.where("value is not null").withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("tries"))).where("_k = 1").drop("_k")


def growth_by_year(points_: DataFrame, part: list[str]) -> DataFrame:
    before = F.lag("value").over(Window.partitionBy(*part).orderBy("year"))
    return points_.withColumn("growth", terms.growth(F.col("value"), before))


def check_sql(spark, text: str) -> None:
    """Lets a single SELECT through; anything that writes or sets is refused before it runs."""
    import re

    if not re.match(r"(?is)\s*(select|with)\b", text) or ";" in text.strip().rstrip(";"):
        raise ValueError("only one SELECT is allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text).toString()
    if re.search(r"InsertInto|CreateTable|DropTable|SetCommand|Delete|Update|Merge", plan):
        raise ValueError("the statement changes something")
    called = {f.lower() for f in re.findall(r"(?i)\b(\w+)\s*\(", text)}
    if called & {"reflect", "try_reflect", "java_method", "read_files", "http_request", "input_file_name", "current_user", "session_user"}:
        raise ValueError("the statement calls a function that reaches outside its tables")


#: Phrases that tell what is computed from the figures of a question, in the order in which they decide.
KIND_PHRASES = (
    ("share_above_median", ("tren trung vi", "cao hon trung vi", "lon hon trung vi", "vuot trung vi")),
    ("cagr", ("cagr", "tang truong kep", "tang truong binh quan")),
    ("growth", ("tang truong", "toc do tang", *(f"{verb} bao nhieu {share}" for verb in ("tang", "giam") for share in ("%", "phan tram")))),
    ("median", ("trung vi",)),
    ("mean", ("trung binh", "binh quan")),
    ("max", ("cao nhat", "lon nhat", "nhieu nhat")),
    ("min", ("thap nhat", "nho nhat", "it nhat")),
    ("difference", ("chenh lech", "hon kem", *(f"{more} hon ... bao nhieu" for more in ("cao", "thap", "nhieu", "it", "lon", "nho")))),
)


def kind_of(question: Column, found: Column) -> Column:
    """The kind of answer that a question asks for; found: its terms, as terms.find_terms gives them.

    Wordings of metrics are taken out first, so the "total" of total assets asks
    for no sum. Without any phrase a single figure is selected.
    """

    def kind(flat: Column) -> Column:
        bare = F.aggregate(F.transform(F.coalesce(found, F.array().cast("array<struct<at:int,surface:string,metric:string,derived:boolean>>")), lambda t: F.when(t["metric"].isin("growth", "cagr"), "").otherwise(t["surface"])), flat, lambda acc, surface: F.when(surface == "", acc).otherwise(F.replace(acc, surface, F.lit("_"))))
        return let(bare, lambda b: F.coalesce(first_said(b, KIND_PHRASES), F.when(said(b, ["tong", "cong lai"]), F.lit("sum")), F.lit("select")))

    return let(words(question), kind)


def _values(kind: Column) -> Column:
    """A question's answer from its points (ticker, year, value, order), as an aggregate: all kinds are taken, the asked one is kept."""
    p = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("year", "ticker", "value"))))
    points = F.transform(p, lambda x: x["value"])
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    middle = F.median("value")
    by_year = lambda at: let(F.get(p, at)["year"], lambda y: total(F.transform(F.filter(p, lambda x: x["year"] == y), lambda x: x["value"])))
    first, last, span = by_year(F.lit(0)), by_year(F.size(p) - 1), F.max("year") - F.min("year")
    share = let(middle, lambda m: F.try_divide(total(F.filter(points, lambda x: x > m)), total(points)) * 100)
    return (
        F.when(kind == "sum", F.sum("value")).when(kind == "mean", F.avg("value")).when(kind == "median", middle).when(kind == "max", F.max("value")).when(kind == "min", F.min("value"))
        .when(kind == "difference", F.max("value") - F.min("value")).when(kind == "growth", F.when(span > 0, terms.growth(last, first))).when(kind == "cagr", terms.cagr(first, last, span)).when(kind == "share_above_median", share)
        .otherwise(F.min_by("value", "order"))
    )


def answer_all(questions: DataFrame, chosen: DataFrame, facts: DataFrame) -> DataFrame:
    """Every question over its chosen tables in one plan: id, kind, value (base currency), query.

    questions (id, question, years, tickers, metrics, requested_period), as
    retrieve.analyze gives them; chosen (question_id, table_ref, place). A
    question has one point for each company and year that it names (each that
    its tables hold, where it names none; growth over one year takes the year
    before too): the ratio of FORMULAS that it names, else its first metric,
    else the item whose words match best. kind_of() says what is computed from
    the points. A single figure that no year fits is taken from another year.
    Questions without a point have a null value.

    Facts join on table_ref alone. Points are minima, combined before their
    shuffle; what is gathered in one row are the points of one question.
    """
    from ledgerspark.plans.context import anchor_score

    q = questions.select(F.col("id").alias("question_id"), "question", "years", "tickers", "metrics", "requested_period").withColumn("_found", terms.find_terms(F.col("question")))
    q = q.withColumn("kind", kind_of(F.col("question"), F.col("_found"))).drop("_found")
    plain = F.filter("metrics", lambda m: ~m.isin(*terms.DERIVED))
    named = F.get(F.array_intersect("metrics", F.array(*map(F.lit, terms.FORMULAS))), F.lit(0))
    q = q.withColumns({"_ratio": named, "_metric": F.get(plain, F.lit(0)), "_asked": F.when((F.col("kind") == "growth") & (F.size("years") == 1), F.array(F.get("years", F.lit(0)) - 1, F.get("years", F.lit(0)))).otherwise(F.col("years"))})
    f = facts.where("value is not null").select("table_ref", "ticker", "year", "period", "item", "metric", "row_idx", "column_label", "value")
    pool = chosen.select("question_id", "table_ref", "place").join(q, "question_id").join(f, "table_ref")
    fits = (F.size("tickers") == 0) | F.array_contains("tickers", F.col("ticker"))
    in_year = (F.size("_asked") == 0) | F.coalesce(F.array_contains("_asked", F.col("year")), F.lit(False))
    rank = F.when(F.col("period") == F.col("requested_period"), 0).when(F.col("period") == "closing", 1).when(F.col("period") == "annual", 2).when(F.col("period") == "unknown", 4).otherwise(3)
    pool = pool.where(F.coalesce(fits, F.lit(False))).withColumns({"_off": F.when(in_year, 0).otherwise(1), "_rank": rank}).where("_off = 0 or kind = 'select'")
    order = F.struct("_off", "_rank", "place", "row_idx", "column_label", "table_ref")
    point = ["question_id", "ticker", "year"]
    carried = [F.first(c).alias(c) for c in ("kind", "_ratio", "_metric", "tickers", "_off")]

    parts = sorted({m for top, less, below, _ in terms.FORMULAS.values() for m in (top, less, below) if m})
    wanted = F.when(F.col("_ratio").isNotNull(), F.col("metric").isin(parts)).otherwise(F.col("metric") == F.col("_metric"))
    by_metric = pool.where(F.coalesce(wanted, F.lit(False))).groupBy(*point, "metric").agg(*carried, F.min_by("value", order).alias("value"), F.min(order).alias("o"))
    wide = by_metric.groupBy(*point).agg(*carried, F.min("o").alias("o"), F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    ratio = F.coalesce(*[F.when(F.col("_ratio") == r, terms.ratio(r, lambda m: F.try_element_at("m", F.lit(m)))) for r in terms.FORMULAS])
    of_metric = wide.select(*point, "kind", "_ratio", "_metric", "tickers", "_off", "o", F.when(F.col("_ratio").isNotNull(), ratio).otherwise(F.try_element_at("m", F.col("_metric"))).alias("value"))

    score = F.coalesce(F.round(anchor_score(F.col("question"), F.col("item")), 6), F.lit(-1.0)) + F.when(F.array_contains("metrics", F.col("metric")), 4).otherwise(0)
    matched = pool.where(F.col("_ratio").isNull() & (F.col("_metric").isNull() | (F.col("kind") == "select"))).withColumn("_score", score).where("_score > 0")
    best_first = F.struct((-F.col("_score")).alias("s"), "_off", "_rank", "place", "row_idx", "column_label", "table_ref")
    single = matched.where("kind = 'select'").groupBy("question_id").agg(F.min_by(F.struct("value", "table_ref", "item", "year", "period"), best_first).alias("b"))
    of_item = matched.where("kind <> 'select'").groupBy(*point).agg(*carried, F.min(order).alias("o"), F.min_by("value", best_first).alias("value"))

    place = F.array_position("tickers", F.col("ticker"))
    points = of_metric.unionByName(of_item.select(*of_metric.columns)).where("kind <> 'select' or _ratio is not null").withColumn("order", F.struct("_off", F.when(place == 0, 99).otherwise(place).alias("t"), (-F.col("year")).alias("y"), "o"))
    many = points.groupBy("question_id", "kind").agg(_values(F.col("kind")).alias("value"), F.first(F.coalesce("_ratio", "_metric", F.lit("the item that matches best"))).alias("of"), F.array_sort(F.collect_set(F.concat_ws(" ", "ticker", F.col("year").cast("string")))).alias("points"))

    quoted = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    text = F.concat(
        F.lit("SELECT value AS result FROM all_df WHERE table_ref = "), quoted(F.col("b.table_ref")), F.lit(" AND item = "), quoted(F.col("b.item")),
        F.coalesce(F.concat(F.lit(" AND year = "), F.col("b.year")), F.lit("")), F.coalesce(F.concat(F.lit(" AND period = "), quoted(F.col("b.period"))), F.lit("")),
    )
    said_ = F.concat(F.lit("-- "), "_k", F.lit(" of "), "of", F.lit(" over "), F.array_join("points", ", "))
    both = q.select("question_id", "kind").join(single, "question_id", "left").join(many.select("question_id", F.col("kind").alias("_k"), "value", "of", "points"), "question_id", "left")
    return both.select(F.col("question_id").alias("id"), "kind", F.when(F.col("of").isNotNull(), F.col("value")).otherwise(F.col("b.value")).alias("value"), F.when(F.col("of").isNotNull(), said_).otherwise(text).alias("query"))
