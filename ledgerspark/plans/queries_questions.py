"""Queries that start from the text of questions, one for each kind of answer, against plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.operators import retrieve
from ledgerspark.plans import answer, synth
from ledgerspark.plans.queries import RUN, SQL, t

#: Figures of a nation and year: net revenue and profit from its orders, as facts of a company with a code of three letters.
_POINTS = """WITH o AS (SELECT c_nationkey AS k, year(o_orderdate)::INT AS y, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE AS r, sum(round(o_totalprice * 100)::BIGINT) FILTER (o_orderstatus <> 'O')::DOUBLE AS p FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
v AS (SELECT k, y, r, coalesce(p, 0)::DOUBLE AS p FROM o)"""


def code(key: Column) -> Column:
    return F.concat(F.lit("N"), F.char(65 + F.floor(key / 5)), F.char(65 + key % 5))


def nation_facts(spark: SparkSession, sf: str) -> DataFrame:
    """A table a nation and year with two rows; orders and customers are read once, however often the facts are."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    sums = t(spark, sf, "orders").join(t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").groupBy("c_nationkey", F.year("o_orderdate").alias("year"))
    sums = sums.agg(F.sum(cents).cast("double").alias("r"), F.coalesce(F.sum(F.when(F.col("o_orderstatus") != "O", cents)), F.lit(0)).cast("double").alias("p"))
    line = lambda item, metric, value, i: F.struct(F.lit(item).alias("item"), F.lit(metric).alias("metric"), F.col(value).alias("value"), F.lit(i).alias("row_idx"))
    ticker = code(F.col("c_nationkey"))
    rows = sums.select(ticker.alias("ticker"), "year", F.explode(F.array(line("Doanh thu thuần", "net_revenue", "r", 0), line("Lợi nhuận sau thuế", "profit_after_tax", "p", 1))).alias("x"))
    facts = rows.select("ticker", "year", "x.*", F.lit("annual").alias("period"), F.lit("").alias("column_label"), F.concat("ticker", F.lit("_"), F.col("year").cast("string"), F.lit("|1")).alias("table_ref"))
    return synth.kept(facts, "facts")


def ask(spark: SparkSession, sf: str, text: Column) -> DataFrame:
    """id, kind and value of one question a nation: text of its code, and of the codes of the next nations, as a, b, c."""
    n = t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), *[code((F.col("n_nationkey") + i) % 25).alias(x) for i, x in enumerate("abc")])
    q = retrieve.analyze(n.select("id", text.alias("question")))
    facts = nation_facts(spark, sf)
    chosen = q.select(F.col("id").alias("question_id"), F.explode("tickers").alias("ticker")).join(facts.select("ticker", "table_ref").distinct(), "ticker").select("question_id", "table_ref", F.lit(1).alias("place"))
    return answer.answer_all(q, chosen, facts).select("id", "kind", F.round("value", 6).alias("value"))


def said(template: str) -> Column:
    """A question with {a}, {b} and {c} for the codes."""
    return F.format_string(template.replace("%", "%%").replace("{a}", "%1$s").replace("{b}", "%2$s").replace("{c}", "%3$s"), "a", "b", "c")


def question(name: str, template: str, kind: str, body: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return ask(spark, sf, said(template))

    run.__name__ = name
    runs: dict[str, Callable[[SparkSession, str], DataFrame]] = RUN
    runs[name] = run
    SQL[name] = f"{_POINTS}, n AS (SELECT n_nationkey::BIGINT AS id, (n_nationkey + 1) % 25 AS k1, (n_nationkey + 2) % 25 AS k2 FROM nation) SELECT id, '{kind}' AS kind, round(({body}), 6)::DOUBLE AS value FROM n"


_THREE, _ONE = "v WHERE v.k IN (n.id, n.k1, n.k2)", "v WHERE v.k = n.id"
question("ask_select", "Doanh thu thuần của ({a}) năm 1998 là bao nhiêu đồng?", "select", f"SELECT any_value(r) FROM {_ONE} AND y = 1998")
question("ask_sum_companies", "Tổng doanh thu thuần của ({a}), ({b}) và ({c}) năm 1998 là bao nhiêu?", "sum", f"SELECT sum(r) FROM {_THREE} AND y = 1998")
question("ask_sum_years", "Tổng lợi nhuận sau thuế của ({a}) từ 1996 đến 1999 là bao nhiêu?", "sum", f"SELECT sum(p) FROM {_ONE} AND y BETWEEN 1996 AND 1999")
question("ask_mean", "Doanh thu thuần trung bình của ({a}), ({b}) và ({c}) năm 1997?", "mean", f"SELECT avg(r) FROM {_THREE} AND y = 1997")
question("ask_median", "Trung vị doanh thu thuần của ({a}), ({b}) và ({c}) năm 1997 là bao nhiêu?", "median", f"SELECT median(r) FROM {_THREE} AND y = 1997")
question("ask_max", "Doanh thu thuần cao nhất trong các năm 1996 đến 1999 của ({a}) là bao nhiêu?", "max", f"SELECT max(r) FROM {_ONE} AND y BETWEEN 1996 AND 1999")
question("ask_min", "Lợi nhuận sau thuế thấp nhất trong nhóm ({a}), ({b}), ({c}) năm 1999?", "min", f"SELECT min(p) FROM {_THREE} AND y = 1999")
question("ask_difference", "Chênh lệch doanh thu thuần giữa ({a}) và ({b}) năm 1998 là bao nhiêu?", "difference", "SELECT max(r) - min(r) FROM v WHERE v.k IN (n.id, n.k1) AND y = 1998")
question("ask_growth", "Tốc độ tăng trưởng doanh thu thuần năm 1998 của ({a}) là bao nhiêu %?", "growth", f"SELECT (max(r) FILTER (y = 1998) - max(r) FILTER (y = 1997)) / abs(max(r) FILTER (y = 1997)) * 100 FROM {_ONE} AND y IN (1997, 1998) HAVING count(*) = 2")
question("ask_growth_years", "Doanh thu thuần của ({a}) và ({b}) tăng bao nhiêu phần trăm từ 1996 đến 1999?", "growth", "SELECT (sum(r) FILTER (y = 1999) - sum(r) FILTER (y = 1996)) / abs(sum(r) FILTER (y = 1996)) * 100 FROM v WHERE v.k IN (n.id, n.k1) AND y IN (1996, 1999) HAVING count(*) = 4")
question("ask_cagr", "CAGR doanh thu thuần của ({a}) giai đoạn 1996-1999 là bao nhiêu?", "cagr", f"SELECT (pow(max(r) FILTER (y = 1999) / max(r) FILTER (y = 1996), 1.0 / 3) - 1) * 100 FROM {_ONE} AND y IN (1996, 1999) HAVING count(*) = 2")
question("ask_share", "Tỷ trọng doanh thu thuần của các công ty trên trung vị trong nhóm ({a}), ({b}), ({c}) năm 1998?", "share_above_median", f"WITH w AS (SELECT r, (SELECT median(r) FROM {_THREE} AND y = 1998) AS mid FROM {_THREE} AND y = 1998) SELECT sum(r) FILTER (r > mid) / sum(r) * 100 FROM w")
question("ask_ratio", "Biên lợi nhuận ròng của ({a}) năm 1997 là bao nhiêu %?", "select", f"SELECT any_value(p / r * 100) FROM {_ONE} AND y = 1997")
question("ask_ratio_mean", "Net margin bình quân của ({a}), ({b}) và ({c}) năm 1997 là bao nhiêu %?", "mean", f"SELECT avg(p / r * 100) FROM {_THREE} AND y = 1997")
