"""Queries that hold the engine's operators against plain SQL on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions import numbers, periods, terms, text, units
from ledgerspark.operators import evaluate, extract, retrieve, standardize
from ledgerspark.plans import answer, cards, synth
from ledgerspark.streaming import incremental

SQL: dict[str, str] = {}
RUN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(sql: str | None = None):
    def put(f):
        RUN[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def plain_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^0-9a-z]+"), lambda x: x != "")


def order_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts from rendered reports, through the whole extraction; orders are read once, however often the facts are."""
    docs = synth.kept(synth.reports(t(spark, sf, "orders")), "reports")
    tables = extract.extract_tables(docs).join(docs.select("doc_id", "fallback_year"), "doc_id").withColumn("ticker", F.substring("doc_id", 1, 3))
    return synth.kept(standardize.to_facts(tables), "facts")


_TOTALS = "SELECT year(o_orderdate) AS y, o_orderpriority AS p, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY 1, 2"


@query(f"""WITH a AS ({_TOTALS})
SELECT y::INT AS year, 'closing' AS period, p AS item, round(cents / 100.0, 2)::DOUBLE AS value, '31/12/' || y AS source_date, 'income_statement' AS section, 'ABC_' || y || '|1' AS table_ref FROM a
UNION ALL SELECT b.y::INT, 'opening', b.p, round(b.cents / 100.0, 2)::DOUBLE, '01/01/' || (b.y + 1), 'income_statement', 'ABC_' || (b.y + 1) || '|1' FROM a AS b SEMI JOIN a AS n ON n.y = b.y + 1 AND n.p = b.p""")
def report_roundtrip_facts(spark, sf):
    return order_facts(spark, sf).select("year", "period", "item", F.round("value", 2).alias("value"), "source_date", "section", "table_ref")


@query(f"""WITH a AS ({_TOTALS}), b AS (SELECT y, sum(cents) / 100.0 AS v FROM a GROUP BY y), c AS (SELECT y, v, lag(v) OVER (ORDER BY y) AS w FROM b)
SELECT y::INT AS year, round(v, 2)::DOUBLE AS value, round((v - w) / abs(w) * 100, 6)::DOUBLE AS growth FROM c""")
def growth_yoy(spark, sf):
    p = order_facts(spark, sf).where("period = 'closing'").groupBy("year").agg(F.sum("value").alias("value")).withColumn("k", F.lit(1))
    return answer.growth_by_year(p, ["k"]).select("year", F.round("value", 2).alias("value"), F.round("growth", 6).alias("growth"))


@query(f"""WITH a AS ({_TOTALS}), b AS (SELECT y, sum(cents) / 100.0 AS v FROM a GROUP BY y)
SELECT round((pow(max_by(v, y) / min_by(v, y), 1.0 / (max(y) - min(y))) - 1) * 100, 2)::DOUBLE AS value FROM b""")
def cagr(spark, sf):
    return order_facts(spark, sf).where("period = 'closing'").groupBy("year").agg(F.sum("value").alias("v")).agg(F.round(terms.cagr(F.min_by("v", "year"), F.max_by("v", "year"), F.max("year") - F.min("year")), 2).alias("value"))


@query("""WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(strip_accents(regexp_replace(text, 'đ', 'd', 'g'))), '[^0-9a-z]+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS term FROM d) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM e GROUP BY term""")
def fold_tokenize_df(spark, sf):
    return retrieve.term_counts(t(spark, sf, "documents"), "text", lambda c: text.tokenize(c, False))


@query("""WITH d AS (SELECT doc_id AS ref, list_filter(string_split_regex(lower(text), '[^0-9a-z]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d), e AS (SELECT ref, len(w) AS l, unnest(w) AS term FROM d), p AS (SELECT term, ref, any_value(l) AS l, count(*) AS tf FROM e GROUP BY term, ref),
i AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, s GROUP BY term),
q AS (SELECT item_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^0-9a-z]+'), lambda x: x <> ''))) AS term FROM benchmark),
r AS (SELECT item_id AS query_id, ref, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean))) AS score FROM q JOIN p USING (term) JOIN i USING (term), s GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, ref) AS rank FROM r)
SELECT query_id, ref, round(score, 4)::DOUBLE AS score, rank::INT AS rank FROM k WHERE rank <= 10""")
def bm25_topk(spark, sf):
    asked = retrieve.query_terms(t(spark, sf, "benchmark"), "item_id", "text", plain_tokens)
    index = retrieve.build_bm25(t(spark, sf, "documents"), "doc_id", "text", plain_tokens, asked)
    return retrieve.bm25_search(index, t(spark, sf, "benchmark"), "item_id", "text", 10, plain_tokens).select("query_id", "ref", F.round("score", 4).alias("score"), "rank")


def _vectors(spark, sf):
    e = t(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("ref"), "embedding"), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


_KNN = """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS ref, round({f}(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)::DOUBLE AS score FROM embeddings AS a, embeddings AS b WHERE a.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {d}, ref) AS rank FROM s) SELECT query_id, ref, {c} AS score, rank::INT AS rank FROM k WHERE rank <= 10"""


@query(_KNN.format(f="list_dot_product", d="DESC", c="score"))
def knn_topk_ip(spark, sf):
    return retrieve.knn(*_vectors(spark, sf), 10).select("query_id", "ref", "score", "rank")


@query(_KNN.format(f="list_distance", d="ASC", c="0 - score"))
def knn_topk_l2(spark, sf):
    return retrieve.knn(*_vectors(spark, sf), 10, "l2").select("query_id", "ref", (F.lit(0.0) + F.col("score")).alias("score"), "rank")


@query("""WITH a AS (SELECT o_custkey AS q, o_orderkey AS ref, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders),
b AS (SELECT o_custkey AS q, o_orderkey AS ref, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders)
SELECT q AS query_id, ref, round(coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0), 9)::DOUBLE AS score FROM (SELECT * FROM a WHERE r <= 5) AS a FULL OUTER JOIN (SELECT * FROM b WHERE r <= 5) AS b USING (q, ref)""")
def rrf_fusion(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("ref"), "o_totalprice", "o_orderdate")
    lists = [retrieve.top_k(o, "query_id", 5, F.col(c).desc(), F.col("ref")) for c in ("o_totalprice", "o_orderdate")]
    return retrieve.rrf(*lists).select("query_id", "ref", F.round("score", 9).alias("score"))


@query("""WITH q AS (SELECT c_custkey AS question_id, c_nationkey::VARCHAR AS ticker, 1992 + (c_custkey % 8)::INT AS year, c_mktsegment AS rt FROM customer),
s AS (SELECT s_suppkey AS ref, s_nationkey::VARCHAR AS ticker, 1992 + (s_suppkey % 8)::INT AS year, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS rt FROM supplier),
j AS (SELECT question_id, ref::VARCHAR AS table_ref, CASE WHEN q.rt = s.rt AND s.year = q.year THEN 1 WHEN q.rt = s.rt AND s.year BETWEEN q.year AND q.year + 2 THEN 2 WHEN s.year = q.year THEN 3 WHEN s.year BETWEEN q.year AND q.year + 2 THEN 4 ELSE 5 END AS level FROM q JOIN s USING (ticker))
SELECT question_id, table_ref, level FROM j QUALIFY level = min(level) OVER (PARTITION BY question_id)""")
def filter_ladder(spark, sf):
    year = lambda c: (1992 + F.col(c) % 8).cast("int")
    q = t(spark, sf, "customer").select(F.col("c_custkey").alias("question_id"), F.col("c_nationkey").cast("string").alias("ticker"), year("c_custkey").alias("year"), F.col("c_mktsegment").alias("report_type"))
    s = t(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("table_ref"), F.col("s_nationkey").cast("string").alias("ticker"), year("s_suppkey").alias("year"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("report_type"))
    return retrieve.filter_ladder(q, s)


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS value FROM lineitem")
def format_parse_roundtrip(spark, sf):
    cell = synth.vn_number(F.round(F.col("l_extendedprice") * 100).cast("long"))
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", cell.alias("cell"))
    return numbers.with_number(rows, "value", F.col("cell")).drop("cell")


@query("""SELECT o_orderkey, i + 1 AS part, (floor(o_totalprice) + i * 1000)::DOUBLE AS value FROM orders, (SELECT unnest([0, 1, 2]) AS i) WHERE o_totalprice >= 1000""")
def rowspan_roundtrip(spark, sf):
    whole = F.floor("o_totalprice")
    glued = F.concat(*[synth.grouped(whole + 1000 * i) for i in range(3)])
    cell = F.concat(F.lit("<table><tr><td rowspan=3>"), F.col("o_orderkey").cast("string"), F.lit("</td><td rowspan=\"3\">"), glued, F.lit("</td></tr><tr></tr><tr></tr></table>"))
    docs = t(spark, sf, "orders").where("o_totalprice >= 1000").select(F.col("o_orderkey").cast("string").alias("doc_id"), cell.alias("text"))
    rows = docs.select("doc_id", F.explode(extract.find_tables("text")).alias("tab")).select("doc_id", F.posexplode("tab.rows").alias("i", "row"))
    cells = rows.select(F.col("doc_id").cast("long").alias("o_orderkey"), (F.col("i") + 1).alias("part"), F.get("row", F.lit(1)).alias("cell"))
    return numbers.with_number(cells, "value", F.col("cell")).drop("cell")


@query("""WITH m AS (SELECT user_id, ts, max(event_id) AS mark FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT e.event_id, m.mark FROM events AS e ASOF LEFT JOIN m ON e.user_id = m.user_id AND e.ts >= m.ts WHERE e.event_type <> 'view'""")
def page_asof(spark, sf):
    e = t(spark, sf, "events")
    marks = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("mark"))
    others = e.where("event_type <> 'view'").select("user_id", "ts", "event_id")
    return extract.page_asof(marks, others, "user_id", "ts", "mark").select("event_id", "mark")


@query("""SELECT l_shipmode_item AS item, year, l_returnflag AS period, count(DISTINCT l_quantity) AS n_values FROM (SELECT l_partkey::VARCHAR AS l_shipmode_item, year(l_shipdate)::INT AS year, l_returnflag, l_quantity FROM lineitem) GROUP BY 1, 2, 3 HAVING count(DISTINCT l_quantity) > 1""")
def ambiguity_groups(spark, sf):
    return evaluate.ambiguous(t(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("item"), F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("period"), F.col("l_quantity").alias("value")))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'total_assets' WHEN 1 THEN 'profit_after_tax' WHEN 2 THEN 'equity' WHEN 3 THEN 'net_revenue' END AS metric, CASE WHEN p_partkey % 5 = 4 THEN 0 WHEN p_partkey % 5 = 3 THEN 2 ELSE 1 END AS n FROM part""")
def term_tagging(spark, sf):
    words = F.array(*map(F.lit, ("Tổng tài sản", "LỢI NHUẬN SAU THUẾ", "Vốn chủ sở hữu", "doanh thu  thuần và giá vốn hàng bán", "khác")))
    item = F.concat(F.upper("p_type"), F.lit(" - "), F.get(words, (F.col("p_partkey") % 5).cast("int")))
    return t(spark, sf, "part").select("p_partkey", terms.map_one(item).alias("metric"), F.size(terms.metrics(item)).alias("n"))


_RATIO = "SELECT year(l_shipdate)::INT AS year, sum((l_extendedprice * 100)::BIGINT) / 100.0 AS a, sum(l_quantity) AS b FROM lineitem GROUP BY 1"


@query(f"SELECT year, round(a / b * 100.0, 4)::DOUBLE AS roe FROM ({_RATIO})")
def ratio_formula(spark, sf):
    p = t(spark, sf, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / 100).alias("profit_after_tax"), F.sum("l_quantity").alias("equity"))
    return p.select("year", F.round(terms.ratio("roe", F.col), 4).alias("roe"))


@query("""WITH p AS (SELECT o_custkey, sum((o_totalprice * 100)::BIGINT)::DOUBLE AS v FROM orders GROUP BY 1), m AS (SELECT median(v) AS mid FROM p)
SELECT round(sum(CASE WHEN v > mid THEN v END) / sum(v) * 100, 2)::DOUBLE AS value, count(*) AS n FROM p, m""")
def median_share(spark, sf):
    facts = t(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("ticker")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double").alias("value"))
    facts = facts.withColumns({"year": F.lit(2000), "metric": F.lit("cash"), "period": F.lit("closing"), "table_ref": F.lit(""), "row_idx": F.lit(0), "column_label": F.lit(""), "item": F.lit("")})
    return answer.answer(facts, answer.Query(1, "share_above_median", metric="cash")).select("value", "n")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'ty_dong' WHEN 1 THEN 'trieu_dong' WHEN 2 THEN 'percent' ELSE 'none' END AS asked,
(round(o_totalprice)::BIGINT + CASE WHEN o_orderkey % 4 < 2 THEN 1 ELSE 0 END)::DOUBLE AS value FROM orders""")
def unit_convert(spark, sf):
    whole = F.round("o_totalprice").cast("long")
    kind = F.col("o_orderkey") % 4
    raw = F.when(kind == 0, (whole + 1) * 1_000_000_000).when(kind == 1, (whole + 1) * 1_000_000).otherwise(whole).cast("double")
    asks = F.array(*map(F.lit, ("Lợi nhuận là bao nhiêu tỷ đồng?", "Doanh thu bao nhiêu triệu đồng?", "Tăng bao nhiêu %?", "Doanh thu năm 2020?")))
    o = t(spark, sf, "orders").select("o_orderkey", raw.alias("raw"), units.asked_unit(F.get(asks, kind.cast("int"))).alias("asked"))
    return o.select("o_orderkey", "asked", units.convert(F.col("raw"), F.col("asked")).alias("value"))



@query("""WITH e AS (SELECT user_id, event_type, min(ts) AS f, row_number() OVER (PARTITION BY user_id ORDER BY min(ts), event_type) AS k FROM events GROUP BY user_id, event_type)
SELECT user_id, string_agg(event_type, ',' ORDER BY k) AS types FROM e WHERE k <= 3 GROUP BY user_id""")
def ordered_distinct(spark, sf):
    return t(spark, sf, "events").groupBy("user_id").agg(F.array_join(cards.first_distinct(F.col("event_type"), F.col("ts"), 3), ",").alias("types"))


@query("""SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'new' ELSE 'old' END AS state FROM documents AS d LEFT JOIN labels AS l USING (doc_id) UNION ALL SELECT doc_id, 'new' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def manifest_upsert(spark, sf):
    old = t(spark, sf, "documents").select("doc_id", F.lit("old").alias("state"))
    return evaluate.upsert(old, t(spark, sf, "labels").select("doc_id", F.lit("new").alias("state")), "doc_id")


@query("""SELECT *, missing = 0 AND repeated = 0 AND orphans <= 0.05 * files AS ok FROM (SELECT count(*) AS entries, (SELECT count(DISTINCT doc_id) FROM labels) AS files, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing,
(SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS orphans, (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)) AS repeated FROM documents)""")
def orphan_missing(spark, sf):
    return evaluate.integrity(t(spark, sf, "documents"), t(spark, sf, "labels"), "doc_id")


def _scored(spark, sf):
    docs, labels = t(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("n")), t(spark, sf, "labels")
    g = labels.select(F.col("doc_id").alias("id"), (F.col("quality") * 100.0).alias("answer"), F.array(F.concat(F.lit("d"), (F.col("doc_id") % 7).cast("string"))).alias("relevant_docs"), F.array(F.concat(F.lit("t"), (F.col("doc_id") % 5).cast("string")), F.lit("t9")).alias("relevant_tables"))
    text_ = lambda m, p: F.concat(F.lit(p), (F.col("n") % m).cast("string"))
    p = docs.select(F.col("doc_id").alias("id"), F.when(F.col("n") % 3 > 0, F.when(F.col("n") % 3 == 1, 100.0).otherwise(0.0)).alias("answer"), F.array(text_(7, "d"), F.concat(F.lit("d"), (F.col("doc_id") % 3).cast("string"))).alias("relevant_docs"), F.array(text_(5, "t"), F.lit("t8"), F.lit("t9")).alias("relevant_tables"), F.when(F.col("n") % 4 > 0, "q").alias("query"))
    return evaluate.evaluate(g, p)


_EVAL = """WITH b AS (SELECT l.doc_id AS id, l.quality * 100.0 AS gold, CASE d.n_chars % 3 WHEN 1 THEN 100.0 WHEN 2 THEN 0.0 END AS pred, 'd' || (l.doc_id % 7) AS gd, ['t' || (l.doc_id % 5), 't9'] AS gt,
list_distinct(['d' || (d.n_chars % 7), 'd' || (l.doc_id % 3)]) AS pd, 'd' || (d.n_chars % 7) AS pd1, ['t' || (d.n_chars % 5), 't8', 't9'] AS pt, d.n_chars % 4 > 0 AS code FROM labels AS l JOIN documents AS d USING (doc_id)),
m AS (SELECT *, list_contains(pd, gd)::INT AS dh, len(list_intersect(pt, gt)) AS th FROM b),
r AS (SELECT id, dh::DOUBLE / len(pd) AS dp, dh::DOUBLE AS dr, th / 3.0 AS tp, th / 2.0 AS tr, CASE WHEN dh = 0 THEN 0 WHEN pd1 = gd THEN 1 ELSE 0.5 END AS dm, CASE WHEN list_contains(gt, pt[1]) THEN 1 ELSE 1 / 3.0 END AS tm,
coalesce(abs(pred - gold) <= greatest(0.000001, 0.01 * gold), false)::INT AS ans, (pred IS NOT NULL)::INT AS exe, code FROM m),
f AS (SELECT *, CASE WHEN dr = 0 THEN 0 ELSE 5 * dp * dr / (4 * dp + dr) END AS df, 5 * tp * tr / (4 * tp + tr) AS tf FROM r)
"""


@query(_EVAL + """SELECT count(*) AS n, round(avg(dp), 6)::DOUBLE AS doc_precision, round(avg(dr), 6)::DOUBLE AS doc_recall, round(avg(df), 6)::DOUBLE AS doc_f2, round(avg(tp), 6)::DOUBLE AS table_precision, round(avg(tr), 6)::DOUBLE AS table_recall, round(avg(tf), 6)::DOUBLE AS table_f2,
round(avg(dm), 6)::DOUBLE AS doc_mrr5, round(avg(tm), 6)::DOUBLE AS table_mrr5, round(avg(ans), 6)::DOUBLE AS answer_accuracy, round(avg(exe), 6)::DOUBLE AS execution_accuracy, round((avg(tf) + avg(ans) + avg(exe)) / 3, 6)::DOUBLE AS overall FROM f""")
def prf2_macro(spark, sf):
    m = evaluate.macro(_scored(spark, sf))
    return m.select("n", *[F.round(c, 6).alias(c) for c in m.columns if c != "n"])


@query(_EVAL + "SELECT id, round(dm, 6)::DOUBLE AS doc_mrr5, round(tm, 6)::DOUBLE AS table_mrr5 FROM f")
def mrr5(spark, sf):
    return _scored(spark, sf).select("id", F.round("doc_mrr5", 6).alias("doc_mrr5"), F.round("table_mrr5", 6).alias("table_mrr5"))


@query(_EVAL + "SELECT id, ans AS answer_accuracy FROM f")
def answer_accuracy(spark, sf):
    return _scored(spark, sf).select("id", "answer_accuracy")


@query(_EVAL + """, t AS (SELECT id, list_filter([CASE WHEN tr = 0 THEN 'TABLE_MISS' END, CASE WHEN dr = 0 THEN 'DOC_MISS' END, CASE WHEN tr > 0 AND tm < 1 THEN 'TABLE_BAD_RANK' END, CASE WHEN dr > 0 AND dm < 1 THEN 'DOC_BAD_RANK' END,
CASE WHEN NOT code THEN 'QUERY_NO_CODE' END, CASE WHEN code AND exe = 0 THEN 'EXECUTION_ERROR' END, CASE WHEN exe = 1 AND ans = 0 THEN 'ANSWER_MISMATCH' END], lambda x: x IS NOT NULL) AS tags FROM f),
u AS (SELECT unnest(CASE WHEN len(tags) = 0 THEN ['SUCCESS'] ELSE tags END) AS tag FROM t) SELECT tag, count(*) AS n FROM u GROUP BY tag""")
def failure_tags(spark, sf):
    return evaluate.tag_histogram(_scored(spark, sf))


@query(_EVAL + "SELECT count(*) AS asked, count(*) FILTER (dr > 0) AS doc_found, count(*) FILTER (tr > 0) AS table_found, count(*) FILTER (code) AS with_code, count(*) FILTER (exe = 1) AS executed, count(*) FILTER (ans = 1) AS \"right\" FROM f")
def funnel(spark, sf):
    return evaluate.funnel(_scored(spark, sf))


@query("""WITH i AS (SELECT conv_id AS id, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), r AS (
SELECT id, 'error' AS level, 'id is repeated' AS message FROM i WHERE n > 1 UNION ALL SELECT id, 'error', 'answer is not a finite number' FROM i WHERE turn % 3 = 0 UNION ALL SELECT id, 'error', 'document with .txt suffix' FROM i WHERE turn % 2 = 0
UNION ALL SELECT id, 'error', 'table without |' FROM i WHERE turn % 4 = 1 UNION ALL SELECT id, 'error', 'table position is not a number' FROM i WHERE turn % 4 = 2 UNION ALL SELECT id, 'error', 'path is not relative' FROM i WHERE turn = 1 UNION ALL SELECT id, 'warning', 'no query' FROM i)
SELECT level, message, count(*) AS n FROM r GROUP BY ALL""")
def submission_rules(spark, sf):
    c = t(spark, sf, "conversations")
    items = c.select(
        F.col("conv_id").alias("id"), F.when(F.col("turn") % 3 > 0, 1.5).alias("answer"), F.array(F.concat(F.lit("d"), F.when(F.col("turn") % 2 == 0, ".txt").otherwise(""))).alias("relevant_docs"),
        F.array(F.when(F.col("turn") % 4 == 1, "d").when(F.col("turn") % 4 == 2, "d|x").otherwise("d|1")).alias("relevant_tables"), F.array(F.when(F.col("turn") == 1, "/a.csv").otherwise("a.csv")).alias("csv_paths"), F.lit("").alias("query"),
    )
    return evaluate.check_submission(items).groupBy("level", "message").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN year(o_orderdate) WHEN o_orderkey % 3 = 1 THEN year(o_orderdate) - 1 ELSE year(o_orderdate) END::INT AS year, CASE o_orderkey % 3 WHEN 0 THEN 'closing' WHEN 1 THEN 'opening' ELSE 'annual' END AS period FROM orders")
def column_periods(spark, sf):
    y = F.year("o_orderdate")
    head = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Tại ngày 31.12."), y)).when(F.col("o_orderkey") % 3 == 1, F.lit("Số đầu năm")).otherwise(F.concat(F.lit("Năm "), y))
    return t(spark, sf, "orders").select("o_orderkey", periods.parse_period(head, y).alias("p")).select("o_orderkey", "p.year", "p.period")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4)::DOUBLE AS total FROM events GROUP BY ALL")
def event_windows(spark, sf):
    return incremental.windowed_counts(t(spark, sf, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4)::DOUBLE AS total FROM events GROUP BY ALL")
def event_windows_stream(spark, sf):
    """The same windows over a stream of the table's files, run to its end."""
    path = f"{synth.scratch(spark, 'stream')}/windows"
    events = incremental.table_stream(spark, f"{sf}/events.parquet")
    incremental.run(incremental.windowed_counts(events), f"{path}.checkpoint", lambda rows, _: rows.write.mode("overwrite").parquet(path), "complete").awaitTermination()
    return spark.read.parquet(path).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
