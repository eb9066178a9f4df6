"""Queries that hold sources, sinks, extraction, wordings and answering against plain SQL, a few rows of each driver table at a time."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.functions import numbers, periods, text, units
from ledgerspark.operators import evaluate, extract, retrieve, select, standardize
from ledgerspark.plans import answer, cards, context, sandbox, stages, submit, synth
from ledgerspark.plans.queries import plain_tokens, query, t
from ledgerspark.plans.queries_questions import _POINTS, code, nation_facts
from ledgerspark.sources import corpus, files
from ledgerspark.sources.paths import Output

#: The code of a nation in SQL.
_CODE = "('N' || chr(65 + (n_nationkey // 5)::INT) || chr(65 + (n_nationkey % 5)::INT))"


def among(values: tuple[str, ...], key: Column) -> Column:
    """One of the values by the key's remainder."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(key, F.lit(len(values))).cast("int"))


def _list(values: tuple[object, ...]) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values) + "]"


# --- sources ---------------------------------------------------------------------------------------------------


def _tree(spark: SparkSession, sf: str) -> str:
    """A folder of reports: odd nations as bytes of Latin-1 in one folder, even ones by company and year."""
    n = t(spark, sf, "nation").select("n_nationkey", code(F.col("n_nationkey")).alias("code"), "n_name").collect()
    found = {}
    for k, c, name in n:
        body = f"Báo cáo\n{name}" if k % 2 == 0 else f"caf\xe9\n\n{name}"
        path = f"{c}/{2000 + k}/{c}_{1990 + k}_Hop_nhat_extracted.txt" if k % 2 == 0 else f"misc/{c.lower()}-1999-rieng-le-{2000 + k}.txt"
        found[path] = body.encode("utf-8" if k % 2 == 0 else "latin-1")
    return synth.put_files(spark, "reports", found)


_TREE = f"""SELECT CASE WHEN n_nationkey % 2 = 0 THEN {_CODE} || '_' || (1990 + n_nationkey) || '_Hop_nhat' ELSE lower({_CODE}) || '-1999-rieng-le-' || (2000 + n_nationkey) END AS doc_id, {_CODE} AS ticker, (2000 + n_nationkey)::INT AS year,
CASE WHEN n_nationkey % 2 = 0 THEN 'consolidated' ELSE 'separate' END AS report_type, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 3 END::INT AS n_lines, CASE WHEN n_nationkey % 2 = 0 THEN 'Báo cáo' || chr(10) ELSE 'café' || chr(10) || chr(10) END || n_name AS text, CASE WHEN n_nationkey % 2 = 0 THEN {_CODE} ELSE 'misc' END AS folder FROM nation"""


@query(f"SELECT doc_id, ticker, year, report_type, n_lines, text FROM ({_TREE})")
def report_tree(spark, sf):
    return corpus.read_reports(spark, _tree(spark, sf)).drop("path")


@query(f"SELECT doc_id, ticker, year FROM ({_TREE}) ORDER BY folder, year LIMIT 7")
def report_tree_limit(spark, sf):
    return corpus.read_reports(spark, _tree(spark, sf), 7).select("doc_id", "ticker", "year")


@query("SELECT n_nationkey::BIGINT AS id, 'Hỏi ' || n_name AS question, kind FROM nation, (SELECT unnest(['array', 'object', 'lines']) AS kind)")
def question_files(spark, sf):
    import json

    rows = [{"id": r["n_nationkey"], "question": f"Hỏi {r['n_name']}"} for r in t(spark, sf, "nation").collect()]
    dump = lambda x: json.dumps(x, ensure_ascii=False)
    root = synth.put_files(spark, "questions", {"array.json": dump(rows).encode(), "object.json": dump({"questions": rows}).encode(), "lines.jsonl": "\n\n".join(map(dump, rows)).encode()})
    each = [corpus.read_questions(spark, f"{root}/{p}").select("id", "question", F.lit(p.split(".")[0]).alias("kind")) for p in ("array.json", "object.json", "lines.jsonl")]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(f"SELECT {_CODE} AS code, n_name || chr(10) || 'Ltd, \"' || n_regionkey || '\"' AS name FROM nation")
def company_file(spark, sf):
    rows = t(spark, sf, "nation").select(code(F.col("n_nationkey")), "n_name", "n_regionkey").collect()
    body = "".join(f'{c},"{name}\nLtd, ""{r}"""\n' for c, name, r in rows)
    root = synth.put_files(spark, "companies", {"c.csv": ("\ufeffcode,name\n" + body).encode()})
    none = corpus.read_companies(spark, f"{root}/missing.csv")
    return files.read_csv(spark, f"{root}/c.csv").unionByName(none)


@query(f"""{_POINTS} SELECT code || '_' || y || '|1' AS table_ref, code AS ticker, y AS year, 'unknown' AS report_type, 2::BIGINT AS n_rows, 'income_statement' AS section, code || '_' || y || '_table_1.csv' AS csv_path, code || '_' || y || chr(10) || 'Doanh thu thuần; Lợi nhuận sau thuế' || chr(10) || 'Năm ' || y AS card
FROM v JOIN (SELECT n_nationkey, {_CODE} AS code FROM nation) ON n_nationkey = k WHERE y = 1996""")
def manifest_from_files(spark, sf):
    facts = nation_facts(spark, sf).where("year = 1996").withColumns({"section": F.lit("income_statement"), "unit": F.lit("vnd"), "column_label": F.concat(F.lit("Năm "), F.col("year").cast("string"))})
    bodies = {r["csv_path"]: r["body"].encode() for r in files.csv_files(facts, "deep/").select("csv_path", "body").collect()}
    return files.rebuild_manifest(spark, synth.put_files(spark, "csv", bodies)).select("table_ref", "ticker", "year", "report_type", "n_rows", "section", "csv_path", "card")


@query(f"""SELECT {_CODE} || '_' || (1990 + n_nationkey) AS doc_id, {_CODE} AS ticker, (1990 + n_nationkey)::INT AS year, 'consolidated' AS report_type, 'unknown' AS raw_report_type, CASE WHEN n_nationkey < 10 THEN 'old' WHEN n_nationkey < 15 THEN 'both' ELSE 'new' END AS state FROM nation""")
def manifest_written(spark, sf):
    n = t(spark, sf, "nation").select(F.concat(code(F.col("n_nationkey")), F.lit("_"), (F.col("n_nationkey") + 1990).cast("string")).alias("doc_id"), "n_nationkey").withColumn("table_ref", F.concat("doc_id", F.lit("|1")))
    path = f"{synth.scratch(spark, 'manifest')}/m"
    corpus.write_manifest(n.where("n_nationkey < 15").select("table_ref", "doc_id", F.lit("old").alias("state"), F.lit("x").alias("ticker")), path)
    corpus.write_manifest(n.where("n_nationkey >= 10").select("table_ref", "doc_id", F.when(F.col("n_nationkey") < 15, "both").otherwise("new").alias("state"), F.lit("y").alias("ticker")), path, "upsert")
    return corpus.read_manifest(spark, path).select("doc_id", "ticker", "year", "report_type", "raw_report_type", "state")


# --- sinks -----------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name, count(*) OVER () AS written, 'second' AS note FROM nation")
def json_sinks(spark, sf):
    root = synth.scratch(spark, "json")
    rows = t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    files.write_jsonl(rows.limit(3), f"{root}/rows")
    n = files.write_jsonl(rows, f"{root}/rows")
    for note in ("first", "second"):
        files.write_text_atomic(spark, f'{{"note": "{note}"}}', f"{root}/note.json")
    note = files.read_json(spark, f"{root}/note.json", "note string")
    return files.read_jsonl(spark, f"{root}/rows", "id long, name string").withColumn("written", F.lit(n).cast("long")).crossJoin(note)


@query(f"{_POINTS}, c AS (SELECT n_nationkey, {_CODE} AS ticker FROM nation) SELECT ticker, count(*) * 2 AS n, sum(r + p)::DOUBLE AS total FROM v JOIN c ON n_nationkey = k GROUP BY ticker")
def fact_sink(spark, sf):
    path = f"{synth.scratch(spark, 'facts')}/f"
    corpus.write_facts(nation_facts(spark, sf), path)
    return spark.read.parquet(path).groupBy("ticker").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("""WITH d AS (SELECT item_id AS ref, list_filter(string_split_regex(lower(text), '[^0-9a-z]+'), lambda x: x <> '') AS w FROM benchmark),
s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d), e AS (SELECT ref, len(w) AS l, unnest(w) AS term FROM d), p AS (SELECT term, ref, any_value(l) AS l, count(*) AS tf FROM e GROUP BY term, ref),
i AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, s GROUP BY term),
q AS (SELECT ref AS query_id, unnest(list_distinct(w)) AS term FROM d WHERE ref % 5 = 0),
r AS (SELECT query_id, ref, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean))) AS score FROM q JOIN p USING (term) JOIN i USING (term), s WHERE (query_id + ref) % 2 = 0 GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, ref) AS rank FROM r) SELECT query_id, ref, round(score, 4)::DOUBLE AS score, rank::INT AS rank, true AS whole FROM k WHERE rank <= 5""")
def index_roundtrip(spark, sf):
    """An index saved, loaded, checked against its rows and searched among allowed rows only."""
    b = t(spark, sf, "benchmark")
    path = f"{synth.scratch(spark, 'index')}/i"
    submit.save_index(retrieve.build_bm25(b, "item_id", "text", plain_tokens), path)
    index = submit.load_index(spark, path)
    whole = submit.check_index(b.withColumnRenamed("item_id", "table_ref"), index, None) == []
    q = b.where("item_id % 5 = 0")
    allowed = q.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 2).alias("k")).join(b.select(F.col("item_id").alias("ref"), (F.col("item_id") % 2).alias("k")), "k")
    return retrieve.bm25_search(index, q, "item_id", "text", 5, plain_tokens, allowed).select("query_id", "ref", F.round("score", 4).alias("score"), "rank", F.lit(whole).alias("whole"))


@query(f"""WITH c AS (SELECT {_CODE} AS code, n_nationkey FROM nation WHERE n_nationkey % 3 = 0) SELECT 'data/' || code || '_1996_table_1.csv' AS name, (SELECT count(*) FROM c)::BIGINT AS answers FROM c UNION ALL SELECT 'answers.json', (SELECT count(*) FROM c)::BIGINT""")
def package_entries(spark, sf):
    """Names in a package written as a stream: one JSON, and only the tables that answers cite."""
    import json

    facts = nation_facts(spark, sf).where("year = 1996")
    cited = F.concat(code(F.col("n_nationkey")), F.lit("_1996"))
    n = t(spark, sf, "nation").where("n_nationkey % 3 = 0").select(F.col("n_nationkey").cast("long").alias("id"), F.lit("q").alias("question"), cited.alias("doc"))
    items = submit.build(n.select("id", "question"), n.select(F.col("id").alias("question_id"), F.concat("doc", F.lit("|1")).alias("table_ref"), F.lit(1).alias("place")), n.select("id", F.lit(1.0).alias("value"), F.lit("SELECT 1").alias("query")))
    bodies = files.csv_files(facts, submit.PREFIX).join(items.select(F.explode("csv_paths").alias("csv_path")).distinct(), "csv_path", "left_semi")
    path = f"{synth.scratch(spark, 'package')}/a.zip"
    with Output(spark, path) as out:
        submit.hand_in_to(out, items, bodies, n.select("id"))
    z = zipfile.ZipFile(io.BytesIO(bytes(spark.read.format("binaryFile").load(path).first()["content"])))
    return spark.createDataFrame([(name, len(json.loads(z.read("answers.json")))) for name in z.namelist()], "name string, answers long")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_remaining(spark, sf):
    return corpus.remaining(t(spark, sf, "documents").select("doc_id"), t(spark, sf, "labels"), "doc_id")


# --- extraction ------------------------------------------------------------------------------------------------


@query("""SELECT s_suppkey, (1 + s_suppkey % 3)::INT AS position, (s_suppkey % 7)::INT AS page, CASE WHEN s_suppkey % 3 = 0 THEN 'đoạn đầu' || chr(10) ELSE '' END || CASE WHEN s_suppkey % 2 = 0 THEN 'Tiêu đề ' || s_suppkey || chr(10) || 'ĐVT: triệu đồng' ELSE 'Một dòng' END AS context, (2 + s_suppkey % 3)::BIGINT AS n_tables,
CASE WHEN s_suppkey % 2 = 0 THEN 'ĐVT: triệu đồng' ELSE 'Một dòng' END AS title, CASE WHEN s_suppkey % 2 = 0 THEN 1e6 ELSE 1 END::DOUBLE AS scale, s_suppkey || ' & <b>' AS cell FROM supplier""")
def table_contexts(spark, sf):
    """Tables after small ones that do not count, with pages, context lines, titles and unescaped cells."""
    k = F.col("s_suppkey")
    before = F.when(k % 2 == 0, F.concat(F.lit("Tiêu đề "), k.cast("string"), F.lit("\n\n<i> ĐVT: triệu đồng </i>\n"))).otherwise("Một dòng\n===== PAGE 99 =====\n")
    page = F.concat(F.lit("===== PAGE "), (k % 7).cast("string"), F.lit(" =====\n"))
    small, big = F.repeat(F.lit("<table><tr><td>một</td></tr></table>"), (k % 3).cast("int")), F.concat(F.lit("<TABLE class='x'><tr><th>a</th><th>b</th></tr><tr><td> <p>"), k.cast("string"), F.lit("&nbsp;&amp; &lt;b&gt;</p></td><td>1</td></tr></TABLE>"))
    doc = F.concat(F.when(k % 2 == 0, page).otherwise(""), F.lit("đoạn đầu"), small, F.lit("\n"), before, F.when(k % 2 == 0, "").otherwise(page), big, F.lit("<table><tr><td>cuối</td></tr></table>"))
    s = t(spark, sf, "supplier").select("s_suppkey", doc.alias("text"))
    found = s.select("s_suppkey", extract.count_html_tables(F.col("text")).cast("long").alias("n_tables"), F.explode(extract.find_tables("text")).alias("x"))
    cell = F.get(F.get("x.rows", F.lit(1)), F.lit(0))
    return found.select("s_suppkey", "x.position", "x.page", "x.context", "n_tables", extract.title_of(F.col("x.context")).alias("title"), numbers.detect_unit(F.col("x.context"))["scale"].alias("scale"), cell.alias("cell"))


@query("""WITH k AS (SELECT s_suppkey, unnest([1, 2, 3, 4]) AS p FROM supplier), b AS (SELECT *, CASE WHEN p = 1 OR s_suppkey % 4 + 2 = p THEN 1 ELSE 0 END AS brk FROM k),
i AS (SELECT *, sum(brk) OVER (PARTITION BY s_suppkey ORDER BY p) AS g FROM b) SELECT s_suppkey, min(p)::INT AS position, (2 * count(*))::INT AS n_rows, string_agg('h' || p || ',' || 'c' || p, ',' ORDER BY p) AS first_cells, s_suppkey::VARCHAR || '|' || min(p) AS table_ref FROM i GROUP BY s_suppkey, g""")
def stitched_tables(spark, sf):
    """Four tables a document; text of some length, or a change of width, parts them at one place."""
    k = F.col("s_suppkey")
    table = lambda p, wide: F.concat(F.lit(f"<table><tr><td>h{p}</td><td>x</td>"), F.lit("<td>w</td>" if wide else ""), F.lit(f"</tr><tr><td>c{p}</td><td>y</td>"), F.lit("<td>z</td>" if wide else ""), F.lit("</tr></table>"))
    gap = lambda p: F.when(k % 4 + 2 == p, F.lit("Một đoạn văn đủ dài để chia hai bảng này ra.")).otherwise("\n===== PAGE 3 =====\n<br>tiếp")
    doc = F.concat(table(1, False), gap(2), table(2, False), gap(3), table(3, False), gap(4), table(4, False))
    # where the last table stands alone by its width, the text between is short
    doc = F.when(k % 8 == 2, F.concat(table(1, False), gap(9), table(2, False), gap(9), table(3, False), gap(9), table(4, True))).otherwise(doc)
    made = extract.extract_tables(t(spark, sf, "supplier").select(k.alias("doc_id"), doc.alias("text")))
    cells = F.array_join(F.transform("rows", lambda r: F.get(r, F.lit(0))), ",")
    return made.select(F.col("doc_id").cast("long").alias("s_suppkey"), "position", F.size("rows").alias("n_rows"), cells.alias("first_cells"), "table_ref")


@query("""WITH r AS (SELECT s_suppkey, unnest([0, 1, 2]) AS i FROM supplier) SELECT s_suppkey, (i + 1)::INT AS row_no, CASE i WHEN 0 THEN 'Chỉ tiêu' WHEN 1 THEN 'Doanh thu ' || s_suppkey ELSE 'Chi phí' END AS item, CASE i WHEN 0 THEN '2020' WHEN 1 THEN s_suppkey || '.000' ELSE '(500)' END AS figure,
CASE s_suppkey % 3 WHEN 0 THEN 'Bảng một' WHEN 1 THEN 'Bảng hai' ELSE 'Bảng ba' END AS title FROM r WHERE s_suppkey % 4 <> 3""")
def text_tables(spark, sf):
    """Tables set with bars, tabs or spaces, junk lines inside; every fourth text is prose alone."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("Doanh thu "), k.cast("string"))
    row = lambda gap: F.concat(F.lit(f"Chỉ tiêu{gap}2020\n"), F.lit("--- | ---\n" if "|" in gap else ""), name, F.lit(gap), k.cast("string"), F.lit(f".000\n\nghi chú\nChi phí{gap}(500)\n"))
    bars = F.concat(F.lit("Bảng một\n"), F.replace(F.replace(row(" | "), F.lit("Chỉ tiêu"), F.lit("| Chỉ tiêu")), F.lit("2020\n"), F.lit("2020 |\n")))
    bars = F.replace(F.replace(F.replace(bars, F.lit("Doanh"), F.lit("| Doanh")), F.lit(".000"), F.lit(".000 |")), F.lit("Chi phí | (500)"), F.lit("| Chi phí | (500) |"))
    doc = F.when(k % 4 == 3, "Văn xuôi không có bảng nào.\nDòng hai, năm nay tốt.").when(k % 3 == 0, bars).when(k % 3 == 1, F.concat(F.lit("Bảng hai\n"), row("\t"))).otherwise(F.concat(F.lit("Bảng ba\n"), row("    ")))
    made = extract.extract_tables(t(spark, sf, "supplier").select(k.alias("doc_id"), doc.alias("text")))
    cells = made.select(F.col("doc_id").cast("long").alias("s_suppkey"), "title", F.posexplode("rows").alias("i", "r"))
    return cells.select("s_suppkey", (F.col("i") + 1).alias("row_no"), F.get("r", F.lit(0)).alias("item"), F.get("r", F.lit(1)).alias("figure"), "title")


@query("""SELECT o_orderkey, 'Chỉ tiêu|col_1|' || year(o_orderdate) || '|' || year(o_orderdate) || '_1|a b' AS columns, 1::INT AS n_body, CASE WHEN o_orderkey % 2 = 0 THEN '7' ELSE '' END AS last_cell FROM orders WHERE o_orderkey % 3 > 0
UNION ALL SELECT o_orderkey, 'col_0|col_1|col_2|col_3|col_4', 3, '' FROM orders WHERE o_orderkey % 3 = 0""")
def table_headers(spark, sf):
    """Headers found, squeezed, named by place and numbered; rows of figures alone get made-up names; short rows are padded."""
    y, k = F.year("o_orderdate").cast("string"), F.col("o_orderkey")
    row = lambda *c: F.array(*[x if isinstance(x, Column) else F.lit(x) for x in c])
    headed = F.array(row("Công ty", "x"), row(" Chỉ  tiêu ", " ", y, y, "a\n b"), F.when(k % 2 == 0, row("m", "1", "2", "3", "7")).otherwise(row("m", "1", "2")))
    bare = F.array(row("1", "2", "3", "4", "5"), row("6", "7", "8"), row("9", "10"))
    o = t(spark, sf, "orders").select("o_orderkey", F.when(k % 3 > 0, headed).otherwise(bare).alias("rows"))
    f = standardize.frames(o)
    return f.select("o_orderkey", F.array_join("columns", "|").alias("columns"), F.size("body").alias("n_body"), F.element_at(F.element_at("body", -1), -1).alias("last_cell"))


@query("""WITH v AS (SELECT o_orderkey AS k, year(o_orderdate)::INT AS y FROM orders WHERE o_orderkey % 40 = 0 AND o_orderkey > 0),
r AS (SELECT k, y, unnest([{'i': 1, 'item': 'I. TÀI SẢN - Tiền', 'c': '110', 'q': '31/12', 'm': 'm1', 'v': 5}, {'i': 1, 'item': 'I. TÀI SẢN - Tiền', 'c': '110', 'q': '01/01', 'm': 'm1', 'v': 4}, {'i': 3, 'item': 'I. TÀI SẢN - Phải thu - Khách hàng', 'c': '131', 'q': '31/12', 'm': 'm1', 'v': -3}, {'i': 4, 'item': 'II. NGUỒN VỐN - Phải thu - Khách', 'c': NULL, 'q': 'x', 'm': NULL, 'v': 0}]) AS x FROM v)
SELECT 'd' || k || '|1' AS table_ref, x.i AS row_idx, x.item AS item, x.c AS item_code, CASE x.q WHEN '31/12' THEN y ELSE y - 1 END AS year, CASE x.q WHEN '31/12' THEN 'closing' ELSE 'opening' END AS period, (x.v * k * 1000)::DOUBLE AS value, x.q || '/' || y AS column_label FROM r WHERE x.i < 4""")
def hierarchy_facts(spark, sf):
    """Sections and categories prefix the items below; of two columns of one period the first counts; codes come from their own column; notes are no category."""
    k, y = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    figure = lambda n: F.concat(F.lit("(" if n < 0 else ""), (abs(n) * k).cast("string"), F.lit(")" if n < 0 else ""))
    row = lambda *c: F.array(*[x if isinstance(x, Column) else F.lit(x) for x in c])
    day = lambda d: F.concat(F.lit(d), y)
    rows = F.array(
        row("Chỉ tiêu", "Mã số", "Thuyết minh", day("31/12/"), day("01/01/"), day("31/12/")), row("I. TÀI SẢN", "", "", "", "", ""), row("Tiền", "110", "5", figure(5), figure(4), figure(9)),
        row("Phải thu", "", "", "", "", ""), row("Khách hàng", "131", "", figure(-3), "-", figure(9)),
    )
    o = t(spark, sf, "orders").where("o_orderkey % 40 = 0 and o_orderkey > 0").select(F.concat(F.lit("d"), k.cast("string"), F.lit("|1")).alias("table_ref"), rows.alias("rows"), F.lit("balance_sheet").alias("section"), F.lit("nghin dong").alias("unit"), F.lit(1000.0).alias("unit_scale"), F.lit("ABC").alias("ticker"), F.year("o_orderdate").alias("fallback_year"))
    f = standardize.to_facts(o)
    return f.select("table_ref", F.when(F.col("row_idx") == 1, 1).otherwise(F.col("row_idx")).alias("row_idx"), "item", "item_code", "year", "period", "value", "column_label")


@query("""SELECT p_partkey, chr(65 + (p_partkey % 26)::INT) || ' TỔNG CỘNG..  ' || p_partkey AS fixed, 'a' || p_partkey || '_x' AS slug, 'duong  ' || p_partkey AS folded, p_partkey % 3 = 0 AS noise, (p_partkey % 2 = 0) AS figure, '1' || p_partkey AS mended, 'a b ' || p_partkey AS squeezed, 'lai ' || p_partkey AS tokens FROM part""")
def scanned_text(spark, sf):
    k = F.col("p_partkey")
    s = k.cast("string")
    line = F.concat(F.char(65 + k % 26), F.lit(" TONG CONG......    "), s, F.lit("\x07  \nTrang 12\n - 3 - \n4/9"))
    noise = F.when(k % 3 == 0, F.concat(F.lit("  Page "), s)).otherwise(F.concat(F.lit("page "), s, F.lit(" of text")))
    return t(spark, sf, "part").select(
        "p_partkey", text.fix_ocr_text(line).alias("fixed"), text.slugify(F.concat(F.lit("  A"), s, F.lit("--X "))).alias("slug"), text.fold(F.concat(F.lit("ĐƯỜNG  "), s)).alias("folded"), text.is_page_noise(noise).alias("noise"),
        numbers.is_numeric_like(F.when(k % 2 == 0, F.concat(F.lit("(1.O"), s, F.lit(")"))).otherwise(F.concat(F.lit("năm "), s))).alias("figure"), numbers.fix_numeric_token(F.concat(F.lit("l"), s)).alias("mended"), text.normalize_ws(F.concat(F.lit(" a \u00a0 b\n"), s)).alias("squeezed"),
        F.array_join(text.tokenize(F.concat(F.lit("Bao nhiêu và của LÃI ,"), s)), " ").alias("tokens"),
    )


# --- wordings --------------------------------------------------------------------------------------------------

UNITS = {
    "Đơn vị: triệu đồng": 1e6, "ĐVT: tr.đ": 1e6, "ĐVT: tr đồng": 1e6, "Đơn vị tính: triệu VND": 1e6, "Đơn vị: tỷ đồng": 1e9, "ĐVT: tỷ": 1e9, "ĐVT : tỷ đ": 1e9, "nghìn đồng": 1e3, "Đơn vị: ngàn đồng": 1e3, "ĐVT: ng.đ": 1e3, "Unit: million VND": 1e6,
    "Unit: VND'000": 1e3, "VND 000": 1e3, "thousand": 1e3, "in billion": 1e9, "Đơn vị: VND": 1.0, "Bảng cân đối kế toán": 1.0, "Đơn vị: tỷ đồng; trước là triệu đồng": 1e9, "trydong": 1.0, "31.12.2015Triệu đồng": 1.0, "TRIỆUĐỒNG": 1e6,
}


@query(f"SELECT c_custkey, {_list(tuple(UNITS.values()))}[1 + c_custkey % {len(UNITS)}]::DOUBLE AS scale FROM customer")
def unit_wordings(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", numbers.detect_unit(among(tuple(UNITS), F.col("c_custkey")))["scale"].alias("scale"))


ASKED = {
    "là bao nhiêu tỷ đồng?": "ty_dong", "bao nhiêu tỷ?": "ty_dong", "bao nhieu trieu dong": "trieu_dong", "bao nhiêu triệu": "trieu_dong", "bao nhiêu nghìn đồng?": "nghin_dong", "bao nhiêu ngàn?": "nghin_dong", "bao nhiêu nghìn tỷ đồng": "nghin_ty_dong",
    "mấy nghìn tỷ": "nghin_ty_dong", "mấy trăm tỷ đồng": "tram_ty_dong", "tính bằng đồng": "dong", "đơn vị đồng?": "dong", "theo VND": "dong", "bao nhiêu %": "percent", "tỷ lệ sở hữu là bao nhiêu phần trăm": "percent", "hệ số nợ (theo %) là bao nhiêu lần?": "times",
    "gấp mấy lần": "times", "hệ số thanh toán là mấy lần, theo %": "times", "tỷ lệ biểu quyết là bao nhiêu?": "none", "đồng bằng": "none",
}
DIVISORS = {"ty_dong": 1e9, "trieu_dong": 1e6, "nghin_dong": 1e3, "nghin_ty_dong": 1e12, "tram_ty_dong": 1e11}


@query(f"SELECT c_custkey, {_list(tuple(ASKED.values()))}[1 + c_custkey % {len(ASKED)}] AS asked, {_list(tuple(DIVISORS.get(v, 1.0) for v in ASKED.values()))}[1 + c_custkey % {len(ASKED)}]::DOUBLE AS divisor FROM customer")
def asked_wordings(spark, sf):
    asked = units.asked_unit(among(tuple(ASKED), F.col("c_custkey")))
    return t(spark, sf, "customer").select("c_custkey", asked.alias("asked"), units.divisor(asked).alias("divisor"))


HEADS = {
    "31/12/{y}": ("{y} (closing)", "31/12/{y}"), "01/01/{y}": ("{x} (opening)", "01/01/{y}"), "1.1.{y}Triệu đồng": ("{x} (opening)", "1.1.{y}"), "Tại ngày31-12-{y}VND": ("{y} (closing)", "31-12-{y}"), "30/6/{y}": ("{y} (point_in_time)", "30/6/{y}"), "45/13/{y}": ("{y} (unknown)", "45/13/{y}"),
    "Ngày 31 tháng 12 năm {y}": ("{y} (closing)", "31 tháng 12 năm {y}"), "Năm {y}": ("{y} (annual)", None), "{y}": ("{y} (annual)", None), "Số cuối năm": ("{y} (closing)", None), "Số dư đầu kỳ": ("{x} (opening)", None), "Năm trước": ("{x} (annual)", None), "Kỳ này": ("{y} (annual)", None),
    "Chỉ tiêu": (None, None), "Theo BCTC {y}": (None, None), "{x} và {y}": (None, None), "Năm {y} là một nhãn rất dài, dài hơn sáu mươi chữ nên không thể là cột": (None, None),
}


def _sql_heads(i: int) -> str:
    return _list(tuple(v[i] for v in HEADS.values()))


@query(f"SELECT o_orderkey, replace(replace({_sql_heads(0)}[1 + o_orderkey % {len(HEADS)}], '{{y}}', year(o_orderdate)::VARCHAR), '{{x}}', (year(o_orderdate) - 1)::VARCHAR) AS label, replace({_sql_heads(1)}[1 + o_orderkey % {len(HEADS)}], '{{y}}', year(o_orderdate)::VARCHAR) AS source_date FROM orders")
def header_wordings(spark, sf):
    y = F.year("o_orderdate")
    head = F.replace(F.replace(among(tuple(HEADS), F.col("o_orderkey")), F.lit("{y}"), y.cast("string")), F.lit("{x}"), (y - 1).cast("string"))
    o = t(spark, sf, "orders").select("o_orderkey", periods.parse_period(head, y).alias("p"))
    return o.select("o_orderkey", F.when(F.col("p").isNotNull(), periods.period_label(F.col("p"))).alias("label"), "p.source_date")


ASKS = {
    "Số dư phải thu của ({c}) đến ngày 01/01/{y} là bao nhiêu?": ("opening", None, False, False), "Thuế phải nộp đầu năm {y} của ({c})?": ("opening", None, False, False), "Cho vay của ({c}) cuối năm {y}, báo cáo hợp nhất": ("closing", "consolidated", False, False),
    "Vốn của công ty mẹ ({c}) vào ngày 31/12/{y}?": ("closing", "separate", False, False), "Chi phí trong năm {y} của ({c})": ("annual", None, False, False), "Lãi năm {y} của ({c}) so với năm khác": (None, None, True, False), "Từ đầu năm đến cuối năm {y} của ({c}), cao nhất": ("opening", None, False, True), "Trung bình của ({c}) năm {y}": (None, None, False, True),
}


def _sql_asks(i: int) -> str:
    return _list(tuple(v[i] for v in ASKS.values())) + f"[1 + n_nationkey % {len(ASKS)}]"


@query(f"""SELECT n_nationkey::BIGINT AS id, {_CODE} AS tickers, (2000 + n_nationkey)::VARCHAR AS years, {_sql_asks(0)} AS requested_period, {_sql_asks(1)} AS report_type, {_sql_asks(2).replace('True', 'true').replace('False', 'false')} AS is_comparison, {_sql_asks(3).replace('True', 'true').replace('False', 'false')} AS is_aggregate FROM nation""")
def question_wordings(spark, sf):
    n = t(spark, sf, "nation")
    q = F.replace(F.replace(among(tuple(ASKS), F.col("n_nationkey")), F.lit("{y}"), (2000 + F.col("n_nationkey")).cast("string")), F.lit("{c}"), code(F.col("n_nationkey")))
    a = retrieve.analyze(n.select(F.col("n_nationkey").cast("long").alias("id"), q.alias("question")))
    return a.select("id", F.array_join("tickers", ",").alias("tickers"), F.array_join(F.col("years").cast("array<string>"), ",").alias("years"), "requested_period", "report_type", "is_comparison", "is_aggregate")


@query(f"""WITH n AS (SELECT n_nationkey AS k, {_CODE} AS c FROM nation) SELECT k::BIGINT AS id, CASE k % 5 WHEN 0 THEN c WHEN 1 THEN c WHEN 2 THEN c || ',NX1' ELSE c END AS tickers, CASE k % 2 WHEN 0 THEN '2018,2019,2020' ELSE '2015,2021' END AS years,
'tổng ' || CASE k % 2 WHEN 0 THEN '2018-2020' ELSE '2021 2015' END || ' roe profit_after_tax equity ' || CASE k % 5 WHEN 2 THEN c || ' NX1' ELSE c END || ' ' || CASE k % 2 WHEN 0 THEN '2018 2019 2020' ELSE '2015 2021' END AS searched FROM n""")
def question_codes(spark, sf):
    """Codes in brackets, bare, in small letters or with digits; words that look like codes; ranges of years either way; the query as it is searched for."""
    k = F.col("n_nationkey")
    c = code(k)
    said = F.when(k % 5 == 0, F.concat(F.lit("EPS ("), c, F.lit(") và VAT "))).when(k % 5 == 1, F.concat(F.lit("ROE của "), c, F.lit(" HDQT "))).when(k % 5 == 2, F.concat(F.lit("tổng "), c, F.lit(" nx1 "))).otherwise(F.concat(F.lit("hai nam "), F.lower(c), F.lit(" cho ")))
    years = F.when(k % 2 == 0, "từ 2020 đến năm 2018").otherwise("2021, 2015 và 2021")
    n = t(spark, sf, "nation").select(k.cast("long").alias("id"), F.concat(said, years).alias("question"), "n_nationkey")
    known = [r[0] for r in t(spark, sf, "nation").select(c).collect()] + ["NX1"]
    a = retrieve.analyze(n, known).join(n.select("id", "n_nationkey"), "id")
    bare = F.concat(F.lit("tổng "), F.when(k % 2 == 0, "2018-2020").otherwise("2021 2015"))
    searched = retrieve.expand_query(bare, F.array(F.lit("roe")), F.col("tickers"), F.col("years"))
    return a.select("id", F.array_join("tickers", ",").alias("tickers"), F.array_join(F.col("years").cast("array<string>"), ",").alias("years"), searched.alias("searched"))


@query("""WITH w AS (SELECT n_nationkey AS code, string_split('alpha ' || CASE WHEN n_nationkey % 3 = 0 THEN 'shared name' ELSE 'unit u' || n_nationkey END, ' ') AS w FROM nation),
g AS (SELECT DISTINCT code, array_to_string(w[len(w) - n + 1:], ' ') AS alias FROM w, (SELECT unnest([2, 3, 4]) AS n) WHERE len(w) >= n) SELECT alias, min(code) AS code FROM g WHERE length(alias) >= 6 GROUP BY alias HAVING count(DISTINCT code) = 1""")
def unique_suffixes(spark, sf):
    k = F.col("n_nationkey")
    name = F.concat(F.lit("ALPHA "), F.when(k % 3 == 0, "Shared Name").otherwise(F.concat(F.lit("Unit U"), k.cast("string"))))
    return retrieve.unique_aliases(t(spark, sf, "nation").select(k.alias("code"), name.alias("name")))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN l_quantity WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE -1.5 END::DOUBLE AS value FROM lineitem WHERE l_orderkey % 50 = 0""")
def coerced_numbers(spark, sf):
    m = F.col("l_linenumber") % 5
    raw = F.when(m == 0, F.col("l_quantity").cast("string")).when(m == 1, "NaN").when(m == 2, "-Infinity").when(m == 3, "abc").otherwise(" -1.5 ")
    return t(spark, sf, "lineitem").where("l_orderkey % 50 = 0").select("l_orderkey", "l_linenumber", numbers.coerce_number(raw).alias("value"))


# --- cards, ranking, choice ------------------------------------------------------------------------------------


@query(f"""{_POINTS} SELECT c || '_' || y || '|1' AS table_ref, 'company: ' || c || chr(10) || 'years: ' || y || ' (annual)' || chr(10) || 'items: Doanh thu thuần; Lợi nhuận sau thuế' || chr(10) || 'metrics: net_revenue, profit_after_tax' || chr(10) || 'categories: nhóm' || chr(10) || 'ref: ' || c || '_' || y || '|1' AS card, 2::BIGINT AS n_rows
FROM v JOIN (SELECT n_nationkey, {_CODE} AS c FROM nation) ON n_nationkey = k""")
def table_card_text(spark, sf):
    f = nation_facts(spark, sf).withColumns({"section": F.lit(None).cast("string"), "unit": F.lit(None).cast("string"), "source_date": F.lit(None).cast("string"), "column_label": F.lit("nhóm")})
    return cards.cards(f)


@query(f"SELECT {_CODE} AS ticker, CASE n_nationkey % 3 WHEN 0 THEN 'thẻ ' || n_nationkey ELSE {_CODE} || ' 2020 notes ' || n_name || ' t|1' END AS text FROM nation")
def card_fallback(spark, sf):
    k = F.col("n_nationkey")
    card = F.when(k % 3 == 0, F.concat(F.lit("thẻ "), k.cast("string"))).when(k % 3 == 1, "  ")
    n = t(spark, sf, "nation").select(code(k).alias("ticker"), F.lit(2020).alias("year"), F.lit("notes").alias("section"), F.col("n_name").alias("title"), F.lit(None).cast("string").alias("unit"), F.lit("t|1").alias("table_ref"), card.alias("card"))
    return n.select("ticker", submit.card_text().alias("text"))


_TFIDF = """d AS (SELECT item_id AS ref, list_filter(string_split_regex(lower(text), '[^0-9a-z]+'), lambda x: x <> '') AS w FROM benchmark), p AS (SELECT ref, term, count(*) AS tf FROM (SELECT ref, unnest(w) AS term FROM d) GROUP BY ALL),
i AS (SELECT term, ln(1 + ((SELECT count(*) FROM d) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p GROUP BY term),
h AS (SELECT ref, 16 * (instr('0123456789abcdef', substr(md5(term), 1, 1)) - 1) + instr('0123456789abcdef', substr(md5(term), 2, 1)) - 1 AS place, CASE WHEN instr('01234567', substr(md5(term), 3, 1)) > 0 THEN 1 ELSE -1 END * (1 + ln(tf)) * idf AS w FROM p JOIN i USING (term)),
s AS (SELECT ref, place, sum(w) AS w FROM h GROUP BY ALL), u AS (SELECT ref, place, w / sqrt(sum(w * w) OVER (PARTITION BY ref)) AS w FROM s)"""


@query(f"WITH {_TFIDF} SELECT ref, place::INT AS place, round(w, 4)::DOUBLE AS w FROM u WHERE abs(w) > 0.001")
def hashed_vectors(spark, sf):
    b = t(spark, sf, "benchmark")
    index = retrieve.build_bm25(b, "item_id", "text", plain_tokens)
    v = retrieve.hashed_vectors(b, "item_id", "text", index["terms"], plain_tokens)
    return v.select("ref", F.posexplode("embedding").alias("place", "w")).where("abs(w) > 0.001").select("ref", "place", F.round(F.col("w").cast("double"), 4).alias("w"))


@query(f"""WITH {_TFIDF}, c AS (SELECT a.ref AS query_id, b.ref, round(sum(a.w * b.w), 4) AS score FROM u AS a JOIN u AS b USING (place) WHERE a.ref % 5 = 0 GROUP BY ALL) SELECT query_id, ref, score::DOUBLE AS score FROM c WHERE score > 0.5""")
def dense_of_own_vectors(spark, sf):
    """Texts near each other by vectors that the engine made itself."""
    b = t(spark, sf, "benchmark")
    index = retrieve.build_bm25(b, "item_id", "text", plain_tokens)
    v = retrieve.hashed_vectors(b, "item_id", "text", index["terms"], plain_tokens)
    found = retrieve.knn(v, v.where("ref % 5 = 0").withColumnRenamed("ref", "query_id"), 1000)
    return found.select("query_id", "ref", F.round("score", 4).alias("score")).where("score > 0.5")


@query("""WITH o AS (SELECT o_custkey AS question_id, o_orderkey::VARCHAR AS table_ref, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey::VARCHAR) AS place FROM orders),
h AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN place <= 4 THEN 0 ELSE 1 END, CASE WHEN place <= 4 THEN table_ref::BIGINT % 10 END DESC NULLS LAST, place) AS n FROM o) SELECT question_id, table_ref, n::INT AS place FROM h WHERE n <= 6""")
def reranked(spark, sf):
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("score").desc(), "table_ref"))
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").cast("string").alias("table_ref"), F.col("o_totalprice").alias("score")).withColumn("place", place)
    return select.rerank(o, F.col("table_ref").cast("long") % 10, 6, 4).select("question_id", "table_ref", "place")


@query("""WITH o AS (SELECT o_custkey AS question_id, o_orderkey::VARCHAR AS table_ref, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey::VARCHAR) AS r, o_totalprice AS score, o_orderkey % 4 AS m FROM orders),
s AS (SELECT *, CASE WHEN r <= 5 THEN CASE m WHEN 0 THEN 2 + 6 + 2 + 2 + 6 + 6 ELSE 0 END + CASE m WHEN 1 THEN 2 WHEN 2 THEN -10 ELSE 0 END ELSE 0 END AS c FROM o)
SELECT question_id, table_ref, CASE WHEN r <= 5 THEN c END::DOUBLE AS content_score, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN r <= 5 THEN 0 ELSE 1 END, 10 * c + score DESC, score DESC, table_ref)::INT AS place FROM s""")
def content_order(spark, sf):
    """Tables that hold words and phrases of the question first; cash-flow tables last where a balance is asked."""
    k = F.col("o_orderkey")
    o = t(spark, sf, "orders")
    pool = o.select(F.col("o_custkey").alias("question_id"), k.cast("string").alias("table_ref"), F.col("o_totalprice").alias("score"))
    body = F.when(k % 4 == 0, "HÀNG TỒN KHO cuối kỳ").when(k % 4 == 1, "mục tồn").when(k % 4 == 2, "Lưu chuyển tiền tệ").otherwise("bảng")
    q = o.select(F.col("o_custkey").alias("question_id")).distinct().withColumn("question", F.lit("Số dư hàng tồn kho"))
    return select.by_content(pool, q, o.select(k.cast("string").alias("table_ref"), body.alias("content"), F.lit(None).cast("string").alias("section")), 5).select("question_id", "table_ref", "content_score", "place")


@query("""SELECT c_custkey AS question_id, 'A_' || c_custkey || '|' || p AS table_ref, place::INT AS place FROM customer, (VALUES (1, 1), (2, 2)) AS t(p, place) WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, CASE p WHEN 1 THEN 'A_' || c_custkey || '|1' WHEN 2 THEN 'B_' || c_custkey || '|9' END, p FROM customer, (VALUES (1), (2)) AS t(p) WHERE c_custkey % 3 = 1
UNION ALL SELECT c_custkey, CASE p WHEN 1 THEN 'A_' || c_custkey || '|1' WHEN 2 THEN 'A_' || c_custkey || '|2' ELSE 'A_' || c_custkey || '|8' END, p FROM customer, (VALUES (1), (2), (3)) AS t(p) WHERE c_custkey % 3 = 2""")
def coverage(spark, sf):
    """A company, or a statement that a ratio needs, gets its table though its score is low; else the best tables alone."""
    k, m = F.col("c_custkey"), F.col("c_custkey") % 3
    ref = lambda c, p: F.concat(F.lit(f"{c}_"), k.cast("string"), F.lit(f"|{p}"))
    row = lambda c, p, section, score: F.struct(ref(c, p).alias("table_ref"), F.concat(F.lit(f"{c}_"), k.cast("string")).alias("doc_id"), F.lit(section).alias("section"), F.lit("").alias("card"), F.lit(score).alias("score"), F.lit(p).alias("place"))
    two = F.array(row("A", 1, "balance_sheet", 9.0), row("A", 2, "balance_sheet", 8.0), row("A", 3, "notes", 1.0), row("A", 8, "income_statement", 0.5), row("B", 9, "notes", 0.4))
    one = F.array(row("A", 1, "balance_sheet", 9.0), row("B", 9, "notes", 0.4))
    c = t(spark, sf, "customer")
    pool = c.select(k.alias("question_id"), F.explode(F.when(m == 1, one).otherwise(two)).alias("r")).select("question_id", "r.*")
    names = F.when(m == 1, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A")))
    q = c.select(k.alias("question_id"), names.alias("tickers"), F.array().cast("array<int>").alias("years"), F.when(m == 2, F.array(F.lit("roe"))).otherwise(F.array().cast("array<string>")).alias("metrics"), (m == 2).alias("needs_derived"))
    chosen = select.choose(pool, q, ratio=0.5)
    return chosen.select("question_id", "table_ref", "place")


# --- answers ---------------------------------------------------------------------------------------------------


@query(f"""{_POINTS}, n AS (SELECT n_nationkey AS k, {_CODE} AS c FROM nation), w AS (SELECT n.k, any_value(c) AS c FROM n GROUP BY n.k)
SELECT w.k::BIGINT AS id, CASE w.k % 5 WHEN 0 THEN '' WHEN 1 THEN 'EmptyFilterError' WHEN 2 THEN 'UnsafeCodeError' WHEN 3 THEN 'KeyError' ELSE 'ResultTypeError' END AS error, CASE w.k % 5 WHEN 0 THEN (SELECT sum(r) FROM v WHERE v.k = w.k AND y = 1996) END::DOUBLE AS value,
CASE w.k % 5 WHEN 0 THEN 1 ELSE 2 END AS attempts, CASE w.k % 5 WHEN 0 THEN (SELECT sum(r) FROM v WHERE v.k = w.k AND y = 1996) ELSE 2 END::DOUBLE AS repaired FROM w WHERE w.k < 10""")
def sandboxed(spark, sf):
    """Replies in fences run as one SELECT over the tables bound; what fails is told apart and written again."""
    facts = nation_facts(spark, sf).where("year = 1996")
    replies = ("Đây:\n```sql\nSELECT sum(value) AS result FROM df1 WHERE contains(lower(item), 'doanh thu');\n```", "```\nSELECT value AS result FROM all_df WHERE item = 'không có'\n```", "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT nothing AS result FROM df1", "WITH x AS (SELECT * FROM df1) SELECT value FROM x")
    out = []
    for k, c in t(spark, sf, "nation").where("n_nationkey < 10").select("n_nationkey", code(F.col("n_nationkey"))).collect():
        frames = context.frames_of(facts, [f"{c}_1996|1"])
        first = sandbox.run(spark, sandbox.extract_query(replies[k % 5]), frames)
        last = sandbox.repair(spark, "q", replies[k % 5], frames, lambda q, hints, result: "SELECT count(*) AS result FROM df1")
        out.append((k, first.error_type, first.value if first.success else None, last.attempt, last.value))
    return spark.createDataFrame(out, "id long, error string, value double, attempts int, repaired double")


@query(f"{_POINTS} SELECT k::BIGINT AS id, r AS value, 2::INT AS tries FROM v WHERE y = 1998 AND k < 5")
def relaxed_answers(spark, sf):
    """A keyword for a year that no fact has is sought without the year; one year alone is there, so that year answers."""
    facts = nation_facts(spark, sf).where("year = 1998").withColumn("section", F.lit(None).cast("string"))
    made = None
    for k, c in t(spark, sf, "nation").where("n_nationkey < 5").select("n_nationkey", code(F.col("n_nationkey"))).collect():
        row = answer.relaxed(facts, answer.Query(k, keyword="doanh thu", tickers=(c,), years=(1900,)))
        made = row if made is None else made.unionByName(row)
    return made.select(F.col("id").cast("long").alias("id"), "value", "tries")


@query(f"""{_POINTS} SELECT k::BIGINT AS question_id, c || '_1996|1' AS table_ref, item, item AS keyword, true AS best FROM v JOIN (SELECT n_nationkey, {_CODE} AS c FROM nation) ON n_nationkey = k, (SELECT unnest(['Doanh thu thuần', 'Lợi nhuận sau thuế']) AS item) WHERE y = 1996""")
def question_anchors(spark, sf):
    """Both items hold a word of the question, the second inside a longer word; both tables' best is the one table there is."""
    q = t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("question_id"), F.lit("Doanh thu thuần của nước là bao nhiêu?").alias("question"), code(F.col("n_nationkey")).alias("ticker"))
    facts = nation_facts(spark, sf).where("year = 1996")
    chosen = q.join(facts.select("ticker", "table_ref").distinct(), "ticker").select("question_id", "table_ref")
    return context.anchors(q, chosen, facts).select("question_id", "table_ref", "item", "keyword", "best")


@query("""WITH i AS (SELECT s_suppkey AS id, s_suppkey % 6 AS m FROM supplier) SELECT id, 'error' AS level, 'id was not asked' AS message FROM i WHERE m = 0 UNION ALL SELECT id, 'error', 'document with .txt suffix' FROM i WHERE m = 2
UNION ALL SELECT s_suppkey + 100000, 'error', 'id is not answered' FROM supplier WHERE s_suppkey % 6 = 1 UNION ALL SELECT id, 'warning', 'no table' FROM i WHERE m = 3""")
def submission_ids(spark, sf):
    s, m = t(spark, sf, "supplier"), F.col("s_suppkey") % 6
    items = s.select(F.col("s_suppkey").alias("id"), F.lit(1.0).alias("answer"), F.array(F.when(m == 2, "d.txt").otherwise("d")).alias("relevant_docs"), F.when(m == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("d|1"))).alias("relevant_tables"), F.array(F.lit("a.csv")).alias("csv_paths"), F.lit("SELECT 1").alias("query"))
    expected = s.where(m != 0).select(F.col("s_suppkey").alias("id")).unionByName(s.where(m == 1).select((F.col("s_suppkey") + 100000).alias("id")))
    return evaluate.check_submission(items, expected)


@query("SELECT doc_id AS id, round(n_chars / 1e6, 6)::DOUBLE AS table_f2 FROM documents ORDER BY table_f2, id LIMIT 15")
def worst_rows(spark, sf):
    return evaluate.worst(t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.round(F.col("n_chars") / 1e6, 6).alias("table_f2")))


_YEARS = "SELECT year(o_orderdate)::INT AS y, sum(round(o_totalprice * 100)::BIGINT) FILTER (o_orderpriority = '1-URGENT')::BIGINT AS u, sum(round(o_totalprice * 100)::BIGINT) FILTER (o_orderpriority = '5-LOW')::BIGINT AS l FROM orders GROUP BY 1"


@query(f"""WITH a AS ({_YEARS}) SELECT y::BIGINT AS id, round(u / 100.0, 2)::DOUBLE AS answer, 'ABC_' || y AS doc, 'ABC_' || y || '|1' AS first_table, 2::BIGINT AS entries, 7::BIGINT AS reports FROM a WHERE y < 2001""")
def whole_run(spark, sf):
    """All stages from report files to a package: a question a year; the answers, what they cite, and the entries of the zip for each document."""
    import json

    root = synth.scratch(spark, "run")
    docs = synth.reports(t(spark, sf, "orders")).collect()
    raw = synth.put_files(spark, "raw", {f"ABC/{r['fallback_year']}/{r['doc_id']}_extracted.txt": r["text"].encode() for r in docs})
    asked = [{"id": r["fallback_year"], "question": f"Giá trị 1-URGENT cuối năm {r['fallback_year']} của (ABC) là bao nhiêu?"} for r in docs if r["fallback_year"] < 2001]
    questions = synth.put_files(spark, "asked", {"q.json": json.dumps(asked, ensure_ascii=False).encode()})
    stages.run_all(spark, raw, root, f"{questions}/q.json")
    z = zipfile.ZipFile(io.BytesIO(bytes(spark.read.format("binaryFile").load(f"{root}/answers.zip").first()["content"])))
    entries = spark.createDataFrame([(n.removeprefix("data/").split("_table_")[0],) for n in z.namelist()], "doc string").distinct().withColumn("in_zip", F.lit(1))
    a = spark.read.parquet(f"{root}/answers")
    rows = a.select("id", F.round("answer", 2).alias("answer"), F.get("relevant_docs", F.lit(0)).alias("doc"), F.get("relevant_tables", F.lit(0)).alias("first_table"))
    return rows.join(entries, "doc").select("id", "answer", "doc", "first_table", F.lit(len({n.split("/")[0] for n in z.namelist()})).cast("long").alias("entries"), F.lit(len(docs)).cast("long").alias("reports"))


@query(f"""WITH a AS ({_YEARS}), d AS (SELECT y AS d, unnest([y, y - 1]) AS y FROM a) SELECT 'ABC_' || d || '|1' AS table_ref, d.y::INT AS year, count(*) AS n, round(sum(cents / 100.0), 2)::DOUBLE AS total, CASE WHEN d % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS batch
FROM d JOIN (SELECT year(o_orderdate)::INT AS y, o_orderpriority AS p, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY 1, 2) AS v ON v.y = d.y GROUP BY d.d, d.y""")
def resumed_corpus(spark, sf):
    """Reports of even years first, then those of odd years beside them: the second run reads the new ones alone and adds its batch."""
    docs = synth.reports(t(spark, sf, "orders")).collect()
    body = lambda even: {f"ABC/{r['fallback_year']}/{r['doc_id']}.txt": r["text"].encode() for r in docs if (r["fallback_year"] % 2 == 0) == even}
    raw, out = synth.put_files(spark, "raw", body(True)), synth.scratch(spark, "resumed")
    stages.run_corpus(spark, raw, out)
    for name, text_ in body(False).items():
        with Output(spark, f"{raw}/{name}") as f:
            f.write(text_)
    stages.run_corpus(spark, raw, out)
    batch = spark.read.schema(stages.MANIFEST).json(f"{out}/manifest").select("table_ref", "batch")
    facts = stages._facts(spark, out).groupBy("table_ref", "year").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return facts.join(batch, "table_ref").select("table_ref", "year", "n", "total", "batch")


@query("SELECT n_nationkey::BIGINT AS id, n_name AS body, n_nationkey % 2 = 0 AS found FROM nation")
def fetched_files(spark, sf):
    """A tree copied to another place, its files found by name under the roots given."""
    rows = t(spark, sf, "nation").select("n_nationkey", "n_name").collect()
    source, target = synth.put_files(spark, "far", {f"{k % 3}/{k}.txt": name.encode() for k, name in rows}), f"{synth.scratch(spark, 'near')}/copy"
    files.fetch(spark, source, target)
    got = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(target).select("value", F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)\.txt$", 1).cast("long").alias("id"))
    found = spark.createDataFrame([(k, files.resolve_local(spark, f"x/{k}.txt" if k % 2 == 0 else f"x/{k}.csv", [f"{target}/{i}" for i in range(3)]) is not None) for k, _ in rows], "id long, found boolean")
    return got.join(found, "id").select("id", F.col("value").alias("body"), "found")


@query("SELECT * FROM (SELECT n_nationkey::BIGINT AS id, CASE n_nationkey % 4 WHEN 0 THEN '16' WHEN 1 THEN '7' WHEN 2 THEN '[1, 2]' ELSE 'none' END AS value FROM nation)")
def layered_settings(spark, sf):
    """Built-in values, a file over them, the environment over that, by dotted names."""
    import json

    from ledgerspark.config import Settings

    root = synth.scratch(spark, "settings")
    files.write_text_atomic(spark, json.dumps({"execution": {"timeout_sec": 5}}), f"{root}/s.json")
    held = files.read_json(spark, f"{root}/s.json").toJSON().first()
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".json") as f:  # settings are read by the driver alone
        f.write(held)
        f.flush()
        s = Settings(f.name, {"LEDGERSPARK_EXECUTION__TIMEOUT_SEC": "7", "LEDGERSPARK_A__B": "[1, 2]"})
    names = ("retrieval.selector.max_tables", "execution.timeout_sec", "a.b", "a.c.d")
    return t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), among(tuple(str(s.get(n, "none")) for n in names), F.col("n_nationkey")).alias("value"))
