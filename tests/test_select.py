"""Names, filters, ranking, coverage, query context, sandbox and submission."""

import json
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import retrieve, select
from ledgerspark.plans import context, sandbox, submit


@pytest.fixture(scope="module")
def facts(spark):
    rows = [("a|1", 0, "Tổng tài sản", "270", "Năm 2020", 2020, "closing", 10.0), ("a|1", 1, "Vốn chủ sở hữu", "400", "Năm 2020", 2020, "closing", 4.0), ("a|1", 2, "- Nguyên giá", "222", "Năm 2020", 2020, "closing", 1.0),
            ("a|1", 3, "- Nguyên giá", "228", "Năm 2020", 2020, "closing", 2.0), ("b|2", 0, "1. Lợi nhuận sau thuế", None, "", 2020, "annual", 3.0), ("b|2", 1, None, None, None, None, None, None)]
    return spark.createDataFrame([(*r, "balance_sheet" if r[0] == "a|1" else "income_statement") for r in rows], "table_ref string, row_idx int, item string, item_code string, column_label string, year int, period string, value double, section string")


def test_companies(spark):
    names = spark.createDataFrame([("HPG", "CTCP Tập đoàn Hòa Phát"), ("HSG", "CTCP Tập đoàn Hoa Sen"), ("VNM", "CTCP Sữa Việt Nam"), ("X", "TNHH"), (None, "Không mã")], "code string, name string")
    keys = select.company_keys(names)
    got = {r["key"]: r["code"] for r in keys.collect()}
    assert got["hoa phat"] == "HPG" and got["vinamilk"] == "VNM" and "tap doan" not in got and "viet nam" not in got and "acb" not in got
    q = spark.createDataFrame([(1, "Trong nhóm Hòa Phát, Hoa Sen và Vinamilk"), (2, "không có"), (3, None), (4, "")], "id int, question string")
    rows = {r["id"]: r["codes"] for r in select.resolve_companies(q, keys).collect()}
    assert set(rows) == {1} and sorted(rows[1]) == ["HPG", "HSG", "VNM"]
    assert select.resolve_companies(q, keys.where("false")).count() == 0


def test_filter_refs(spark):
    t = spark.createDataFrame([("a|1", "VNM", 2020, "x", "consolidated"), ("b|1", "VNM", 2021, None, "separate"), ("c|1", None, None, None, None)], "table_ref string, ticker string, year int, section string, report_type string")
    refs = lambda d: sorted(r["table_ref"] for r in d.collect())
    assert refs(select.filter_refs(t, ["vnm"], [2020], 1)) == ["a|1", "b|1"] and refs(select.filter_refs(t, years=[2020])) == ["a|1"]
    assert select.filter_refs(t) is None and select.filter_refs(t, ["ZZZ"]) is None and refs(select.filter_refs(t, report_types=["SEPARATE"])) == ["b|1"]


def test_hybrid(spark):
    docs = spark.createDataFrame([("d|1", "apple pear"), ("d|20", "apple apple"), ("d|x", "plum")], "ref string, text string")
    index = retrieve.build_bm25(docs, "ref", "text")
    q = spark.createDataFrame([(1, "apple", True), (2, "apple", False)], "query_id long, text string, has_metrics boolean")
    rows = {(r["query_id"], r["ref"]): r for r in select.hybrid(index, None, q).collect()}
    assert rows[1, "d|20"]["score"] == pytest.approx(1 / 61) and rows[1, "d|1"]["score"] == pytest.approx(1 / 62 + 0.003) and rows[1, "d|1"]["rank"] == 1 and rows[2, "d|1"]["rank"] == 2
    only = spark.createDataFrame([(1, "d|1")], "query_id long, ref string")
    assert sorted((r["query_id"], r["ref"]) for r in select.hybrid(index, None, q, only).collect()) == [(1, "d|1"), (2, "d|1"), (2, "d|20")]


def test_restricted_knn_is_brute_force(spark, sf):
    import numpy as np

    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("ref"), "embedding").where("ref < 60")
    q = e.where("ref < 5").select(F.col("ref").alias("query_id"), "embedding")
    allowed = q.select("query_id").crossJoin(e.select("ref")).where("(ref + query_id) % 3 = 0")
    v = {r["ref"]: np.array(r["embedding"], float) for r in e.collect()}
    found = select.restricted_knn(e, q, allowed, 4).orderBy("query_id", "rank").collect()
    for i in range(5):
        want = sorted(((-round(float(v[i] @ v[j]), 6), j) for j in v if (i + j) % 3 == 0))[:4]
        got = [r for r in found if r["query_id"] == i]
        assert [r["ref"] for r in got] == [j for _, j in want] and [-r["score"] for r in got] == pytest.approx([s for s, _ in want])


def test_content_and_choice(spark):
    q = spark.createDataFrame([(1, "Số dư quỹ khen thưởng cuối năm của A và B", ["A", "B"], [2020, 2021], [], False), (2, "ROE?", ["A"], [2020], ["roe"], True), (3, "x", [], [], [], False)], "question_id long, question string, tickers array<string>, years array<int>, metrics array<string>, needs_derived boolean")
    pool = spark.createDataFrame([(i, t, s) for i in (1, 2) for t, s in (("A_2020_x|1", 5.0), ("A_2020_x|2", 4.0), ("A_2020_x|3", 3.9), ("B_2021_y|1", 0.5))], "question_id long, table_ref string, score double")
    content = spark.createDataFrame([("A_2020_x|1", "Lưu chuyển tiền quỹ", "cash_flow"), ("A_2020_x|2", "Quỹ khen thưởng", "balance_sheet"), ("A_2020_x|3", "", None), ("B_2021_y|1", None, "income_statement")], "table_ref string, content string, section string")
    placed = select.by_content(pool, q, content)
    order = [r["table_ref"] for r in placed.where("question_id = 1").orderBy("place").collect()]
    assert order[0] == "A_2020_x|2" and order[-1] == "A_2020_x|1"
    assert [r["place"] for r in select.rerank(placed, F.length("table_ref"), 2).where("question_id = 2").orderBy("place").collect()] == [1, 2]
    full = placed.join(content.select("table_ref", "section"), "table_ref").withColumns({"doc_id": F.substring_index("table_ref", "|", 1), "card": F.lit(None).cast("string")})
    got = select.choose(full, q, low=2, high=3)
    refs = lambda i: [r["table_ref"] for r in got.where(f"question_id = {i}").orderBy("place").collect()]
    assert "B_2021_y|1" in refs(1) and len(refs(1)) == 3
    assert "B_2021_y|1" not in refs(2) and not refs(3)  # no room left
    wider = select.choose(full, q, low=2, high=4).where("question_id = 2")
    assert "B_2021_y|1" in [r["table_ref"] for r in wider.collect()]  # the income statement that a ratio needs
    b = spark.createDataFrame([(3, 2, False), (2, 0, False), (1, 3, False), (1, 1, True), (0, 0, False)], "t int, y int, d boolean").select(select.budget(F.col("t"), F.col("y"), F.col("d")).alias("b"))
    assert [r["b"] for r in b.collect()] == [6, 2, 6, 3, 2]


def test_context(spark, facts):
    notes = context.ambiguity_notes(facts).collect()
    assert [(r["table_ref"], r["item"], r["codes"]) for r in notes] == [("a|1", "- Nguyên giá", ["222", "228"])]
    text = {r["table_ref"]: r["schema"] for r in context.schemas(facts).collect()}
    assert "item_code in 222, 228" in text["a|1"] and "ambiguous" not in text["b|2"] and "years: 2020" in text["b|2"]
    q = spark.createDataFrame([(1, "Lợi nhuận sau thuế năm 2020?"), (2, "zzz")], "question_id long, question string")
    chosen = spark.createDataFrame([(1, "a|1"), (1, "b|2"), (2, "a|1")], "question_id long, table_ref string")
    rows = context.anchors(q, chosen, facts).collect()
    assert [(r["question_id"], r["keyword"]) for r in rows if r["best"]] == [(1, "Lợi nhuận sau thuế")] and all(r["question_id"] == 1 for r in rows)
    assert context.formulas(["quick_ratio"]) == "quick_ratio = (current_assets - inventory) / current_liabilities" and len(context.formulas().splitlines()) == 8
    assert "opening" in context.period_hint("opening") and context.period_hint(None) == "" and context.variables(["a|1", "b|2"]) == {"df1": "a|1", "df2": "b|2"}


def test_sandbox(spark, facts):
    frames = context.frames_of(facts, ["a|1", "b|2"])
    kind = lambda text, **k: sandbox.run(spark, text, frames, **k).error_type
    assert sandbox.run(spark, "SELECT a.value / b.value AS result FROM df1 AS a, df2 AS b WHERE a.item = 'Tổng tài sản' AND b.item LIKE '%sau thuế'", frames).value == pytest.approx(10 / 3)
    assert sandbox.run(spark, "WITH x AS (SELECT max(value) AS m FROM all_df) SELECT m FROM x", frames).value == 10.0
    assert kind("DROP TABLE df1") == "UnsafeCodeError" and kind("SELECT reflect('java.lang.System', 'exit', 0)") == "UnsafeCodeError" and kind("SELECT 1; SELECT 2") == "UnsafeCodeError"
    assert kind("SELECT count(*) FROM parquet.`/root/testdata/sf0.001/nation.parquet`") == "NameError" and kind("SELECT (SELECT max(value) FROM other) FROM df1") == "NameError"
    assert kind("SELECT nope FROM df1") == "KeyError" and kind("SELECT (value FROM df1") == "SyntaxError" and kind("SELECT value FROM df1") == "ResultTypeError" and kind("SELECT item FROM df1 LIMIT 1") == "ResultTypeError"
    empty = sandbox.run(spark, "SELECT sum(value) AS result FROM df1 WHERE item LIKE '%sau thuế%'", frames)
    assert empty.error_type == "EmptyFilterError" and "'sau thuế' is in df2" in sandbox.diagnose(empty, frames)
    assert any("items of df1" in h for h in sandbox.diagnose(sandbox.run(spark, "SELECT sum(value) FROM df1 WHERE item LIKE '%zzz%'", frames), frames))
    slow = "SELECT sum(a.id * b.id % 7) AS result FROM range(3000000) AS a, range(3000000) AS b WHERE a.id + b.id % 11 <> 3"
    assert kind(slow, timeout=3.0) == "TimeoutError"
    seen = []

    def write(question, hints, last):
        seen.append(hints)
        return "```sql\nSELECT max(value) AS result FROM df1\n```"

    fixed = sandbox.repair(spark, "?", "SELECT nope FROM df1", frames, write)
    assert (fixed.value, fixed.attempt, len(seen)) == (10.0, 2, 1) and "columns" in seen[0]
    assert sandbox.repair(spark, "?", "no query", frames).value == 0.0 and sandbox.repair(spark, "?", "SELECT nope FROM df1", frames).value == 0.0
    assert sandbox.extract_query("text ```python\nx = 1\n``` and ```\nselect 1;\n```") == "select 1" and sandbox.extract_query(None) == ""
    assert len(sandbox.warnings_of("SELECT value FROM df1 WHERE item = 'x'")) == 2
    assert not [t for t in spark.catalog.listTables() if t.name in ("df1", "df2", "all_df")]


def test_submission(spark, tmp_path):
    q = spark.createDataFrame([(1, "Tài sản bao nhiêu tỷ đồng?"), (2, "Lợi nhuận?")], "id long, question string")
    chosen = spark.createDataFrame([(1, "VNM 2020|3", 1), (1, "VNM 2020|4", 2), (1, "VNM 2020|3", 3)], "question_id long, table_ref string, place int")
    items = submit.build(q, chosen, spark.createDataFrame([(1, 3.0e9, "SELECT 1")], "id long, value double, query string"))
    a, b = items.orderBy("id").collect()
    assert (a["answer"], a["relevant_docs"], a["relevant_tables"]) == (3.0, ["VNM 2020"], ["VNM 2020|3", "VNM 2020|4"]) and [e["csv_path"] for e in a["evidence"]] == ["data/VNM_2020_table_3.csv", "data/VNM_2020_table_4.csv"]
    assert (b["answer"], b["relevant_docs"], b["query"]) == (0.0, [], "")
    z = zipfile.ZipFile(BytesIO(submit.hand_in(items, {"data/VNM_2020_table_3.csv": "x", "other.csv": "y"}, q)))
    assert z.namelist() == ["answers.json", "data/VNM_2020_table_3.csv"] and [x["id"] for x in json.loads(z.read("answers.json"))] == [1, 2]
    with pytest.raises(ValueError):
        submit.hand_in(items, {}, spark.createDataFrame([(1,), (2,), (3,)], "id long"))
    docs = spark.createDataFrame([("a|1", "one two"), ("b|1", "two")], "table_ref string, text string")
    index = retrieve.build_bm25(docs, "table_ref", "text")
    submit.save_index(index, str(tmp_path / "index"))
    again = submit.load_index(spark, str(tmp_path / "index"))
    assert again["postings"].count() == index["postings"].count()
    submit.verify_or_raise(docs, docs, again)
    with pytest.raises(RuntimeError):
        submit.verify_or_raise(docs.where("table_ref = 'a|1'"), docs, again)
    m = spark.createDataFrame([("VNM", "d1"), ("HPG", "d2")], "ticker string, doc_id string")
    assert submit.corpus_state(m, m).first()["ok"] and not submit.corpus_state(m.limit(1), m).first()["ok"]
