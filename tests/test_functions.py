import datetime

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import numbers, periods, terms, text, units
from ledgerspark.operators import evaluate, extract, retrieve, standardize
from ledgerspark.plans import answer, cards
from ledgerspark.sources import corpus
from ledgerspark.streaming import incremental


def one(spark, cases, kind, build):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("c")).alias("x")).collect()]


NUMBERS = {
    "1.234": 1234.0, "12,5": 12.5, "(1.234)": -1234.0, "(-1.234)": 1234.0, "1a2b": None, "": None, "-": None, "n/a": None, None: None, "1.234.567,89": 1234567.89, "1,234,567.89": 1234567.89,
    "-5": -5.0, "+5": 5.0, "12%": 12.0, "l.234": 1234.0, "1 234": 1234.0, "abc": None, "..": None, " '7' ": 7.0, "0,123": 123.0, ",123": 0.123,
}


def test_numbers(spark):
    assert one(spark, list(NUMBERS), "string", numbers.parse_number) == list(NUMBERS.values())
    assert one(spark, ["12,5%"], "string", lambda c: numbers.parse_number(c, as_ratio=True, scale=1000.0)) == [125.0]
    assert one(spark, ["1.2341.235", "-", "12.345-", "x", " "], "string", numbers.split_glued) == [["1.234", "1.235"], ["-"], ["12.345", "-"], ["x"], []]
    assert one(spark, ["Đơn vị tính: triệu đồng", "ĐVT: tỷ đồng", "VND", "", None, "nghìn đồng"], "string", lambda c: numbers.detect_unit(c)["scale"]) == [1e6, 1e9, 1.0, 1.0, 1.0, 1e3]


def test_text(spark):
    assert one(spark, ["Đường  Nguyễn Huệ ", "École"], "string", text.normalize_text) == ["duong nguyen hue", "ecole"]
    assert one(spark, ["Tổng tài sản của Công ty"], "string", text.tokenize) == [["tong", "tai", "san"]]
    assert one(spark, ["A b--C"], "string", text.slugify) == ["a_b_c"]
    assert one(spark, ["x\x07.....  \ntrang 3\nTAI SAN"], "string", text.fix_ocr_text) == ["x..\nTÀI SẢN"]


PERIODS = {
    "31/12/2015": (2015, "closing", "31/12/2015"), "01/01/2015": (2014, "opening", "01/01/2015"), "30.6.2020": (2020, "point_in_time", "30.6.2020"), "45/13/2020": (2020, "unknown", "45/13/2020"), "Năm 2019": (2019, "annual", None),
    "Số đầu năm": (2021, "opening", None), "Số cuối kỳ": (2022, "closing", None), "Năm trước": (2021, "annual", None), "Chỉ tiêu": None, "": None, "Theo báo cáo kiểm toán 2020": None, "2019 và 2020": None,
}


def test_periods(spark):
    got = one(spark, list(PERIODS), "string", lambda c: periods.parse_period(c, F.lit(2022)))
    assert [tuple(g) if g else None for g in got] == list(PERIODS.values())
    assert one(spark, ["Số đầu năm"], "string", periods.parse_period) == [None]
    assert one(spark, ["từ đầu năm đến cuối năm", "tại ngày 31/12/2020", "trong năm", "?"], "string", periods.requested_period) == ["opening", "closing", "annual", None]


ASKED = {"là bao nhiêu tỷ đồng?": "ty_dong", "bao nhiêu nghìn tỷ đồng": "nghin_ty_dong", "trăm tỷ": "tram_ty_dong", "bao nhiêu phần trăm": "percent", "gấp bao nhiêu lần": "times", "bao nhiêu đồng": "dong", "triệu đồng": "trieu_dong", "?": "none"}
CONVERT = [(2.5e12, "ty_dong", None, 2500.0), (2500.0, "ty_dong", None, 2.5), (0.0, "ty_dong", None, 0.0), (5e6, "trieu_dong", None, 5.0), (3.2e12, "nghin_ty_dong", None, 3.2), (2500.0, "ty_dong", "trieu_dong", 2.5), (12.345, "percent", None, 12.35), (3e11, "tram_ty_dong", None, 3.0), (0.001, "none", None, 0.001)]


def test_units(spark):
    assert one(spark, list(ASKED), "string", units.asked_unit) == list(ASKED.values())
    df = spark.createDataFrame(CONVERT, "v double, a string, s string, want double")
    assert all(abs(r.got - r.want) < 1e-9 for r in df.select("want", units.convert(F.col("v"), F.col("a"), F.col("s")).alias("got")).collect())


def test_terms(spark):
    assert one(spark, ["Lợi nhuận sau thuế chưa phân phối", "Tổng tài sản và vốn chủ sở hữu", "khác"], "string", terms.metrics) == [["retained_earnings"], ["total_assets", "equity"], []]
    assert one(spark, ["ROE năm 2020"], "string", terms.has_derived) == [True]


REPORT = """===== PAGE 8 =====
Công ty ABC
BẢNG CÂN ĐỐI KẾ TOÁN
Đơn vị tính: triệu đồng
<table><tr><td>Mã số</td><td>Chỉ tiêu</td><td>Số cuối năm</td><td>Số đầu năm</td></tr><tr><td></td><td>A. TÀI SẢN NGẮN HẠN</td><td></td><td></td></tr><tr><td>110</td><td>Tiền mặt</td><td rowspan="2">1.0002.000</td><td>(500)</td></tr><tr><td>120</td><td>Hàng tồn kho</td><td>1.500</td></tr></table>
===== PAGE 9 =====
<table><tr><td>270</td><td>Tổng tài sản</td><td>3.000</td><td>2.000</td></tr><tr><td>280</td><td>Khác</td><td>-</td><td>7</td></tr></table>"""


def test_report_to_facts(spark):
    docs = spark.createDataFrame([("ABC_2020", REPORT), ("ABC_2021", "x | 2020 | 2019\n--- | --- | ---\nDoanh thu | 1.000 | 900\nChi phí | 500 | 400"), ("ABC_2022", "no table here"), ("ABC_2023", None)], "doc_id string, text string")
    tables = extract.extract_tables(docs)
    rows = {r["table_ref"]: r for r in tables.collect()}
    assert set(rows) == {"ABC_2020|1", "ABC_2021|1"}
    t = rows["ABC_2020|1"]
    assert (t["page"], t["section"], t["unit"], len(t["rows"]), t["title"]) == (8, "balance_sheet", "trieu dong", 6, "BẢNG CÂN ĐỐI KẾ TOÁN")
    facts = standardize.to_facts(tables.withColumns({"ticker": F.lit("ABC"), "fallback_year": F.lit(2020)}))
    assert facts.columns == list(standardize.COLUMNS)
    got = {(r["item"], r["year"], r["period"]): (r["value"], r["item_code"], r["metric"]) for r in facts.where("table_ref = 'ABC_2020|1'").collect()}
    assert got["A. TÀI SẢN NGẮN HẠN - Tiền mặt", 2020, "closing"][:2] == (1000e6, "110")
    assert got["A. TÀI SẢN NGẮN HẠN - Tiền mặt", 2019, "opening"][0] == -500e6
    assert got["A. TÀI SẢN NGẮN HẠN - Hàng tồn kho", 2020, "closing"][0] == 2000e6
    assert {k[0].split(" - ")[-1] for k in got} == {"Tiền mặt", "Hàng tồn kho", "Tổng tài sản", "Khác"}
    assert facts.groupBy("table_ref", "row_idx", "column_label").count().where("count > 1").count() == 0
    assert "Hàng tồn kho" in cards.cards(facts).where("table_ref = 'ABC_2020|1'").first()["card"]
    q = answer.Query(1, keyword="tổng tài sản", years=(2020,), period="closing", unit="ty_dong")
    assert answer.answer(facts, q).first()["value"] == 3.0
    assert answer.relaxed(facts, answer.Query(2, keyword="tổng tài sản", years=(1999,), unit="ty_dong")).first()["tries"] == 2
    with pytest.raises(ValueError):
        answer.check_sql(spark, "DROP TABLE x")
    answer.check_sql(spark, "SELECT 1")


def test_grid():
    grid = extract.decode_grid("<tr><td rowspan=3>n</td><td rowspan='2'>1.234-</td><td colspan=2>w</td></tr><tr><td>a</td><td>b</td></tr><tr><td>x</td><td>y&amp;z</td></tr>")
    assert grid == [["n", "1.234", "w", ""], ["n", "-", "a", "b"], ["n", "x", "y&z", ""]]
    assert extract.decode_grid("<tr><td rowspan=2>5.000</td><td>a</td></tr><tr><td>b</td></tr>") == [["5.000", "a"], ["", "b"]]


def test_header_and_names(spark):
    df = spark.createDataFrame([([["x", "y"], ["Chỉ tiêu", "2020"], ["a", "1"]],), ([["1", "2"], ["3", "4"], ["5", "6"]],)], "rows array<array<string>>")
    assert [r[0] for r in df.select(standardize.header_row(F.col("rows"))).collect()] == [1, None]
    assert one(spark, [["a", "", "a", " b  c ", "a"]], "array<string>", standardize.clean_columns) == [["a", "col_1", "a_1", "b c", "a_2"]]


def test_questions(spark):
    q = spark.createDataFrame([(1, "Lợi nhuận sau thuế của (VNM) từ 2018 đến 2020 là bao nhiêu tỷ đồng?"), (2, "So với HPG, ROE hợp nhất năm 2021 của kbc?")], "id int, question string")
    a, b = retrieve.analyze(q, ["VNM", "HPG", "KBC"]).orderBy("id").collect()
    assert (a["tickers"], a["years"], a["metrics"], a["asked_unit"], a["is_comparison"]) == (["VNM"], [2018, 2019, 2020], ["profit_after_tax"], "ty_dong", True)
    assert (b["tickers"], b["years"], b["needs_derived"], b["report_type"], b["is_comparison"]) == (["HPG", "KBC"], [2021], True, "consolidated", True)


def test_cover(spark):
    pool = spark.createDataFrame([(1, "a|1", "A", 2020, "balance_sheet", 9.0), (1, "a|2", "A", 2020, "balance_sheet", 8.0), (1, "b|1", "B", 2020, "income_statement", 1.0), (1, "c|1", "A", 2020, "balance_sheet", 0.5)], "question_id int, table_ref string, ticker string, year int, section string, score double")
    assert {r["table_ref"] for r in retrieve.cover(pool, max_tables=3).collect()} == {"a|1", "a|2", "b|1"}


def test_scores(spark):
    df = spark.createDataFrame([(["a", "b"], ["a"]), ([], ["a"]), ([], []), (["a"], [])], "p array<string>, g array<string>")
    assert [tuple(round(x, 6) for x in r[0]) for r in df.select(evaluate.prf2(F.col("p"), F.col("g"))).collect()] == [(0.5, 1.0, round(5 * 0.5 / 3, 6)), (0, 0, 0), (1, 1, 1), (0, 1, 0)]
    df = spark.createDataFrame([(100.5, 100.0), (102.0, 100.0), (None, None), (float("nan"), 1.0), (1e-7, 0.0), (None, 1.0)], "p double, g double")
    assert [r[0] for r in df.select(evaluate.answer_correct(F.col("p"), F.col("g"))).collect()] == [True, False, True, False, True, False]


def test_report_files(spark, tmp_path):
    d = tmp_path / "raw" / "VNM" / "2020"
    d.mkdir(parents=True)
    (d / "VNM_2020_Hopnhat_extracted.txt").write_bytes("Năm\nhai".encode())
    (tmp_path / "raw" / "hpg-riengle-2019.txt").write_bytes("caf\xe9".encode("latin-1"))
    got = {r["doc_id"]: r for r in corpus.read_reports(spark, str(tmp_path / "raw")).collect()}
    v, h = got["VNM_2020_Hopnhat"], got["hpg-riengle-2019"]
    assert (v["ticker"], v["year"], v["report_type"], v["n_lines"], v["text"]) == ("VNM", 2020, "consolidated", 2, "Năm\nhai")
    assert (h["ticker"], h["year"], h["report_type"], h["text"]) == ("HPG", 2019, "separate", "café")
    seen = []
    stream = incremental.new_reports(spark, str(tmp_path / "raw"))
    for _ in range(2):
        incremental.run(stream, str(tmp_path / "check"), lambda df, i: seen.extend(r["doc_id"] for r in df.collect())).awaitTermination()
    assert sorted(seen) == sorted(got)


def test_manifest_and_package(spark, tmp_path):
    path = str(tmp_path / "manifest")
    make = lambda *r: spark.createDataFrame(list(r), "table_ref string, doc_id string")
    corpus.write_manifest(make(("a|1", "x"), ("b|1", "y")), path)
    corpus.write_manifest(make(("b|1", "z"), ("c|1", "w")), path, "upsert")
    assert sorted((r["table_ref"], r["doc_id"]) for r in spark.read.json(path).collect()) == [("a|1", "x"), ("b|1", "z"), ("c|1", "w")]
    with pytest.raises(ValueError):
        corpus.write_manifest(make(), path, "append")
    files, answers = {"a.csv": "1", "b.csv": "2"}, [{"id": 1, "evidence": [{"csv_path": "a.csv"}]}]
    assert corpus.package(answers, files) == corpus.package(answers, dict(reversed(files.items()))) and b"b.csv" not in corpus.package(answers, files)
    m = evaluate.integrity(make(("a|1", "x"), ("a|1", "x")), make(("a|1", "x"), ("d|1", "q"))).first()
    assert (m["entries"], m["missing"], m["orphans"], m["repeated"], m["ok"]) == (2, 0, 1, 1, False)


def test_windows_on_a_table(spark):
    at = datetime.datetime(2024, 1, 1, 5, 30)
    df = spark.createDataFrame([(at, "a", 1.0), (at, "a", 2.0)], "ts timestamp, event_type string, value double")
    assert [(r["n"], r["total"]) for r in incremental.windowed_counts(df).collect()] == [(2, 3.0)]
