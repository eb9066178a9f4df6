from pyspark.sql import functions as F

from ledgerspark.functions import register, text

WORDS = ["Công ty Đường  Quảng\tNgãi", "", None, "ÉÀ x_1"]
HTML = "===== PAGE 3 =====\n<table><tr><td rowspan=2>a</td><td>1</td></tr><tr><td>2</td></tr></table>"


def test_sql_functions(spark):
    assert register.register(spark) == ["fold", "normalize_text", "tokenize", "decode_grid", "find_tables", "extract_tables"]
    df = spark.createDataFrame([(w,) for w in WORDS], "s string")
    df.createOrReplaceTempView("words")
    got = spark.sql("SELECT fold(s), normalize_text(s), tokenize(s) FROM words").collect()
    want = df.select(text.fold(F.col("s")), text.normalize_text(F.col("s")), text.tokenize(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    spark.createDataFrame([(1, HTML), (2, None), (3, "none")], "id int, text string").createOrReplaceTempView("docs")
    rows = spark.sql("SELECT d.id, t.position, t.page, t.rows FROM docs AS d, LATERAL extract_tables(d.text) AS t").collect()
    assert [tuple(r) for r in rows] == [(1, 1, 3, [["a", "1"], ["a", "2"]])]
    assert spark.sql("SELECT decode_grid('<tr><td>x</td></tr>') AS g, decode_grid(CAST(NULL AS STRING)) AS n").first().asDict() == {"g": [["x"]], "n": None}
    for v in ("words", "docs"):
        spark.catalog.dropTempView(v)
