"""Each query against its SQL in DuckDB: `python tests/compare.py [sf_dir] [names]`, and test_queries.py."""

import math
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else repr(round(v, 9))
    if v is None:
        return "null"
    if hasattr(v, "isoformat"):
        return v.isoformat().removesuffix("+00:00")
    return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in values)


def differences(spark, con, sf, run, sql):
    df = run(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        from collections import Counter

        a, b = Counter(got[1]), Counter(want[1])
        return f"{len(got[1])} and {len(want[1])} rows; only here {list((a - b).items())[:2]}; only in SQL {list((b - a).items())[:2]}"
    return ""


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = sys.argv[1]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, runs, sqls = duck(sf), e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or [n for n in runs if not n.startswith("op") and n != "pipeline"] + [n for n in sqls if n.startswith("op")]:
        began = time.time()
        try:
            said = differences(spark, con, sf, runs[name], sqls[name]) if name in sqls else f"{runs[name](spark, sf).count()} rows, no SQL"
        except Exception as x:
            said = "ERROR " + str(x)[:700]
        print(name, round(time.time() - began, 1), said[:900] or "same", flush=True)
