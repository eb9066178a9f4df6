"""Reports rendered from orders, so that extraction can be held against plain aggregates, and small files to read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.sources.paths import Output, handle


def grouped(whole: Column) -> Column:
    """A whole number as 1.234.567."""
    return F.regexp_replace(whole.cast("string"), r"(?<=\d)(?=(?:\d{3})+$)", ".")


def vn_number(cents: Column) -> Column:
    """Cents (long) as 1.234,56; negative in brackets."""
    whole, part = F.abs(cents) / 100, F.pmod(F.abs(cents), F.lit(100))
    text = F.concat(grouped(F.floor(whole)), F.lit(","), F.lpad(part.cast("string"), 2, "0"))
    return F.when(cents < 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)


def order_totals(orders: DataFrame) -> DataFrame:
    """year, priority, cents: order totals summed exactly."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return orders.groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("priority")).agg(F.sum(cents).alias("cents"))


def reports(orders: DataFrame) -> DataFrame:
    """doc_id, text: a report a year with its totals and the year before's, as an inline table under a page mark."""
    t = order_totals(orders)
    wide = t.alias("a").join(t.select((F.col("year") + 1).alias("year"), "priority", F.col("cents").alias("before")), ["year", "priority"], "left")
    row = F.concat(F.lit("<tr><td>"), F.col("priority"), F.lit("</td><td>"), vn_number(F.col("cents")), F.lit("</td><td>"), F.coalesce(vn_number(F.col("before")), F.lit("-")), F.lit("</td></tr>"))
    rows = wide.groupBy("year").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("priority", row.alias("row")))), lambda x: x["row"]), "").alias("rows"))
    y = F.col("year").cast("string")
    text = F.concat(
        F.lit("===== PAGE 7 =====\nCông ty ABC\nBÁO CÁO KẾT QUẢ HOẠT ĐỘNG KINH DOANH\nĐơn vị tính: đồng\n<table><tr><th>Chỉ tiêu</th><th>31/12/"), y, F.lit("</th><th>01/01/"), y, F.lit("</th></tr>"), F.col("rows"), F.lit("</table>\n")
    )
    return rows.select(F.concat(F.lit("ABC_"), y).alias("doc_id"), text.alias("text"), F.col("year").alias("fallback_year"))


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that goes with the application: in spark.checkpoint.dir, or on a local master without it in the temporary folder."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.gettempdir()
    path = f"{base.rstrip('/')}/{sc.applicationId}-{label}-{uuid.uuid4().hex[:12]}"
    fs, p = handle(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def kept(df: DataFrame, label: str) -> DataFrame:
    """df written once to a scratch folder and read from there: what reads it again and again does not compute it again."""
    path = f"{scratch(df.sparkSession, label)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_files(spark: SparkSession, label: str, bodies: dict[str, bytes]) -> str:
    """A scratch folder with these small files; its path."""
    root = scratch(spark, label)
    for name, body in bodies.items():
        with Output(spark, f"{root}/{name}") as out:
            out.write(body)
    return root
