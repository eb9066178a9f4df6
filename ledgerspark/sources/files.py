"""JSON, JSON lines and CSV in and out, tables as CSV files, manifests rebuilt from them, copies with retries."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerspark.plans.cards import first_distinct
from ledgerspark.sources.corpus import csv_name, report_type_of, year_of
from ledgerspark.sources.paths import Output, handle, settle, swap

CARD_ITEMS, CARD_COLUMNS = 15, 8
FIRST_WAIT, LONGEST_WAIT, TRIES = 10.0, 300.0, 8


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON array or object a file."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON object a line; blank lines are passed over. A schema saves the pass that infers one."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_csv(spark: SparkSession, path: str, rows: int | None = None, schema: str | None = None) -> DataFrame:
    """CSV with a header, a byte order mark or none, quoted line breaks; rows bounds how many come back."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    found = (r.schema(schema) if schema else r).csv(path)
    return found if rows is None else found.limit(rows)


def write_text_atomic(spark: SparkSession, text: str, path: str) -> None:
    """A small file that is there in full, as it was or as it is to be: written beside its place, then renamed over it."""
    with Output(spark, path) as out:
        out.write(text.encode())


def write_jsonl(df: DataFrame, path: str) -> int:
    """A folder of JSON lines, complete before it takes the old one's place; the number of rows, counted while writing."""
    settle(df.sparkSession, path)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(f"{path.rstrip('/')}.new")
    swap(df.sparkSession, path)
    return seen.get["n"]


def csv_files(facts: DataFrame, prefix: str = "") -> DataFrame:
    """(table_ref, csv_path, body): each table as one CSV text with header, rows in order; nothing larger than a table is gathered."""
    columns = [c for c in facts.columns]
    row = F.to_csv(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]))
    lines = facts.groupBy("table_ref").agg(F.array_sort(F.collect_list(F.struct("row_idx", "column_label", row.alias("line")))).alias("l"))
    body = F.concat(F.lit(",".join(columns) + "\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n"))
    name = csv_name(F.substring_index("table_ref", "|", 1), F.substring_index("table_ref", "|", -1))
    return lines.select("table_ref", F.concat(F.lit(prefix), name).alias("csv_path"), body.alias("body"))


def resolve_local(spark: SparkSession, path: str, roots: list[str]) -> str | None:
    """The first of path itself and its file name under each root that exists."""
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    for candidate in [path, *(f"{r.rstrip('/')}/{name}" for r in roots)]:
        fs, p = handle(spark, candidate)
        if fs.exists(p):
            return candidate
    return None


def rebuild_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The manifest of CSV files named <doc>_table_<n>.csv below root: one scan, a card from the first items and columns."""
    pattern = r"([^/]*)_table_(\d+)\.csv$"
    rows = spark.read.option("header", True).option("escape", '"').option("recursiveFileLookup", True).option("pathGlobFilter", "*_table_*.csv").csv(root)
    path = F.url_decode(F.col("_metadata.file_path"))
    found = rows.withColumn("_path", path).withColumns({"doc_id": F.regexp_extract("_path", pattern, 1), "position": F.regexp_extract("_path", pattern, 2).cast("int")}).where("position is not null")
    item = F.when(F.length("item") > 2, F.col("item"))
    m = found.groupBy("doc_id", "position").agg(
        first_distinct(item, F.col("row_idx").cast("int"), CARD_ITEMS).alias("items"), first_distinct(F.when(F.col("column_label") != "", F.col("column_label")), F.col("row_idx").cast("int"), CARD_COLUMNS).alias("labels"),
        F.count("*").alias("n_rows"), F.min("section").alias("section"), F.min("unit").alias("unit"),
    )
    kind: Column = report_type_of(F.col("doc_id"))
    card = F.concat_ws("\n", F.col("doc_id"), F.array_join("items", "; "), F.array_join("labels", "; "))
    return m.select(
        F.concat_ws("|", "doc_id", "position").alias("table_ref"), "doc_id", "position", csv_name(F.col("doc_id"), F.col("position")).alias("csv_path"), F.upper(F.regexp_extract("doc_id", "^([0-9A-Za-z]{3,5})(?:_|-|$)", 1)).alias("ticker"),
        year_of(F.lit(""), F.col("doc_id")).alias("year"), kind.alias("report_type"), "section", "unit", "n_rows", card.alias("card"),
    )


def with_retries(act: Callable[[], object], tries: int = TRIES, wait: Callable[[float], None] = time.sleep) -> object:
    """act(), again after 10, 20, 40 ... 300 seconds where it raises OSError; the last error is raised."""
    for i in range(tries):
        try:
            return act()
        except OSError:
            if i == tries - 1:
                raise
            wait(min(LONGEST_WAIT, FIRST_WAIT * 2**i))


def fetch(spark: SparkSession, source: str, target: str) -> None:
    """Copies a tree between any two file systems that Hadoop knows, with retries."""
    from_fs, from_path = handle(spark, source)
    to_fs, to_path = handle(spark, target)
    util, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil, spark.sparkContext._jsc.hadoopConfiguration()

    def copy() -> None:
        try:
            done = util.copy(from_fs, from_path, to_fs, to_path, False, True, conf)
        except Exception as e:  # errors of the JVM
            raise OSError(f"could not copy {source}: {e}") from e
        if not done:
            raise OSError(f"could not copy {source}")

    with_retries(copy)
