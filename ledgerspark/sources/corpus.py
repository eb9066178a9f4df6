"""Sources and sinks: report trees, questions, company names, facts, manifests, packages."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterable
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions.periods import YEAR
from ledgerspark.sources.paths import handle, settle, swap

FILES_A_TICKER, ROWS_A_FILE = 16, 5_000_000

# Parts of a report's name that tell its type, in order.
REPORT_TYPES = (("congtyme", "separate"), ("riengle", "separate"), ("separate", "separate"), ("rieng", "separate"), ("hopnhat", "consolidated"), ("consolidated", "consolidated"))


def doc_id_of(path: Column) -> Column:
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.regexp_replace(stem, "_extracted$", "")


def ticker_of(path: Column, doc_id: Column) -> Column:
    """The nearest folder that looks like a code, else the head of the id."""
    folders = F.filter(F.reverse(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))), lambda p: p.rlike("^[A-Z]{3,4}$"))
    head = F.upper(F.regexp_extract(doc_id, "^([^_-]+)", 1))
    return F.coalesce(F.get(folders, F.lit(0)), F.when(head.rlike("^[A-Z]{3,4}$"), head))


def year_of(path: Column, doc_id: Column) -> Column:
    """The nearest folder that is a year, else the last year in the id."""
    folders = F.filter(F.reverse(F.split(path, "/")), lambda p: p.rlike(r"^(?:19|20)\d{2}$"))
    return F.coalesce(F.get(folders, F.lit(0)), F.try_element_at(F.regexp_extract_all(doc_id, F.lit(YEAR), F.lit(1)), F.lit(-1))).try_cast("int")


def report_type_of(doc_id: Column) -> Column:
    flat, out = F.lower(F.translate(doc_id, "_- ", "")), F
    for needle, kind in REPORT_TYPES:
        out = out.when(F.contains(flat, F.lit(needle)), F.lit(kind))
    return out.otherwise(F.lit("unknown"))


def text_of(content: Column) -> Column:
    """Bytes as UTF-8, or as Latin-1 where they are not."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def read_reports(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """doc_id, path, text, ticker, year, report_type, n_lines of every .txt below root; bytes that are not UTF-8 are read as Latin-1."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").option("ignoreCorruptFiles", True).load(root)
    if limit is not None:
        raw = raw.orderBy("path").limit(limit)
    docs = raw.select("path", text_of(F.col("content")).alias("text")).withColumn("doc_id", doc_id_of(F.col("path")))
    return docs.select("doc_id", "path", "text", ticker_of(F.col("path"), F.col("doc_id")).alias("ticker"), year_of(F.col("path"), F.col("doc_id")).alias("year"), report_type_of(F.col("doc_id")).alias("report_type"), (F.regexp_count("text", F.lit("\n")) + 1).alias("n_lines"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """id, question from a JSON list, an object with questions or data, or JSON lines."""
    if path.endswith(".jsonl"):
        return spark.read.json(path)
    found = spark.read.option("multiLine", True).json(path)
    for name in ("questions", "data"):
        if name in found.columns:
            return found.select(F.explode(name).alias("q")).select("q.*")
    return found


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """code, name; an empty table where there is no file."""
    try:
        return spark.read.option("header", True).csv(path).select("code", "name")
    except Exception as error:  # a missing file is an AnalysisException
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "code string, name string")


def csv_name(doc_id: Column, position: Column) -> Column:
    return F.concat(F.btrim(F.regexp_replace(doc_id, "[^0-9A-Za-z._-]+", "_"), F.lit("_")), F.lit("_table_"), position.cast("string"), F.lit(".csv"))


def write_facts(facts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Facts as Parquet by ticker: retrieval filters on it first, and the partition prunes. A company is dealt over FILES_A_TICKER tasks and its files are bounded."""
    dealt = facts.repartition("ticker", F.pmod(F.xxhash64("table_ref"), F.lit(FILES_A_TICKER)))
    dealt.write.mode(mode).option("maxRecordsPerFile", ROWS_A_FILE).partitionBy("ticker").parquet(path)


def export_csv(facts: DataFrame, path: str) -> None:
    """One folder of CSV per table_ref, for readers outside."""
    facts.withColumn("ref", F.regexp_replace("table_ref", "[^0-9A-Za-z._-]+", "_")).repartition("ref").write.mode("overwrite").partitionBy("ref").option("header", True).csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest with ticker, year and report type worked out anew from doc_id; an unknown type counts as consolidated."""
    m = spark.read.json(path)
    kind = report_type_of(F.col("doc_id"))
    return m.withColumns({"ticker": F.upper(F.regexp_extract("doc_id", "^([0-9A-Za-z]{3,5})(?:_|-|$)", 1)), "year": year_of(F.lit(""), F.col("doc_id")), "raw_report_type": kind, "report_type": F.when(kind == "unknown", "consolidated").otherwise(kind)})


def write_manifest(manifest: DataFrame, path: str, mode: str = "full") -> None:
    """full replaces the manifest; upsert keeps what the new rows do not name. The new table is complete before it takes the old one's place."""
    from ledgerspark.operators.evaluate import upsert

    if mode not in ("full", "upsert"):
        raise ValueError(f"mode {mode!r} is neither full nor upsert")
    spark = manifest.sparkSession
    settle(spark, path)
    fs, here = handle(spark, path)
    if mode == "upsert" and fs.exists(here):
        manifest = upsert(spark.read.schema(manifest.schema).json(path), manifest)
    manifest.write.mode("overwrite").json(path.rstrip("/") + ".new")
    swap(spark, path)


def remaining(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resume: what is not done yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def write_package(out: BinaryIO, answers: Iterable[dict], files: Iterable[tuple[str, str]]) -> None:
    """A zip with one JSON and the files given, in their order and undated, so equal input gives equal bytes. One answer and one file are held at a time."""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        with z.open(zipfile.ZipInfo("answers.json"), "w") as entry:
            gap = b"[\n"
            for a in answers:
                entry.write(gap + json.dumps(a, ensure_ascii=False).encode())
                gap = b",\n"
            entry.write(b"[]" if gap == b"[\n" else b"\n]")
        for name, body in files:
            z.writestr(zipfile.ZipInfo(name), body)


def package(answers: list[dict], files: dict[str, str]) -> bytes:
    """write_package() in memory: all answers, and of the files those that answers cite, sorted."""
    cited = sorted({e["csv_path"] for a in answers for e in a.get("evidence", [])} & files.keys())
    out = io.BytesIO()
    write_package(out, answers, ((p, files[p]) for p in cited))
    return out.getvalue()
