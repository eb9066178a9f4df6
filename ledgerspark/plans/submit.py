"""Answers as they are handed in: units, evidence, order of references, staging, index checks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions.units import asked_unit, convert
from ledgerspark.operators.evaluate import check_submission, integrity
from ledgerspark.sources.corpus import csv_name, package, write_package
from ledgerspark.sources.paths import handle

FALLBACK, PREFIX = 0.0, "data/"
# Codes of banks and brokers, whose statements carry other magnitudes.
FINANCIAL = ("BID", "SHB", "STB", "ACB", "CTG", "VCB", "TCB", "MBB", "VIB", "VPB", "TPB", "HDB", "MSB", "LPB", "FTS", "SSI", "VND", "HCM")


def csv_path(doc_id: Column, position: Column, prefix: str = PREFIX) -> Column:
    return F.concat(F.lit(prefix), csv_name(doc_id, position))


def build(questions: DataFrame, chosen: DataFrame, results: DataFrame, fallback: float = FALLBACK, scaled: bool = True) -> DataFrame:
    """id, question, answer, relevant_docs, relevant_tables, evidence, csv_paths, query: one row a question.

    questions (id, question); chosen (question_id, table_ref, place[, unit]);
    results (id, value, query). Values are in base currency and are converted
    to the unit asked; a missing or non-finite value is the fallback. scaled
    False reads values in the unit of the first table. Documents and tables keep
    the order of choice and appear once.
    """
    doc, pos = F.substring_index("table_ref", "|", 1), F.substring_index("table_ref", "|", -1)
    unit = F.col("unit") if "unit" in chosen.columns else F.lit(None).cast("string")
    first = chosen.groupBy("question_id", "table_ref").agg(F.min("place").alias("place"), F.min(unit).alias("unit"))
    refs = first.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("place", "table_ref", doc.alias("doc_id"), csv_path(doc, pos).alias("path"), "unit"))).alias("t"))
    rows = questions.select("id", "question").join(refs.select(F.col("question_id").alias("id"), "t"), "id", "left").join(results.select("id", "value", "query"), "id", "left")
    t = F.coalesce("t", F.array().cast(refs.schema["t"].dataType))
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    bank = F.exists(F.array(*map(F.lit, FINANCIAL)), lambda c: F.contains(F.col("question"), c))
    source = F.lit(None).cast("string") if scaled else F.replace(F.get(t, F.lit(0))["unit"], F.lit(" "), F.lit("_"))
    answer = F.when(finite, convert(F.col("value"), asked_unit(F.col("question")), source, bank)).otherwise(F.lit(float(fallback)))
    return rows.select(
        "id", "question", answer.alias("answer"), F.array_distinct(F.transform(t, lambda x: x["doc_id"])).alias("relevant_docs"), F.transform(t, lambda x: x["table_ref"]).alias("relevant_tables"),
        F.transform(t, lambda x, i: F.struct(F.concat(F.lit("df"), (i + 1).cast("string")).alias("variable"), x["path"].alias("csv_path"))).alias("evidence"), F.transform(t, lambda x: x["path"]).alias("csv_paths"), F.coalesce("query", F.lit("")).alias("query"),
    )


def refuse_broken(items: DataFrame, expected: DataFrame | None) -> None:
    """Raises with the first broken rules of level error."""
    bad = check_submission(items, expected).where("level = 'error'").orderBy("id", "message").limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"{r['id']}: {r['message']}" for r in bad))


def answers_of(items: DataFrame) -> Iterator[dict]:
    """The answers in order of id, a partition at a time."""
    return (json.loads(r) for r in items.drop("csv_paths").orderBy("id").toJSON().toLocalIterator())


def hand_in(items: DataFrame, files: dict[str, str], expected: DataFrame | None = None, strict: bool = True) -> bytes:
    """The zip of answers and the files that they cite, in memory; with strict, a broken rule of level error raises."""
    if strict:
        refuse_broken(items, expected)
    return package(list(answers_of(items)), files)


def hand_in_to(out: BinaryIO, items: DataFrame, bodies: DataFrame, expected: DataFrame | None = None, strict: bool = True) -> None:
    """hand_in() as a stream: bodies (csv_path, body) of the cited tables, in order of path; the driver holds a partition of either at most."""
    if strict:
        refuse_broken(items, expected)
    write_package(out, answers_of(items), ((r["csv_path"], r["body"]) for r in bodies.select("csv_path", "body").orderBy("csv_path").toLocalIterator()))


def check_index(manifest: DataFrame, index: dict[str, DataFrame], vectors: DataFrame | None, key: str = "table_ref") -> list[str]:
    """Errors where an index does not hold as many tables as the manifest; vectors None where dense search is not used."""
    want = manifest.select(key).distinct().count()
    parts = {"BM25": index["postings"].select("ref").distinct()} | ({"vectors": vectors.select("ref").distinct()} if vectors is not None else {})
    return [f"{name} index holds {n} tables, the manifest {want}" for name, df in parts.items() if (n := df.count()) != want]


def verify_or_raise(manifest: DataFrame, files: DataFrame, index: dict[str, DataFrame], vectors: DataFrame | None = None) -> None:
    """Before answering: manifest, files and indexes agree."""
    errors = check_index(manifest, index, vectors)
    state = integrity(manifest, files).first()
    if not state["ok"]:
        errors.append(f"manifest and files differ: {state.asDict()}")
    if errors:
        raise RuntimeError("; ".join(errors))


def corpus_state(manifest: DataFrame, raw: DataFrame, min_tickers: float = 0.9) -> DataFrame:
    """One row: documents, tickers of manifest and raw reports, and whether enough tickers are covered."""
    m, r = (d.select("ticker").where("ticker is not null").distinct() for d in (manifest, raw))
    both = m.withColumn("m", F.lit(1)).join(r.withColumn("r", F.lit(1)), "ticker", "full_outer").agg(F.count("m").alias("tickers"), F.count("r").alias("raw_tickers"), F.count_if(F.col("m").isNotNull() & F.col("r").isNotNull()).alias("covered"))
    docs = manifest.agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("entries"))
    return docs.crossJoin(both).withColumn("ok", F.col("covered") >= min_tickers * F.col("raw_tickers"))  # two rows of one row each


def card_text() -> Column:
    """What is indexed of a manifest row: its card, or what else tells of the table where it has none."""
    rest = F.concat_ws(" ", "ticker", F.col("year").cast("string"), "section", "title", "unit", "table_ref")
    return F.when(F.trim(F.coalesce("card", F.lit(""))) != "", F.col("card")).otherwise(rest)


def save_index(index: dict[str, DataFrame], path: str) -> None:
    """BM25 as Parquet: postings sorted by term, so that a query's terms prune row groups; terms and vectors, where there are any, beside them."""
    index["postings"].repartitionByRange("term").sortWithinPartitions("term", "ref").write.mode("overwrite").parquet(f"{path}/postings")
    index["terms"].repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    if "vectors" in index:
        index["vectors"].write.mode("overwrite").parquet(f"{path}/vectors")


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    fs, vectors = handle(spark, f"{path}/vectors")
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", *["vectors"] * fs.exists(vectors))}
