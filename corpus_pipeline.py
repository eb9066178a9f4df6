"""documents -> a training corpus, stage by stage; each stage works on all that the one before kept.

All stages but the last return the columns of their documents, whatever else
these hold; extra columns with names of any kind pass through. An empty table
stays empty. What each stage does with null, empty and equal rows is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerspark.llm import byte_cnn, decontam, mixing, simhash, token_files
from ledgerspark.llm.common import new_path, table
from ledgerspark.llm.queries import tokenizer_path

#: No SQL for a trained classifier, XXH64 fingerprints or a tokenizer: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more.

    A document goes or stays by its text: null and empty texts by the score of
    an empty text, equal texts together; null ids and sources play no part.
    """
    return byte_cnn.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the one with the smallest id, then the smallest hash of its text.

    Null and empty texts form a group; wholly equal rows count as one document;
    rows with a null id cannot be named and all stay.
    """
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    A document goes or stays by its text; null and empty texts hold no passage
    and stay, and so do null ids; equal rows share their fate.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, not at all to twice.

    A null source is one of its own, last in order; null and empty texts have no
    words and are taken once; equal rows are documents of their own, and which
    of them gets an odd copy makes no difference.
    """
    return mixing.repeated(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, read back from the token files.

    Null texts are empty ones, of the end id alone; null ids come first; the
    copies that the mix made are rows of their own, with places of their own.
    """
    return token_files.encode_and_read(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokenize", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between two, the rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
