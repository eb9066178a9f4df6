"""Incremental runs: new report files only, facts and manifest upserted batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerspark.sources.corpus import doc_id_of, report_type_of, text_of, ticker_of, year_of
from ledgerspark.sources.paths import handle


def new_reports(spark: SparkSession, root: str) -> DataFrame:
    """A stream of reports below root, one row a file."""
    raw = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(root)
    docs = raw.select("path", text_of(F.col("content")).alias("text"), doc_id_of(F.col("path")).alias("doc_id"))
    return docs.withColumns({"ticker": ticker_of(F.col("path"), F.col("doc_id")), "year": year_of(F.col("path"), F.col("doc_id")), "report_type": report_type_of(F.col("doc_id"))})


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the rows of a Parquet file or folder."""
    fs, p = handle(spark, path)
    schema = spark.read.parquet(path).schema
    if fs.getFileStatus(p).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())


def run(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Whatever is new since the checkpoint, then stop; a batch that failed is given again, so batch must upsert."""
    return stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums by event type and tumbling window; on a stream the watermark bounds the state, and times without a zone are read in the session's."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
