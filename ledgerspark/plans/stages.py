"""The whole run as stages over one folder: corpus, index, infer, package, eval, verify, all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.config import Settings, logger, settings
from ledgerspark.operators import evaluate, extract, retrieve, select, standardize
from ledgerspark.plans import answer, cards, submit
from ledgerspark.sources import corpus, files
from ledgerspark.sources.paths import Output, handle, settle

MANIFEST = "table_ref string, card string, n_rows long, doc_id string, position int, title string, section string, unit string, ticker string, year int, report_type string, csv_path string, batch long"
ORDER = ("corpus", "index", "infer", "package", "verify")
log = logger("stages")


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = handle(spark, path)
    return fs.exists(p)


def _manifest(spark: SparkSession, out: str) -> DataFrame | None:
    """The manifest, or None; a replacement that a crash cut short is ended first."""
    settle(spark, f"{out}/manifest")
    return spark.read.schema(MANIFEST).json(f"{out}/manifest") if exists(spark, f"{out}/manifest") else None


def _batches(manifest: DataFrame | None) -> list[int]:
    return sorted(r["batch"] for r in manifest.select("batch").distinct().collect()) if manifest is not None else []


def _facts(spark: SparkSession, out: str) -> DataFrame:
    """Facts of the batches that the manifest names; what a run left that did not reach its manifest is passed over."""
    return spark.read.schema(f"{standardize.SCHEMA}, batch long").parquet(f"{out}/facts").where(F.col("batch").isin(_batches(_manifest(spark, out)))).drop("batch")


def run_corpus(spark: SparkSession, raw: str, out: str, limit: int | None = None, resume: bool = True) -> None:
    """Reports below raw -> facts and manifest below out. With resume, documents in the manifest are passed over and new rows are upserted.

    A run writes its tables once, then its facts as a batch of their own, and
    the manifest, which marks its documents done, last. A run that stops before
    that leaves a batch that nobody reads and the next run overwrites, so it
    loses and doubles nothing.
    """
    docs = corpus.read_reports(spark, raw, limit)
    before = _manifest(spark, out)
    batch = 1 + max(_batches(before), default=0)
    old = resume and before is not None
    if old:
        docs = corpus.remaining(docs, before, "doc_id")
    part = f"{out}/tables.part"
    extract.extract_tables(docs).join(docs.select("doc_id", "ticker", F.col("year").alias("fallback_year"), "report_type"), "doc_id").write.mode("overwrite").parquet(part)
    tables = spark.read.parquet(part)
    corpus.write_facts(standardize.to_facts(tables), f"{out}/facts/batch={batch}")
    facts = spark.read.schema(standardize.SCHEMA).parquet(f"{out}/facts/batch={batch}")
    made = cards.cards(facts).join(tables.select("table_ref", "doc_id", "position", "title", "section", "unit", "ticker", F.col("fallback_year").alias("year"), "report_type"), "table_ref")
    made = made.withColumns({"csv_path": submit.csv_path(F.col("doc_id"), F.col("position")), "batch": F.lit(batch).cast("long")}).select(*[c.split()[0] for c in MANIFEST.split(", ")])
    corpus.write_manifest(made, f"{out}/manifest", "upsert" if old else "full")
    for path in [part] if old else [part, *(f"{out}/facts/batch={b}" for b in _batches_on_disk(spark, out) if b != batch)]:
        fs, p = handle(spark, path)
        fs.delete(p, True)


def _batches_on_disk(spark: SparkSession, out: str) -> list[int]:
    fs, p = handle(spark, f"{out}/facts")
    return [int(s.getPath().getName().removeprefix("batch=")) for s in fs.listStatus(p) if s.getPath().getName().startswith("batch=")]


def run_index(spark: SparkSession, out: str) -> None:
    """BM25 and hashed TF-IDF vectors of the tables' cards."""
    text = _manifest(spark, out).select("table_ref", submit.card_text().alias("text"))
    index = retrieve.build_bm25(text, "table_ref", "text")
    submit.save_index({**index, "vectors": retrieve.hashed_vectors(text, "table_ref", "text", index["terms"])}, f"{out}/index")


def run_infer(spark: SparkSession, out: str, questions: str, companies: str | None = None, limit: int | None = None, config: Settings | None = None) -> None:
    """Questions -> answers.parquet: analysis, filters, ranking, choice, values and units. Ids already answered are passed over.

    What several steps read (analysed questions, query vectors, candidates, the
    choice) is written below out/infer.part once, and goes when the answers are there.
    """
    part = f"{out}/infer.part"

    def once(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{part}/{name}")
        return spark.read.schema(df.schema).parquet(f"{part}/{name}")

    s = config or settings()
    k, low, high, ratio = (s.get(f"retrieval.{n}") for n in ("candidate_top_k", "selector.min_tables", "selector.max_tables", "selector.score_ratio"))
    asked = corpus.read_questions(spark, questions).select(F.col("id").cast("long").alias("id"), "question")
    done = f"{out}/answers"
    if exists(spark, done):
        asked = corpus.remaining(asked, spark.read.parquet(done), "id")
    if limit is not None:
        asked = asked.orderBy("id").limit(limit)
    manifest = _manifest(spark, out)
    q = retrieve.analyze(asked)
    if companies:
        keys = select.company_keys(corpus.read_companies(spark, companies))
        named = select.resolve_companies(asked, keys).withColumnRenamed("codes", "_codes")
        q = q.join(named, "id", "left").withColumn("tickers", F.array_distinct(F.concat(F.coalesce("_codes", F.array().cast("array<string>")), "tickers"))).drop("_codes")
    q = once(q, "questions")
    allowed = once(ladder(q, manifest, s.get("retrieval.year_tolerance")), "allowed")
    text = retrieve.expand_query(F.col("question"), F.col("metrics"), F.col("tickers"), F.col("years"))
    index = submit.load_index(spark, f"{out}/index")
    searched = q.select(F.col("id").alias("query_id"), text.alias("text"), (F.size("metrics") > 0).alias("has_metrics"))
    vectors = retrieve.hashed_vectors(searched, "query_id", "text", index["terms"]).withColumnRenamed("ref", "query_id")
    ranked = once(select.hybrid(index, index["vectors"], once(searched.join(vectors, "query_id"), "searched"), allowed, k), "ranked")
    pool = ranked.select(F.col("query_id").alias("question_id"), F.col("ref").alias("table_ref"), "score")
    facts = _facts(spark, out)
    content = manifest.select("table_ref", F.col("card").alias("content"), "section")
    by_id = q.withColumnRenamed("id", "question_id")
    placed = select.by_content(pool, by_id, content).join(manifest.select("table_ref", "doc_id", "section", "card"), "table_ref")
    chosen = once(select.choose(placed, by_id, low, high, ratio, k), "chosen")
    values = answer.answer_all(q, chosen, facts)
    submit.build(q, chosen, values, s.get("submission.fallback_answer")).write.mode("append").parquet(done)
    fs, p = handle(spark, part)
    fs.delete(p, True)


def ladder(q: DataFrame, manifest: DataFrame, tolerance: int = 2) -> DataFrame:
    """(query_id, ref) that the ladder allows: the strictest level of company, year and report type that holds a table, for each company a question names."""
    asks = q.select(F.col("id").alias("question_id"), F.explode_outer("tickers").alias("ticker"), "years", "report_type").select("question_id", "ticker", F.explode_outer("years").alias("year"), "report_type")
    # a rung is found for each (question, company, year): one company must not hide another
    rung = asks.withColumn("_q", F.struct("question_id", "ticker", "year"))
    named = rung.select(F.col("_q").alias("question_id"), "ticker", "year", "report_type")
    found = retrieve.filter_ladder(named, manifest.select("table_ref", "ticker", "year", "report_type"), tolerance)
    return found.select(F.col("question_id.question_id").alias("query_id"), F.col("table_ref").alias("ref")).distinct()


def run_package(spark: SparkSession, out: str, questions: str, strict: bool = True) -> str:
    """answers.zip below out: all answers and the tables that they cite."""
    items = spark.read.parquet(f"{out}/answers")
    cited = items.select(F.explode("csv_paths").alias("csv_path")).distinct()
    bodies = files.csv_files(_facts(spark, out), submit.PREFIX).join(cited, "csv_path", "left_semi")
    expected = corpus.read_questions(spark, questions).select(F.col("id").cast("long").alias("id"))
    with Output(spark, f"{out}/answers.zip") as zipped:
        submit.hand_in_to(zipped, items, bodies, expected, strict)
    return f"{out}/answers.zip"


def run_eval(spark: SparkSession, out: str, gold: str) -> dict:
    """Metrics, tags and funnel of the answers against gold (id, answer, relevant_docs, relevant_tables)."""
    rows = evaluate.evaluate(files.read_json(spark, gold), spark.read.parquet(f"{out}/answers"))
    return {
        "metrics": evaluate.macro(rows).first().asDict(), "tags": {r["tag"]: r["n"] for r in evaluate.tag_histogram(rows).collect()},
        "funnel": evaluate.funnel(rows).first().asDict(), "worst": [r["id"] for r in evaluate.worst(rows).collect()],
    }


def run_verify(spark: SparkSession, out: str) -> None:
    index = submit.load_index(spark, f"{out}/index")
    submit.verify_or_raise(_manifest(spark, out), _facts(spark, out).select("table_ref").distinct(), index, index.get("vectors"))


def run_all(spark: SparkSession, raw: str, out: str, questions: str, companies: str | None = None) -> None:
    """Every stage whose output is not there yet, then verification before answers are given."""
    if _manifest(spark, out) is None:
        log.info("corpus")
        run_corpus(spark, raw, out)
    if not exists(spark, f"{out}/index"):
        log.info("index")
        run_index(spark, out)
    run_verify(spark, out)
    run_infer(spark, out, questions, companies)
    run_package(spark, out, questions)
