"""Which tables a question gets: names to codes, metadata filters, hybrid ranking, order by content, coverage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.text import normalize_text
from ledgerspark.operators import retrieve

CANDIDATES, CONTENT_CANDIDATES, MIN_TABLES, MAX_TABLES, RATIO = 120, 35, 2, 16, 0.35
# Legal forms that are no part of a name, in the order in which they go.
LEGAL_FORMS = ("cong ty co phan", "cong ty tnhh mtv", "cong ty tnhh", "tong cong ty", "ctcp", "tmcp", "mtv", "tnhh", "cong ty")
# Brands that no legal name holds.
BRANDS = {
    "vinamilk": "VNM", "eximbank": "EIB", "mbbank": "MBB", "mb bank": "MBB", "saigonbank": "SGB", "vietcombank": "VCB", "vietinbank": "CTG", "techcombank": "TCB",
    "sacombank": "STB", "agribank": "AGR", "bidv": "BID", "vpbank": "VPB", "acb": "ACB", "vingroup": "VIC", "masan": "MSN", "gelex": "GEX",
}
# Words and phrases that many names share.
GENERIC = (
    "xanh", "viet", "nam", "vietnam", "dau", "khi", "dien", "luc", "thep", "sua", "nhua", "dam", "than", "cao", "su", "xay", "dung", "dich", "vu",
    "dau tu", "phat trien", "tap doan", "san xuat", "thuong mai", "viet nam", "ha noi", "sai gon", "ho chi minh", "thanh pho ho chi minh", "mien nam",
    "mien bac", "mien trung", "ngan hang", "chung khoan", "bat dong san", "cong nghiep", "cong nghe", "quoc te", "xuat nhap khau", "khu", "phat",
    "trien", "cong", "nghiep", "tong", "quan", "ly", "khu cong nghiep", "phat trien khu cong nghiep",
)
BALANCE_HINTS = ("so du", "cuoi nam", "dau nam", "tai ngay", "quy", "nganh")
CASH_HINTS = ("luu chuyen tien", "dong tien", "tien thuan tu")
#: Ratios that need both the balance sheet and the income statement.
TWO_SECTIONS = ("roe", "roa", "debt_to_equity", "current_ratio", "quick_ratio")


def name_key(text: Column) -> Column:
    """A name without accents, legal forms and punctuation."""
    flat = normalize_text(text)
    for form in LEGAL_FORMS:
        flat = F.replace(flat, F.lit(form), F.lit(" "))
    return F.trim(F.regexp_replace(flat, "[^0-9a-z]+", " "))


def company_keys(companies: DataFrame, brands: dict[str, str] = BRANDS) -> DataFrame:
    """(code, name) -> (key, code): whole names, last 2 to 4 words that one code alone has, and brands of known codes.

    Aliases shorter than 6 characters or made of generic words are left out. A
    key that several codes share names the smallest; null codes and empty names
    are left out.
    """
    spark = companies.sparkSession
    named = companies.where("code is not null").select(F.upper(F.trim("code")).alias("code"), name_key(F.col("name")).alias("key")).where("key <> ''").distinct()
    words, generic = F.split("key", " "), F.array(*map(F.lit, GENERIC))
    grams = F.array_compact(F.array(*[F.when(F.size(words) >= n, F.array_join(F.slice(words, -n, n), " ")) for n in (2, 3, 4)]))
    dull = F.array_contains(generic, F.col("alias")) | F.forall(F.split("alias", " "), lambda w: F.array_contains(generic, w))
    alias = named.select("code", F.explode(grams).alias("alias")).where((F.length("alias") >= 6) & ~dull)
    alias = alias.groupBy("alias").agg(F.count_distinct("code").alias("n"), F.min("code").alias("code")).where("n = 1").select(F.col("alias").alias("key"), "code")
    brand = spark.createDataFrame([(k, c) for k, c in brands.items()] or [("", "")], "key string, code string").where("key <> ''").join(companies.select(F.upper(F.trim("code")).alias("code")).distinct(), "code", "left_semi").select("key", "code")
    ranked = named.select("key", "code", F.lit(0).alias("o")).unionByName(alias.withColumn("o", F.lit(1))).unionByName(brand.withColumn("o", F.lit(1)))
    return ranked.groupBy("key").agg(F.min_by("code", F.struct("o", "code")).alias("code"))


def resolve_companies(questions: DataFrame, keys: DataFrame, id_col: str = "id", text_col: str = "question") -> DataFrame:
    """(id, codes) of questions that name a company: longest names first, and what one name has taken is taken.

    Every run of words of a question, up to the length of the longest name,
    meets the names by an equality join, so no pair of question and name is
    tried in vain.
    """
    longest = keys.agg(F.max(F.size(F.split("key", " ")))).first()[0] or 1
    words = F.split(name_key(F.col(text_col)), " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - i + 1)), lambda n: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice("w", i, n), " ").alias("key")))))
    runs = questions.select(F.col(id_col).alias("id"), words.alias("w")).where("w is not null").select("id", F.explode(spans).alias("s")).select("id", "s.*").where("key <> ''")
    hits = runs.join(keys, "key").groupBy("id").agg(F.array_sort(F.collect_set(F.struct((-F.length("key")).alias("o"), "key", "at", "n", "code"))).alias("hits"))

    def step(taken: Column, h: Column) -> Column:
        free = ~F.exists(taken, lambda t: (t["code"] == h["code"]) | ((h["at"] < t["at"] + t["n"]) & (t["at"] < h["at"] + h["n"])))
        return F.when(free, F.array_append(taken, F.struct(h["at"].alias("at"), h["n"].alias("n"), h["code"].alias("code")))).otherwise(taken)

    taken = F.aggregate("hits", F.array().cast("array<struct<at:int,n:int,code:string>>"), step)
    return hits.select("id", F.transform(taken, lambda t: t["code"]).alias("codes"))


def filter_refs(tables: DataFrame, tickers: list[str] = (), years: list[int] = (), year_tolerance: int = 0, sections: list[str] = (), report_types: list[str] = ()) -> DataFrame | None:
    """Tables that meet every condition given; None (no filter) where none is given or nothing meets them. Years reach up to year_tolerance on."""
    conditions = []
    if tickers:
        conditions.append(F.upper("ticker").isin(*{t.upper() for t in tickers}))
    if years:
        conditions.append(F.col("year").isin(*sorted({y + d for y in years for d in range(year_tolerance + 1)})))
    if sections:
        conditions.append(F.col("section").isin(*sections))
    if report_types:
        conditions.append(F.lower("report_type").isin(*{r.lower() for r in report_types}))
    if not conditions:
        return None
    found = tables
    for c in conditions:
        found = found.where(c)
    return found if found.head(1) else None


def restricted_knn(vectors: DataFrame, queries: DataFrame, allowed: DataFrame | str, k: int) -> DataFrame:
    """query_id, ref, score, rank by inner product among the allowed (query_id, ref) pairs only: two equality joins, no Python.

    allowed as the name of a column that queries and vectors share allows the
    pairs that agree there; these are never written out, so that they may be
    many. The joins take 300 bytes and more a pair.
    """
    if isinstance(allowed, str):
        return retrieve.knn(vectors, queries, k, within=allowed)
    pairs = allowed.select("query_id", "ref").distinct().join(queries.select("query_id", F.col("embedding").alias("q")), "query_id").join(vectors.select("ref", F.col("embedding").alias("v")), "ref")
    dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return retrieve.top_k(pairs.select("query_id", "ref", F.round(dot, 6).alias("score")).where("score is not null"), "query_id", k, F.col("score").desc(), F.col("ref"))


def hybrid(index: dict[str, DataFrame], vectors: DataFrame | None, questions: DataFrame, allowed: DataFrame | None = None, k: int = CANDIDATES, tokens=retrieve.tokenize) -> DataFrame:
    """questions (query_id, text, embedding[, has_metrics]) -> query_id, ref, score, rank, bm25_score, dense_score.

    BM25 and exact inner products fused by reciprocal rank. allowed
    (query_id, ref) restricts the questions that it names; the others search
    everything. Without vectors BM25 ranks alone. Ties go by ref.
    """
    lexical = retrieve.bm25_search(index, questions, "query_id", "text", k, tokens, allowed)
    if vectors is None:
        dense = lexical.where("false")
    elif allowed is None:
        dense = retrieve.knn(vectors, questions.select("query_id", "embedding"), k)
    else:
        bound = allowed.select("query_id").distinct()
        dense = restricted_knn(vectors, questions, allowed, k).unionByName(retrieve.knn(vectors, questions.join(bound, "query_id", "left_anti").select("query_id", "embedding"), k))
    bonus = questions.where("has_metrics").select("query_id") if "has_metrics" in questions.columns else None
    both = ("bm25_score", "dense_score")
    lists = [found.withColumns({c: F.col("score") if c == own else F.lit(None).cast("double") for c in both}) for found, own in zip((lexical, dense), both)]
    raw = retrieve.rrf(*lists, bonus=bonus, keep=both).fillna(0.0, list(both))
    return retrieve.top_k(raw, "query_id", k, F.round("score", 9).desc(), F.col("ref"))


def by_content(pool: DataFrame, questions: DataFrame, content: DataFrame, candidates: int = CONTENT_CANDIDATES) -> DataFrame:
    """pool (question_id, table_ref, score) with content_score and place.

    The first candidates of a question are put in order by 10 * content_score +
    score; the others follow in theirs. content (table_ref, content, section)
    holds items and column labels, or the card; both sides are folded. Cash-flow
    tables lose 10 where a balance is asked and gain 6 where cash flow is.
    """
    flat_q = normalize_text(F.col("question"))
    asks = lambda hints: F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(flat_q, h))
    q = questions.select("question_id", "question", asks(BALANCE_HINTS).alias("_balance"), asks(CASH_HINTS).alias("_cash"))
    ranked = pool.withColumn("_rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("score").desc(), "table_ref")))
    head = ranked.where(F.col("_rank") <= candidates).join(q, "question_id").join(content.select("table_ref", normalize_text(F.col("content")).alias("_text"), F.col("section").alias("_section")), "table_ref", "left")
    is_cash = F.contains(F.col("_text"), F.lit(CASH_HINTS[0])) | F.coalesce(F.col("_section") == "cash_flow", F.lit(False))
    shift = F.when(F.col("_balance") & ~F.col("_cash") & is_cash, -10).when(F.col("_cash") & is_cash, 6).otherwise(0)
    scored = head.select("question_id", "table_ref", F.coalesce(retrieve.content_score(F.col("question"), F.col("_text")) + shift, F.lit(0)).cast("double").alias("content_score"))
    out = ranked.join(scored, ["question_id", "table_ref"], "left")
    order = Window.partitionBy("question_id").orderBy(F.when(F.col("_rank") <= candidates, 0).otherwise(1), (10 * F.coalesce("content_score", F.lit(0.0)) + F.col("score")).desc(), F.col("score").desc(), "table_ref")
    return out.withColumn("place", F.row_number().over(order)).drop("_rank")


def rerank(pool: DataFrame, pair_score, top: int = 30, inputs: int = 50) -> DataFrame:
    """pool in a new order: the first inputs of a question by pair_score (a Column of the pool's columns), then the tail; top rows stay.

    pair_score None keeps the order, as where no scorer is at hand.
    """
    head = F.col("place") <= inputs
    score = F.when(head, pair_score if pair_score is not None else -F.col("place").cast("double"))
    order = Window.partitionBy("question_id").orderBy(F.when(head, 0).otherwise(1), score.desc_nulls_last(), "place")
    return pool.withColumn("_new", F.row_number().over(order)).where(F.col("_new") <= top).withColumn("place", F.col("_new")).drop("_new")


def budget(n_tickers: Column, n_years: Column, derived: Column, low: int = MIN_TABLES, high: int = MAX_TABLES) -> Column:
    """How many tables a question is worth: by companies, else by years, else 2, or 3 for a derived figure."""
    companies = F.greatest(n_tickers, n_tickers * F.least(F.lit(2), F.greatest(F.lit(1), n_years)))
    return (
        F.when(n_tickers >= 2, F.least(F.lit(high), companies)).when(n_years >= 2, F.least(F.lit(high), F.greatest(F.lit(low), n_years * 2)))
        .otherwise(F.greatest(F.lit(low), F.when(derived, 3).otherwise(2)))
    )


def _cover(score: list[float], ticker: list[str], hits: list[str], section: list[str | None], asked: list[str], years: list[int], two: bool, room: int, low: int, high: int, ratio: float) -> list[int]:
    """Places in one question's ordered pool that are chosen, in order. hits holds the asked years that a table mentions, as ,2019,2020,"""
    n = len(score)
    cutoff = score[0] * ratio if score[0] > 0 else -float("inf")
    chosen = [i for i in range(min(room, n)) if score[i] >= cutoff]
    if len(chosen) < low:
        chosen = list(range(min(low, n)))
    companies = [(lambda i, t=t.upper(): ticker[i] == t) for t in asked] if len(asked) > 1 else []
    others = [(lambda i, y=y: f",{y}," in hits[i]) for y in years]
    others += [(lambda i, s=s: section[i] == s) for s in ("income_statement", "balance_sheet")] if two else []
    for k, meets in enumerate(companies + others):
        if any(meets(i) for i in chosen):
            continue
        found = next((i for i in range(n) if i not in chosen and meets(i)), None)
        if found is None:
            continue
        if len(chosen) < high:
            chosen.append(found)
        elif k < len(companies):  # a company's second table gives way to a company without any
            held = [ticker[i] for i in chosen]
            spare = next((p for p in reversed(range(len(chosen))) if held.count(held[p]) > 1), None)
            if spare is not None:
                chosen[spare] = found
    return chosen[:high]


def choose(pool: DataFrame, questions: DataFrame, low: int = MIN_TABLES, high: int = MAX_TABLES, ratio: float = RATIO, candidates: int = CANDIDATES) -> DataFrame:
    """The tables of each question: question_id, table_ref, score, place.

    pool (question_id, table_ref, doc_id, section, card, score, place);
    questions (question_id, tickers, years, metrics, needs_derived). Taken are
    the first tables within the budget whose score is near the best, low at
    least; then the best table of each company, year and section still missing.
    A question gathers candidates small rows at most, without cards; the greedy
    step sees many questions a batch.
    """
    two = F.coalesce(F.col("needs_derived") & F.arrays_overlap("metrics", F.array(*map(F.lit, TWO_SECTIONS))), F.lit(False))
    q = questions.select("question_id", "tickers", "years", two.alias("two"), budget(F.size("tickers"), F.size("years"), F.col("needs_derived"), low, high).alias("room"))
    said = F.concat_ws(" ", "doc_id", "card")
    hits = F.concat(F.lit(","), F.array_join(F.filter(F.col("years").cast("array<string>"), lambda y: F.contains(said, y)), ","), F.lit(","))
    ticker = F.when(F.contains("doc_id", F.lit("_")), F.upper(F.substring_index("doc_id", "_", 1))).otherwise("")
    rows = pool.where(F.col("place") <= candidates).join(q, "question_id").select("question_id", "tickers", "years", "two", "room", F.struct("place", "table_ref", "score", F.coalesce(ticker, F.lit("")).alias("ticker"), hits.alias("hits"), "section").alias("r"))
    grouped = rows.groupBy("question_id").agg(F.array_sort(F.collect_list("r")).alias("r"), *[F.first(c).alias(c) for c in ("tickers", "years", "two", "room")])

    @F.pandas_udf("array<int>")
    def pick(score: pd.Series, ticker: pd.Series, hits: pd.Series, section: pd.Series, asked: pd.Series, years: pd.Series, two: pd.Series, room: pd.Series) -> pd.Series:
        each = zip(score, ticker, hits, section, asked, years, two, room, strict=True)
        return pd.Series([_cover(list(s), list(t), list(h), list(c), [] if a is None else list(a), [] if y is None else list(y), bool(b), int(n), low, high, ratio) for s, t, h, c, a, y, b, n in each], dtype=object)

    picked = grouped.withColumn("p", pick("r.score", "r.ticker", "r.hits", "r.section", "tickers", "years", "two", "room"))
    taken = picked.select("question_id", "r", F.posexplode("p").alias("k", "i")).withColumn("t", F.get("r", F.col("i")))
    return taken.select("question_id", "t.table_ref", "t.score", (F.col("k") + 1).alias("place"))
