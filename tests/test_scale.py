"""Work and memory of the queries that search or ask again and again stay bounded."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import retrieve, select
from ledgerspark.plans import queries, queries_questions, queries_selection


def _vectors(spark, n, key=None):
    made = np.random.default_rng(3).integers(-3, 4, (n, 4)).astype(float)  # few values: many ties
    df = spark.createDataFrame([(i, [float(x) for x in made[i]], None if key is None or i % 11 == 0 else i % key) for i in range(n)], "ref long, embedding array<float>, k long")
    return made, df


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_knn_keeps_the_best_over_batches_and_parts(spark, metric, monkeypatch):
    monkeypatch.setattr(retrieve, "HELD", 1)  # each batch of queries is a part of its own
    made, df = _vectors(spark, 300, 3)
    q = df.where("ref % 7 = 0").withColumnRenamed("ref", "query_id").repartition(3)
    for within in (None, "k"):
        got = {(r["query_id"], r["rank"]): (r["ref"], r["score"]) for r in retrieve.knn(df, q, 5, metric, block=8, within=within).collect()}
        want = {}
        for i in range(0, 300, 7):
            if within and i % 11 == 0:
                continue  # no key
            score = np.round(made @ made[i] if metric == "ip" else -np.sqrt(((made - made[i]) ** 2).sum(1)), 6)
            fit = [j for j in range(300) if not within or (j % 11 and j % 3 == i % 3)]
            for rank, j in enumerate(sorted(fit, key=lambda j: (-score[j], j))[:5], 1):
                want[i, rank] = (j, pytest.approx(score[j]))
        assert got == want
    assert retrieve.knn(df, q.where("false"), 5).count() == 0


def test_kept_is_bounded_and_breaks_ties_by_ref():
    kept = retrieve._Kept(2)
    for at in range(0, 90, 30):
        kept.add(np.repeat([0, 1], 15), pa.array([f"t|{at + i}" for i in range(30)]), np.ones(30))
        assert len(kept.rows) == 4
    assert kept.give(pa.array(["a", "b"])).to_pydict() == {"query_id": ["a", "a", "b", "b"], "ref": ["t|0", "t|1", "t|15", "t|16"], "score": [1.0] * 4}


def test_knn_sends_python_no_pair_of_blocks(spark):
    """Rows that reach Python are vectors, however many queries there are."""
    _, df = _vectors(spark, 60)
    plan = retrieve.knn(df, df.withColumnRenamed("ref", "query_id"), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_restriction_by_a_shared_column_joins_no_pairs(spark, sf):
    plan = queries_selection.knn_restricted(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    _, df = _vectors(spark, 90, 3)
    q = df.where("ref % 5 = 0").withColumnRenamed("ref", "query_id")
    pairs = q.select("query_id", "k").join(df.select("ref", "k"), "k")
    rows = lambda d: sorted(tuple(r) for r in d.select("query_id", "ref", F.round("score", 6), "rank").collect())
    assert rows(select.restricted_knn(df, q, "k", 4)) == rows(select.restricted_knn(df, q, pairs, 4))


def test_bm25_is_brute_force_over_batches(spark, monkeypatch):
    import math
    from collections import Counter

    monkeypatch.setattr(retrieve, "CELLS", 40)  # few texts at a time, and the best given away in between
    words = np.random.default_rng(5).integers(0, 12, (80, 6))
    texts = {f"t|{i}": [f"w{x}" for x in words[i][: 1 + i % 6]] for i in range(80)}
    asks = {1: ["w1", "w2"], 2: ["w3", "w3", "zzz"], 3: ["zzz"], 4: ["w1", "w5", "w7"]}
    docs = spark.createDataFrame([(r, " ".join(w)) for r, w in texts.items()], "ref string, text string").repartition(3)
    q = spark.createDataFrame([(i, " ".join(w)) for i, w in asks.items()], "query_id long, text string")
    split = lambda c: F.split(c, " ")
    only = {(4, f"t|{i}") for i in range(0, 80, 3)} | {(3, "t|1")}
    allowed = spark.createDataFrame(sorted(only), "query_id long, ref string")
    mean, df = sum(map(len, texts.values())) / 80, Counter(t for w in texts.values() for t in set(w))
    for pairs in (None, allowed):
        found = retrieve.bm25_search(retrieve.build_bm25(docs, "ref", "text", split), q, "query_id", "text", 7, split, pairs)
        want = {}
        for i, asked in asks.items():
            score = {}
            for r, w in texts.items():
                got = sum(math.log(1 + (80 - df[t] + 0.5) / (df[t] + 0.5)) * (n := w.count(t)) * 2.5 / (n + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in set(asked))
                if got > 0 and (pairs is None or i not in (3, 4) or (i, r) in only):
                    score[r] = got
            want |= {(i, n): (r, pytest.approx(score[r])) for n, r in enumerate(sorted(score, key=lambda r: (-round(score[r], 6), r))[:7], 1)}
        assert {(r["query_id"], r["rank"]): (r["ref"], r["score"]) for r in found.collect()} == want
    assert retrieve.bm25_search(retrieve.build_bm25(docs, "ref", "text", split), q.where("false"), "query_id", "text", 7, split).count() == 0


def test_bm25_shuffles_no_pairs_of_query_and_text(spark, sf):
    plan = queries.bm25_topk(spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate(keys=[query_id" not in plan and "MapInArrow" in plan


def test_hybrid_searches_once(spark, sf):
    """Scores of both lists come with the ranks, not from joins that search again."""
    plan = queries_selection.hybrid_rank(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2


def test_facts_of_nations_are_computed_once(spark, sf):
    """What the sandbox and the questions read again and again is no join of orders and customers."""
    plan = queries_questions.nation_facts(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_facts_of_orders_are_computed_once(spark, sf):
    """Answers read the facts many times; orders are aggregated and reports extracted before that."""
    plan = queries.order_facts(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan and "Relation" in plan
