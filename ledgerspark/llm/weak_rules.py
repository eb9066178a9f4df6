"""Quality rules as weak supervision: votes, expectation-maximisation, posterior."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.llm.common import written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
ROUNDS, MIN_ACCURACY, MAX_ACCURACY, PRIOR_STRENGTH, PRIOR_ACCURACY = 100, 0.55, 0.99, 20.0, 0.85
#: The class balance that is assumed.
SHARE_GOOD = 0.5
_SPACES = " \t\n\v\f\r"
_SPACE_BYTES, _SYMBOL_BYTES = ([c.encode() for c in x] for x in (_SPACES, SYMBOLS))
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct")


def repeated_words(words: list[bytes]) -> int:
    """Words in WINDOW-word windows that stand twice or more in the text, the first included; exact."""
    n = len(words)
    if n <= WINDOW:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    if len(index) == n:
        return 0
    h, width = ids.astype(np.uint64), 1
    for m in _MULTIPLIERS:
        h = (h[:-width] * m) ^ h[width:]
        width *= 2
    h.sort()
    if not (h[1:] == h[:-1]).any():  # different hashes: no window stands twice
        return 0
    rank, width = ids, 1
    while width < WINDOW:  # rank[i] names the width words from i on; pairs of names are named again
        rank = np.unique(rank[:-width] * (int(rank.max()) + 1) + rank[width:], return_inverse=True)[1]
        width *= 2
    often = np.bincount(rank)[rank] > 1
    step = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(step, at, 1)
    np.add.at(step, at + WINDOW, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def features(text: str | None) -> tuple[int, ...]:
    """The nine counts in _FIELDS; a null text is an empty one."""
    t = text or ""
    raw = t.encode()
    words = raw.split()
    worded = [x for x in t.split("\n") if x.strip(_SPACES)]
    return (
        len(words),
        len(t) - sum(map(raw.count, _SPACE_BYTES)),
        sum(map(raw.count, _SYMBOL_BYTES)),
        len(worded) - len(set(worded)),
        repeated_words(words),
        len(worded),
        sum(map(str.isupper, t.split())),
        t.count("!!"),
        len(set(words)),
    )


@F.pandas_udf(T.StructType([T.StructField(f, T.LongType()) for f in _FIELDS]))
def _features(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([features(t) for t in texts], columns=list(_FIELDS))


def votes() -> dict[str, Column]:
    """1: good, 0: bad, -1: abstains. Each rule sees the counts alone. A rule that looks for one fault abstains where it finds none: that a text has no pipes says little for it."""
    n = F.col("n_words")
    mean = F.col("word_chars") / F.greatest(n, F.lit(1))
    prose = (n >= 20) & mean.between(2.5, 9) & (F.col("n_symbols") <= 0.05 * n) & (F.col("n_upper") <= 0.15 * n) & (F.col("n_marks") <= 0.01 * n)
    varied = (F.col("n_distinct") >= F.least(0.2 * n, F.lit(200))) & (F.col("n_repeat_words") <= 0.15 * n)

    def fault(bad: Column) -> Column:
        return F.when(bad, 0).otherwise(-1).cast("int")

    return {
        "length": fault(n < 20),
        "word_length": fault((mean < 2) | (mean > 12)),
        "symbols": fault(F.col("n_symbols") > 0.3 * n),
        "upper": fault(F.col("n_upper") > 0.4 * n),
        "exclaim": fault(F.col("n_marks") > 0.2 * n),
        "repeats": fault((F.col("n_repeat_words") > 0.3 * n) | (F.col("n_dup_lines") > 0.5 * F.col("n_lines"))),
        "prose": F.when(prose, 1).otherwise(-1).cast("int"),
        "varied": F.when(prose & varied, 1).when(~varied, 0).otherwise(-1).cast("int"),
    }


def fit(patterns: np.ndarray, counts: np.ndarray, share: float = SHARE_GOOD) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good for each vote pattern, and the accuracy of each rule where it votes.

    A rule is right with one probability whichever way it votes, as most vote
    one way only. share is the class balance that is assumed, not estimated:
    with faults that only one rule sees, an estimated one would drift to all
    good. Each accuracy has a Beta prior of PRIOR_STRENGTH votes around
    PRIOR_ACCURACY and stays within MIN_ACCURACY and MAX_ACCURACY, so that good
    and bad cannot change places.
    """
    good, bad = patterns == 1, patterns == 0
    acc = np.full(patterns.shape[1], PRIOR_ACCURACY)
    post = np.full(len(counts), 0.5)
    for _ in range(ROUNDS):
        weight = np.log(acc) - np.log1p(-acc)
        odds = np.log(share) - np.log1p(-share) + good @ weight - bad @ weight
        new = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        right = (new * counts) @ good + ((1 - new) * counts) @ bad
        voted = counts @ (good | bad)
        acc = np.clip((right + PRIOR_STRENGTH * PRIOR_ACCURACY) / (voted + PRIOR_STRENGTH), MIN_ACCURACY, MAX_ACCURACY)
        done, post = np.abs(new - post).max(initial=0) < 1e-9, new
        if done:
            break
    return post, acc


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_from: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, kept, posterior: one row per row of docs.

    kept: base_failed is false and the posterior is keep_from or more. A null
    or empty text has no words, so it fails the base rules. Repeated rows and
    null ids are judged like any row; other columns are not read; an empty
    table gives an empty result. Counts are taken over the whole text and the
    accuracies over all documents: documents are counted by vote pattern (3 to
    the power of 8 at most), and only those counts reach the driver.
    """
    spark = docs.sparkSession
    rules = votes()
    seen = written(docs.select(F.col(id_col).alias("doc_id"), _features(F.col(text_col)).alias("f")).select("doc_id", "f.*"), "rule_counts")
    code = sum(((c + 1) * 3**i for i, c in enumerate(rules.values())), F.lit(0)).alias("votes")
    voted = seen.withColumn("votes", code)
    counted = Counter({r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()})
    codes = sorted(counted)
    patterns = np.array([[c // 3**i % 3 - 1 for i in range(len(rules))] for c in codes]).reshape(-1, len(rules))
    post, _ = fit(patterns, np.array([counted[c] for c in codes], float))
    known = spark.createDataFrame([(c, float(round(p, 9))) for c, p in zip(codes, post, strict=True)], "votes int, posterior double")
    n = F.col("n_words")
    failed = (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    return voted.join(F.broadcast(known), "votes").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("posterior") >= keep_from)).alias("kept"), "posterior",
    )
