"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import at_work, written

#: Bytes that a filter sees, and filters.
WIDTH, FILTERS = 6, 24
#: Positions of half a chunk: chunks are two halves long and start every half, so they overlap.
HALF = 64
#: Bound on the labelled rows that are fitted on, and on the bytes of each.
MAX_ROWS, MAX_ROW_BYTES = 2000, 32_768
EPOCHS, BATCH, RATE, SEED = 5, 16, 0.01, 7
THRESHOLD = 0.7
_SLICE = 1 << 17


@dataclass
class Net:
    """filters[k, byte] is what the byte at offset k adds to each filter."""

    filters: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (FILTERS,)
    base: np.ndarray  # (1,)


def start(seed: int = SEED) -> Net:
    r = np.random.default_rng(seed)
    return Net(r.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), r.normal(0, 0.3, FILTERS).astype(np.float32), np.zeros(1, np.float32))


def _padded(raw: bytes) -> np.ndarray:
    """The bytes, zero-filled to two whole halves at least, and WIDTH - 1 zeros more."""
    n = max(2, -(-len(raw) // HALF)) * HALF
    x = np.zeros(n + WIDTH - 1, np.uint8)
    x[: len(raw)] = np.frombuffer(raw, np.uint8)
    return x


def _convolve(net: Net, x: np.ndarray) -> np.ndarray:
    n = len(x) - WIDTH + 1
    a = np.take(net.filters[0], x[:n], axis=0)
    b = np.empty_like(a)
    for k in range(1, WIDTH):
        a += np.take(net.filters[k], x[k : k + n], axis=0, out=b, mode="clip")
    return a


def _halves(net: Net, x: np.ndarray) -> np.ndarray:
    """The maximum of each filter over each half chunk, a slice at a time."""
    n = len(x) - WIDTH + 1
    return np.concatenate([_convolve(net, x[s : min(s + _SLICE, n) + WIDTH - 1]).reshape(-1, HALF, FILTERS).max(1) for s in range(0, n, _SLICE)])


def scores(net: Net, texts: list[str | None]) -> np.ndarray:
    """A probability for each text; the same for a text whatever texts stand beside it."""
    out = np.empty(len(texts))
    for i, t in enumerate(texts):
        half = _halves(net, _padded((t or "").encode()))
        chunk = np.maximum(np.maximum(half[:-1], half[1:]) + net.bias, 0)
        z = float(chunk.mean(0, dtype=np.float64) @ net.out.astype(np.float64) + net.base[0])
        out[i] = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    return out


def fit(texts: list[str], labels: list[int], seed: int = SEED) -> Net:
    """Adam on the logistic loss; gradients go through each chunk's maximum. Texts of one label alone give that label's share."""
    net, r = start(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        net.base[0] = 0 if not len(y) else (4 if y[0] else -4)
        return net
    rows = [_padded(t.encode()) for t in texts]
    names = ("filters", "bias", "out", "base")
    m1, m2, step = {k: np.zeros_like(getattr(net, k)) for k in names}, {k: np.zeros_like(getattr(net, k)) for k in names}, 0
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    for _ in range(EPOCHS):
        order = r.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            g = {k: np.zeros_like(getattr(net, k)) for k in names}
            for i in order[at : at + BATCH]:
                x = rows[i]
                a = _convolve(net, x).reshape(-1, HALF, FILTERS)
                where = a.argmax(1)
                half = np.take_along_axis(a, where[:, None], 1)[:, 0]
                first = half[:-1] >= half[1:]
                pre = np.where(first, half[:-1], half[1:]) + net.bias
                act = np.maximum(pre, 0)
                mean = act.mean(0)
                dz = (1 / (1 + np.exp(-np.clip(mean @ net.out + net.base[0], -60, 60))) - y[i]) * share[i]
                g["out"] += dz * mean
                g["base"] += dz
                da = (dz / len(act)) * net.out * (pre > 0)
                g["bias"] += da.sum(0)
                pos = np.where(first, where[:-1], where[1:] + HALF) + (np.arange(len(act)) * HALF)[:, None]
                f = np.broadcast_to(np.arange(FILTERS), pos.shape)
                live = da != 0
                p, f, d = pos[live], f[live], da[live]
                for k in range(WIDTH):
                    g["filters"][k] += np.bincount(x[p + k].astype(np.int64) * FILTERS + f, d, 256 * FILTERS).reshape(256, FILTERS)
            step += 1
            for k in names:
                d = g[k] / BATCH
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.99 * m2[k] + 0.01 * d * d
                p = getattr(net, k)
                p -= (RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def held_out(id_column: Column) -> Column:
    """Rows that no label may be learned from: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Net:
    """Fits on at most max_rows labelled texts, the first by a hash of the id, of MAX_ROW_BYTES or fewer each.

    Both labels get half of max_rows at most. Held-out rows, null ids and
    labels other than 0 and 1 are left out; an id that labels repeat counts once
    with its smallest label, one that documents repeat once with the text of the
    smallest hash. Only text and label reach the network.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_ls_id")).agg(F.min(label_col).alias("_ls_y"))
    slim = docs.select(F.col(id_col).alias("_ls_id"), F.col(text_col).alias("_ls_text")).where(F.octet_length("_ls_text") <= MAX_ROW_BYTES).withColumn("_ls_tie", F.xxhash64("_ls_text"))
    # ids first, so that the sort carries no texts; an id that documents repeat has one text, whatever their number
    ids = written(slim.select("_ls_id", "_ls_tie").join(known, "_ls_id").groupBy("_ls_y", "_ls_id").agg(F.min("_ls_tie").alias("_ls_tie")), "labelled")
    first = [ids.where(F.col("_ls_y") == y).orderBy(F.xxhash64("_ls_id"), "_ls_id").limit(max_rows // 2) for y in (0, 1)]
    chosen = {(r["_ls_id"], r["_ls_tie"]): r["_ls_y"] for f in first for r in f.collect()}
    asked = slim.where(F.col("_ls_id").isin([i for i, _ in chosen]) & F.col("_ls_tie").isin([t for _, t in chosen]))
    texts = asked.groupBy("_ls_id", "_ls_tie").agg(F.min("_ls_text").alias("_ls_text")).collect() if chosen else []
    rows = [(r["_ls_id"], chosen[r["_ls_id"], r["_ls_tie"]], r["_ls_text"]) for r in texts if (r["_ls_id"], r["_ls_tie"]) in chosen]
    rows.sort()
    return fit([t for _, _, t in rows], [y for _, y, _ in rows])


def scorer(net: Net):
    """A text column's scores, as a column function; the weights (150 kB) go along with the tasks."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        at_work("byte_cnn")
        return pd.Series(scores(net, texts.tolist()))

    return score


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    Null and empty texts are scored as an empty text; repeated rows repeat
    their score; a null id is scored too. Without labels every score is 0.5.
    Other columns are not read. No shuffle: scoring is one pass.
    """
    score = scorer(train(docs, labels, id_col, text_col))
    return docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score(F.col(text_col)).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with a score of THRESHOLD or more, all columns as they are.

    A row stays or goes by its text alone: null and empty texts by the score of
    an empty text, repeated rows together, null ids like any other. Without
    labels every score is 0.5 and nothing stays; an empty table stays empty.
    """
    return docs.where(scorer(train(docs, labels, id_col, text_col))(F.col(text_col)) >= THRESHOLD)
