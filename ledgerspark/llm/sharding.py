"""Sharding by vector bin packing of bytes, words and rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import written

SHARDS = 40
#: Bytes that a document takes besides its text.
OVERHEAD = 16
#: Rows that one packing task places, about.
TASK_ROWS = 65_536
#: Hash salts a group's rows are counted by, for each shard of each task.
SALTS = 4
#: What bytes, words and rows count for in the dot product. Bytes lead: the law is theirs.
WEIGHTS = (64.0, 1.0, 1.0)
#: Each level of packing has this many times the tasks of the one before; a unit goes to the first level
#: for whose successor it is too large: over 1 / COARSE of what one task there puts into one shard.
FAN_OUT, COARSE = 64, 16


def pack(shares: np.ndarray, lacks: np.ndarray, turn: int = 0) -> np.ndarray:
    """The shard of each item (its shares of all bytes, words and rows).

    Items go in the given order, each to the shard whose residual capacity
    (lacks: a row a shard, in the same shares) has the largest dot product with
    it by WEIGHTS; equal products: the next shard from `turn` on.
    """
    left = lacks.astype(float).copy()
    weighted = shares * np.array(WEIGHTS)
    order = np.roll(np.arange(len(left)), -(turn % len(left)))
    out = np.empty(len(shares), np.int64)
    for i, (u, w) in enumerate(zip(shares, weighted, strict=True)):
        at = order[np.argmax((left @ w)[order])]
        out[i] = at
        left[at] -= u
    return out


def levels(tasks: int) -> list[int]:
    """Packing tasks of each level: 1, FAN_OUT, FAN_OUT squared, ..., tasks."""
    out = [1]
    while out[-1] * FAN_OUT < tasks:
        out.append(out[-1] * FAN_OUT)
    return out + [tasks] * (tasks > 1)


def _placer(lacks: np.ndarray, totals: np.ndarray) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One packing task: its units, largest first, with their shards and places among its rows there."""

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "words", "n", "group", "piece"], ascending=[False, False, False, True, True], ignore_index=True)
        pdf["shard"] = pack(pdf[["bytes", "words", "n"]].to_numpy(float) / totals, lacks, int(pdf["task"].iloc[0]) if len(pdf) else 0)
        pdf["at"] = pdf.groupby("shard")["n"].cumsum() - pdf["n"]
        return pdf[["task", "group", "piece", "n", "bytes", "words", "shard", "at"]]

    return place


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", task_rows: int = TASK_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    law is "bytes": shards have nearly equal sizes (size: bytes of the text and
    OVERHEAD), and words and rows are balanced with them. Rows of equal text
    form a group and stay in one shard; only a group that no shard can hold,
    with more than 1 / shards of all bytes, words or rows, is cut, into even
    pieces for every shard (a single row is never cut). Where groups of about a
    shard's size are many, or the table is small beside its longest text,
    shards are as even as whole units allow.

    Units are packed level by level. The first level packs what is large beside
    a whole shard, in one task and into whole shards; each later level has
    FAN_OUT times the tasks and packs smaller units into an even part of what
    the levels before left open, so a task sees FAN_OUT * COARSE * shards units
    or task_rows rows' worth at most, about. slot numbers a shard's rows from 0
    without gaps.

    Null texts have no bytes and code 0 and group with one another, not with
    empty texts; null ids and repeated rows are placed like any row (which of
    the equal rows gets which slot is open). Other columns are not read. An
    empty table gives an empty result.
    """
    text = F.col(text_col)
    words = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    base = written(
        docs.select(
            F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD).alias("size"), words.alias("words"),
            F.coalesce(F.crc32(text), F.lit(0)).alias("text_crc32"), F.coalesce(F.unhex(F.md5(text)), F.lit(b"")).alias("group"),
            # rows without an id are told apart by their place in the scan, which the written table fixes
            F.when(F.col(id_col).isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(id_col)).alias("h"),
        ),
        "rows",
    )
    rows, n_bytes, n_words = base.agg(F.count("*"), F.sum("size"), F.sum("words")).first()
    totals = np.maximum(np.array([n_bytes or 0, n_words or 0, rows], float), 1)
    tasks = max(1, -(-rows // task_rows))
    base = base.withColumn("salt", F.pmod("h", F.lit(SALTS * shards * tasks))).drop("h")
    salted = written(base.groupBy("group", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.sum("words").alias("words")), "salted")
    share = F.greatest(*[F.col(c) / F.lit(float(t)) for c, t in zip(("bytes", "words", "n"), totals, strict=True)])
    groups = salted.groupBy("group").agg(*[F.sum(c).alias(c) for c in ("n", "bytes", "words")])
    groups = groups.withColumn("pieces", F.when(share * shards > 1, F.least(F.lit(shards), "n")).otherwise(1))
    begin = lambda i: F.floor((F.col("n") * i + F.col("pieces") - 1) / F.col("pieces"))
    cut = groups.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).withColumn("m", begin(F.col("piece") + 1) - begin(F.col("piece")))
    units = cut.select("group", "piece", F.col("m").alias("n"), *[(F.col(c) / F.col("n") * F.col("m")).cast("long").alias(c) for c in ("bytes", "words")])
    sizes = levels(tasks)
    level = F.lit(len(sizes) - 1)
    for i in reversed(range(len(sizes) - 1)):
        level = F.when(share * shards * sizes[i + 1] * COARSE > 1, i).otherwise(level)
    units = written(units.withColumn("level", level), "units")
    held = {r["level"] for r in units.select("level").distinct().collect()}
    lacks = np.full((shards, 3), 1 / shards)
    done = []
    for i, own in enumerate(sizes):
        if i not in held:
            continue
        dealt = units.where(F.col("level") == i).withColumn("task", F.pmod(F.xxhash64("group", "piece"), F.lit(own)))
        placed = written(dealt.groupBy("task").applyInPandas(_placer(lacks / own, totals), "task long, group binary, piece long, n long, bytes long, words long, shard long, at long"), "placed")
        done.append(placed.withColumn("level", F.lit(i)))
        if i < len(sizes) - 1:
            lacks = lacks.copy()
            for r in placed.groupBy("shard").agg(*[F.sum(c).alias(c) for c in ("bytes", "words", "n")]).collect():
                lacks[r["shard"]] -= np.array([r["bytes"], r["words"], r["n"]]) / totals
    if not done:
        return base.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    placed = done[0]
    for d in done[1:]:
        placed = placed.unionByName(d)
    tallies = placed.groupBy("level", "task", "shard").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("level", "task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = tallies.select("level", "task", "shard", before.alias("before"))
    of_piece = F.struct("piece", "shard", (F.col("before") + F.col("at")).alias("from"))
    of_group = placed.join(starts, ["level", "task", "shard"]).groupBy("group").agg(F.array_sort(F.collect_list(of_piece)).alias("pieces"), F.sum("n").alias("n"))
    within = F.coalesce(F.sum("m").over(Window.partitionBy("group").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_salt = salted.select("group", "salt", F.col("n").alias("m")).withColumn("within", within).join(of_group, "group").select("group", "salt", "within", "pieces", "n")
    rank = F.col("within") + F.row_number().over(Window.partitionBy("group", "salt").orderBy("doc_id")) - 1
    ranked = base.join(of_salt, ["group", "salt"]).withColumn("rank", rank).withColumn("piece", F.floor(F.col("rank") * F.size("pieces") / F.col("n")).cast("int"))
    own = F.get("pieces", F.col("piece"))
    first = F.floor((F.col("n") * F.col("piece") + F.size("pieces") - 1) / F.size("pieces"))
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), own["shard"].cast("int").alias("shard"),
        (own["from"] + F.col("rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
