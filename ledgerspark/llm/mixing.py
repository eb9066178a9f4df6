"""Mixing sources to target weights by entropy balancing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import written

#: Weights that the sources take in turn, the share of all words to take, and the most copies of a document.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
NEWTON_ROUNDS, TOLERANCE, MEND_ROUNDS = 150, 1e-7, 12
_FINE = 1 << 20
_BUCKET_ROWS = 8192


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(key, source, source_size) -> also target: the words to take of each source.

    Sources in code point order, null last, take the weights in turn and share
    `share` of all words; none gets more than `most` times its own, and what is
    over is shared again by weight. That is one water level for all sources
    under their caps, found with three running sums over the sources.
    """
    rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    w = sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), rank)).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = (
        w.withColumn("all", share * F.sum("source_size").over(everything))
        .withColumn("full_before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("full", F.col("cap") / F.col("weight") <= (F.col("all") - F.col("full_before")) / F.col("weight_left"))
    )
    taken = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything)
    level = F.when(open_weight > 0, (F.col("all") - taken) / open_weight)
    return w.select("key", "source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * level).alias("target"))


def _exact(x: Column) -> Column:
    """A sum that does not depend on the order of its rows, so reruns agree to the last bit."""
    return F.sum(F.round(x * 1000).cast("decimal(30,0)")).cast("double") / 1000


def _tilt(cells: DataFrame, goal: DataFrame, most: int) -> DataFrame:
    """(key, size, n, rate): min(most, exp(tilt * size / the source's mean size)) copies a document meet each source's target.

    Newton's method on the convex dual of the entropy balance, one dimension
    a source and all sources at once: each round is one aggregation over the
    cells. Steps are bounded, and bisected where they leave the bracket. A
    source that is not at its target after NEWTON_ROUNDS raises.
    """
    mean = cells.groupBy("key").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    state = written(
        goal.join(mean, "key").withColumn("mean", F.greatest("mean", F.lit(1e-9))).withColumn("tilt", F.lit(0.0)).withColumn("low", F.lit(None).cast("double")).withColumn("high", F.lit(None).cast("double"))
        .withColumn("done", (F.col("target") <= 0) | (F.col("target") >= most * F.col("source_size") * (1 - 1e-12))),
        "tilt",
    )
    x = F.col("size") / F.col("mean")
    for i in range(NEWTON_ROUNDS):
        raw = F.exp(F.least(F.col("tilt") * x, F.lit(50.0)))
        own = cells.join(state.where("not done").select("key", "tilt", "mean"), "key")
        words = F.col("n") * F.col("size")
        got = own.groupBy("key").agg(_exact(words * F.least(raw, F.lit(float(most)))).alias("f"), _exact(F.when(raw < most, words * x * raw).otherwise(0.0)).alias("d"))
        s = state.join(got, "key", "left")
        met = F.col("done") | (F.abs(F.col("f") - F.col("target")) <= TOLERANCE * F.col("target") + 0.01)
        under = F.col("f") < F.col("target")
        low = F.when(under, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(under, F.col("high")).otherwise(F.col("tilt"))
        most_step = F.lit(4.0 * 2**i)  # until a source has a bracket, its steps may double each round
        step = F.when(F.col("d") > 0, (F.col("target") - F.col("f")) / F.col("d")).otherwise(F.when(under, most_step).otherwise(-most_step))
        s = s.withColumn("low", low).withColumn("high", high).withColumn("next", F.col("tilt") + F.greatest(-most_step, F.least(most_step, step)))
        inside = (F.col("low").isNull() | (F.col("next") > F.col("low"))) & (F.col("high").isNull() | (F.col("next") < F.col("high")))
        # every third round halves the bracket, so that it closes whatever the curve
        newton = inside & F.lit(i % 3 < 2)
        reach = F.when(newton, F.col("next")).when(F.col("low").isNotNull() & F.col("high").isNotNull(), (F.col("low") + F.col("high")) / 2).otherwise(F.col("next"))
        state = written(s.select("key", "source", "source_size", "target", "mean", F.when(met, F.col("tilt")).otherwise(reach).alias("tilt"), "low", "high", met.alias("done")), "tilt")
        open_ = state.where("not done").select("source").head(1)
        if not open_:
            break
    else:
        raise RuntimeError(f"source {open_[0]['source']!r} is not at its target after {NEWTON_ROUNDS} rounds")
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("target") <= 0, 0.0).when(full, F.lit(float(most))).otherwise(F.least(F.exp(F.least(F.col("tilt") * x, F.lit(50.0))), F.lit(float(most))))
    return cells.join(state.select("key", "target", "tilt", "source_size", "mean"), "key").select("key", "size", "n", F.round(rate, 9).alias("rate"))


def _copies(rated: DataFrame, goal: DataFrame, most: int) -> DataFrame:
    """(key, size, n, rate) -> (key, size, n, copies): whole copies of each cell, 0 to most * n.

    Rates are first rounded by systematic rounding down the sizes: copies so
    far are the rounded sum of rates so far, so a source is off by its longest
    text at most. Then whole copies are added or taken away in the size that
    best fits what is still off, while that brings a source nearer its target.
    """
    fine = F.round(F.col("n") * F.col("rate") * _FINE).cast("long")
    banded = rated.select("*", fine.alias("fine"), F.floor(F.col("size") / 64).alias("band"))
    bands = banded.groupBy("key", "band").agg(F.sum("fine").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("key").orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = banded.join(bands.select("key", "band", before.alias("before")), ["key", "band"]).withColumn(
        "upto", F.col("before") + F.sum("fine").over(Window.partitionBy("key", "band").orderBy(F.col("size").desc()))
    )

    def whole(c: Column) -> Column:
        return F.floor((c + _FINE // 2) / _FINE)

    k = F.least(whole(F.col("upto")) - whole(F.col("upto") - F.col("fine")), most * F.col("n"))
    cells = written(upto.select("key", "size", "n", F.greatest(k, F.lit(0)).cast("long").alias("copies")), "copies")
    for _ in range(MEND_ROUNDS):
        off = cells.groupBy("key").agg(F.sum(F.col("copies") * F.col("size")).alias("got")).join(goal.select("key", "target"), "key").select("key", (F.col("got") - F.col("target")).alias("off"))
        room = F.when(F.col("off") > 0, F.col("copies")).otherwise(most * F.col("n") - F.col("copies"))
        fit = cells.join(off, "key").where((F.col("size") > 0) & (room > 0) & (F.col("size") < 2 * F.abs("off")))
        best = fit.groupBy("key").agg(F.min(F.struct(F.abs(F.col("size") - F.abs("off")).alias("far"), "size", "off", room.alias("room"))).alias("b"))
        move = F.greatest(F.lit(1), F.least(F.col("b.room"), F.floor(F.abs("b.off") / F.col("b.size")))) * -F.signum("b.off")
        change = written(best.select("key", F.col("b.size").alias("size"), move.cast("long").alias("change")), "change")
        if not change.head(1):
            break
        cells = written(cells.join(change, ["key", "size"], "left").select("key", "size", "n", (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies")), "copies")
    return cells


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, carry: list[str] | None = None
) -> DataFrame:
    """Every row of docs with _ls_size, _ls_source_size, _ls_target and _ls_copies (0 to most).

    A document's rate is the tilted exp(tilt * size), most at the limit, with
    one tilt a source; rates are rounded to whole copies. Documents of a source
    and size share a rate; which of them get the odd copies is decided by a hash
    of id and text, so reruns agree. Null texts have size 0 and, like empty
    ones, rate 1; a null source is a source of its own, last in order. Repeated
    rows are documents of their own; null ids take part. The columns in carry
    (all of docs by default) pass through. An empty table gives an empty result.

    Words are counted once, into a written table of what is carried. Targets
    and tilts come from counts by (source, size), combined before their
    shuffle; the odd copies of a cell are dealt over hash buckets, by counts
    that have a row a bucket. Rows are shuffled once, by source, size and
    bucket, so no source and no group of copies meets in one task. Sources are
    put in order in one task, a row each; Spark broadcasts tables by source
    where it finds them small and else shuffles them.
    """
    carry = docs.columns if carry is None else carry
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))
    own = [F.col(f"`{c}`") for c in carry]
    sized = written(docs.select(*own, F.col(source_col).alias("_ls_source"), key.alias("_ls_key"), word_count(F.col(text_col)).alias("_ls_size"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_ls_tie")), "sized")
    per_size = written(sized.groupBy("_ls_key", "_ls_source", "_ls_size").agg(F.count("*").alias("n")).select(F.col("_ls_key").alias("key"), F.col("_ls_source").alias("source"), F.col("_ls_size").alias("size"), "n"), "cells")
    total, sizes = per_size.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], per_size.groupBy("key", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goal, cells = written(targets(sizes, weights, share, most), "targets"), per_size.select("key", "size", "n")
    copies = _copies(_tilt(cells, goal, most), goal, most)
    bucket = F.pmod("_ls_tie", F.lit(max(16, total // _BUCKET_ROWS)))
    by = sized.groupBy(F.col("_ls_key").alias("key"), F.col("_ls_size").alias("size"), bucket.alias("bucket")).agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = by.select("key", "size", "bucket", "m", before.alias("before")).join(copies, ["key", "size"]).join(goal.select("key", "source_size", "target"), "key")
    odd = F.col("copies") % F.col("n") - F.col("before")
    quota = quota.select(
        F.col("key").alias("_ls_key"), F.col("size").alias("_ls_size"), F.col("bucket").alias("_ls_bucket"),
        F.floor(F.col("copies") / F.col("n")).alias("_ls_base"), F.greatest(F.lit(0), F.least(odd, F.col("m"))).alias("_ls_odd"),
        F.col("source_size").alias("_ls_source_size"), F.col("target").alias("_ls_target"),
    )
    on = ["_ls_key", "_ls_size", "_ls_bucket"]
    place = F.row_number().over(Window.partitionBy(*on).orderBy("_ls_tie"))
    out = sized.withColumn("_ls_bucket", bucket).join(quota, on).withColumn("_ls_copies", (F.col("_ls_base") + F.when(place <= F.col("_ls_odd"), 1).otherwise(0)).cast("int"))
    return out.select(*own, "_ls_size", "_ls_source_size", "_ls_target", "_ls_copies")


def repeated(docs: DataFrame, **options) -> DataFrame:
    """docs as mixed: every row as often as it has copies, with the columns of docs.

    Nulls, ties, repeated rows and empty tables: as in mix(). An empty text has
    rate 1, so it is taken once.
    """
    mixed = mix(docs, **options).where("_ls_copies > 0")
    return mixed.withColumn("_ls_copy", F.explode(F.sequence(F.lit(1), "_ls_copies"))).select(*[F.col(f"`{c}`") for c in docs.columns])
