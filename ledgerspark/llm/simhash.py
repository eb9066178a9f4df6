"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.llm.common import at_work, written
from ledgerspark.llm.components import connected_components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Six blocks; two fingerprints within three bits agree on at least three of them.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Pieces of the free bits in the second tier. A bucket leaves three open, 4 + 4 + 5 bits at most (the last piece of 33
#: free bits has five): it holds 2 ** 13 different fingerprints at most.
SUB_BITS, SUB_BLOCKS = 4, 8
MAX_RUN, MAX_SUB_RUN = 1 << 12, 1 << 13
_AT_ONCE = 1 << 16


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of one text; 0 for a null text or one without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    spans = list(zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(spans), _AT_ONCE):
        part = spans[at : at + _AT_ONCE]
        h = np.fromiter((digest(line[s:e], SEED) for s, e in part), np.uint64, len(part))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(spans), bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    at_work("simhash")
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def _block_masks() -> list[int]:
    ends = np.cumsum(BLOCKS)
    block = [((1 << size) - 1) << (int(end) - size) for size, end in zip(BLOCKS, ends, strict=True)]
    return [sum(block[i] for i in c) for c in combinations(range(len(BLOCKS)), len(BLOCKS) - MAX_BITS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _sub_masks(mask: int) -> list[int]:
    """mask with five of the eight four-bit pieces of the bits it leaves free."""
    free = [i for i in range(64) if not mask >> i & 1]
    pieces = [sum(1 << b for b in free[i * SUB_BITS : (i + 1) * SUB_BITS]) for i in range(SUB_BLOCKS - 1)]
    pieces.append(sum(1 << b for b in free[(SUB_BLOCKS - 1) * SUB_BITS :]))
    return [mask | sum(c) for c in combinations(pieces, SUB_BLOCKS - MAX_BITS)]


def _forest(fps: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among different fingerprints: fewer pairs than fingerprints."""
    left = fps
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= MAX_BITS
            for x in left[near]:
                yield int(at), int(x)
            queue.extend(left[near])
            left = left[~near]


def _runs(tables: Iterator[pa.RecordBatch], tier: int) -> Iterator[pa.RecordBatch]:
    """Links within each run of equal (t, key) of sorted rows.

    A run beyond MAX_RUN is passed on, row by row, with over = its t: the
    second tier splits it, and links every run whole. Memory: one batch and one
    run of MAX_RUN rows, in the second tier of MAX_SUB_RUN.
    """
    held = {"t": np.empty(0, np.int64), "key": np.empty(0, np.int64), "fp": np.empty(0, np.uint64)}
    overflowing: tuple[int, int] | None = None

    def out(pairs: list[tuple[int, int]], over: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        a = np.array([p[0] for p in pairs], np.uint64).view(np.int64)
        b = np.array([p[1] for p in pairs], np.uint64).view(np.int64)
        o = np.concatenate([np.full(len(f), t) for t, f in over]) if over else np.empty(0, np.int64)
        f = np.concatenate([f for _, f in over]).view(np.int64) if over else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([a, f])), pa.array(np.concatenate([b, f])), pa.array(np.concatenate([np.full(len(a), -1), o]).astype(np.int64))],
            ["a", "b", "over"],
        )

    def handle(d: dict[str, np.ndarray], last: bool):
        nonlocal overflowing, held
        n = len(d["t"])
        if not n:
            return None
        cut = np.flatnonzero((d["t"][1:] != d["t"][:-1]) | (d["key"][1:] != d["key"][:-1])) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [n]])
        if not last:
            held = {k: v[starts[-1] :] for k, v in d.items()}
            starts, ends = starts[:-1], ends[:-1]
        else:
            held = {k: v[:0] for k, v in d.items()}
        pairs: list[tuple[int, int]] = []
        over: list[tuple[int, np.ndarray]] = []
        size = ends - starts
        for i in np.flatnonzero(size > 1):
            s, e = starts[i], ends[i]
            name = (int(d["t"][s]), int(d["key"][s]))
            if tier == 1 and (e - s > MAX_RUN or name == overflowing):
                over.append((name[0], d["fp"][s:e]))
            else:
                pairs.extend(_forest(d["fp"][s:e]))
        if overflowing and len(starts) and size[0] == 1 and (int(d["t"][0]), int(d["key"][0])) == overflowing:
            over.append((overflowing[0], d["fp"][:1]))
        if len(held["t"]) > (MAX_RUN if tier == 1 else MAX_SUB_RUN):
            if tier == 2:
                raise AssertionError("a second-tier bucket holds more than 2 ** 13 different fingerprints")
            overflowing = (int(held["t"][0]), int(held["key"][0]))
            over.append((overflowing[0], held["fp"]))
            held = {k: v[:0] for k, v in held.items()}
        return out(pairs, over) if pairs or over else None

    for batch in tables:
        new = {"t": batch.column(0).to_numpy(), "key": batch.column(1).to_numpy(), "fp": batch.column(2).to_numpy().view(np.uint64)}
        if (made := handle({k: np.concatenate([held[k], new[k]]) for k in new}, False)) is not None:
            yield made
    if (made := handle(held, True)) is not None:
        yield made


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _runs(batches, 1)


def _second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _runs(batches, 2)


def _split_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, fp) of first-tier runs that are too long -> (t, key, fp) of the second tier."""
    masks = [np.array(_sub_masks(m), np.uint64) for m in _block_masks()]
    for batch in batches:
        t, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        for which in np.unique(t):
            own = fp[t == which]
            for j, m in enumerate(masks[which]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), which * 64 + j)), pa.array((own & m).view(np.int64)), pa.array(own.view(np.int64))], ["t", "key", "fp"])


_LINKS = "a long, b long, over long"
_KEYED = "t long, key long, fp long"


def links(fps: DataFrame) -> DataFrame:
    """Different fingerprints (fp long) -> (a, b) links within MAX_BITS whose closure is that of all links.

    Fingerprints that share three of six blocks meet in one bucket; there the
    Hamming distance is taken and a spanning forest of the links kept, not all
    pairs. Buckets over MAX_RUN fingerprints are split again by five of eight
    pieces of four bits or so of the other bits, which leaves 2 ** 13 different
    fingerprints a bucket at most.
    """
    keys = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(_block_masks())]))
    keyed = fps.select(keys.alias("k"), "fp").select("k.t", "k.key", "fp")
    first = written(keyed.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(_first, _LINKS), "links")
    over = first.where("over >= 0").select(F.col("over").alias("t"), F.col("a").alias("fp")).mapInArrow(_split_over, _KEYED)
    second = over.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(_second, _LINKS)
    return first.where("over < 0").select("a", "b").unionByName(second.select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id, signed fp, tie (a hash of the text), root (a fingerprint that names the component).

    Null and empty texts have fingerprint zero and link like any other. Rows
    with a null id take part but name no component: component_id is the smallest
    id that is not null, or null if there is none. Repeated rows come back as
    often as they come in. Other columns are not read. An empty table gives an
    empty result.
    """
    base = written(docs.select(F.col(id_col).alias("doc_id"), _fingerprints(F.col(text_col)).alias("fp"), F.xxhash64(text_col).alias("tie")), "fingerprints")
    reps = base.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = connected_components(links(reps.select("fp")))
    named = reps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of = named.join(lowest, "root").select("fp", "component_id", "root")
    return base.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp", "tie", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each near-duplicate group: the one with the smallest id, and of texts under that id the one with the smallest hash.

    Wholly equal rows (id and text) count as one document, and one of them
    stays. Rows of one id with different texts are judged each by its own. Rows
    with a null id cannot be named and all stay; null and empty texts are
    near-duplicates of one another. Columns of any name pass through; an empty
    table gives an empty one. What goes is named by (id, hash) in an anti join,
    so texts are shuffled only where that list is too large to broadcast.
    """
    found = written(near_duplicates(docs, id_col, text_col).where("doc_id is not null").groupBy("doc_id", "tie").agg(F.first("component_id").alias("component_id"), F.first("root").alias("root"), F.count("*").alias("n")), "groups")
    # only rows of a group's smallest id can be its best, so no group is gathered; groups may share that id, not their root
    heads = found.where(F.col("doc_id") == F.col("component_id")).withColumn("best", F.col("tie") == F.min("tie").over(Window.partitionBy("doc_id", "root")))
    judged = found.where(F.col("doc_id") != F.col("component_id")).withColumn("best", F.lit(False)).unionByName(heads)
    judged = written(judged.where("not best or n > 1").select(F.col("doc_id").alias("_ls_id"), F.col("tie").alias("_ls_tie"), F.col("best").alias("_ls_best")), "judged")
    on = lambda d: (d[id_col] == F.col("_ls_id")) & (F.xxhash64(d[text_col]) == F.col("_ls_tie"))
    alone = docs.join(judged.select("_ls_id", "_ls_tie"), on(docs), "left_anti")
    again = docs.join(judged.where("_ls_best").select("_ls_id", "_ls_tie"), on(docs), "left_semi")
    place = F.row_number().over(Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(id_col))
    return alone.unionByName(again.withColumn("_ls_rank", place).where("_ls_rank = 1").drop("_ls_rank"))
