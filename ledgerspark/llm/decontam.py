"""Benchmark decontamination by spaced seeds."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.llm.common import at_work, written

#: By least window: masks (1: the token at this offset must agree; 0: any token may stand there) of which one at least
#: lies on agreeing tokens alone in every window of that many tokens or more, up to the next entry, that passes AGREE.
LOSSLESS = {
    8: ("111111", "1110111", "11011011"),
    10: ("110111", "11010011", "11111"),
    12: ("11101011", "1100100111", "111111"),
    15: ("1111011", "11001000111", "11010100011"),
    20: ("11101111", "1101100001011", "1100000010010111", "1111010011"),
}
#: Items with fewer tokens are found only where all of them stand in a row.
MIN_ITEM = 8
#: An overlap is this many aligned tokens (a shorter item: all its tokens) ...
WINDOW = 20
#: ... of which at least this share agree.
AGREE = 0.8
#: The filter of test hashes: bits for each of them, probes, and the most bits in all (128 MB). Beyond that it lets more through, never less.
BITS_PER_SEED, PROBES, MOST_BITS = 32, 6, 1 << 30
#: Rows of the test side up to which it is broadcast to the join; a larger one is joined by a shuffle, in SALTS copies so that no hash is hot.
MAX_BROADCAST, SALTS = 1_000_000, 8
#: Tokens of items up to which these are broadcast.
MAX_ITEM_TOKENS = 2_000_000

#: Punctuation outside ASCII that parts words, as ASCII punctuation does.
_WIDE = re.compile("[\u00a0-\u00bf\u2000-\u206f\u3000-\u303f]")
_TO_SPACE = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_AT_ONCE, _REMEMBERED = 1 << 17, 1 << 16
_PRIME, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and characters outside ASCII other than _WIDE."""
    t = (text or "").lower()
    if not t.isascii():
        t = _WIDE.sub(" ", t)
    return t.encode().translate(_TO_SPACE).split()


class _Names(dict):
    """Token -> its 64-bit hash, never 0; a bounded memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word) or 1
        return h


_names = _Names()


def _forget() -> None:
    _names.clear()


def token_hashes(text: str | None) -> np.ndarray:
    words = tokens(text)
    return np.fromiter(map(_names.__getitem__, words), np.uint64, len(words))


def masks_of(n: int) -> tuple[str, ...]:
    """The masks for an item of n tokens."""
    return LOSSLESS[max(w for w in LOSSLESS if w <= n)] if n >= MIN_ITEM else ("1" * n,)


def _offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def seeds_at(x: np.ndarray, mask: str, at: np.ndarray | None = None) -> np.ndarray:
    """Of each start (of all, or of those in at): the hash of the selected tokens and of the mask itself."""
    n = len(x) - len(mask) + 1
    h = np.full(max(n, 0) if at is None else len(at), np.uint64(xxhash.xxh64_intdigest(mask)), np.uint64)
    if len(h):
        for o in _offsets(mask):
            h = (h ^ (x[o : o + n] if at is None else x[at + o])) * _PRIME
            h ^= h >> np.uint64(29)
    return h


def item_seeds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of an item's tokens, by all its masks."""
    if not len(x):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    made = [seeds_at(x, m) for m in masks_of(len(x))]
    return np.concatenate(made), np.concatenate([np.arange(len(h)) for h in made])


def _slots(h: np.ndarray, bits: int, probe: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h + np.uint64(probe) * (h * _STEP | np.uint64(1))) * _PRIME >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)


def fill(bitmap: np.ndarray, h: np.ndarray) -> None:
    """Enters hashes in a bitmap of a power of two of bits."""
    for k in range(PROBES):
        at = _slots(h, len(bitmap) * 8, k)
        np.bitwise_or.at(bitmap, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def entered(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in h of hashes that the bitmap may hold; all that it holds are among them."""
    left = np.arange(len(h))
    for k in range(PROBES):
        at = _slots(h[left], len(bitmap) * 8, k)
        left = left[bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1]
    return left


def regions(docs: list[np.ndarray], masks: list[str], bitmap: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, first token, tokens, hashes, their places in the document) around hits.

    A region reaches WINDOW tokens to either side of its hits, so every window
    with a hit lies in one region; regions of a document do not touch.
    """
    gap = np.zeros(max(map(len, masks), default=1), np.uint64)  # no token between documents: no hit spans two
    begins = np.cumsum([0] + [len(d) + len(gap) for d in docs])
    flat = np.concatenate([x for d in docs for x in (d, gap)]) if docs else gap
    found_h, found_at, spans = [], [], []
    for mask in masks:
        h = seeds_at(flat, mask)
        at = entered(bitmap, h)
        at = at[np.logical_and.reduce([flat[at + o] > 0 for o in (0, len(mask) - 1)])] if len(at) else at
        found_h.append(h[at])
        found_at.append(at)
        spans.append(np.full(len(at), len(mask)))
    h, at, span = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (found_h, found_at, spans))
    if not len(at):
        return
    order = np.argsort(at, kind="stable")
    h, at, span = h[order], at[order], span[order]
    of = np.searchsorted(begins, at, "right") - 1
    low = np.maximum(at + span - WINDOW, begins[of])
    high = np.minimum(at + np.maximum(span, WINDOW), begins[of + 1] - len(gap))
    # low is not in order where masks differ in length, but its running minimum from the right is what begins a region
    reach = np.maximum.accumulate(high)
    least = np.minimum.accumulate(low[::-1])[::-1]
    cut = np.flatnonzero((least[1:] > reach[:-1]) | (of[1:] != of[:-1])) + 1
    for s, e in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]), strict=True):
        d, lo, hi = int(of[s]), int(low[s:e].min()), int(high[s:e].max())
        yield d, lo - int(begins[d]), flat[lo:hi], h[s:e], at[s:e] - begins[d]


def verified(region: np.ndarray, first: int, item: np.ndarray, shift: int) -> tuple[int, int, int, int] | None:
    """n_same, n_aligned, doc_word and item_word where the item, its first token at token `shift` of the document, passes AGREE in this region."""
    w = min(WINDOW, len(item))
    lo, hi = max(0, first - shift), min(len(item), first + len(region) - shift)
    if hi - lo < w:
        return None
    same = item[lo:hi] == region[lo + shift - first : hi + shift - first]
    sums = np.concatenate([[0], np.cumsum(same)])
    good = sums[w:] - sums[:-w] >= (AGREE * w if w >= MIN_ITEM else w)
    if not good.any():
        return None
    step = np.zeros(len(same) + 1, np.int64)
    step[:-w] += good
    step[w:] -= good
    covered = np.cumsum(step[:-1]) > 0
    at = lo + int(np.argmax(covered))
    return int((same & covered).sum()), int(covered.sum()), at + shift, at


class Searcher:
    """The same search for one text at a time, for use without a session: items (name, text) -> overlaps of a text."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.items = [(name, token_hashes(text)) for name, text in items]
        self.places: dict[int, list[tuple[int, int]]] = {}
        for i, (_, x) in enumerate(self.items):
            for h, q in zip(*(a.tolist() for a in item_seeds(x)), strict=True):
                self.places.setdefault(h, []).append((i, q))
        self.masks = sorted({m for _, x in self.items if len(x) for m in masks_of(len(x))})
        self.bitmap = np.zeros(1 << 17, np.uint8)
        fill(self.bitmap, np.fromiter(self.places, np.uint64, len(self.places)))

    def find(self, text: str | None) -> dict[object, tuple[int, int, int, int]]:
        """Item -> (n_same, n_aligned, doc_word, item_word) of its best overlap."""
        sums: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for _, first, region, hashes, at in regions([token_hashes(text)], self.masks, self.bitmap):
            tried = {(i, int(p) - q) for h, p in zip(hashes.tolist(), at, strict=True) for i, q in self.places.get(h, ())}
            for i, shift in tried:
                if got := verified(region, first, self.items[i][1], shift):
                    old = sums.get((i, shift), (0, 0, got[2], got[3]))
                    sums[i, shift] = (old[0] + got[0], old[1] + got[1], min(old[2], got[2]), min(old[3], got[3]))
        best: dict[object, tuple[int, int, int, int]] = {}
        for (i, _), (same, aligned, doc, own) in sums.items():
            name = self.items[i][0]
            best[name] = max(best.get(name, (0, 0, 0, 0)), (same, aligned, doc, own), key=lambda r: (r[0], -r[2], r[1], r[3]))
        return best


def _number(batch_rows: int, counter: list[int]) -> np.ndarray:
    """Numbers that no other row of this write has: the task's partition, then a count."""
    at = (TaskContext.get().partitionId() << 36) + counter[0]
    counter[0] += batch_rows
    return np.arange(at, at + batch_rows)


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [token_hashes(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(v) for v in x], pa.int32()), pa.array([v.tobytes() for v in x], pa.binary())], ["item_id", "n", "tokens"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = [0]
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_number(len(batch), counter)), batch.column(0), batch.column(1)], ["item", "n", "tokens"])


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            h, at = item_seeds(np.frombuffer(raw, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), key)), pa.array(at.astype(np.int32))], ["h", "item", "q"])


def _bitmap(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            fill(made, batch.column(0).to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([made.tobytes()], pa.binary())], ["bitmap"])

    return run


class Index:
    """The searchable form of a benchmark, in tables of the shared folder: rows (item_id, item), distinct items with their tokens, and their seeds (h, item, q)."""

    def __init__(self, benchmark: DataFrame, id_col: str, text_col: str, max_broadcast: int = MAX_BROADCAST, max_item_tokens: int = MAX_ITEM_TOKENS):
        spark = benchmark.sparkSession
        schema = T.StructType([T.StructField("item_id", benchmark.schema[id_col].dataType), T.StructField("n", T.IntegerType()), T.StructField("tokens", T.BinaryType())])
        rows = written(benchmark.select(id_col, text_col).mapInArrow(_item_rows, schema).where("n > 0"), "bench_rows")
        self.items = written(rows.select("n", "tokens").dropDuplicates(["tokens"]).mapInArrow(_numbered, "item long, n int, tokens binary"), "bench_items")
        self.rows = rows.select("item_id", "tokens").join(self.items, "tokens").select("item", "item_id", F.col("n").cast("long").alias("item_words"))
        self.seeds = written(self.items.mapInArrow(_seed_rows, "h long, item long, q int"), "bench_seeds")
        n_seeds = self.seeds.count()
        lengths = [r["n"] for r in self.items.select(F.least("n", F.lit(WINDOW)).alias("n")).distinct().collect()]
        n_tokens = self.items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.masks = sorted({m for n in lengths for m in masks_of(n)})
        self.small_seeds, self.small_items = n_seeds <= max_broadcast, n_tokens <= max_item_tokens
        bits = min(MOST_BITS, max(1 << 13, 1 << (BITS_PER_SEED * n_seeds).bit_length()))
        parts = self.seeds.select("h").coalesce(1).mapInArrow(_bitmap(bits), "bitmap binary").collect() if n_seeds else []
        self.bitmap = spark.sparkContext.broadcast(np.frombuffer(bytes(parts[0]["bitmap"]), np.uint8)) if parts else None


def _doc_regions(index: Index):
    masks, sent = index.masks, index.bitmap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("decontam", _forget)
        counter = [0]
        for batch in batches:
            rows = _number(len(batch), counter)
            at, column = 0, batch.column(1)
            while at < len(batch):
                held, size, first = [], 0, at
                while at < len(batch) and size < _AT_ONCE:
                    held.append(token_hashes(column[at].as_py()))
                    size += len(held[-1])
                    at += 1
                found = list(regions(held, masks, sent.value))
                if not found:
                    continue
                of = np.array([first + f[0] for f in found])
                own = [pa.array(rows[of]), batch.column(0).take(pa.array(of)), batch.column(2).take(pa.array(of)), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2].tobytes() for f in found], pa.binary())]
                ends = np.cumsum([0] + [len(f[3]) for f in found]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([f[k] for f in found]).astype(np.int64 if k == 4 else np.uint64).view(np.int64))) for k in (3, 4)]
                yield pa.RecordBatch.from_arrays([*own, *lists], ["row", "doc_id", "digest", "first", "tokens", "h", "p"])

    return run


_VERIFIED = T.StructType([T.StructField(n, T.LongType()) for n in ("n_same", "n_aligned", "doc_word", "item_word")])


@F.pandas_udf(_VERIFIED)
def _verify(region: pd.Series, first: pd.Series, item: pd.Series, shift: pd.Series) -> pd.DataFrame:
    each = zip(region, first.tolist(), item, shift.tolist(), strict=True)
    made = [verified(np.frombuffer(r, np.uint64), f, np.frombuffer(i, np.uint64), s) or (None,) * 4 for r, f, i, s in each]
    return pd.DataFrame(made, columns=_VERIFIED.names).astype("Int64")


#: Called once a row: a filter on a deterministic function's result would call it again, in workers of its own.
_verify_once = _verify.asNondeterministic()


def _met(left: DataFrame, right: DataFrame, key: str, small: bool, salt: str) -> DataFrame:
    """left joined to right by key: by a broadcast of a right side whose size was checked, else by a shuffle in which each key of left is dealt over SALTS tasks."""
    if small:
        return left.join(F.broadcast(right), key)
    copies = right.withColumn("_ls_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_ls_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(copies.hint("merge"), [key, "_ls_salt"]).drop("_ls_salt")


def alignments(docs: DataFrame, index: Index, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, digest (of the text), item and the best verified overlap: one row per row of docs and distinct item with one.

    Documents are scanned once: where the filter lets a hash through, the
    tokens around it and the hash are written. Training hashes then meet test
    hashes in an equality join, the alignments found are made distinct, and
    each is verified on the tokens of its region and its item.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", kind), *T._parse_datatype_string("digest binary, first int, tokens binary, h array<long>, p array<long>").fields])
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.unhex(F.md5(F.col(text_col))).alias("digest"))
    found = written(slim.mapInArrow(_doc_regions(index), schema).withColumn("region", F.monotonically_increasing_id()), "regions")
    hits = found.select("region", F.explode(F.arrays_zip("h", "p")).alias("s")).select("region", F.col("s.h").alias("h"), F.col("s.p").alias("p"))
    laid = _met(hits, index.seeds, "h", index.small_seeds, "region").select("region", "item", (F.col("p") - F.col("q")).alias("shift")).distinct()
    # by a shuffle: equal passages make the table of regions small on disk, not in memory
    texts = _met(laid.join(found.select("region", "row", "doc_id", "digest", "first", "tokens").hint("merge"), "region"), index.items.select("item", F.col("tokens").alias("own")), "item", index.small_items, "region")
    tried = texts.select("row", "doc_id", "digest", "item", "shift", _verify_once("tokens", F.col("first").cast("long"), "own", "shift").alias("v")).where("v.n_same is not null")
    # an overlap may go on in another region of the row
    whole = tried.groupBy("row", "item", "shift").agg(F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"), F.sum("v.n_same").alias("n_same"), F.sum("v.n_aligned").alias("n_aligned"), F.min("v.doc_word").alias("doc_word"), F.min("v.item_word").alias("item_word"))
    best = F.max_by(F.struct("n_same", "n_aligned", "doc_word", "item_word"), F.struct("n_same", (-F.col("doc_word")).alias("d"), "n_aligned", "item_word"))
    return whole.groupBy("row", "item").agg(F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"), best.alias("b"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", **index_options) -> DataFrame:
    """One row per row of docs and row of benchmark with a verified overlap.

    Tokens are those of tokens(). A training position and a test position are a
    hit if they agree at all selected positions of one mask; there the item is
    laid along the document, and an overlap holds if WINDOW aligned tokens (all
    of a shorter item) agree in AGREE of them, whatever the substitutions: no
    such window is without a hit of the masks for the item's length. n_aligned
    tokens are in such windows, n_same of them agree; doc_word and item_word are
    where they begin. Equal overlaps of one item: the one with most agreeing
    tokens, then the first. Items of fewer than MIN_ITEM tokens must stand in
    the document in full, unchanged. Null and empty texts match nothing, items
    with a null id are not sought (clean() seeks them), a null doc_id is
    carried, repeated rows of either table repeat their result (an item_id with
    several texts has a row for each that is found), an empty table gives no
    rows; other columns are not read.

    Documents are scanned once whatever the size of the benchmark. What reaches
    the driver and every task is the filter, MOST_BITS at most; equal passages
    are met in joins that no hot hash or item can skew.
    """
    index = Index(benchmark.where(F.col(item_col).isNotNull()), item_col, text_col, **index_options)
    if index.bitmap is None:
        nothing = [F.lit(None).cast("long").alias(c) for c in ("item_id", "n_same", "n_aligned", "doc_word", "item_word", "item_words")]
        return docs.select(F.col(id_col).alias("doc_id"), *nothing).where("false")
    return _met(alignments(docs, index, id_col, text_col), index.rows, "item", index.small_items, "row").select("doc_id", "item_id", "b.*", "item_words")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **index_options) -> DataFrame:
    """docs without the rows that overlap any item of benchmark, by the rule of overlaps(), with an id or without.

    A row goes or stays by its text alone, so equal rows share their fate, and
    rows with a null or empty text stay; null ids, ties and columns of any name
    pass through. Texts that go are named by their digests in an anti join.
    """
    index = Index(benchmark.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), "id", "text", **index_options)
    if index.bitmap is None:
        return docs
    # written, so that its size is known before the join is planned: texts are shuffled only where it is too large to broadcast
    bad = written(alignments(docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), index, "id", "text").select(F.col("digest").alias("_ls_digest")).distinct(), "leaks")
    return docs.join(bad, F.unhex(F.md5(F.col(text_col))) == F.col("_ls_digest"), "left_anti")
