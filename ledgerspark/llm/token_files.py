"""Token-id files: ranked ids in a byte-aligned variable-length code with control bytes apart.

A file set is a folder with two Parquet tables. "blocks": one row per block of
documents with part (the file's place in id order), block (its place in the
part), doc_ids, lengths (ids of each document), control and data. "ranks": the
id of each frequency rank. Each id is stored as its rank, in one to four
little-endian bytes in data; control has two bits per id (its bytes less one),
four ids a byte, first id lowest. Parquet is only the container, so any store
that Spark writes will do, and Spark's commit protocol covers lost executors.
"""

from __future__ import annotations

import os
import string
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import at_work, delete_path, new_path

END_ID = 2
BLOCK_IDS = 1 << 18
#: Words kept by each Python worker with their ids.
CACHE_WORDS = 1_000_000

_MARKS = string.punctuation
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
_SUMS = _LENGTHS.sum(1).astype(np.int64)
#: Between tokenizing and sorting: ids in two or four bytes each, as the vocabulary needs (unranked ids rarely fit one).
_IDS = "doc_id long, n long, ids binary"
_BLOCK = "doc_ids array<long>, lengths array<long>, control binary, data binary"


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Unsigned 32-bit values -> (control bytes, data bytes)."""
    v = values.astype("<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = size - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values back: sizes by table lookup of each control byte, then one gather per byte place."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(size, dtype=np.int64)
    if n and ends[-1] != len(data) or not n and data:
        raise ValueError("data bytes do not fit the control bytes")
    at = ends - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = size > k
        if not more.any():
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class _Known(dict):
    """Word -> ids as bytes; a word that is not there is learned."""

    def __init__(self, learned: Callable[[str], bytes]):
        super().__init__()
        self.learned = learned

    def __missing__(self, w: str) -> bytes:
        return self.learned(w)


class WordEncoder:
    """Encodes texts with a tokenizers file, word by word with a bounded memory of words.

    Texts are cut at spaces and newlines. That changes no id for a tokenizer
    that drops white space before its model sees words; the constructor checks
    it by encoding a probe both ways and else encodes whole texts.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Known(self.learned)
        self.known[""] = b""
        self.older: dict[str, bytes] = {}
        self.cache_words = cache_words
        probe = "Zürich ÇA straße Ñandú İz ÿ It's a  Test,of \n\n don't <|endoftext|> x<|endoftext|>y 12,5 É.\t é ... , \x1c a\x85b"
        self.ends: dict[str, bytes] = {}
        self.width = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        own = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c]
        spare = iter(range(256, 512))  # byte-level models name each other byte by the next of these
        self.byte_names = [chr(c) if c in own else chr(next(spare)) for c in range(256)]
        self.by_word = True
        words = probe.replace("\n", " ").split(" ")
        letters = [w for w in words if self._plain(w)]
        self.by_word = self._whole([probe])[0] == b"".join(self._whole(words)) and self._whole(letters) == [self._letters(w) for w in letters]
        if self.by_word:
            marked = ["Ab,", "ab.,", "a'", "b-'s", "É!!", "c###", "d<|", "e'.", "f_"]
            self.by_word = self._whole(marked) == [self.known[w] for w in marked]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learned(self, w: str) -> bytes:
        """A new word's ids: letters alone go to the tokenizer's model, ASCII marks after letters are a word of their own, anything else goes through all of the library.

        The memory has two halves: when the first is full it becomes the second,
        and what is asked for again moves back, so frequent words stay.
        """
        if len(self.known) >= self.cache_words // 2:
            self.older = dict(self.known)
            self.known.clear()
            self.ends.clear()
            self.known[""] = b""
        if (ids := self.older.get(w)) is not None:
            self.known[w] = ids
            return ids
        head = w.rstrip(_MARKS)
        if not self._plain(head):
            ids = self._whole([w])[0]
        else:
            ids = self._letters(head)
            if len(head) < len(w):
                tail = w[len(head) :]
                if (end := self.ends.get(tail)) is None:
                    end = self.ends[tail] = self._whole([tail])[0]
                ids += end
        self.known[w] = ids
        return ids

    def _plain(self, w: str) -> bool:
        return self.by_word and w.isalpha() and (w.isascii() or (max(w) < "\u0250" and w.lower().isalpha()))

    def _letters(self, w: str) -> bytes:
        """A run of Latin letters is one word to the model: lower-cased, its bytes as the model's characters."""
        low = w.lower()
        ids = self.known.get(low)  # a look that learns nothing
        if ids is None:
            spelled = low if low.isascii() else "".join(map(self.byte_names.__getitem__, low.encode()))
            ids = self.known[low] = array("I", [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        t = text or ""
        if not self.by_word:
            return np.frombuffer(self._whole([t])[0], "<u4")
        words = (t.lower() if _simple(t) else t).replace("\n", " ").split(" ")
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4")


def _simple(t: str) -> bool:
    """Lower case first changes no id: the tokenizer does so itself, and neither composition nor a special token is in play."""
    if "<|" in t:
        return False
    if t.isascii():
        return True
    try:
        t.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _tokenized(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("token_files", _encoder.cache_clear)
        encoder = _encoder(path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids = [np.append(encoder.encode(t), np.uint32(end_id)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(encoder.width).tobytes() for x in ids], pa.binary())], ["doc_id", "n", "ids"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        n, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        if raw:
            own = np.bincount(np.frombuffer(b"".join(raw), f"<u{len(raw[0]) // n[0]}"))
            if len(own) > len(total):
                total = np.concatenate([total, np.zeros(len(own) - len(total), np.int64)])
            total[: len(own)] += own
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])


def _blocked(rank_of: np.ndarray, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        docs, lengths, held, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), f"<u{len(held[0]) // lengths[0]}")
            control, data = pack(rank_of[ids])
            row = [[part], [block], [docs], [lengths], [control], [data]]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["part", "block", "doc_ids", "lengths", "control", "data"])

        for batch in batches:
            for doc, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and size + n > block_ids:
                    yield out()
                    docs, lengths, held, size, block = [], [], [], 0, block + 1
                docs.append(doc)
                lengths.append(n)
                held.append(raw)
                size += n
        if held:
            yield out()

    return run


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of docs, each with end_id after them, to folder.

    Documents stand in ascending id order: null ids first, equal ids by a hash
    of their ids, then by these; every row is written, repeated ones too. A null text is an
    empty one (its end_id alone). Texts are tokenized once, where they are
    read; only ids are shuffled. A document is never cut: a block holds
    block_ids ids at most unless one document has more. The counts that rank
    ids reach the driver: one number per id of the tokenizer's vocabulary.
    """
    spark = docs.sparkSession
    scratch = new_path(spark, "tokenized")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    slim.mapInArrow(_tokenized(tokenizer_path, end_id), _IDS).write.option("compression", "zstd").parquet(scratch)
    ids = spark.read.schema(_IDS).parquet(scratch)
    counts = ids.select("n", "ids").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    ranked = [r["id"] for r in sorted(counts, key=lambda r: (-r["n"], r["id"]))]
    rank_of = np.zeros(max(ranked, default=0) + 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    spark.createDataFrame([(i, x) for i, x in enumerate(ranked)], "rank long, id long").coalesce(1).write.parquet(f"{folder}/ranks")
    tied = ids.withColumn("tie", F.xxhash64("ids"))  # rows without an id, or of one id, are still dealt over files
    in_order = tied.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids").drop("tie")
    in_order.mapInArrow(_blocked(rank_of, block_ids), f"part long, block long, {_BLOCK}").write.option("compression", "none").parquet(f"{folder}/blocks")
    delete_path(spark, scratch)


def _decoded(id_of: np.ndarray, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, docs, lengths, control, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                ends = np.cumsum(lengths, dtype=np.int64)
                ids = id_of[unpack(control, data, int(ends[-1]))].astype("<u4")
                own = [ids[e - n : e] for e, n in zip(ends, lengths, strict=True)]
                cols = [pa.array([part] * len(docs), pa.int64()), pa.array([block] * len(docs), pa.int64()), pa.array(docs, pa.int64()), pa.array(ends - lengths), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
                names = ["part", "block", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([x.tolist() for x in own], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document, decoded from the files in folder.

    start: ids of all documents before it. It is summed in two steps: blocks
    within a part, and the parts' totals (a row per part).
    """
    ranked = [r["id"] for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()]
    stored = spark.read.schema(f"part long, block long, {_BLOCK}").parquet(f"{folder}/blocks")
    decoded = stored.mapInArrow(_decoded(np.array(ranked, np.uint32), with_ids), "part long, block long, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    sizes = stored.select("part", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    blocks = sizes.withColumn("block_start", F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).join(parts, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("from"))
    return decoded.join(blocks, ["part", "block"]).select("doc_id", (F.col("from") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def encode_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """write() to folder (a new one in the shared folder by default), then read()."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    write(docs, folder, tokenizer_path, end_id)
    return read(spark, folder)
