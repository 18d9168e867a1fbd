"""Sequence packing: shortest-pack-first over the length histogram.

Documents are tokenised, cut into pieces of at most one sequence, and only the histogram of piece lengths (at most
`width` entries, whatever the corpus) goes to the driver. Lengths are placed longest first: each goes into the open
packing patterns with least content that it fits, and pattern counts are updated. Patterns are joined back to the
pieces by each piece's rank among those of its length.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zlib
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import documents, held, mapped, ranked, written

WIDTH, END_ID, BUCKET_ROWS, CACHE, STEP = 4096, 2, 20_000, 1_000_000, 64
SEPARATORS = "\x1c\x1d\x1e\x1f"
WORD = re.compile(r"[^ \n\t\r]+")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words(dict):
    """The ids (bytes) of white-space-free words, worked out at first sight. A last full stop or comma after a letter is a
    token of its own, and the vocabulary lower-cases, so words that differ in these are looked up once."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def __missing__(self, word: str) -> bytes:
        low = word.lower() if word.isascii() else word
        if "<|" in word:  # the two special tokens are found before anything else, in this spelling only
            ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        elif len(low) > 1 and low[-1] in ".," and low[-2].isalpha() and low[-2].lower()[-1].isalpha():
            ids = self[low[:-1]] + self[low[-1]]
        elif low != word:
            ids = self[low]
        elif low.isascii() and low.isalpha():  # a single match of the pattern, and its bytes stand for themselves
            ids = array("I", [t.id for t in self.tokenizer.model.tokenize(low)]).tobytes()
        else:
            ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(self) >= CACHE:  # frequent words are soon met again
            self.clear()
        self[word] = ids
        return ids


def _encoder(path: str):
    """A function from a text to its ids. The pattern of this vocabulary never joins across white space, so the ids of a
    text are those of its words. str.split also splits at four separators that the vocabulary keeps."""
    kept = held("packing")
    if path not in kept:
        kept[path] = Words(path)
    words = kept[path]

    def encode(text: str) -> np.ndarray:
        found = WORD.findall(text) if any(c in text for c in SEPARATORS) else text.split()
        return np.frombuffer(b"".join(map(words.__getitem__, found)), np.uint32)

    return encode


def pieces(docs: DataFrame, path: str, width: int = WIDTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of docs(doc_id, text): every id in exactly one piece.

    A null text is empty and is its end id alone; a null id stays null. Special tokens in a text are those of the
    vocabulary. Repeated rows give repeated pieces, an empty table an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part, out = b.slice(at, 128), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(ids), width):
                        piece = ids[s : s + width]
                        out.append((doc, s, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def patterns(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[list[int], int]]:
    """[(lengths, count)]: each pattern is used count times; together they hold the histogram exactly."""
    open_: dict[int, list[tuple[list[int], int]]] = {}  # by space left
    heap: list[int] = []  # negative space left: least content first
    done: list[tuple[list[int], int]] = []

    def put(space: int, lengths: list[int], count: int) -> None:
        if space == 0:
            done.append((lengths, count))
            return
        if space not in open_:
            open_[space] = []
            heapq.heappush(heap, -space)
        open_[space].append((lengths, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while heap and not open_.get(-heap[0]):
                open_.pop(-heapq.heappop(heap), None)
            if heap and -heap[0] >= length:
                space = -heap[0]
                lengths, count = open_[space].pop()
                used = min(count, left)
                if used < count:
                    open_[space].append((lengths, count - used))
                put(space - length, [*lengths, length], used)
                left -= used
            else:
                fit = width // length  # only this length fits: fill whole packs with it
                full, rest = divmod(left, fit)
                if full:
                    put(width - fit * length, [length] * fit, full)
                if rest:
                    put(width - rest * length, [length] * rest, 1)
                left = 0
    return done + [p for group in open_.values() for p in group]


def slots(spark: SparkSession, found: list[tuple[list[int], int]]) -> DataFrame:
    """(length, low, high, base, offset): ranks [low, high) of a length go to sequences base, base + 1, ... at offset."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for lengths, count in found:
        at = 0
        for length in lengths:
            low = taken.get(length, 0)
            rows.append((length, low, low + count, base, at))
            taken[length] = low + count
            at += length
        base += count
    return spark.createDataFrame(rows, "length long, low long, high long, base long, offset long")


def packed(cut: DataFrame, width: int = WIDTH) -> DataFrame:
    """Add sequence_id and offset (gapless from 0) to pieces(doc_id, start, length, ids_crc32, ...).

    Rows that agree in all of these are interchangeable. An empty table gives an empty result.
    """
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(histogram.values())
    buckets = max(16, min(1 << 16, total // BUCKET_ROWS + 1))
    ties = [F.col(c).asc_nulls_first() for c in ("doc_id", "start", "ids_crc32")]
    hashed = cut.withColumn("_h", F.xxhash64("doc_id", "start"))
    numbered = ranked(hashed, ["length"], F.expr(f"(_h >> 32) * {buckets} div 4294967296"), [F.col("_h"), *ties], "rank")
    table = slots(cut.sparkSession, patterns(histogram, width)).withColumn("step", F.explode(F.expr(f"sequence(low div {STEP}, (high - 1) div {STEP})")))
    placed = numbered.withColumn("step", F.expr(f"rank div {STEP}")).join(table, ["length", "step"]).filter("rank >= low and rank < high").drop("step")
    return placed.withColumn("sequence_id", F.col("base") + F.col("rank") - F.col("low")).drop("_h", "rank", "low", "high", "base")


def op7_packing(spark, sf_dir):
    """Pieces of all documents, packed; a null text is empty and is its end id alone."""
    cut = written(pieces(documents(spark, sf_dir), vocabulary()), "pieces")
    return packed(cut).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


SQL: dict[str, str] = {}
