"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (one to three letters, with spaces at word edges)
in order of frequency. A document's own most frequent n-grams are compared with each profile: every n-gram adds how far
out of place it is, or the full penalty if the profile lacks it. The nearest profile names the language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from ._util import documents, mapped

TOP, UNKNOWN, CHUNK, WINDOW = 400, "und", 1 << 19, 1 << 20
SPACE = 32
_letters: list[np.ndarray] = []


def training(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 != 2


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _windows(text: str) -> Iterator[str]:
    """The text in stretches of WINDOW characters, each cut at its last space if it has one."""
    at = 0
    while at < len(text):
        end = at + WINDOW
        if end < len(text):
            end = text.rfind(" ", at, end) + 1 or end
        yield text[at:end]
        at = end


def _grams(text: str) -> Iterator[np.ndarray]:
    """Codes of the 1- to 3-grams (21 bits a letter) that hold a letter, for each stretch of the text; none spans two words.

    Letters are lower-cased, all else is a single space, with one at both ends. Two points are carried over each cut.
    """
    carry = np.array([SPACE], np.int64)
    parts = _windows(text) if len(text) > WINDOW else [text]
    for part in (*parts, " "):
        p = np.frombuffer(part.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        p = np.concatenate([carry, np.where(_letter_table()[p], p, SPACE)])
        keep = np.ones(len(p), bool)
        keep[1:] = (p[1:] != SPACE) | (p[:-1] != SPACE)
        old, p = len(carry), p[keep]
        one = p[old:]
        one = one[one != SPACE]
        two = ((p[:-1] << 21) | p[1:])[old - 1 :]
        three = ((p[:-2] << 42) | (p[1:-1] << 21) | p[2:])[p[1:-1] != SPACE] if len(p) > 2 else p[:0]
        yield np.concatenate([one, two, three])
        carry = p[-2:]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    names, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return names, np.bincount(where, np.concatenate([p[1] for p in parts]), len(names)).astype(np.int64)


def _most(text: str, top: int) -> np.ndarray:
    """The codes of the text's most frequent n-grams in order; ties by code."""
    names, counts = _merged([np.unique(g, return_counts=True) for g in _grams(text)])
    if len(names) > top:
        floor = np.partition(counts, len(counts) - top)[len(counts) - top]
        names, counts = names[counts >= floor], counts[counts >= floor]
    return names[np.lexsort((names, -counts))[:top]]


def profiles(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, code) of docs(text, lang): each language's `top` most frequent n-grams. Null texts and langs are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        held: dict[str, int] = {}

        def fold(lang: str) -> None:
            if waiting.get(lang):
                tally.setdefault(lang, []).append(np.unique(np.concatenate(waiting.pop(lang)), return_counts=True))
                held[lang] = 0
                if len(tally[lang]) > 8:
                    tally[lang] = [_merged(tally[lang])]

        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                for g in _grams(text.as_py()):
                    waiting.setdefault(lang, []).append(g)
                    held[lang] = held.get(lang, 0) + len(g)
                    if held[lang] > CHUNK:
                        fold(lang)
        for lang in set(tally) | set(waiting):
            fold(lang)
            names, counts = _merged(tally[lang])
            for i in range(0, len(names), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names[part])), pa.array(names[part]), pa.array(counts[part])], names=["lang", "code", "c"])

    told = docs.filter("text is not null and lang is not null").select("text", "lang")
    total = mapped(told, run, "lang string, code long, c long").groupBy("lang", "code").agg(F.sum("c").alias("c"))
    order = Window.partitionBy("lang").orderBy(F.desc("c"), "code")
    # Filtered under its own name, so that each task passes on its own first `top` codes of a language and no more.
    first = total.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return first.select("lang", (F.col("rank") - 1).alias("rank"), "code")


def identified(
    docs: DataFrame, profile: DataFrame, text_col: str = "text", top: int = TOP, keep_text: bool = True, pred_col: str = "lang_pred", score_col: str = "score"
) -> DataFrame:
    """docs with pred_col and score_col added, without the text if keep_text is False.

    `profile` holds `top` rows a language and so is bounded by the number of languages. A text that is null or has no
    letter, or any text when there is no profile, is `und` with score 0. Score: how much nearer than the full penalty
    the nearest profile is, 0 to 1. Equal distances go to the language that sorts first. Repeated rows give repeated
    rows, an empty table an empty result. Other columns stay; those named pred_col or score_col are replaced.
    """
    table = profile.toPandas()
    langs = sorted(table["lang"].unique())
    codes = np.unique(table["code"].to_numpy(np.int64))
    ranks = np.full((max(1, len(langs)), len(codes) + 1), top, np.int64)
    for i, lang in enumerate(langs):
        own = table[table["lang"] == lang]
        ranks[i, np.searchsorted(codes, own["code"].to_numpy(np.int64))] = own["rank"].to_numpy(np.int64)

    def one(text: str | None) -> tuple[str, float]:
        g = _most(text, top) if text and langs else np.zeros(0, np.int64)
        if not len(g):
            return UNKNOWN, 0.0
        where = np.searchsorted(codes, g)
        found = codes[np.minimum(where, len(codes) - 1)] == g
        place = ranks[:, np.where(found, where, len(codes))]
        away = np.where(place == top, top, np.abs(place - np.arange(len(g)))).sum(axis=1)
        best = int(np.argmin(away))
        return langs[best], float(1 - away[best] / (top * len(g)))

    docs = docs.drop(pred_col, score_col)
    at = docs.columns.index(text_col)
    out = [i for i, c in enumerate(docs.columns) if keep_text or c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(t.as_py()) for t in b.column(at)]
            added = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in out), *added], names=[*(b.schema.names[i] for i in out), pred_col, score_col])

    schema = StructType([docs.schema.fields[i] for i in out]).add(pred_col, StringType()).add(score_col, DoubleType())
    return mapped(docs, run, schema)


def op2_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    profile = profiles(docs.filter(training(F.col("doc_id"))).select("text", "lang"))
    return identified(docs.select("doc_id", "text"), profile, keep_text=False).select("doc_id", (~training(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


SQL: dict[str, str] = {}
