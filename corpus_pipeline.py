"""A corpus pipeline of five stages: language ID, exact dedup, n-gram Jaccard join, secret scans, packing.

Each stage works on all rows that the one before it kept. All but the last return the columns of documents. Rows are
told apart by id and text, so ids may be null or repeated; further columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import dedup, jaccard, langid, packing, secret_scan
from cohortloom.llm._util import documents, free, small_side, text_hash, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language; null texts and texts without a letter are rejected. lang becomes the predicted one."""
    profile = langid.profiles(docs.filter(langid.training(F.col("doc_id"))).select("text", "lang"))
    pred, score = free(docs, "lang_pred"), free(docs, "lang_score")
    named = langid.identified(docs, profile, pred_col=pred, score_col=score).filter(F.col(pred) != langid.UNKNOWN)
    return named.withColumn("lang", F.col(pred)).select(*docs.columns)


def _kept(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs that decided(doc_id, text_hash, kept), one row for each of docs, keeps.

    Texts are not shuffled unless the dropped rows are too many to broadcast. Of rows that agree in id and text, of which
    one is kept, one stays.
    """
    table = decided.groupBy("doc_id", "text_hash").agg(F.count_if("kept").alias("stay"), F.count(F.lit(1)).alias("n"))
    own, key = free(docs, "own_id"), free(docs, "own_hash")
    odd = written(table.filter("stay < n").select(F.col("doc_id").alias(own), F.col("text_hash").alias(key), (F.col("stay") > 0).alias("stay")), "odd")
    on = docs["doc_id"].eqNullSafe(F.col(own)) & (text_hash(docs["text"]) == F.col(key))
    rest = docs.join(small_side(odd), on, "left_anti")
    repeated = odd.filter("stay").drop("stay")
    if repeated.isEmpty():
        return rest
    one = docs.join(small_side(repeated), on).groupBy(own, key).agg(F.first(F.struct(*[docs[c] for c in docs.columns])).alias("row"))
    return rest.unionByName(one.select("row.*"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; a group without any id keeps one row."""
    return _kept(docs, written(dedup.exact_rows(docs), "groups"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the row with the smallest doc_id, rows without an id last; texts without words stay."""
    return _kept(docs, written(jaccard.keepers(docs), "components"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with each secret's characters replaced by one mark for each found span."""
    return secret_scan.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    cut = written(packing.pieces(docs, packing.vocabulary()), "pieces")
    return packing.packed(cut).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("secret_scans", secret_scans), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
