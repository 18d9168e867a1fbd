"""Exact deduplication by deterministic block naming.

A text is cut into fixed-size blocks. Distinct blocks are sorted by content and numbered, so equal blocks and only they
share an integer name; adjacent pairs of names are named the same way until each document has one identity. DataFrame
functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import documents, text_hash, written

BLOCK, HEAD = 4096, 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty. Texts of ASCII alone take the faster lower()."""
    full = F.coalesce(text, F.lit(""))
    return F.when(F.char_length(full) == F.octet_length(full), F.lower(full)).otherwise(F.translate(full, UPPER, LOWER))


def _blocks(body: Column, size: int) -> Column:
    count = F.greatest(F.lit(1), F.ceil(F.length(body) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(body, i * size + 1, F.lit(size)))


def _block_names(docs: DataFrame, text: Column, size: int) -> DataFrame:
    """(key, name): blocks that recur, sorted by their first bytes and key and numbered; one that occurs once has no name here.

    The key (SHA-256) carries a name back to its block. Contents are compared: a key with two contents stops the job.
    Copies within a task meet before the shuffle, so a hot block crosses it once for each task. Only the first bytes are
    sorted, as range bounds are sampled to the driver.
    """
    cut = docs.select(F.explode(_blocks(normalised(text).cast("binary"), size)).alias("bytes")).select(F.unhex(F.sha2("bytes", 256)).alias("key"), "bytes")
    met = cut.groupBy("key").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high"), F.count(F.lit(1)).alias("n"))
    sure = F.when(F.col("low") == F.col("high"), F.substring("low", 1, HEAD)).otherwise(F.raise_error(F.lit("two blocks share a key")))
    return met.filter("n > 1").select("key", sure.alias("head")).orderBy("head", "key").select("key", F.monotonically_increasing_id().alias("name"))


def _pair_names(pairs: DataFrame) -> DataFrame:
    return pairs.select("left", "right").distinct().orderBy("left", "right").withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, text: Column, rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """(row, blocks, name) of rows(row, keys): one collision-free identity for each text, by recursive pair naming.

    Texts of equally many blocks end in the same round; a text is out of the rounds after its own.
    """
    spread = rows.select("row", F.size("keys").alias("blocks"), F.posexplode("keys").alias("pos", "key"))
    alone = -1 - F.col("row") * 2  # no other row has it, whatever the position
    level = spread.join(_block_names(docs, text, size), "key", "left").select("row", "blocks", "pos", F.coalesce("name", alone).alias("name"))
    most, width, ended = rows.agg(F.max(F.size("keys"))).first()[0] or 1, 1, []
    while width < most:  # one round for each doubling of the longest text
        level = written(level, "names")
        ended.append(level.filter(F.col("blocks") <= width).select("row", "blocks", "name"))
        paired = level.filter(F.col("blocks") > width).groupBy("row", "blocks", F.expr("pos div 2").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-2)).alias("right"))
        level = paired.join(_pair_names(paired), ["left", "right"]).select("row", "blocks", "pos", "name")
        width *= 2
    return reduce(DataFrame.unionByName, ended, level.select("row", "blocks", "name"))


def exact_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """exact_groups with text_hash, which with the id tells a row from any other that is not its equal."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    text = F.col("text")
    body = normalised(text).cast("binary")
    keys = F.transform(_blocks(body, size), lambda b: F.unhex(F.sha2(b, 256)))
    rows = written(
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_hash(text).alias("text_hash"), F.sha2(body, 256).alias("text_sha256"), keys.alias("keys")), "rows")
    root = written(identities(docs, text, rows, size).join(rows.drop("keys"), "row"), "root")
    groups = root.groupBy("blocks", "name").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    return root.join(groups, ["blocks", "name"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256", "text_hash")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest id stays, one
    of them if that id is repeated; a group whose ids are all null keeps one row and has a null keep_id. Other columns
    are ignored, an empty table gives an empty result.
    """
    return exact_rows(docs, id_col, text_col, size).drop("text_hash")


def op9_exact_dedup(spark, sf_dir):
    return exact_groups(documents(spark, sf_dir))


SQL = {
    "op9_exact_dedup": f"""
    WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
    FROM d"""
}
