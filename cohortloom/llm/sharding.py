"""Sharding by proportional stratified interleaving.

Rows are ranked in a seeded shuffle within their source, sorted by fractional rank (rank + 1/2) / rows of the source,
and cut into shards whose row counts differ by one at most; each shard then holds every source in its proportion.
DataFrame functions only. No source is sorted in one task: ranks come from buckets of the shuffle key or of the
fractional rank, each ranked alone, and a count table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import documents, ranked, written

SHARDS, SEED, BUCKET_ROWS = 8, 17, 20_000


def interleaved(rows: DataFrame, strata: str, key: str, ties: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Add shard and slot (gapless from 0 in each shard) to rows; columns of these names are replaced, all others kept.

    A null stratum is a stratum of its own, a null key counts as the text null. Rows that agree in key and ties, repeated rows
    among them, are interchangeable and each gets a place. An empty table gives an empty result.
    """
    columns = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    total = rows.agg(F.count(F.lit(1))).first()[0]
    buckets = max(16, min(1 << 16, total // BUCKET_ROWS + 1))
    body = lambda c: F.col("row").getField(c)  # the caller's columns lie in one struct, beside those named here
    shuffled = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(f"`{strata}`").alias("stratum"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")))).alias("h"))
    number = F.expr(f"cast(conv(substr(h, 1, 8), 16, 10) as bigint) * {buckets} div 4294967296")
    order = [F.col("h"), *[body(c).asc_nulls_first() for c in (key, *ties)]]
    within = written(ranked(shuffled, ["stratum"], number, order, "rank"), "ranks")
    sizes = within.groupBy(F.col("stratum").alias("own")).agg(F.count(F.lit(1)).alias("n"))
    mixed = within.join(sizes, F.col("stratum").eqNullSafe(F.col("own"))).withColumn("f", (F.col("rank") + F.lit(0.5)) / F.col("n"))
    order = [F.col("f"), F.col("stratum").asc_nulls_first(), F.col("rank")]
    placed = ranked(mixed.withColumn("one", F.lit(0)), ["one"], F.floor(F.col("f") * buckets), order, "at")
    cut = placed.withColumn("shard", F.expr(f"cast(least({shards - 1}, (at * {shards}) div {max(total, 1)}) as int)"))
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return cut.select(*[body(c).alias(c) for c in columns], "shard", (F.col("at") - first).alias("slot"))


def op6_sharding(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, sf_dir).select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = interleaved(rows, "source", "doc_id", ["text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


SQL: dict[str, str] = {}
