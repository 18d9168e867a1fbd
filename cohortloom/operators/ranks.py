"""Ranks and medians of large groups without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch


def same_keys(keys: list[str]) -> Column:
    """keys of one side equal `_k0`, `_k1`, ... of the other, nulls included."""
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return on


def hash_bucket(text: Column, bits: int = 12) -> Column:
    """The leading bits of a hexadecimal hash as a number."""
    return F.shiftright(F.conv(F.substring(text, 1, 8), 16, 10).cast("long"), 32 - bits)


def ranked(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], out: str) -> DataFrame:
    """Add `out`, the 0-based rank within keys. `bucket` must not decrease along `order`: each (keys, bucket) is ranked alone
    and shifted by the rows in the buckets before it, from a table of counts."""
    rows = df.withColumn("_b", bucket)
    counts = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)) - 1
    joined = rows.withColumn("_r", within).join(start, same_keys(keys) & F.col("_b").eqNullSafe(F.col("_kb")))
    return joined.withColumn(out, F.col("_r") + F.col("_start")).drop("_b", "_r", "_kb", "_start", *[f"_k{i}" for i in range(len(keys))])


LANES = 16  # of 64 bits: a multiset hash of 1,024 bits


def lane_values(member: Column) -> list[Column]:
    """A member's part of a multiset hash: LANES numbers of 64 bits from SHA-256. Members are equal as multisets, in any order,
    when the sums of each lane modulo 2^64 are; with lanes this wide no collision can be made or met by chance."""
    text = F.coalesce(member.cast("string"), F.lit(""))
    wide = [F.sha2(F.concat(text, F.lit(f":{i}")).cast("binary"), 256) for i in range(LANES // 4)]
    return [F.conv(F.substring(wide[i // 4], 1 + 16 * (i % 4), 16), 16, 10).cast("decimal(28,0)") for i in range(LANES)]


def lanes_text(sums: list[Column]) -> Column:
    """Sums of lanes as one text."""
    return F.concat_ws(",", *[F.coalesce((s % F.lit(str(2**64)).cast("decimal(28,0)")).cast("decimal(28,0)").cast("string"), F.lit("0")) for s in sums])


#: Error of the first bounds as a share of the rows; distinct values of a group that one task may look at; buckets of a further pass.
SKETCH, DISTINCT, BUCKETS = 10_000, 20_000, 64


def middle_values(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(_k, _n, _v, _c): the distinct values around each group's median with the rows that have them, at most DISTINCT a group,
    and one row with _v null for all rows below. _k holds the keys, _n counts the group's rows.

    A sketch bounds the middle and one pass counts what lies within by value, so that tied rows are added up before they
    are shuffled. While a group has too many distinct values left, they are dealt into buckets by quantiles of their own
    and only the buckets that hold the middle ranks go on.
    """
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    rows = rows.filter(F.col(value).isNotNull()).select(key.alias("_k"), F.col(value).cast("double").alias("_v"))
    edge = F.percentile_approx("_v", F.array(F.lit(0.5 - 2 / SKETCH), F.lit(0.5 + 2 / SKETCH)), SKETCH)
    bounds = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), edge.alias("_e"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    small = F.col("_n") < 2 * SKETCH  # the sketch of a small group may miss by a rank
    low, high = F.when(small, F.col("_min")).otherwise(F.col("_e")[0]), F.when(small, F.col("_max")).otherwise(F.col("_e")[1])
    bounds = scratch(bounds.select(F.col("_k").alias("_key"), "_n", low.alias("_low"), high.alias("_high")), "bounds")
    near = rows.join(bounds, F.col("_k").eqNullSafe(F.col("_key"))).filter("_v <= _high")
    inside = F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v")
    table = scratch(near.groupBy("_k", "_n", inside).agg(F.count(F.lit(1)).alias("_c")), "middle")
    while (table.groupBy("_k").agg(F.count("_v").alias("d")).agg(F.max("d")).first()[0] or 0) > DISTINCT:
        table = _narrowed(table)
    return table


def _ranks() -> tuple[Column, Column]:
    """0-based ranks of the one or two middle rows."""
    return F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)


def _narrowed(table: DataFrame) -> DataFrame:
    splits = table.groupBy(F.col("_k").alias("_key")).agg(F.percentile_approx("_v", F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)]), SKETCH).alias("_s"))
    place = F.when(F.col("_v").isNull(), -1).otherwise(F.size(F.filter("_s", lambda s: s < F.col("_v"))))
    dealt = scratch(table.join(splits, F.col("_k").eqNullSafe(F.col("_key"))).select("_k", "_n", "_v", "_c", place.alias("_b")), "dealt")
    upto = F.sum("_c").over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    counts = dealt.groupBy("_k", "_n", "_b").agg(F.sum("_c").alias("_c")).withColumn("_u", upto)
    first, second = _ranks()
    edges = counts.groupBy(F.col("_k").alias("_key")).agg(F.min(F.when(F.col("_u") > first, F.col("_b"))).alias("_from"), F.min(F.when(F.col("_u") > second, F.col("_b"))).alias("_to"))
    near = dealt.join(edges, F.col("_k").eqNullSafe(F.col("_key"))).filter("_b <= _to")
    return scratch(near.groupBy("_k", "_n", F.when(F.col("_b") >= F.col("_from"), F.col("_v")).alias("_v")).agg(F.sum("_c").alias("_c")), "middle")


def medians(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(keys, out): exact medians of groups of any size; missing values do not count. The result is a written table, so that a
    join with it is a broadcast where Spark finds it small. An empty group has no row."""
    upto = F.sum("_c").over(Window.partitionBy("_k").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    first, second = _ranks()
    middle = middle_values(rows, keys, value).withColumn("_u", upto).groupBy("_k")
    found = middle.agg(((F.min(F.when(F.col("_u") > first, F.col("_v"))) + F.min(F.when(F.col("_u") > second, F.col("_v")))) / 2).alias(out))
    return scratch(found.select(*[F.col(f"_k.{k}").alias(k) for k in keys], out), "medians")
