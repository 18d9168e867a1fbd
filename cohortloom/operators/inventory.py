"""Recording inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import duration
from .ranks import medians


def numbered_runs(df: DataFrame, subject: str, order: list[str]) -> DataFrame:
    """Run `01`, `02`, ... of each subject in time order, missing times last."""
    w = Window.partitionBy(subject).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumn("run", F.lpad(F.row_number().over(w).cast("string"), 2, "0"))


def condition_summary(segments: DataFrame, key: list[str]) -> DataFrame:
    """R2: by run and segment type the merged seconds, distinct blocks and rows."""
    seconds = duration(segments.select(*key, "segment_type", "start", "stop"), (*key, "segment_type"))
    counts = segments.groupBy(*key, "segment_type").agg(F.countDistinct("start", "stop").alias("blocks"), F.count(F.lit(1)).alias("rows"))
    return counts.join(seconds, [*key, "segment_type"], "left").na.fill(0.0, ["seconds"])


def availability(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """(category, n, pct) of rows that pass each test."""
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.coalesce(t, F.lit(False))).alias(k) for k, t in tests.items()])
    return wide.unpivot(["_n"], list(tests), "category", "n").select("category", "n",
        F.round(F.when(F.col("_n") > 0, 100.0 * F.col("n") / F.col("_n")).otherwise(0.0), 2).alias("pct"))


def missing_ids(df: DataFrame, id_col: str, tests: dict[str, Column]) -> DataFrame:
    """(category, id) rows of those that pass each test; a list for display is one aggregate away."""
    each = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())
    return df.select(F.explode(each).alias("category"), F.col(id_col).alias("id"))


def event_rates(df: DataFrame, counts: str) -> DataFrame:
    """(event, records, total, pct): records with the event, from maps of counts."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    e = df.select(F.explode(counts).alias("event", "n")).filter("n > 0").groupBy("event").agg(F.count(F.lit(1)).alias("records"),
        F.sum("n").alias("total"))
    return e.crossJoin(F.broadcast(total)).select("event", "records", "total", F.round(100.0 * F.col("records") / F.col("_n"), 2).alias("pct"))


def group_table(df: DataFrame, by: str, subject: str, seconds: str, has: dict[str, Column]) -> DataFrame:
    """Runs, subjects, mean seconds and percent with each condition, by a metadata column; blank is Unknown."""
    name = F.coalesce(F.nullif(F.trim(F.col(by).cast("string")), F.lit("")), F.lit("Unknown"))
    return df.groupBy(name.alias("group")).agg(
        F.count(F.lit(1)).alias("runs"), F.countDistinct(subject).alias("subjects"), F.round(F.avg(seconds), 4).alias("mean_seconds"),
        *[F.round(100.0 * F.count_if(F.coalesce(t, F.lit(False))) / F.count(F.lit(1)), 2).alias(k) for k, t in has.items()])


def day_span(df: DataFrame, ts: str) -> DataFrame:
    """Earliest and latest time of day as HH:MM:SS."""
    s = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return df.filter(F.col(ts).isNotNull()).agg(clock(F.min(s)).alias("earliest"), clock(F.max(s)).alias("latest"))


def repeated_subjects(df: DataFrame, subject: str, least: int = 2) -> DataFrame:
    """(subject, runs) with `least` runs or more."""
    return df.groupBy(subject).agg(F.count(F.lit(1)).alias("runs")).filter(F.col("runs") >= least)


def hour_histogram(df: DataFrame, ts: str) -> DataFrame:
    """24 rows (hour, n), 0 where none starts."""
    n = df.filter(F.col(ts).isNotNull()).groupBy(F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour")).join(F.broadcast(n), "hour", "left").na.fill(0, ["n"])


def totals(df: DataFrame, subject: str, session: str, seconds: str) -> DataFrame:
    """One row; the median is selected, not gathered."""
    sums = df.agg(F.countDistinct(subject).alias("subjects"), F.countDistinct(subject, session).alias("sessions"), F.count(F.lit(1)).alias("runs"), F.round(F.sum(seconds), 4).alias("total_seconds"),
                  F.round(F.avg(seconds), 4).alias("mean_seconds"))
    middle = medians(df, [], seconds, "median").agg(F.round(F.first("median"), 4).alias("median_seconds"))
    return sums.crossJoin(middle)


def consistency(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Whether each column takes more than one value."""
    return df.groupBy(*(by or [])).agg(*[(F.count_distinct(c) > 1).alias(f"mixed_{c}") for c in columns])


def type_pivot(segments: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Seconds by segment type and eye state, 0 where none."""
    return segments.groupBy(rows).pivot(columns, values).agg(F.sum(F.col("stop") - F.col("start"))).na.fill(0.0)


def span(seconds: Column) -> Column:
    """`Xh Ym Zs`, leading parts of 0 left out."""
    s = F.floor(seconds).cast("long")
    h, m = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    return F.concat_ws(" ", F.when(h > 0, F.concat(h, F.lit("h"))), F.when((h > 0) | (m > 0), F.concat(m, F.lit("m"))),
        F.concat(F.pmod(s, F.lit(60)), F.lit("s")))


def clock(seconds: Column) -> Column:
    """HH:MM:SS."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))


def summed_counts(df: DataFrame, by: list[str], counts: str) -> DataFrame:
    """Key-wise sums of count maps."""
    e = df.select(*by, F.explode(counts).alias("k", "n")).groupBy(*by, "k").agg(F.sum("n").alias("n"))
    return e.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias(counts))


def session_rollup(runs: DataFrame, summary: DataFrame, by: list[str], run: str, seconds: str, first: list[str]) -> DataFrame:
    """By subject and session the runs, raw seconds, first metadata values and summed condition seconds.

    Conditions are summarised for each run and summed; merging the time axes of different runs would undercount.
    """
    head = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.sum(seconds).alias("raw_seconds"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(run))).alias(c) for c in first])
    tail = summary.groupBy(*by).agg(F.sum("seconds").alias("condition_seconds"), F.sum("blocks").alias("blocks"))
    return head.join(tail, by, "left").na.fill(0, ["condition_seconds", "blocks"])


def run_metrics(summary: DataFrame, runs: DataFrame, key: str, seconds: str) -> DataFrame:
    """(run, metric, value): seconds and blocks by condition, covered percent and seconds outside all conditions."""
    kinds = summary.select(key, F.explode(F.array(F.struct(F.concat(F.lit("seconds:"), "segment_type").alias("metric"),
        F.col("seconds").alias("value")), F.struct(F.concat(F.lit("blocks:"), "segment_type").alias("metric"),
            F.col("blocks").cast("double").alias("value")))).alias("m")).select(key, "m.*")
    used = summary.groupBy(key).agg(F.sum("seconds").alias("_u"))
    cover = runs.select(key, F.col(seconds).alias("_s")).join(used, key, "left").na.fill(0.0, ["_u"])
    facts = F.array(F.struct(F.lit("coverage_pct").alias("metric"),
        F.when(F.col("_s") > 0, 100.0 * F.col("_u") / F.col("_s")).otherwise(0.0).alias("value")),
            F.struct(F.lit("discarded_seconds").alias("metric"), F.greatest(F.lit(0.0), F.col("_s") - F.col("_u")).alias("value")))
    return kinds.unionByName(cover.select(key, F.explode(facts).alias("m")).select(key, "m.*"))
