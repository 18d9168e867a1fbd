"""Cohort summaries (C1-C14): small tables from patient rows. Missing categories are left out unless stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metadata import age_group_order


def _share(n: Column, total: Column, digits: int = 2) -> Column:
    return F.round(F.when(total > 0, 100.0 * n / total).otherwise(0.0), digits)


def summary(df: DataFrame, by: str) -> DataFrame:
    """Rows, distinct sources, mean and median age, and `name=count` pairs of one column in order of name."""
    names = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    text = names.agg(F.array_join(F.sort_array(F.collect_list(F.concat(by, F.lit("="), "n"))), ", ").alias("counts"))
    facts = df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("source_dataset").alias("sources"), F.round(F.avg("age"), 2).alias("mean_age"),
        F.round(F.median("age"), 2).alias("median_age"))
    return facts.crossJoin(text)


def prevalence(df: DataFrame, flags: list[str]) -> DataFrame:
    """(diagnosis, n, pct) for each flag."""
    sums = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c) == 1).alias(c) for c in flags])
    return sums.unpivot(["rows"], flags, "diagnosis", "n").select("diagnosis", "n", _share(F.col("n"), F.col("rows")).alias("pct"))


def value_counts(df: DataFrame, column: str, vocabulary: list[str] | None = None) -> DataFrame:
    """(value, n); with a vocabulary its values only, 0 where none occurs."""
    found = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    if vocabulary is None:
        return found
    words = df.sparkSession.createDataFrame([(v,) for v in vocabulary], "value string")
    return words.join(found, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def metrics(df: DataFrame, facts: dict[str, Column]) -> DataFrame:
    """Aggregates as (metric, value) rows of doubles."""
    wide = df.agg(*[c.cast("double").alias(n) for n, c in facts.items()])
    return wide.unpivot([], list(facts), "metric", "value")


def demographics(df: DataFrame) -> DataFrame:
    """C4: counts by sex, age statistics and counts by age group in numeric order (column place)."""
    facts = {
        "rows": F.count(F.lit(1)), "male": F.count_if(F.col("sex") == "M"), "female": F.count_if(F.col("sex") == "F"),
            "unknown_sex": F.count_if(F.col("sex").isNull()),
        "mean_age": F.round(F.avg("age"), 2), "median_age": F.round(F.median("age"), 2), "min_age": F.min("age"), "max_age": F.max("age"),
    }
    groups = df.filter("age_group is not null").groupBy("age_group").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return metrics(df, facts).select("metric", "value", F.lit(-1).alias("place")).unionByName(
        groups.select(F.concat(F.lit("age_group:"), "age_group").alias("metric"), "value",
            age_group_order(F.col("age_group")).alias("place")))


def medication(df: DataFrame) -> DataFrame:
    """C5."""
    on = lambda c: F.col(c) == 1
    return metrics(df, {
        "rows": F.count(F.lit(1)), "psychostimulant": F.count_if(on("psychostimulant")), "asm": F.count_if(on("asm")),
            "both": F.count_if(on("psychostimulant") & on("asm")),
        "neither": F.count_if(~on("psychostimulant") & ~on("asm")), "asm_resistant": F.count_if(on("asm_resistant")),
            "single_asm": F.count_if(on("asm") & ~F.col("asm_types").contains("+")),
    })


def resistance_overview(df: DataFrame) -> DataFrame:
    """(population, metric, value) for all rows and the resistant rows, by way of one row for each patient."""
    both = df.select("*", F.explode(F.filter(F.array(F.lit("all"), F.when(F.col("asm_resistant") == 1, F.lit("resistant"))),
        lambda x: x.isNotNull())).alias("population"))
    patient = both.groupBy("population", "patient_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("first_eeg") == 1).alias("first"), F.count_if(F.col("first_eeg") == 0).alias("later"),
        *[F.count_if(F.col(c) == 1).alias(c) for c in ("adhd", "autism", "epilepsy")])
    known = F.col("patient_id").isNotNull()
    names = {
        "recordings": F.sum("n"), "patients": F.count_if(known), "first_recordings": F.sum("first"), "later_recordings": F.sum("later"),
            "patients_both_kinds": F.count_if(known & (F.col("first") > 0) & (F.col("later") > 0)),
        "patients_repeated": F.count_if(known & (F.col("n") >= 2)), "most_recordings": F.coalesce(F.max(F.when(known, F.col("n"))), F.lit(0)),
            "adhd": F.sum("adhd"), "autism": F.sum("autism"), "epilepsy": F.sum("epilepsy"),
    }
    wide = patient.groupBy("population").agg(*[c.cast("long").alias(n) for n, c in names.items()])
    return wide.unpivot(["population"], list(names), "metric", "value")


def first_versus_later(df: DataFrame) -> DataFrame:
    """Counts, ages and flags of first and later recordings; both kinds are listed."""
    kinds = df.sparkSession.createDataFrame([(1, "first"), (0, "later")], "first_eeg int, kind string")
    found = df.groupBy("first_eeg").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("age"), 2).alias("mean_age"), F.round(F.median("age"), 2).alias("median_age"),
            *[F.count_if(F.col(c) == 1).alias(c) for c in ("adhd", "epilepsy", "asm")])
    return kinds.join(found, "first_eeg", "left").select("kind", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "adhd", "epilepsy", "asm")],
        "mean_age", "median_age")


def source_overlap(df: DataFrame, id_col: str, source_col: str, a: str, b: str) -> DataFrame:
    """(overlap, n): ids in the first source only, the second only, or both."""
    ids = df.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.bool_or(F.col(source_col) == a).alias("a"),
        F.bool_or(F.col(source_col) == b).alias("b"))
    kind = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), f"only_{a}").when(F.col("b"), f"only_{b}")
    return ids.select(kind.alias("overlap")).filter("overlap is not null").groupBy("overlap").agg(F.count(F.lit(1)).alias("n"))


def longitudinal(df: DataFrame) -> DataFrame:
    """Patients with first and later recordings: counts and lists in order of date, then id; most recordings first."""
    visits = F.sort_array(F.collect_list(F.struct(F.coalesce("eeg_date", F.lit("")).alias("d"), F.col("study_id").alias("s"))))
    found = df.filter("patient_id is not null").groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"),
        F.count_if(F.expr("first_eeg = 1")).alias("n_first"), F.count_if(F.expr("first_eeg = 0")).alias("n_later"), visits.alias("v"))
    return found.filter("n_first > 0 and n_later > 0").select(
        "patient_id", "n", "n_first", "n_later", F.array_join(F.transform("v.s", lambda s: s.cast("string")), ",", "").alias("study_ids"),
            F.array_join("v.d", ",").alias("dates")).orderBy(F.desc("n"), "patient_id")


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of row by the given column values, 0 where none occurs."""
    return df.filter(F.col(row).isNotNull()).groupBy(row).pivot(column, values).count().na.fill(0)


def timeline(df: DataFrame, date: Column, by: str) -> DataFrame:
    """C11: recordings a month and source; dates that do not parse are left out."""
    return df.select(F.trunc(date, "MM").alias("month"), by).filter("month is not null").groupBy("month", by).agg(F.count(F.lit(1)).alias("n"))


def provenance(df: DataFrame, reason: str, labels: dict[str, str]) -> DataFrame:
    """(reason, label, n) in falling order; a reason without a label is its own."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]) if labels else F.create_map().cast("map<string,string>")
    found = df.filter(F.col(reason).isNotNull()).groupBy(F.col(reason).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("reason", F.coalesce(F.try_element_at(table, F.col("reason")), F.col("reason")).alias("label"), "n").orderBy(F.desc("n"),
        "reason")


def class_cohort(df: DataFrame, label: str, patient: str = "patient_id", subject: str = "study_id") -> DataFrame:
    """One row for each class over one row for each patient (subject where the patient is missing): n, pct, mean and population sd of age, counts by sex.

    Of a patient's rows the one of smallest subject and label counts; among equal ones the first by sex, then the oldest, so
    that the result is a function of the rows. Rows without any id are one patient. Fewer than two classes give no rows.
    """
    key = F.coalesce(F.concat(F.lit("p"), patient), F.concat(F.lit("s"), subject))
    first = df.filter(F.col(label).isNotNull()).withColumn("_k", key).withColumn("_r",
        F.row_number().over(Window.partitionBy("_k").orderBy(subject, label, F.asc_nulls_last("sex"), F.desc_nulls_last("age")))).filter("_r = 1")
    found = first.groupBy(F.col(label).alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("age").alias("mean_age"), F.stddev_pop("age").alias("sd_age"),
            F.count_if(F.expr("sex = 'M'")).alias("male"), F.count_if(F.expr("sex = 'F'")).alias("female"))
    totals = found.agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("_c"))
    return found.crossJoin(totals).filter("_c > 1").withColumn("pct", _share(F.col("n"), F.col("_t"), 1)).drop("_t", "_c")


def age_boxes(df: DataFrame, by: str) -> DataFrame:
    """C14: minimum, quartiles and maximum of age for each group, largest group first."""
    q = F.percentile("age", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    found = df.filter("age is not null").groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("age").alias("low"), q.alias("q"),
        F.max("age").alias("high"))
    return found.select(by, "n", "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"),
        "high").orderBy(F.desc("n"), by)
