"""Joins of the metadata and QC steps (J1-J6, J10, J12, J16). Lookups are broadcast only below Spark's own size threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metadata import subject


def lookup(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """A left join to a lookup table that must know every key; an unknown one stops the job."""
    t = table.withColumn("_hit", F.lit(True))
    j = df.join(t, keys, "left")
    return j.withColumn(keys[0], F.when(F.col("_hit"),
        F.col(keys[0])).otherwise(F.raise_error(F.concat_ws("|", F.lit("unknown key"), *[F.col(k).cast("string") for k in keys])))).drop("_hit")


def enriched(df: DataFrame, meta: DataFrame, left: str, right: str) -> DataFrame:
    """Metadata columns that df lacks, by normalised subject; the first metadata row of a subject counts (least by all columns)."""
    new = [c for c in meta.columns if c not in df.columns and c != right]
    one = meta.withColumn("_s", subject(F.col(right))).withColumn("_r",
        F.row_number().over(Window.partitionBy("_s").orderBy(*meta.columns))).filter("_r = 1").select("_s", *new)
    return df.join(one, subject(F.col(left)) == F.col("_s"), "left").drop("_s")


def resolved(records: DataFrame, meta: DataFrame, second_source: str = "drug_resistant") -> DataFrame:
    """records(record_id, study_id, patient_id, folder_id, source) to metadata(study_id, patient_id): by study, else
    patient, else (second source only) folder id as study; then status and resolved_by."""
    by_study = meta.filter("study_id is not null").groupBy("study_id").agg(F.min("patient_id").alias("p")).withColumn("hit", F.lit(True))
    by_patient = meta.filter("patient_id is not null").groupBy("patient_id").agg(F.min("study_id").alias("s"))
    a = by_study.select(F.col("study_id").alias("_a"), F.col("hit").alias("_ha"))
    b = by_patient.select(F.col("patient_id").alias("_b"), F.col("s").alias("_sb"))
    c = by_study.select(F.col("study_id").alias("_c"), F.col("hit").alias("_hc"))
    j = records.join(a, records.study_id == F.col("_a"), "left").join(b, records.patient_id == F.col("_b"), "left").join(c,
        (records.folder_id == F.col("_c")) & (records.source == second_source), "left")
    how = F.when(F.col("_ha"), "study_id").when(F.col("_b").isNotNull(), "patient_id").when(F.col("_hc"), "folder_id")
    found = F.when(F.col("_ha"), F.col("_a")).when(F.col("_b").isNotNull(), F.col("_sb")).when(F.col("_hc"), F.col("_c"))
    missing = F.col("has_eeg") == F.lit(False) if "has_eeg" in records.columns else F.lit(False)
    status = F.when(how.isNull(), "unresolved_subject").when(missing, "missing_eeg").otherwise("ready")
    return j.select(*[records[x] for x in records.columns], found.alias("resolved_study_id"), how.alias("resolved_by"), status.alias("status"))


def reference_row(runs: DataFrame, keys: list[str], reference: DataFrame, key: str, order: str) -> DataFrame:
    """The reference row of the first key column of a run that is known; of rows that share a key the last by `order`."""
    last = reference.groupBy(key).agg(F.max(F.struct(order,
        *[c for c in reference.columns if c not in (key, order)])).alias("_ref")).withColumnRenamed(key, "_key")
    tries = runs.select("run_id", F.posexplode(F.array(*[F.col(k) for k in keys])).alias("priority", "_key")).join(last, "_key")
    best = tries.withColumn("_r", F.row_number().over(Window.partitionBy("run_id").orderBy("priority"))).filter("_r = 1")
    return runs.join(best.select("run_id", "priority", "_ref"), "run_id", "left").select(*[runs[c] for c in runs.columns], "priority", "_ref.*")


def stage_comparison(after: DataFrame, before: DataFrame, by: str, metric: str) -> DataFrame:
    """Means of a metric by type after and before; a type without a before has NULL."""
    m = lambda df, n: df.groupBy(by).agg(F.avg(metric).alias(n))
    return m(after, "post").join(m(before, "pre"), by, "left").withColumn("delta", F.col("post") - F.col("pre"))


def in_both_arms(df: DataFrame, id_col: str, arm: str) -> DataFrame:
    """Rows of ids present in both arms."""
    ids = df.groupBy(id_col).agg(F.countDistinct(arm).alias("_n")).filter("_n = 2").select(id_col)
    return df.join(ids, id_col, "left_semi")


def uncovered(expected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Expected rows without a complete shard."""
    return expected.join(done, keys, "left_anti")


def occurrence_matched(a: DataFrame, b: DataFrame, key: str, order_a: str, order_b: str) -> DataFrame:
    """Rows matched by (key, n-th occurrence); keys whose counts differ stop the job."""
    n = lambda df, o: df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(o)))
    right = n(b, order_b).select(F.col(key).alias("_k"), F.col("_n").alias("_m"), *[c for c in b.columns if c != key and c not in a.columns])
    left = n(a, order_a)
    j = left.join(right, (left[key] == F.col("_k")) & (left["_n"] == F.col("_m")), "full")
    ok = F.col(key).isNotNull() & F.col("_k").isNotNull()
    return j.withColumn(key, F.when(ok, F.col(key)).otherwise(F.raise_error(F.lit("occurrence counts differ")))).drop("_n", "_m", "_k")


def valid_subjects(requested: DataFrame | None, meta: DataFrame, column: str = "subject") -> DataFrame:
    """Requested ids that the metadata know, normalised; all of them without a request. None left stops the job."""
    known = meta.select(subject(F.col(column)).alias(column)).distinct()
    out = known if requested is None else requested.select(subject(F.col(column)).alias(column)).distinct().join(known, column, "left_semi")
    if out.isEmpty():
        raise ValueError("no known subject is left")
    return out


def row_ranges(df: DataFrame, number: str, spec: str) -> DataFrame:
    """Rows whose 1-based number column lies in a spec such as `1-1000,1100`."""
    keep = F.lit(False)
    for part in spec.split(","):
        lo, _, hi = part.strip().partition("-")
        keep = keep | F.col(number).between(int(lo), int(hi or lo))
    return df.filter(keep)
