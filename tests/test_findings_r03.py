"""Findings of round 3: results that hung on the order of rows, and steps that grew faster than their input."""

import datetime
import math
import pathlib
import random

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators import embeddings as E
from cohortloom.operators import features as X
from cohortloom.operators import intervals as I
from cohortloom.operators import opportunities as O
from cohortloom.operators.cohort import class_cohort
from cohortloom.operators.sums import steady_mean
from cohortloom.plans import files
from cohortloom.plans.queries import QUERIES


def lines(spark, folder, discounts):
    """A lineitem table in one file whose rows come in this order: one supplier, one channel."""
    day = datetime.datetime(1996, 1, 1)
    rows = [(i, 1, 1, 1, 20.0, 1000.0, x, 0.02, "N", "O", day) for i, x in enumerate(discounts)]
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


@pytest.mark.parametrize("low_first", [True, False])
def test_a_mean_at_a_limit_does_not_hang_on_the_order_of_rows(spark, tmp_path, low_first):
    values = [0.01] * 300 + [0.09] * 300  # their mean is 0.05, at the limit of high_hf_ratio
    d = lines(spark, tmp_path, values if low_first else values[::-1])
    assert [r.flag_reasons for r in QUERIES["q08_segment_flag"](spark, d).collect()] == [""]
    assert not any("high_hf_ratio" in r.reasons for r in QUERIES["q09_usability"](spark, d).collect())
    assert "high_hf_ratio" not in {r.reason for r in QUERIES["q18_q19_reasons"](spark, d).collect()}


def test_steady_mean_of_numbers_with_more_decimals_and_of_none(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.20001), ("b", None), ("c", 1e300), ("c", 1e300), ("d", float("nan"))], "k string, v double")
    got = {r.k: r.m for r in df.groupBy("k").agg(steady_mean("v").alias("m")).collect()}
    assert got["a"] == pytest.approx(0.150005) and got["b"] is None and got["c"] == 1e300 and got["d"] != got["d"]


def test_rows_of_a_patient_tied_by_subject_and_label_give_one_result_in_any_order(spark):
    rows = [(None, None, "A", "F", 9.0), (None, None, "A", "F", 4.0), (None, None, "A", "M", 12.0), (None, None, "A", None, 14.0), (5, 1, "B", "M", 3.0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "patient_id long, study_id long, label string, sex string, age double").coalesce(1)
        found = {r["class"]: (r.n, r.mean_age, r.female) for r in class_cohort(df, "label").collect()}
        assert found == {"A": (1, 9.0, 1), "B": (1, 3.0, 0)}


def test_neighbours_are_ranked_without_making_pairs_in_spark(spark, monkeypatch):
    n, k = 60, 3
    high = [[math.sin(7 * i), math.cos(3 * i), float((i // 2) % 5)] for i in range(n)]  # some distances are equal
    rows = [(i, h, h[:1]) for i, h in enumerate(high)] + [(n, None, None)]
    df = spark.createDataFrame(rows, "i long, h array<double>, l array<double>").repartition(5)
    monkeypatch.setattr(E, "QUERIES_AT_ONCE", 7)
    monkeypatch.setattr(E, "ROWS_AT_ONCE", 4)
    monkeypatch.setattr(DataFrame, "join", None)
    monkeypatch.setattr(DataFrame, "crossJoin", None)
    got = E.neighbour_retention(df, "i", "h", "l", k, F.col("i") % 4 == 0).first()
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    t = c = 0
    asked = range(0, n, 4)
    for i in asked:
        by = [sorted((j for j in range(n) if j != i), key=lambda j, s=s: (dist(rows[i][s], rows[j][s]), j)) for s in (1, 2)]
        t += sum(max(by[0].index(j) + 1 - k, 0) for j in by[1][:k])
        c += sum(max(by[1].index(j) + 1 - k, 0) for j in by[0][:k])
    scale = 2 / ((len(asked) + 1) * k * (2 * (n + 1) - 3 * k - 1))  # the row without a vector is asked for too and counts as a row
    assert got.trustworthiness == pytest.approx(1 - scale * t) and got.continuity == pytest.approx(1 - scale * c)


def test_many_pages_lie_in_few_record_files(spark, tmp_path, monkeypatch):
    odd = ["a|b\nc", "é\u0000\u0001x", "\u001b0\u001e\u001b1", "", None, "Record No: 9 2020-01-01 01:01:01"]
    pages = [(i, odd[i % len(odd)]) for i in range(600)]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    roots = []
    monkeypatch.setattr(files, "scratch_path", lambda s, name: roots.append(f"{tmp_path}/{name}") or roots[-1])
    got = {int(r.record_id): (r.recorded_at.day, r.n_bytes) for r in QUERIES["s06_record_headers"](spark, str(tmp_path)).collect()}
    assert got == {i: (1 + i % 28, None if t is None else len(t.encode())) for i, t in pages}
    assert 1 < len(list(pathlib.Path(roots[0]).rglob("*.txt"))) <= 10


@pytest.mark.parametrize("name", ["f01_aggregate", "f14_epoch_rejection"])
def test_features_are_laid_out_by_subject_once(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_masks_of_outlying_epochs_need_no_copy_of_the_rows(spark, monkeypatch):
    value = {**{(1, i): float(i) for i in range(8)}, (1, 8): 900.0, (2, 20): 5.0, **{(s, 10 * s): 5.0 + s / 10 for s in range(3, 9)}}
    rows = spark.createDataFrame([(o, s, "band_x_ch-Fz", v) for (s, o), v in value.items()], "obs_id long, subject long, feature string, value double")
    groups = X.schema(rows.select("feature").distinct()).select("feature", F.col("family").alias("grp"))
    names = []
    monkeypatch.setattr(X, "scratch", lambda df, name: names.append(name) or df)
    bad = {(r.grp, r.obs_id) for r in X.outlier_masks(rows, groups, 3.0, 0.5).collect()}
    assert bad == {("band", o) for s, o in value if s == 1}  # subject 1 by its mean; of its epochs 8 alone by itself
    assert names == ["means"]


def test_long_intervals_are_not_cut_into_cells(spark):
    kinds = "recording_id long, start double, stop double"
    manual = spark.createDataFrame([(1, 0.0, 1e12), (1, 5.0, 9.0), (2, 0.05, 0.35), (2, 0.9, 1.0), (3, 4.0, 4.0)], kinds)
    found = spark.createDataFrame([(1, 0.0, 2.5e11), (2, 0.3, 0.95)], kinds)
    got = {r.recording_id: r.overlap_pct for r in I.grid_overlap(found, manual, step=0.5).collect()}
    assert got == {1: 25.0, 2: 100.0}


def test_longitudinal_specs_spread_signatures_not_patients(spark, monkeypatch):
    """Patients with visits in several strata, without sex, age group or id, against a count by hand."""
    dice, rows = random.Random(5), []
    for i in range(600):
        rows.append((i, dice.choice([None, *range(150)]), dice.choice(["M", "F", None]), dice.choice(["5-8", "9-12", None]), dice.randint(0, 1), dice.choice([0, 0, 1])))
    kinds = "study_id long, patient_id long, sex string, age_group string, first_eeg int, adhd int"
    fixed = {"autism": 0, "epilepsy": 1, "psychostimulant": 0, "asm": 1, "asm_resistant": 1, "asm_types": "CBZ", "psychostimulant_category": "No Psychostimulant", "combined_diagnosis": "Epilepsy"}
    df = spark.createDataFrame(rows, kinds).withColumns({k: F.lit(v) for k, v in fixed.items()})
    sizes, spread = [], O._spread
    monkeypatch.setattr(O, "_spread", lambda cells, *x: (sizes.append(cells.count()), spread(cells, *x))[1])
    got = {(r.sex, r.age_group, r.constraint): (r.cohort_n, r.n1, r.n2, r.paired_patients) for r in O.opportunities(df, 2).filter(F.col("analysis") == O.LONGITUDINAL).collect()}
    assert max(sizes) <= 3 * 3 * 2 * 2  # sex, age group, visit and diagnosis, however many patients
    for sex, code in (("All", None), ("Male", "M"), ("Female", "F")):
        for age in ("All", "5-8", "9-12"):
            for name, bad in (("No_Constraint", ()), ("No_ADHD", (1,))):
                own = [r for r in rows if (not code or r[2] == code) and (age == "All" or r[3] == age) and r[5] not in bad]
                both = {r[1] for r in own if r[4] == 1} & {r[1] for r in own if r[4] == 0} - {None}
                n = [sum(r[1] in both and r[4] == first for r in own) for first in (1, 0)]
                assert got[sex, age, name] == (len(own), *n, len(both))
