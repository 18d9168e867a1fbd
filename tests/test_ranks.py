"""Medians of whole columns against plain sorting, with the rows that meet in one task counted."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import inventory, ranks


def table(spark, groups):
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "k string, v double").repartition(5)


def groups():
    r = random.Random(2)
    half = [r.gauss(0, 1) for _ in range(3000)]
    return {
        "tied": [0.0] * 4000 + [abs(x) for x in half], "untied": [r.expovariate(1) * 10 ** r.randrange(-3, 4) for _ in range(7001)], "even": [float(i) for i in range(6000)], "between": [1.0] * 2500 + [2.0] * 2500,
        "small": [3.0, 1.0], "one": [5.0], None: half, "gaps": [None, 2.0, None, 4.0, 9.0], "none": [None, None], "negative": [-x for x in half for _ in range(2)], "wide": [10.0 ** r.uniform(-300, 300) for _ in range(5000)]}


@pytest.mark.parametrize("sketch, distinct", [(10_000, 20_000), (100, 40), (100, 3)])
def test_medians(spark, monkeypatch, sketch, distinct):
    monkeypatch.setattr(ranks, "SKETCH", sketch)
    monkeypatch.setattr(ranks, "DISTINCT", distinct)
    given = groups()
    want = {k: statistics.median([x for x in v if x is not None]) for k, v in given.items() if any(x is not None for x in v)}
    df = table(spark, given)
    got = {r.k: r.mid for r in ranks.medians(df, ["k"], "v", "mid").collect()}
    assert got == want
    every = [x for v in given.values() for x in v if x is not None]
    assert [r.mid for r in ranks.medians(df, [], "v", "mid").collect()] == [statistics.median(every)]
    assert ranks.medians(df.limit(0), ["k"], "v", "mid").count() == 0


def test_few_rows_meet_in_one_task(spark, monkeypatch):
    """A group whose median value holds two thirds of its rows, and one without any tie."""
    monkeypatch.setattr(ranks, "SKETCH", 1000)
    monkeypatch.setattr(ranks, "DISTINCT", 200)
    n = 600_000
    df = spark.range(n).select(F.explode(F.array(F.struct(F.lit("tied").alias("k"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(0).cast("double").alias("v")), F.struct(F.lit("untied").alias("k"), F.xxhash64("id").cast("double").alias("v")))).alias("r")).select("r.*")
    left = ranks.middle_values(df, ["k"], "v")
    assert {r["_k"].k: r.n <= 201 for r in left.groupBy("_k").agg(F.count(F.lit(1)).alias("n")).collect()} == {"tied": True, "untied": True}
    assert {r["_k"].k: r.n for r in left.groupBy("_k").agg(F.max("_n").alias("n")).collect()} == {"tied": n, "untied": n}
    got = {r.k: r.mid for r in ranks.medians(df, ["k"], "v", "mid").collect()}
    assert got == {r.k: r.mid for r in df.groupBy("k").agg(F.median("v").alias("mid")).collect()}


def test_totals_of_an_empty_table(spark):
    got = inventory.totals(spark.createDataFrame([], "s string, e string, x double"), "s", "e", "x").collect()
    assert [r.asDict() for r in got] == [{"subjects": 0, "sessions": 0, "runs": 0, "total_seconds": None, "mean_seconds": None, "median_seconds": None}]
