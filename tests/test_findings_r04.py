"""Findings of round 4: means at a limit hung on how the files of a table are cut into tasks."""

import datetime
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cohortloom.plans.queries import QUERIES, SQL


def lines(folder, suppliers=200, each=128, files=9):
    """A lineitem table of files of different sizes. Mean discounts are 0.05 and mean taxes 0.04; with a hundredth more for every
    second supplier, four times its means end in a 5 at the seventh digit."""
    dice, rows, day = random.Random(7), [], datetime.datetime(1996, 1, 1)
    for s in range(suppliers):
        half = [(dice.randint(0, 10), dice.randint(0, 8)) for _ in range(each // 2)]
        cents = half + [(10 - a, 8 - b) for a, b in half]
        cents[0] = (cents[0][0] + s % 2, cents[0][1] + s % 2)
        rows += [{"l_suppkey": s, "l_linenumber": 1, "l_quantity": 20.0, "l_discount": a / 100, "l_tax": b / 100} for a, b in cents]
    dice.shuffle(rows)
    rows = [{"l_orderkey": i, "l_partkey": 1, "l_extendedprice": 1000.0, "l_shipdate": day, **r} for i, r in enumerate(rows)]
    cuts = [0, *sorted(dice.sample(range(len(rows)), files - 1)), len(rows)]
    (folder / "lineitem.parquet").mkdir()
    for i in range(files):
        pq.write_table(pa.Table.from_pylist(rows[cuts[i] : cuts[i + 1]]), folder / "lineitem.parquet" / f"part-{i}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["f02_ratios", "f13_flags", "t21_winners", "t22_method_means"])
def test_means_at_a_limit_fall_as_in_sql_that_reads_the_files_in_turn(spark, tmp_path, name):
    d = lines(tmp_path)
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{d}/lineitem.parquet/*.parquet'")
    assert spark.read.parquet(f"{d}/lineitem.parquet").rdd.getNumPartitions() > 1
    got, want = QUERIES[name](spark, d), con.sql(SQL[name])
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())
