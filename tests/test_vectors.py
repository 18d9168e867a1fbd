"""Matrix operators against numpy, selection of ranks and medians against plain sorting."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import embeddings as E
from cohortloom.operators import evaluation as T
from cohortloom.operators import ranks
from cohortloom.operators import tuning as U


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(120, 6)) @ r.normal(size=(6, 6)) + 2
    subject = np.arange(120) % 7
    x += subject[:, None] * 0.5
    rows = [(i, int(subject[i]), [float(v) for v in x[i]]) for i in range(120)]
    return spark.createDataFrame(rows, "vec_id long, subject long, embedding array<double>").repartition(5), x, subject


def power(m, p, ridge):
    v, u = np.linalg.eigh(m + ridge * np.eye(len(m)))
    return (u * v**p) @ u.T


def test_whitening_and_colouring(vectors):
    df, x, subject = vectors
    colour = power(np.cov(x.T, bias=True), 0.5, 1e-3)
    want = np.empty_like(x)
    for s in set(subject):
        own = x[subject == s]
        want[subject == s] = (own - own.mean(axis=0)) @ power(np.cov(own.T, bias=True), -0.5, 1e-3) @ colour
    got = {r.vec_id: r.embedding for r in E.whitened(df, "subject", ["vec_id"]).collect()}
    assert len(got) == 120 and np.allclose([got[i] for i in range(120)], want, atol=1e-6)


def test_erasure_leaves_no_subject_means(vectors):
    df, x, subject = vectors
    got = {r.vec_id: r.embedding for r in E.erased(df, "subject", ["vec_id"]).collect()}
    y = np.array([got[i] for i in range(120)])
    # Six directions hold seven subjects' means, so nothing is left to keep and the vectors stay; of two groups one goes.
    assert np.allclose(y, x)
    two = df.withColumn("subject", F.col("vec_id") % 2)
    got = {r.vec_id: r.embedding for r in E.erased(two, "subject", ["vec_id"]).collect()}
    y = np.array([got[i] for i in range(120)])
    assert np.allclose(y[::2].mean(axis=0), y[1::2].mean(axis=0), atol=1e-4) and not np.allclose(x[::2].mean(axis=0), x[1::2].mean(axis=0), atol=1e-4)
    assert np.linalg.matrix_rank(y - y.mean(axis=0), tol=1e-3) == 5 and np.allclose(y.mean(axis=0), x.mean(axis=0), atol=1e-4)


def test_token_covariance(spark):
    r = np.random.default_rng(5)
    t = r.normal(size=(4, 9))
    df = spark.createDataFrame([(1, [[float(v) for v in row] for row in t])], "vec_id long, tokens array<array<double>>")
    got = np.array(E.token_covariance(df, ["vec_id"]).first().vector)
    c = np.cov(t, bias=True) + 1e-6 * np.eye(4)
    v, u = np.linalg.eigh(c)
    log = (u * np.log(v)) @ u.T
    assert len(got) == 10 and abs((got**2).sum() - (log**2).sum()) < 1e-6
    assert np.allclose(got[[0, 4, 7, 9]], np.diag(log)) and abs(got[1] - np.sqrt(2) * log[0, 1]) < 1e-9


def test_component_sweep_is_nested(vectors):
    df, x, _ = vectors
    got = {(r.vec_id, r.size): np.array(r.scores) for r in E.pca_sweep(df, ["vec_id"], [2, 4, 500]).collect()}
    assert len(got) == 240
    _, _, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    for i in range(0, 120, 11):
        assert np.allclose(np.abs(got[i, 4]), np.abs((x[i] - x.mean(axis=0)) @ vt[:4].T), atol=1e-6) and np.allclose(got[i, 2], got[i, 4][:2])


def test_ratio_of_participation(vectors):
    df, x, _ = vectors
    v = np.linalg.eigvalsh(np.cov(x.T, bias=True))
    assert abs(E.participation_ratio(df) - v.sum() ** 2 / (v**2).sum()) < 1e-6


def test_medians_and_ranks(spark, monkeypatch):
    """Small groups and groups beyond the sketch, ties, an even and an odd number of values, missing values and keys."""
    r = random.Random(2)
    rows = [(k, None if r.random() < 0.05 else float(r.choice([r.randrange(20), r.random() * 50]))) for k, n in (("a", 7001), ("b", 6000), (None, 9), ("c", 1)) for _ in range(n)] + [("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    for sketch in (10_000, 500):
        monkeypatch.setattr(ranks, "SKETCH", sketch)
        got = {x.k: x.m for x in ranks.medians(df, ["k"], "v", "m").collect()}
        for k in ("a", "b", None, "c"):
            assert abs(got[k] - statistics.median([v for x, v in rows if x == k and v is not None])) < 1e-9
        assert "d" not in got
    numbered = ranks.ranked(df.filter("k = 'a' and v is not null"), ["k"], F.floor("v"), [F.col("v")], "at").orderBy("at").collect()
    assert [x.at for x in numbered] == list(range(len(numbered))) and all(a.v <= b.v for a, b in zip(numbered, numbered[1:]))


def test_tuning_and_forward_selection(spark):
    r = random.Random(1)
    rows = [(i % 3, y, float(y * 4 + r.random()), float(r.random())) for i in range(90) for y in (i // 3 % 2,)]
    df = spark.createDataFrame(rows, "fold int, y int, good double, noise double")
    found = U.forward_selection(df.withColumn("x", F.array("noise", "good")), "x").collect()
    assert [(r.place, r.feature, r.score) for r in found] == [(0, 1, 1.0)]
    own = df.withColumns({"x": F.array("good", "noise"), "group": F.monotonically_increasing_id()}).drop("fold")
    settings = [{"penalty": 100.0, "l1_share": 1.0}, {"penalty": 0.01, "l1_share": 0.5}]
    got = {(r.fold, r.setting): r for r in U.nested_tuning(U.nested_folds(own, 3, 2), "x", settings, inner_folds=2).collect()}
    assert all(got[f, 1].chosen and got[f, 1].inner_score == got[f, 1].outer_score == 1.0 > got[f, 0].inner_score for f in range(3))


def test_area_under_the_curve(spark):
    r = random.Random(6)
    rows = [(f, r.randrange(2), r.randrange(2), r.choice([0.1, 0.5, r.random(), 1.0])) for f in range(2) for _ in range(300)] + [(2, 1, 1, 0.5)]
    got = {x.fold: x for x in T.fold_metrics(spark.createDataFrame(rows, "fold int, y int, prediction int, probability double"), []).collect()}
    for f in range(2):
        pos, neg = ([p for g, y, _, p in rows if g == f and y == v] for v in (1, 0))
        want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
        assert abs(got[f].roc_auc - want) < 1e-9
    assert got[2].roc_auc is None and got[2].accuracy == 1.0


def test_retention_in_blocks(spark, monkeypatch):
    """Queries dealt into many blocks give what one block gives, and what ranks of all distances give."""
    r = np.random.default_rng(8)
    x = r.integers(-9, 9, size=(150, 6)).astype(float)  # exact distances, with ties
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "i long, h array<double>").withColumn("l", F.slice("h", 1, 2))
    k, asked = 5, range(0, 150, 3)
    t = c = 0
    for i in asked:
        d = [((x[i] - x) ** 2).sum(1), ((x[i, :2] - x[:, :2]) ** 2).sum(1)]
        order = [[j for j in sorted(range(150), key=lambda j, v=v: (v[j], j)) if j != i] for v in d]
        rank = [{j: n + 1 for n, j in enumerate(o)} for o in order]
        t += sum(max(rank[0][j] - k, 0) for j in order[1][:k])
        c += sum(max(rank[1][j] - k, 0) for j in order[0][:k])
    scale = 2 / (len(asked) * k * (2 * 150 - 3 * k - 1))
    for size in (1 << 25, 2000):
        monkeypatch.setattr(E, "ASKED_BYTES", size)
        got = E.neighbour_retention(df, "i", "h", "l", k, F.col("i") % 3 == 0).first()
        assert abs(got.trustworthiness - (1 - scale * t)) < 1e-9 and abs(got.continuity - (1 - scale * c)) < 1e-9


@pytest.mark.parametrize("rows, width, narrow", [(40, 20_000, 2048), (200, 30, 8), (200, 30, 2048), (3, 5, 2)])
def test_wide_components(spark, monkeypatch, rows, width, narrow):
    """Scores of wide vectors are those of a singular value decomposition, up to sign, without a width x width matrix."""
    monkeypatch.setattr(E, "NARROW", narrow)
    r = np.random.default_rng(1)
    x = r.normal(size=(rows, 25)) * 0.8 ** np.arange(25) @ r.normal(size=(25, width)) + 3
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "i long, embedding array<double>").repartition(3)
    k = min(6, rows, width)
    got = np.array([s.scores for s in E.pca_sweep(df, ["i"], [k]).orderBy("i").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :k] * s[:k]), atol=1e-4 * s[0])
