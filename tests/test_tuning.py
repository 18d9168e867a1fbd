"""Nested tuning and forward selection against plain loops, one model at a time."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortloom.operators import evaluation as T
from cohortloom.operators import tuning as U

SCHEMA = "group string, y int, x array<double>, fold_ string"
GRID = [{"penalty": 0.002, "l1_share": 0.0}, {"penalty": 0.05, "l1_share": 0.5}, {"penalty": 3.0, "l1_share": 1.0}]


def data(n=240, width=6):
    r = np.random.default_rng(5)
    x = r.normal(size=(n, width)) * [1, 10, 0.1, 1, 1, 0] + [0, 5, 0, 0, 0, 2]
    y = (x[:, 0] + 0.1 * x[:, 1] + 6 * x[:, 2] + r.normal(size=n) > 0.5).astype(int)
    return [(f"g{i % 40}", int(y[i]), [float(v) for v in x[i]], "x") for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def scaled(train, test, y):
    mean, sd = train.mean(0), train.std(0)
    sd = np.where(sd > 1e-12, sd, 1)
    w = np.where(y == 1, len(y) / (2 * max((y == 1).sum(), 1)), len(y) / (2 * max((y == 0).sum(), 1)))
    return (train - mean) / sd, (test - mean) / sd, w


def balanced(says, y):
    return (np.mean(says[y == 1]) + np.mean(~says[y == 0])) / 2


def fitted(train, y, test, penalty, l1_share):
    """Whether each test row is taken for class 1, by plain proximal steps until nothing moves."""
    z, t, w = scaled(train, test, y)
    z, t = (np.hstack([a, np.ones((len(a), 1))]) for a in (z, t))
    free = np.append(np.ones(z.shape[1] - 1), 0)
    b, top = np.zeros(z.shape[1]), np.linalg.eigvalsh((z * w[:, None]).T @ z / len(y) / 4)[-1] + penalty
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-z @ b))
        g = z.T @ (w * (p - y)) / len(y) + penalty * (1 - l1_share) * b * free
        step = b - g / top
        new = np.sign(step) * np.maximum(np.abs(step) - penalty * l1_share / top * free, 0)
        if np.abs(new - b).max() < 1e-10:
            break
        b = new
    return t @ b > 0


def rows_of(df):
    found = df.select("group", "y", "x", "fold", *(["inner"] if "inner" in df.columns else [])).collect()
    return np.array([r.x for r in found]), np.array([r.y for r in found]), np.array([r.fold for r in found]), [r["inner"] if "inner" in df.columns else None for r in found], [r.group for r in found]


def test_nested_tuning_is_a_plain_loop(spark):
    df = U.nested_folds(table(spark, data()), 3, 2)
    x, y, fold, inner, group = rows_of(df)
    got = {(r.fold, r.setting): r for r in U.nested_tuning(df, "x", GRID, inner_folds=2).collect()}
    assert len(got) == 9
    for f in range(3):
        own = defaultdict(set)
        for g, k, i in zip(group, fold, inner, strict=True):
            assert (i[f] is None) == (k == f)
            own[g].add((k, i[f]))
        assert all(len(v) == 1 for v in own.values())  # no group is on both sides of a split
        scores = []
        for s, setting in enumerate(GRID):
            parts = []
            for i in range(2):
                held = np.array([v[f] == i for v in inner])
                train = (fold != f) & ~held
                parts.append(balanced(fitted(x[train], y[train], x[held], **setting), y[held]))
            scores.append(np.mean(parts))
            assert got[f, s].inner_score == pytest.approx(scores[-1], abs=1e-9)
        best = int(np.argmax(scores))
        assert [got[f, s].chosen for s in range(3)] == [s == best for s in range(3)]
        assert got[f, best].outer_score == pytest.approx(balanced(fitted(x[fold != f], y[fold != f], x[fold == f], **GRID[best]), y[fold == f]), abs=1e-9)


def test_tuning_never_sees_the_outer_fold(spark):
    """Whatever an outer fold's rows hold, its inner scores and choice stay."""
    df = U.nested_folds(table(spark, data()), 3, 2).cache()
    before = {(r.fold, r.setting): (r.inner_score, r.chosen) for r in U.nested_tuning(df, "x", GRID, inner_folds=2).collect()}
    odd = df.selectExpr("group", "CASE WHEN fold = 1 THEN 1 - y ELSE y END AS y", "CASE WHEN fold = 1 THEN transform(x, v -> v * 100 - 7) ELSE x END AS x", "fold", "inner")
    after = {(r.fold, r.setting): (r.inner_score, r.chosen) for r in U.nested_tuning(odd, "x", GRID, inner_folds=2).collect()}
    assert {k: v for k, v in before.items() if k[0] == 1} == {k: v for k, v in after.items() if k[0] == 1}
    assert before != after


def test_forward_selection_is_a_plain_loop(spark):
    df = T.group_folds(table(spark, data()), 3)
    x, y, fold, _, _ = rows_of(df)
    chosen, best, want = [], -1.0, []
    while len(chosen) < x.shape[1]:
        scores = []
        for j in [j for j in range(x.shape[1]) if j not in chosen]:
            parts, own = [], [*chosen, j]
            for f in range(3):
                z, t, w = scaled(x[fold != f][:, own], x[fold == f][:, own], y[fold != f])
                z, t = (np.hstack([a, np.ones((len(a), 1))]) for a in (z, t))
                a = (z * w[:, None]).T @ z / len(z) + np.diag([1e-3] * len(own) + [0])
                b = np.linalg.solve(a, z.T @ (w * (2 * y[fold != f] - 1)) / len(z))
                parts.append(balanced(t @ b > 0, y[fold == f]))
            scores.append((round(np.mean(parts), 12), -j))
        top = max(scores)
        if top[0] < best + 1e-3:
            break
        best = top[0]
        chosen.append(-top[1])
        want.append((len(chosen) - 1, chosen[-1], pytest.approx(best, abs=1e-9)))
    got = [tuple(r) for r in U.forward_selection(df, "x").orderBy("place").collect()]
    assert got == want and len(got) > 1
    assert U.forward_selection(df, "x", most=1).count() == 1 and U.forward_selection(df.limit(0), "x").count() == 0


def test_folds_are_balanced(spark):
    """Groups of very different sizes: a class's rows and all rows differ by no more than one largest group."""
    r = random.Random(3)
    sizes = [r.choice([1, 2, 3, 50, 200]) for _ in range(90)]
    rows = [(f"g{g}", g % 2, [0.0], "x") for g, n in enumerate(sizes) for _ in range(n)]
    got = T.group_folds(table(spark, rows), 4).collect()
    assert len(got) == len(rows) and all(len({r.fold for r in got if r.group == g}) == 1 for g in {r.group for r in got})
    for own in (got, [r for r in got if r.y == 0], [r for r in got if r.y == 1]):
        n = Counter(r.fold for r in own)
        assert max(n.values()) - min(n.values()) <= max(sizes)


def test_fold_predictions_are_a_plain_fit(spark):
    """Scaling and an elastic-net logistic fit on the other folds give the same classes and probabilities as plain steps."""
    df = T.group_folds(table(spark, data()), 3)
    got = T.fold_predictions(df.selectExpr("group", "y", "x", "fold", "monotonically_increasing_id() AS i"), "x", maxIter=500, regParam=0.01, elasticNetParam=0.5, tol=1e-10)
    got = {r.i: r for r in got.collect()}
    rows = df.selectExpr("y", "x", "fold", "monotonically_increasing_id() AS i").collect()
    x, y, fold = np.array([r.x for r in rows]), np.array([r.y for r in rows]), np.array([r.fold for r in rows])
    assert sorted(got) == sorted(r.i for r in rows)
    for f in range(3):
        want = fitted(x[fold != f], y[fold != f], x[fold == f], 0.01, 0.5)
        have = np.array([got[r.i].prediction for r in rows if r.fold == f]) == 1
        assert (want == have).mean() > 0.97
        assert all((got[r.i].probability > 0.5) == (got[r.i].prediction == 1) for r in rows if r.fold == f)
