"""Nested tuning (T7) and forward selection (T8): many small linear models fitted together.

Rows stay where they are. Each pass over them sums, for all models at once, what the next step needs (moments, gradients or
counts of right answers) in tasks that work on whole batches; the sums, bounded by the vectors' width and the number of
models, are added up in a tree of tasks and come to the driver, which steps every model.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from .evaluation import dealt_groups
from .sums import summed, vectors

STEPS, CLOSE = 60, 1e-5  # passes of a fit at most; largest change at its end


def nested_folds(df: DataFrame, outer: int, inner: int, label: str = "y", group: str = "group", seed: int = 0) -> DataFrame:
    """Add fold and inner, an array by outer fold: the fold of the row among the rows outside that outer fold, null for its own.

    Both are dealt by group, as T4 does, so that no group is in two folds of one split. Rows without a label or group are left out.
    """
    df = df.filter(F.col(label).isNotNull() & F.col(group).isNotNull())
    first = scratch(dealt_groups(df, outer, [], label, group, seed), "outer")
    each = first.withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(outer - 1)))).filter("_f <> fold").drop("fold")
    again = dealt_groups(each, inner, ["_f"], label, group, seed + 1)
    lists = again.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_f", "fold"))).alias("_l"))  # one for each outer fold but its own
    own = first.join(lists, group, "left").select(
        F.col(group), "fold", F.transform(F.sequence(F.lit(0), F.lit(outer - 1)), lambda f: F.when(f != F.col("fold"), F.get("_l", F.when(f < F.col("fold"), f).otherwise(f - 1))["fold"])).alias("inner"))
    return df.join(own, group)


@dataclass(frozen=True)
class Part:
    """A split's training rows: all outside outer fold `fold`, and there outside inner fold `inner` if that is given."""

    fold: int
    inner: int | None = None


def _members(parts: list[Part], fold: np.ndarray, inner: np.ndarray | None, held_out: bool) -> np.ndarray:
    """Which rows (down) each part (across) trains on, or holds out."""
    out = np.empty((len(fold), len(parts)), bool)
    for i, p in enumerate(parts):
        away = fold != p.fold
        if p.inner is None:
            out[:, i] = ~away if held_out else away
        else:
            out[:, i] = away & ((inner[:, p.fold] == p.inner) if held_out else (inner[:, p.fold] != p.inner))
    return out


def _summed(rows: DataFrame, sums: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None], np.ndarray]) -> np.ndarray:
    """The sum over all batches of sums(x, y, fold, inner)."""

    def part(b: pa.RecordBatch) -> np.ndarray:
        inner = None
        if b.num_columns > 3:
            inner = np.asarray(b.column(3).flatten().fill_null(-1)).reshape(b.num_rows, -1)
        return sums(vectors(b.column(0)), np.asarray(b.column(1)), np.asarray(b.column(2)), inner)

    return summed(rows, part)


def _table(df: DataFrame, features: str, label: str, nested: bool) -> tuple[DataFrame, int]:
    """Written rows (x, y, fold, inner) of one width; rows with a missing value are left out."""
    x = F.transform(features, lambda v: v.cast("double"))
    whole = F.col(features).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v))
    cols = [x.alias("x"), F.col(label).cast("int").alias("y"), F.col("fold").cast("int").alias("fold"), *([F.col("inner")] if nested else [])]
    rows = scratch(df.filter(whole & F.col(label).isNotNull() & F.col("fold").isNotNull()).select(*cols), "vectors")
    sizes = rows.agg(F.min(F.size("x")).alias("a"), F.max(F.size("x")).alias("b")).first()
    if sizes.a != sizes.b:
        raise ValueError(f"vectors of {sizes.a} to {sizes.b} values")
    return rows, sizes.a or 0


class Moments:
    """Means, spreads and second moments of each part's training rows, each class weighing the same."""

    def __init__(self, rows: DataFrame, width: int, parts: list[Part]) -> None:
        def sums(x: np.ndarray, y: np.ndarray, fold: np.ndarray, inner: np.ndarray | None) -> np.ndarray:
            m, out = _members(parts, fold, inner, False), []
            for i in range(len(parts)):
                for label in (0, 1):
                    own = x[m[:, i] & (y == label)]
                    out += [[len(own)], own.sum(0), (own.T @ own).ravel()]
            return np.concatenate(out)

        found = _summed(rows, sums)
        self.parts, self.width = parts, width
        per = found.reshape(len(parts), 2, 1 + width + width * width) if len(found) else np.zeros((len(parts), 2, 1 + width + width * width))
        n, s, q = per[:, :, 0], per[:, :, 1 : 1 + width], per[:, :, 1 + width :].reshape(len(parts), 2, width, width)
        total = n.sum(1)
        self.valid = (n > 0).all(1)
        self.class_weight = np.where(n > 0, total[:, None] / (2 * np.maximum(n, 1)), 0.0)
        self.total = np.maximum(total, 1)
        self.mean = s.sum(1) / self.total[:, None]
        var = np.einsum("pkii->pi", q) / self.total[:, None] - self.mean**2
        self.spread = np.where(var > 1e-24, np.sqrt(np.maximum(var, 1e-24)), 1.0)  # a constant value is left as it is
        w = self.class_weight
        sx, sxx = np.einsum("pk,pki->pi", w, s), np.einsum("pk,pkij->pij", w, q)
        mass = (w * n).sum(1)
        centred = sxx - sx[:, :, None] * self.mean[:, None, :] - self.mean[:, :, None] * sx[:, None, :] + mass[:, None, None] * self.mean[:, :, None] * self.mean[:, None, :]
        scale = self.spread[:, :, None] * self.spread[:, None, :]
        self.second = centred / scale / self.total[:, None, None]  # of scaled values, weighted
        self.first = (sx - mass[:, None] * self.mean) / self.spread / self.total[:, None]
        self.mass = mass / self.total
        sign = np.array([-1.0, 1.0])
        self.cross = (np.einsum("pk,k,pki->pi", w, sign, s) - np.einsum("pk,k,pk->p", w, sign, n)[:, None] * self.mean) / self.spread / self.total[:, None]

    def plain(self, part: np.ndarray, weights: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and levels of models on scaled values as those on values as they are."""
        own = weights / self.spread[part]
        return own, level - (own * self.mean[part]).sum(1)


def balanced_accuracies(rows: DataFrame, parts: list[Part], part: np.ndarray, weights: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Balanced accuracy of each model (weights and level) on the rows that its part holds out; NaN without rows of both classes."""

    def sums(x: np.ndarray, y: np.ndarray, fold: np.ndarray, inner: np.ndarray | None) -> np.ndarray:
        m = _members(parts, fold, inner, True)
        says = x @ weights.T + level > 0
        held = m[:, part]
        pos = (y == 1)[:, None]
        return np.array([(held & pos & says).sum(0), (held & pos).sum(0), (held & ~pos & ~says).sum(0), (held & ~pos).sum(0)], np.float64).ravel()

    found = _summed(rows, sums)
    tp, p, tn, n = found.reshape(4, -1) if len(found) else np.zeros((4, len(part)))
    with np.errstate(invalid="ignore", divide="ignore"):
        return (tp / p + tn / n) / 2


def logistic(rows: DataFrame, moments: Moments, part: np.ndarray, penalty: np.ndarray, l1_share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and levels, on scaled values, of elastic-net logistic models, one for each entry of part, penalty and l1_share.

    The loss is the mean over training rows, classes weighing the same, plus penalty (l1_share |w| + (1 - l1_share) w^2 / 2). A
    quarter of the weighted second moments bounds the curvature for good, so that each pass needs gradients only and each
    step lowers every loss.
    """
    parts, d = moments.parts, moments.width
    curve = np.zeros((len(parts), d + 1, d + 1))
    curve[:, :d, :d], curve[:, d, d] = moments.second / 4, moments.mass / 4
    curve[:, :d, d] = curve[:, d, :d] = moments.first / 4
    bound = np.linalg.eigvalsh(curve)[:, -1] + 1e-12
    h, top = curve[part], bound[part][:, None] + (penalty * (1 - l1_share))[:, None]
    ridge = np.concatenate([np.repeat((penalty * (1 - l1_share))[:, None], d, 1), np.zeros((len(part), 1))], 1)
    lasso = np.concatenate([np.repeat((penalty * l1_share)[:, None], d, 1), np.zeros((len(part), 1))], 1)
    beta = np.zeros((len(part), d + 1))
    weight = moments.class_weight / moments.total[:, None]

    for _ in range(STEPS):
        w, level = moments.plain(part, beta[:, :d], beta[:, d])

        def sums(x: np.ndarray, y: np.ndarray, fold: np.ndarray, inner: np.ndarray | None, w: np.ndarray = w, level: np.ndarray = level) -> np.ndarray:
            m = _members(parts, fold, inner, False) * weight[:, np.clip(y, 0, 1)].T
            rest = (1 / (1 + np.exp(-np.clip(x @ w.T + level, -500, 500))) - y[:, None]) * m[:, part]
            return np.concatenate([(rest.T @ x), rest.sum(0)[:, None]], 1).ravel()

        found = _summed(rows, sums)
        g = found.reshape(len(part), d + 1) if len(found) else np.zeros((len(part), d + 1))
        g = np.concatenate([(g[:, :d] - moments.mean[part] * g[:, d:]) / moments.spread[part], g[:, d:]], 1)
        # The model of the loss around beta, minimised by accelerated proximal steps.
        new, point, t = beta.copy(), beta.copy(), 1.0
        for _ in range(300):
            slope = g + np.einsum("mij,mj->mi", h, point - beta) + ridge * point
            step = point - slope / top
            step = np.sign(step) * np.maximum(np.abs(step) - lasso / top, 0)
            t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            point = step + (was - 1) / t * (step - new)
            moved, new = np.abs(step - new).max(initial=0), step
            if moved < CLOSE / 100:
                break
        change, beta = np.abs(new - beta).max(initial=0), new
        if change < CLOSE:
            break
    return beta[:, :d], beta[:, d]


def nested_tuning(df: DataFrame, features: str, grid: list[dict], label: str = "y", inner_folds: int = 3) -> DataFrame:
    """(fold, setting, penalty, l1_share, inner_score, chosen, outer_score) from rows with fold and inner (`nested_folds`).

    grid: penalty and l1_share of elastic-net logistic models. A setting's inner score in an outer fold is the mean balanced
    accuracy over that fold's inner folds; the largest is chosen, the first of equal ones. The chosen setting is fitted to all
    rows outside the outer fold and scored on it. All models of all folds are fitted together. Folds that lack a class have
    a null score.
    """
    rows, width = _table(df, features, label, True)
    folds = sorted(r.fold for r in rows.select("fold").distinct().collect())
    parts = [Part(f, i) for f in folds for i in [*range(inner_folds), None]]
    moments = Moments(rows, width, parts)
    inner = [(i, s) for i, p in enumerate(parts) if p.inner is not None for s in range(len(grid))]
    values = lambda chosen: [np.array([float(grid[s].get(k, z)) for _, s in chosen]) for k, z in (("penalty", 0.01), ("l1_share", 0.5))]

    def scores(models: list[tuple[int, int]]) -> np.ndarray:
        part = np.array([i for i, _ in models], int)
        found = balanced_accuracies(rows, parts, part, *moments.plain(part, *logistic(rows, moments, part, *values(models))))
        return np.where(moments.valid[part], found, np.nan)

    by: dict[tuple[int, int], list[float]] = {}
    for (i, s), v in zip(inner, scores(inner), strict=True):
        by.setdefault((parts[i].fold, s), []).append(v)
    mean = {k: float(np.nanmean(v)) if np.isfinite(v).any() else None for k, v in by.items()}
    best = {f: max(range(len(grid)), key=lambda s: -1.0 if mean[f, s] is None else mean[f, s]) for f in folds}
    whole = [(parts.index(Part(f)), best[f]) for f in folds]
    outer = {f: float(v) if np.isfinite(v) else None for f, v in zip(folds, scores(whole), strict=True)}
    penalty, share = values([(0, s) for s in range(len(grid))])
    found = [(f, s, float(penalty[s]), float(share[s]), mean[f, s], s == best[f], outer[f] if s == best[f] else None) for f in folds for s in range(len(grid))]
    return df.sparkSession.createDataFrame(found, "fold int, setting int, penalty double, l1_share double, inner_score double, chosen boolean, outer_score double")


def forward_selection(df: DataFrame, features: str, tolerance: float = 1e-3, most: int | None = None, ridge: float = 1e-3, label: str = "y") -> DataFrame:
    """(place, feature, score) in the order of selection: the place of the value in the vector that helps the mean balanced
    accuracy over the folds (column fold) most, until it helps by less than tolerance or `most` are chosen.

    Every candidate of a step is fitted at once as a ridge classifier (targets -1 and 1, classes weighing the same) from
    moments that one pass over the rows gives, and all are scored in one further pass. Of equal candidates the first is taken.
    """
    rows, width = _table(df, features, label, False)
    parts = [Part(r.fold) for r in rows.select("fold").distinct().orderBy("fold").collect()]
    moments = Moments(rows, width, parts)
    use = np.flatnonzero(moments.valid)
    chosen: list[int] = []
    found: list[tuple[int, int, float]] = []
    best = -np.inf
    while len(chosen) < min(width, width if most is None else most) and len(use):
        left = [j for j in range(width) if j not in chosen]
        sets = np.array([[*chosen, j] for j in left])
        size = sets.shape[1]
        part = np.repeat(use, len(left))
        index = np.tile(sets, (len(use), 1))
        # Weighted least squares with a free level: the moments about the weighted mean.
        first, mass = moments.first[part[:, None], index], moments.mass[part]
        a = moments.second[part[:, None, None], index[:, :, None], index[:, None, :]] - first[:, :, None] * first[:, None, :] / mass[:, None, None]
        w = np.linalg.solve(a + ridge * np.eye(size), moments.cross[part[:, None], index][:, :, None])[:, :, 0]
        weights = np.zeros((len(part), width))
        np.put_along_axis(weights, index, w, 1)
        level = -(w * first).sum(1) / mass
        score = balanced_accuracies(rows, parts, part, *moments.plain(part, weights, level)).reshape(len(use), len(left))
        mean = np.where(np.isfinite(score).any(0), np.nanmean(np.where(np.isfinite(score), score, np.nan), 0), -np.inf)
        top = int(np.argmax(np.round(mean, 12)))
        if not mean[top] >= best + tolerance:
            break
        best = float(mean[top])
        chosen.append(left[top])
        found.append((len(chosen) - 1, left[top], best))
    return df.sparkSession.createDataFrame(found, "place int, feature int, score double")
