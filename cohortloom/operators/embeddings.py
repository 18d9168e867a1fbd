"""Embedding tables and diagnostics (E1-E13). Vectors are arrays; only matrices of the vectors' width reach the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch, ship
from .features import vector_means
from .ranks import LANES, hash_bucket, lane_values, lanes_text, ranked
from .sums import summed, vectors


def levels(df: DataFrame) -> dict[str, DataFrame]:
    """The epoch, recording and subject tables of embeddings(model_key, condition, subject, recording_id, embedding)."""
    return {"epoch": df, "recording": vector_means(df, ["model_key", "condition", "subject", "recording_id"], "embedding"),
        "subject": vector_means(df, ["model_key", "condition", "subject"], "embedding")}


def centred(df: DataFrame, subject: str, ids: list[str], vector: str = "embedding") -> DataFrame:
    """E3 ea_mean: each vector less its subject's mean."""
    mean = vector_means(df.select(subject, vector), [subject], vector).withColumnRenamed(vector, "_m")
    return df.join(mean, subject).withColumn(vector, F.zip_with(vector, "_m", lambda a, b: a - b)).drop("_m").select(subject, *ids, vector)


def moments(df: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """(by, n, total, products): sums for means and covariances; each task folds its rows first, Spark adds the parts."""
    cols = [*by, vector]
    kinds = ", ".join(f"{c} {t}" for c, t in df.dtypes if c in by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b[vector].notna()]
            for key, g in b.groupby(by, dropna=False) if by else [((), b)]:
                if len(g):
                    x = np.stack(g[vector].to_numpy()).astype(float)
                    yield pd.DataFrame([[*key, len(x), np.concatenate([x.sum(axis=0), (x.T @ x).reshape(-1)])]], columns=[*by, "n", "s"])

    parts = df.select(*cols).mapInPandas(run, (kinds + ", " if kinds else "") + "n long, s array<double>")
    n = parts.groupBy(*by).agg(F.sum("n").alias("n"))
    s = vector_sums(parts, by)
    return n.join(s, by) if by else n.crossJoin(s)


def vector_sums(parts: DataFrame, by: list[str]) -> DataFrame:
    e = parts.select(*by, F.posexplode("s").alias("i", "x")).groupBy(*by, "i").agg(F.sum("x").alias("x"))
    return e.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("s"))


def _covariance(n: float, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = int((np.sqrt(1 + 4 * len(s)) - 1) / 2)
    mean = s[:d] / n
    return mean, s[d:].reshape(d, d) / n - np.outer(mean, mean)


def _power(m: np.ndarray, p: float, ridge: float) -> np.ndarray:
    v, u = np.linalg.eigh((m + m.T) / 2 + ridge * np.eye(len(m)))
    return (u * np.maximum(v, ridge) ** p) @ u.T


def whitened(df: DataFrame, subject: str, ids: list[str], vector: str = "embedding", ridge: float = 1e-3) -> DataFrame:
    """E3 ea_coral: each subject's vectors centred, whitened by the subject's covariance and coloured by the pooled one."""
    n, s = moments(df, [], vector).first()
    _, pooled = _covariance(n, np.array(s))
    colour = _power(pooled, 0.5, ridge)
    own = moments(df, [subject], vector).select(F.col(subject).alias("_s"), "n", "s")
    cols = [subject, *ids, vector]
    kinds = ", ".join(f"{c} {t}" for c, t in df.dtypes if c in (subject, *ids))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean = w = None
        for b in batches:
            told = b["s"].notna().to_numpy()
            group = np.cumsum(told)
            for g in np.unique(group):  # a subject's sums stand before its rows
                part, here = b[group == g], told[group == g]
                if here[0]:
                    mean, cov = _covariance(part["n"].iloc[0], np.asarray(part["s"].iloc[0]))
                    w = _power(cov, -0.5, ridge) @ colour
                    part = part[1:]
                if len(part):
                    yield part[[subject, *ids]].assign(**{vector: list((np.stack(part[vector].to_numpy()).astype(float) - mean) @ w)})

    # Each subject's rows meet its sums once, in PARTS places, so that no subject is a task of its own.
    rows = df.filter(F.col(vector).isNotNull()).select(*cols).withColumn("_part", F.pmod(F.xxhash64(*ids), F.lit(PARTS)))
    sums = own.select(F.col("_s").alias(subject), "n", "s",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("_part"))
    both = rows.withColumn("_row", F.lit(1)).unionByName(sums.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    dealt = both.repartition(subject, "_part").sortWithinPartitions(subject, "_part", "_row")
    return dealt.select(*cols, "n", "s").mapInPandas(run, f"{kinds}, {vector} array<double>")


PARTS = 8


def erased(df: DataFrame, subject: str, ids: list[str], vector: str = "embedding", ridge: float = 1e-6) -> DataFrame:
    """E4 leace: x - W^-1 P W (x - mean), where W whitens and P projects on the whitened between-subject directions.

    The subject indicators' cross-covariance spans the same space as the subject means, so only means and second moments
    of the vectors' width reach the driver. A degenerate projector (no subject direction) leaves the vectors as they are.
    """
    n, s = moments(df, [], vector).first()
    mean, cov = _covariance(n, np.array(s))
    between = vector_means(df.select(subject, vector), [subject], vector).join(df.groupBy(subject).agg(F.count(F.lit(1)).alias("k")), subject)
    shifted = between.select(F.expr(f"transform({vector}, (x, i) -> (x - array({', '.join(repr(float(m)) for m in mean)})[i]) * sqrt(k))").alias(vector))
    _, s2 = moments(shifted, [], vector).first()
    d = len(mean)
    scatter = np.array(s2)[d:].reshape(d, d) / n
    w, back = _power(cov, -0.5, ridge), _power(cov, 0.5, ridge)
    values, u = np.linalg.eigh(w @ scatter @ w)
    basis = u[:, values > 1e-8 * max(1e-12, values.max())]
    matrix = np.eye(d) - w @ basis @ basis.T @ back if basis.shape[1] and basis.shape[1] < d else np.eye(d)
    kinds = ", ".join(f"{c} {t}" for c, t in df.dtypes if c in (subject, *ids))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b[vector].to_numpy()).astype(float)
                yield b[[subject, *ids]].assign(**{vector: list(mean + (x - mean) @ matrix)})

    return df.select(subject, *ids, vector).mapInPandas(run, f"{kinds}, {vector} array<double>")


def token_covariance(df: DataFrame, ids: list[str], tokens: str = "tokens", ridge: float = 1e-6) -> DataFrame:
    """E5: the upper triangle (off-diagonal times sqrt 2) of the matrix logarithm of each row's token covariance; d tokens give d(d+1)/2."""
    kinds = ", ".join(f"{c} {t}" for c, t in df.dtypes if c in ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b[tokens]:
                x = np.stack([np.asarray(r, float) for r in t])
                x = x - x.mean(axis=1, keepdims=True)
                v, u = np.linalg.eigh(x @ x.T / x.shape[1] + ridge * np.eye(len(x)))
                log = (u * np.log(np.maximum(v, ridge))) @ u.T
                i, j = np.triu_indices(len(x))
                out.append((log[i, j] * np.where(i == j, 1.0, np.sqrt(2))).tolist())
            yield b[ids].assign(vector=out)

    return df.select(*ids, tokens).mapInPandas(run, f"{kinds}, vector array<double>")


def diagnostic_tasks(df: DataFrame, evals: dict[str, dict], populations: dict[str, dict], conditions: list[str], ids: list[str]) -> DataFrame:
    """(eval_name, population, scope, ids, y) for every evaluation, population and scope (each condition and `pooled`).

    evals: name -> column, and mapping, positive or order (T1); populations: name -> any_of, all_of (P2).
    condition_separation takes the condition as its target and runs on the pooled scope only. One pass for each task of
    a short list; the union is one plan.
    """
    from ..functions.predicates import cohort
    from .evaluation import target

    out = None
    for name, spec in evals.items():
        for population, wanted in populations.items():
            for scope in ([] if name == "condition_separation" else conditions) + ["pooled"]:
                rows = cohort(df, wanted.get("any_of", ()), wanted.get("all_of"))
                rows = rows.filter(F.col("condition").isin(conditions)) if scope == "pooled" else rows.filter(F.col("condition") == scope)
                rows = target(rows, spec["column"], spec.get("mapping"), spec.get("positive"), spec.get("order"))
                task = rows.select(F.lit(name).alias("eval_name"), F.lit(population).alias("population"), F.lit(scope).alias("scope"), *ids, "y")
                out = task if out is None else out.unionByName(task)
    return out


def fingerprint(df: DataFrame, task: list[str], parts: list[str]) -> DataFrame:
    """(task, n, selection_fingerprint): a hash of the task and of its members, the same for any order.

    Members enter as sums of 16 lanes of 64 bits, so a task of any size is a partial aggregate. Parts are told apart by their
    lengths; missing ones count as empty.
    """
    text = [F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]
    member = F.concat_ws("|", *[F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in text])
    lanes = df.select(*task, *[x.alias(f"_lane{i}") for i, x in enumerate(lane_values(member))])
    s = lanes.groupBy(*task).agg(F.count(F.lit(1)).alias("n"), lanes_text([F.sum(f"_lane{i}") for i in range(LANES)]).alias("_sums"))
    named = [F.coalesce(F.col(t).cast("string"), F.lit("")) for t in task]
    return s.select(*task, "n", F.sha2(F.concat_ws("|", *named, F.col("n").cast("string"), "_sums").cast("binary"), 256).alias("selection_fingerprint"))


def variance_parts(df: DataFrame, groups: list[str], subject: str, vector: str = "embedding") -> DataFrame:
    """(groups, total_variance, between_variance, eta2): sums of squares over dimensions."""
    e = df.select(*groups, subject, F.posexplode(vector).alias("i", "x"))
    s = e.groupBy(*groups, subject, "i").agg(F.count(F.lit(1)).alias("k"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    d = s.groupBy(*groups, "i").agg(F.sum("k").alias("n"), F.sum("sx").alias("t"), F.sum("sxx").alias("q"),
        F.sum(F.col("sx") * F.col("sx") / F.col("k")).alias("b"))
    total, between = F.sum(F.col("q") / F.col("n") - F.pow(F.col("t") / F.col("n"),
        2)), F.sum(F.col("b") / F.col("n") - F.pow(F.col("t") / F.col("n"), 2))
    return d.groupBy(*groups).agg(total.alias("total_variance"), between.alias("between_variance"), (between / total).alias("eta2"))


SLOT = 1024


def excess_eta2(df: DataFrame, subject: str, ids: list[str], vector: str = "embedding", shuffles: int = 5, seed: int = 0) -> DataFrame:
    """Observed eta2, mean eta2 of seeded label shuffles, and their difference. Replicates are rows of one plan.

    A shuffle deals the subjects' row counts out anew: rows in hash order take the labels in their order.
    """
    rep = df.select(*ids, subject, vector).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(shuffles))))
    h = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in ids], F.col("rep").cast("string"), F.lit(str(seed))))
    rows = ranked(rep.withColumn("_h", h), ["rep"], hash_bucket(F.col("_h")), [F.col("_h"), *[F.col(c) for c in ids]], "_at")
    # The label that row number n gets: labels in order, each as often as it occurs.
    sizes = df.groupBy(F.col(subject).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    last = F.sum("_n").over(Window.orderBy(F.col("_label").asc_nulls_first()))  # one row for each label
    spans = sizes.select("_label", (last - F.col("_n")).alias("_from"), last.alias("_to"))
    slots = spans.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("_from") / SLOT), F.floor((F.col("_to") - 1) / SLOT))))
    dealt = rows.withColumn("_slot", F.floor(F.col("_at") / SLOT)).join(slots, "_slot").filter("_at >= _from and _at < _to")
    null = variance_parts(dealt.select("rep", "_label", vector), ["rep"], "_label", vector).agg(F.avg("eta2").alias("null_eta2"))
    seen = variance_parts(df.select(subject, vector), [], subject, vector).select("eta2", "total_variance")
    return seen.crossJoin(null).withColumn("excess_eta2", F.col("eta2") - F.col("null_eta2"))


def participation_ratio(df: DataFrame, vector: str = "embedding") -> float:
    """(sum of eigenvalues)^2 / sum of their squares of the covariance: squared trace by squared Frobenius norm."""
    n, s = moments(df, [], vector).first()
    c = _covariance(n, np.array(s))[1]
    return float(np.trace(c) ** 2 / (c**2).sum())


def skipped(tasks: DataFrame, transform: str, reason: str) -> DataFrame:
    """A status row for each task of a transform that was not computed."""
    return tasks.withColumns({"transform": F.lit(transform), "status": F.lit("skipped"), "reason": F.lit(reason)})


def selected_diagnostics(df: DataFrame, cohort: str, population: str) -> DataFrame:
    """Rows of exactly this cohort and population; keys of derived models (`_align-`) are rejected."""
    missing = [c for c in ("cohort_name", "population", "model_key") if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df.filter((F.col("cohort_name") == cohort) & (F.col("population") == population) & ~F.col("model_key").contains("_align-"))


#: Bytes of asked vectors, or of asked pairs, that are sent to every task at a time.
ASKED_BYTES = 32 << 20


def neighbour_retention(df: DataFrame, id_col: str, high: str, low: str, k: int, queries: Column) -> DataFrame:
    """Trustworthiness and continuity of `low` against `high`: the rows for which `queries` holds against all rows.

    Queries are dealt into blocks of bounded bytes by a hash of their id. For each block all rows stream by twice: each task
    keeps the k nearest of each query in either space, Spark keeps the nearest of those, and then tasks count the rows nearer
    than each. Ties go to the smaller id. Rows without a vector are nobody's neighbours.
    """
    rows = df.select(F.col(id_col).alias("i"), F.col(high).cast("array<double>").alias("h"), F.col(low).cast("array<double>").alias("l"), queries.alias("q"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("asked"))
    rows = rows.filter("h is not null and l is not null")
    asked = scratch(rows.filter("q").drop("q"), "queries")
    others = scratch(rows.drop("q").repartition("i"), "vectors")  # work for a row is large, so rows are spread out
    held = asked.agg(F.sum(F.greatest(8 * (F.size("h") + F.size("l")), F.lit(48 * k)).cast("long") + 64)).first()[0] or 0
    blocks = max(1, -(-held // ASKED_BYTES))
    sums = [0, 0]
    for block in range(blocks):
        own = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block)
        sums = [a + b for a, b in zip(sums, _excesses(others, own, k), strict=True)]
    t, c = [F.lit(float(x)) for x in sums]
    scale = F.lit(2.0) / (F.col("asked") * k * (2 * F.col("n") - 3 * k - 1))
    return size.select((1 - scale * t).alias("trustworthiness"), (1 - scale * c).alias("continuity"))


#: Queries and rows whose distances are worked out at a time.
QUERIES_AT_ONCE, ROWS_AT_ONCE = 128, 1024


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of the columns of q to those of x, added up in the order of the dimensions."""
    total, part = np.zeros((q.shape[1], x.shape[1])), np.empty((q.shape[1], x.shape[1]))
    for a, b in zip(q, x, strict=True):
        np.subtract(a[:, None], b[None, :], out=part)
        part *= part
        total += part
    return total


def _tiles(batch: pa.RecordBatch, sent) -> Iterator[tuple[slice, np.ndarray, list[np.ndarray]]]:
    """(queries, ids, distances in both spaces) of tiles of a batch of (i, h, l); a row is infinitely far from itself."""
    ids, spaces = sent.value
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        b = batch.slice(at, ROWS_AT_ONCE)
        j = b.column(0).to_numpy(zero_copy_only=False)
        x = [np.ascontiguousarray(vectors(b.column(s)).T) for s in (1, 2)]
        for first in range(0, len(ids), QUERIES_AT_ONCE):
            part = slice(first, min(first + QUERIES_AT_ONCE, len(ids)))
            d = [_distances(q[:, part], v) for q, v in zip(spaces, x, strict=True)]
            own = ids[part, None] == j[None, :]
            for m in d:
                m[own] = np.inf
            yield part, j, d


def _excesses(others: DataFrame, asked: DataFrame, k: int) -> list[int]:
    """For a block of queries the sums over the k nearest by the low vectors of how far beyond k they rank by the high ones,
    and the other way round. The block and k rows for each of its queries are sent out."""
    told = asked.collect()
    if not told:
        return [0, 0]
    spark = others.sparkSession
    place = {r.i: n for n, r in enumerate(told)}
    sent = spark.sparkContext.broadcast((np.array([r.i for r in told]), [np.ascontiguousarray(np.array([r[s] for r in told], float).T) for s in ("h", "l")]))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(sent.value[0])
        limit = np.full((2, n), np.inf)
        best = [[(np.zeros(0), np.zeros(0), np.zeros(0, sent.value[0].dtype))] * n for _ in range(2)]
        for b in batches:
            for part, j, d in _tiles(b, sent):
                for s in (0, 1):
                    near, edge = d[s], limit[s, part]
                    if len(j) > k and np.isinf(edge).any():
                        edge = np.minimum(edge, np.partition(near, k - 1, axis=1)[:, k - 1])
                    hit = (near <= edge[:, None]) & (near < np.inf)
                    for r in np.flatnonzero(hit.any(axis=1)):
                        at, q = np.flatnonzero(hit[r]), part.start + r
                        kept = [np.concatenate(p) for p in zip(best[s][q], (near[r, at], d[1 - s][r, at], j[at]), strict=True)]
                        first = np.lexsort((kept[2], kept[0]))[:k]
                        best[s][q] = tuple(c[first] for c in kept)
                        if len(first) == k:
                            limit[s, q] = best[s][q][0][-1]
        for s in (0, 1):
            sizes = [len(x[0]) for x in best[s]]
            ids = np.repeat(sent.value[0], sizes)
            for at in range(0, len(ids), 4096) if len(ids) else ():
                cut = slice(at, at + 4096)
                near, far, other = (np.concatenate([x[c] for x in best[s]])[cut] for c in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), s)), pa.array(ids[cut]), pa.array(other), pa.array(near), pa.array(far)], names=["s", "i", "m", "near", "far"])

    ship(spark)
    kind = dict(others.dtypes)["i"]
    found = others.mapInArrow(nearest, f"s long, i {kind}, m {kind}, near double, far double")
    first = F.row_number().over(Window.partitionBy("s", "i").orderBy("near", "m"))
    far, member = np.full((2, len(told), k), -1.0), np.zeros((2, len(told), k), sent.value[0].dtype)
    for r in found.withColumn("_r", first).filter(F.col("_r") <= k).select("s", "i", "m", "far", "_r").collect():
        far[r.s, place[r.i], r[4] - 1], member[r.s, place[r.i], r[4] - 1] = r.far, r.m
    goals = spark.sparkContext.broadcast((far, member))

    def ranks(batch: pa.RecordBatch) -> np.ndarray:
        far, member = goals.value
        count = np.zeros(far.shape)
        for part, j, d in _tiles(batch, sent):
            for s in (0, 1):
                other = d[1 - s]  # the space in which the nearest of space s are ranked
                for m in range(k):
                    goal = far[s, part, m]
                    upto = other <= goal[:, None]
                    count[s, part, m] += upto.sum(axis=1)
                    tied = (other == goal[:, None]) & (j[None, :] > member[s, part, m][:, None])
                    if tied.any():
                        count[s, part, m] -= tied.sum(axis=1)
        return count.ravel()

    rank = summed(others, ranks).reshape(far.shape)
    by_high, by_low = [int(np.maximum(rank[s] - k, 0)[far[s] >= 0].sum()) for s in (0, 1)]
    for b in (sent, goals):
        b.unpersist()
    return [by_low, by_high]


#: Width up to which second moments are summed; seed, further directions and rounds of the range finder beyond it, and how
#: little its values may change at the end.
NARROW, SEED, MORE, ROUNDS, STILL = 2048, 7, 10, 100, 1e-9


def components(rows: DataFrame, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, directions: width x k) of the k largest principal components of rows(x), each with its largest entry positive.

    Narrow vectors: from their second moments. Wide ones: a randomised range finder, whose passes send a width x (k + MORE)
    matrix out and sum one of that size, so no width x width matrix is made; it is exact at once where that many directions
    hold all rows, and else goes on until the values stay.
    """
    total = summed(rows, lambda b: np.concatenate([[b.num_rows], vectors(b.column(0)).sum(0)]))
    n, mean = int(total[0]), total[1:] / total[0]

    def centred(b: pa.RecordBatch) -> np.ndarray:
        return vectors(b.column(0)) - mean

    if width <= NARROW:
        second = summed(rows, lambda b: (centred(b).T @ centred(b)).ravel()).reshape(width, width)
        found = np.linalg.eigh(second)[1][:, ::-1][:, :k]
    else:
        size = min(n, width, k + MORE)
        q, last = np.linalg.qr(np.random.default_rng(SEED).normal(size=(width, size)))[0], None
        for _ in range(ROUNDS):
            w = summed(rows, lambda b, q=q: (centred(b).T @ (centred(b) @ q)).ravel()).reshape(width, size)
            values, turn = np.linalg.eigh((q.T @ w + w.T @ q) / 2)
            found, values = (q @ turn)[:, ::-1][:, :k], values[::-1][:k]
            if last is not None and np.allclose(values, last, rtol=STILL, atol=0):
                break
            q, last = np.linalg.qr(w)[0], values
    return mean, found * np.where(found[np.abs(found).argmax(0), np.arange(k)] < 0, -1.0, 1.0)


def pca_sweep(df: DataFrame, ids: list[str], sizes: list[int], vector: str = "embedding") -> DataFrame:
    """Components fitted once at the largest valid size (<= rows and width); (ids, size, scores) are slices of it.

    The sign of a component is that its largest entry is positive. Vectors have one width; rows without one are left out.
    """
    rows = scratch(df.filter(F.col(vector).isNotNull()).select(F.transform(vector, lambda x: x.cast("double")).alias("_v"), *ids), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_v")).alias("w")).first()
    n, width = size.n, size.w or 0
    valid = sorted({k for k in sizes if 1 <= k <= min(n, width)})
    if not valid:
        raise ValueError("no valid number of components")
    mean, found = components(rows.select("_v"), width, valid[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                c = b.slice(at, 1024)
                scores = (vectors(c.column(0)) - mean) @ found
                yield pa.RecordBatch.from_arrays([*c.columns[1:], pa.array(list(scores), pa.list_(pa.float64()))], names=[*c.schema.names[1:], "_s"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*ids).schema)
    scores = rows.mapInArrow(run, f"{kinds}, _s array<double>")
    return scores.withColumn("size", F.explode(F.array(*[F.lit(k) for k in valid]))).select(*ids, "size", F.slice("_s", F.lit(1), F.col("size")).alias("scores"))


def availability(n_rows: int, n_features: int, sizes: list[int]) -> list[dict]:
    """Each requested size and whether it can be fitted."""
    return [{"size": k, "available": 1 <= k <= min(n_rows, n_features)} for k in sizes]
