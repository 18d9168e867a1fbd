"""Decoding evaluation and result tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metadata import number
from ..session import scratch
from .ranks import hash_bucket, ranked, same_keys


def target(df: DataFrame, column: str, mapping: dict[str, int] | None = None, positive: str | None = None,
    order: list[str] | None = None) -> DataFrame:
    """Add y by a label map, a positive class (1, others 0) or the place in a class order; rows without y are dropped."""
    c = F.col(column).cast("string")
    if mapping is not None:
        y = F.try_element_at(F.create_map(*[F.lit(x) for k, v in mapping.items() for x in (str(k), v)]), c)
    elif positive is not None:
        y = F.when(c.isNotNull(), (c == positive).cast("int"))
    elif order is not None:
        y = F.nullif(F.array_position(F.array(*[F.lit(o) for o in order]), c), F.lit(0).cast("long")) - 1
    else:
        raise ValueError("give a mapping, a positive class or a class order")
    return df.withColumn("y", y.cast("int")).filter("y is not null")


def safe_folds(df: DataFrame, requested: int, label: str = "y", group: str = "group") -> DataFrame:
    """The requested folds, but no more than the groups of the scarcest class."""
    n = df.groupBy(label).agg(F.countDistinct(group).alias("g")).agg(F.min("g").alias("g"))
    return n.select(F.least(F.lit(requested), F.col("g")).cast("int").alias("folds"))


def validity(df: DataFrame, unit: list[str], label: str = "y") -> DataFrame:
    """(unit, valid, reason): rows, two classes or more, two rows or more in each."""
    c = df.groupBy(*unit, label).agg(F.count(F.lit(1)).alias("n")).groupBy(*unit).agg(F.count(label).alias("classes"), F.min("n").alias("least"))
    reason = F.when(F.col("classes") < 2, "one_class").when(F.col("least") < 2, "class_too_small")
    return c.select(*unit, reason.isNull().alias("valid"), reason.alias("reason"))


def dealt_groups(df: DataFrame, k: int, keys: list[str], label: str, group: str, seed: int) -> DataFrame:
    """(keys, group, label, rows, fold): each group's place among k folds, within keys.

    Groups take the label that most of their rows have. Within a label they are dealt in turn from the largest to the
    smallest, those of equal size by a seeded hash, and every second label is dealt backwards; so the rows of a label, and
    with two labels those of a fold, differ from fold to fold by no more than one largest group.
    """
    counted = "_rows" in df.columns
    n = df if counted else df.groupBy(*keys, group, label).agg(F.count(F.lit(1)).alias("n"))
    g = n if counted else n.groupBy(*keys, group).agg(F.max(F.struct("n", label)).alias("m"), F.sum("n").alias("_rows")).select(*keys, group, F.col(f"m.{label}").alias(label), "_rows")
    g = g.withColumn("_h", F.md5(F.concat_ws(":", F.col(group).cast("string"), F.lit(str(seed)))))
    bucket = F.struct((-F.col("_rows")).alias("a"), hash_bucket(F.col("_h")).alias("b"))
    at = ranked(g, [*keys, label], bucket, [F.col("_rows").desc(), F.col("_h"), F.col(group)], "_at")
    # Labels are few: their order is a small table.
    turn = g.select(label).distinct().select(F.col(label).alias("_y"), ((F.row_number().over(Window.orderBy(label)) - 1) % 2 == 1).alias("_back"))
    at = at.join(turn, F.col(label).eqNullSafe(F.col("_y")))
    fold = F.when(F.col("_back"), k - 1 - F.col("_at") % k).otherwise(F.col("_at") % k).cast("int")
    return at.select(*keys, group, label, "_rows", fold.alias("fold"))


def group_folds(df: DataFrame, k: int, label: str = "y", group: str = "group", seed: int = 0) -> DataFrame:
    """T4: add fold 0..k-1; no group is in two folds. See `dealt_groups`; rows without a group are left out."""
    return df.join(dealt_groups(df, k, [], label, group, seed).select(group, "fold"), group)


def unit_grid(modes: DataFrame, models: DataFrame, allowed: DataFrame) -> DataFrame:
    """T5: the units of (mode, unit) x (model) that allowed(mode, model) lists."""
    return modes.join(F.broadcast(allowed), "mode").join(F.broadcast(models), "model")


def fold_predictions(df: DataFrame, features: str, kind: str = "logistic", label: str = "y", **settings) -> DataFrame:
    """Out-of-fold (ids, fold, y, prediction, probability): scaling and fitting see the other folds only; balanced class weights.

    A loop over the few folds, each a distributed fit over one written table.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("_x", array_to_vector(F.transform(features, lambda v: v.cast("double")))).withColumn("_y", F.col(label).cast("double"))
    rows = scratch(rows.withColumn("_x", vector_to_array("_x")), "folds").withColumn("_x", array_to_vector("_x"))
    folds = sorted(r.fold for r in rows.select("fold").distinct().collect())
    out = None
    for f in folds:
        train = rows.filter(F.col("fold") != f)
        n = {r._y: r["count"] for r in train.groupBy("_y").count().collect()}
        weight = F.lit(1.0)
        for y, c in n.items():
            weight = F.when(F.col("_y") == y, sum(n.values()) / (len(n) * c)).otherwise(weight)
        common = {"featuresCol": "_z", "labelCol": "_y", "weightCol": "_w", "predictionCol": "prediction", "probabilityCol": "_p"}
        model = LogisticRegression(**common,
            **{"elasticNetParam": 0.5, "regParam": 0.01, "maxIter": 50, **settings}) if kind == "logistic" else RandomForestClassifier(**common,
                **{"numTrees": 50, "seed": 0, **settings})
        fitted = Pipeline(stages=[StandardScaler(inputCol="_x", outputCol="_z", withMean=True), model]).fit(train.withColumn("_w", weight))
        got = fitted.transform(rows.filter(F.col("fold") == f)).select(*[c for c in df.columns if c != features], "prediction",
            F.try_element_at(vector_to_array("_p"), F.lit(2)).alias("probability"))
        out = got if out is None else out.unionByName(got)
    return out


def fold_metrics(df: DataFrame, unit: list[str], label: str = "y") -> DataFrame:
    """Accuracy, balanced accuracy, precision, recall, f1 and rank AUC of binary predictions by (unit, fold)."""
    keys = [*unit, "fold"]
    y, p = F.col(label) == 1, F.col("prediction") == 1
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    # Area: for each score, its positives times the negatives below it and half of those beside it. Scores are summed
    # by distinct value, and run up within buckets of scores and then over the buckets.
    by_score = df.groupBy(*keys, "probability").agg(F.count_if(y).alias("_pos"), F.count_if(~y).alias("_neg"))
    by_score = by_score.withColumn("_b", F.floor(F.coalesce("probability", F.lit(-1.0)) * BUCKETS))
    below = Window.partitionBy(*keys, "_b").orderBy("probability").rowsBetween(Window.unboundedPreceding, -1)
    parts = by_score.withColumn("_inner", F.coalesce(F.sum("_neg").over(below), F.lit(0)) + F.col("_neg") / 2.0)
    parts = parts.groupBy(*keys, "_b").agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"),
        F.sum(F.col("_pos") * F.col("_inner")).alias("_area"))
    lower = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_area", F.col("_area") + F.col("_pos") * F.coalesce(F.sum("_neg").over(lower), F.lit(0)))
    area = parts.groupBy(*named).agg(F.sum("_area").alias("_s"))
    c = df.groupBy(*keys).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"))
    c = c.join(area, same_keys(keys))
    div = lambda a, b: F.when(b > 0, a / b)
    pos, neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    recall, special, precision = div(F.col("tp"), pos), div(F.col("tn"), neg), F.coalesce(div(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    return c.select(
        *keys, ((F.col("tp") + F.col("tn")) / (pos + neg)).alias("accuracy"),
            (F.coalesce((recall + special) / 2, recall, special)).alias("balanced_accuracy"), precision.alias("precision"),
                F.coalesce(recall, F.lit(0.0)).alias("recall"),
        F.coalesce(div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"),
            div(F.col("_s"), pos * neg).alias("roc_auc"))


BUCKETS = 4096
METRICS = ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "roc_auc"]


def metric_summary(folds: DataFrame, unit: list[str]) -> DataFrame:
    """Mean and population sd over folds."""
    return folds.groupBy(*unit).agg(*[f(m).alias(f"{m}_{n}") for m in METRICS for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def chance_p(df: DataFrame, hits: str, n: str, chance: float = 0.5) -> DataFrame:
    """Add p, the binomial tail of at least `hits` of n at chance, by log-gamma-free recursion over the few outcomes."""
    lc = lambda k: F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), k)), F.lit(0.0), lambda a,
        i: a + F.log((F.col(n) - i + 1) / i))
    term = lambda k: F.exp(F.when(k > 0, lc(k)).otherwise(0.0) + k * math.log(chance) + (F.col(n) - k) * math.log(1 - chance))
    return df.withColumn("p", F.least(F.lit(1.0),
        F.aggregate(F.sequence(F.col(hits).cast("int"), F.col(n).cast("int")), F.lit(0.0), lambda a, k: a + term(k))))


def adjusted(df: DataFrame, p: str, by: list[str]) -> DataFrame:
    """Benjamini-Hochberg p_adjusted within a sweep."""
    w = Window.partitionBy(*by)
    r = df.withColumn("_m", F.count(p).over(w)).withColumn("_i", F.row_number().over(w.orderBy(F.col(p).asc_nulls_last())))
    raw = F.when(F.col(p).isNotNull(), F.col(p) * F.col("_m") / F.col("_i"))
    return r.withColumn("p_adjusted", F.least(F.lit(1.0),
        F.min(raw).over(w.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)))).withColumn("p_adjusted",
            F.when(F.col(p).isNotNull(), F.col("p_adjusted"))).drop("_m", "_i")


def allowed_units(spec: DataFrame) -> DataFrame:
    """condition_separation runs on the pooled scope only."""
    return spec.filter((F.col("eval_name") != "condition_separation") | (F.col("scope") == "pooled"))


def best_runs(fits: DataFrame, evals: DataFrame, by: list[str], eval_name: str, reducers: list[str], metric: str, ties: list[str]) -> DataFrame:
    """The best successful fit of each group by one evaluation's metric; then by the tie-breakers, then fit_id."""
    e = evals.filter((F.col("eval_name") == eval_name) & (F.col("status") == "success")).select("fit_id", number(F.col(metric)).alias("score"))
    j = fits.filter((F.col("status") == "success") & F.col("reducer").isin(reducers)).join(e, "fit_id").filter("score is not null")
    w = Window.partitionBy(*by).orderBy(F.desc("score"), *[F.col(t).desc_nulls_last() for t in ties], "fit_id")
    return j.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


PRIORITY = ("balanced_accuracy_mean", "roc_auc_mean", "accuracy_mean", "f1_mean")


def best_decoding(df: DataFrame, by: list[str], p: str = "p_adjusted", ids: tuple[str, ...] = ()) -> DataFrame:
    """The best row of each group by the first metric there is; equal ones by the smaller p."""
    have = [m for m in PRIORITY if m in df.columns]
    w = Window.partitionBy(*by).orderBy(F.col("primary_value").desc_nulls_last(), F.col(p).asc_nulls_last(), *ids)
    return df.withColumn("primary_value", F.coalesce(*[number(F.col(m)) for m in have])).withColumn("_r",
        F.row_number().over(w)).filter("_r = 1").drop("_r")


def model_parts(c: Column) -> tuple[Column, Column]:
    """Model and transform of `model_align-transform`; without the mark the transform is none."""
    has = c.contains("_align-")
    return F.when(has, F.substring_index(c, "_align-", 1)).otherwise(c), F.when(has, F.substring_index(c, "_align-", -1)).otherwise("none")


def leaderboard(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of several result families under one schema, with their family."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("family", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


DEFAULTS = {"transform": "none", "reduction_mode": "all_dimensions"}


def with_defaults(df: DataFrame, defaults: dict[str, str] = DEFAULTS) -> DataFrame:
    """Columns that older results lack, and NULLs in them, take their defaults."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def compatibility(df: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """Whether a group has one signature, and the fields that differ."""
    n = {f: F.countDistinct(F.coalesce(F.col(f).cast("string"), F.lit("\u0000"))) for f in fields}
    return df.groupBy(*by).agg(*[n[f].alias(f"_{f}") for f in fields]).select(
        *by, F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_{f}") > 1, F.lit(f)) for f in fields])),
            ",").alias("differing")).withColumn("comparable", F.col("differing") == "")


def deltas(df: DataFrame, by: list[str], kind: str, baseline: str, metric: str) -> DataFrame:
    """Each row's metric less the baseline row's of its group; several baselines count by their mean."""
    base = df.filter(F.col(kind) == baseline).groupBy(*by).agg(F.avg(metric).alias("baseline"))
    return df.join(base, by, "left").withColumn("delta", F.col(metric) - F.col("baseline"))


def failures(df: DataFrame, reason: str, top: int = 8) -> DataFrame:
    """The most frequent failure reasons."""
    return df.filter("status <> 'success'").groupBy(F.coalesce(reason,
        F.lit("unknown")).alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(top)


def resume(units: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Units in all, done and pending."""
    j = units.select(*keys).distinct().join(done.select(*keys).distinct().withColumn("_d", F.lit(1)), keys, "left")
    return j.agg(F.count(F.lit(1)).alias("units"), F.count("_d").alias("done"), (F.count(F.lit(1)) - F.count("_d")).alias("pending"))


def step_scores(df: DataFrame) -> DataFrame:
    """Score of a method on a subject: correlation up to .4, slope distortion .3, components .2, variance removed .1.
    A missing metric scores 0, missing component counts are 0."""
    corr, slope, var = number(F.col("mean_dss_ica_corr")), number(F.col("slope_distortion")), number(F.col("variance_removed_pct"))
    parts = F.coalesce("eog_components", F.lit(0)) + F.coalesce("ecg_components", F.lit(0)) + F.coalesce("emg_components", F.lit(0))
    score = (
        F.when(corr > 0.98, 0.4).when(corr > 0.95, 0.3).when(corr > 0.9, 0.15).otherwise(0.0) + F.when(slope < 0.15, 0.3).when(slope < 0.3,
            0.2).when(slope < 0.5, 0.1).otherwise(0.0)
        + F.when(parts <= 4, 0.2).when(parts <= 7, 0.15).when(parts <= 10, 0.1).otherwise(0.0) + F.when(var.between(5, 25),
            0.1).when((var < 5) | var.between(25, 40), 0.05).otherwise(0.0)
    )
    return df.withColumn("score", F.round(score, 6))


def winners(scored: DataFrame) -> DataFrame:
    """(subject, method) of the best score; ties by name."""
    w = Window.partitionBy("subject").orderBy(F.desc("score"), "method")
    return scored.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("subject", "method", "score")


def method_means(df: DataFrame, metrics: list[str]) -> DataFrame:
    """T22."""
    return df.groupBy("method").agg(F.count(F.lit(1)).alias("subjects"), *[F.avg(number(F.col(m))).alias(f"mean_{m}") for m in metrics])


def signal_change(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """By (key, channel) the correlation of two signals and the percent of variance removed, clipped to 0..100."""
    j = before.select(*key, "channel", "sample_idx",
        F.col("value").alias("a")).join(after.select(*key, "channel", "sample_idx", F.col("value").alias("b")), [*key, "channel", "sample_idx"])
    v = 100.0 * (1 - F.var_pop("b") / F.when(F.var_pop("a") > 0, F.var_pop("a")))
    return j.groupBy(*key, "channel").agg(F.corr("a", "b").alias("correlation"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), v)).alias("variance_removed_pct"))


def scope_stats(df: DataFrame, scope: str) -> DataFrame:
    """T24."""
    return df.groupBy(scope).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("subject").alias("subjects"),
        F.countDistinct("recording_id").alias("recordings"))


def run_variant(path: Column) -> Column:
    """The folder above a result file."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def provenance(df: DataFrame, column: str) -> DataFrame:
    """Total seconds of the timing map and the three component counts (missing is 0) of a JSON text."""
    p = F.from_json(column, "timing map<string,double>, components struct<eog:int,ecg:int,emg:int>")
    total = F.aggregate(F.coalesce(F.map_values("_p.timing"), F.array().cast("array<double>")), F.lit(0.0), lambda a,
        x: a + F.coalesce(x, F.lit(0.0)))
    return df.withColumn("_p", p).select(*df.columns, total.alias("total_seconds"),
        *[F.coalesce(f"_p.components.{c}", F.lit(0)).alias(f"{c}_components") for c in ("eog", "ecg", "emg")]).drop("_p")
