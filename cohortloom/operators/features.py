"""Feature tables: aggregation, merging and screening (F1-F22, P10-P14, J11). Long tables are (obs_id, ..., feature, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metadata import number
from ..session import scratch
from .ranks import hash_bucket, medians, ranked

ROBUST = 0.6745


def long(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """Wide to long; NaN becomes NULL. Unlike after an unpivot, rows stay known to lie where the wide ones do."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), number(F.col(f)).cast("double").alias("value")) for f in features])
    return df.select(*ids, F.explode(cells).alias("_c")).select(*ids, "_c.feature", "_c.value")


def schema(names: DataFrame) -> DataFrame:
    """(feature, family, subfamily, measure, sensor, grouped) of feature names `{family}_{subfamily}_{measure}_ch-{sensor}` or `_chgrp-{group}`."""
    body = F.regexp_replace("feature", r"_(ch|chgrp)-.*$", "")
    body = F.regexp_replace(body, "^(mean|median|iqr|mad|agg)_", "")
    part = F.split(body, "_")
    return names.select(
        "feature", part[0].alias("family"), F.concat_ws("_", part[0], F.try_element_at(part, F.lit(2))).alias("subfamily"), body.alias("measure"),
        F.nullif(F.regexp_extract("feature", r"_(?:ch|chgrp)-(.*)$", 1), F.lit("")).alias("sensor"),
            F.col("feature").contains("_chgrp-").alias("grouped"))


def families(names: list[str], enabled: list[str]) -> list[str]:
    """Names that hold an enabled family token."""
    return [n for n in names if any(t in n.split("_") for t in enabled)]


def prune(rows: DataFrame, most_missing: float, tolerance: float = 1e-12) -> DataFrame:
    """(feature) that is not missing too often and not constant; apply by a semi join."""
    s = rows.groupBy("feature").agg(F.avg(F.col("value").isNull().cast("int")).alias("missing"), F.stddev_pop("value").alias("sd"))
    return s.filter((F.col("missing") <= most_missing) & (F.coalesce("sd", F.lit(0.0)) > tolerance)).select("feature")


def purge(df: DataFrame, features: list[str], limit: float = 1e12) -> DataFrame:
    """Rows without a non-finite or extreme feature value."""
    bad = F.exists(F.array(*[F.col(f).cast("double") for f in features]), lambda x: F.isnan(x) | (F.abs(x) > limit))
    return df.filter(~F.coalesce(bad, F.lit(False)))


def finite_audit(rows: DataFrame, preview: int = 20) -> DataFrame:
    """One row: bad cells, rows and features, and the first features and rows by name."""
    bad = rows.filter("value is null or isnan(value)")
    top = lambda c: bad.select(F.col(c).cast("string").alias("x")).distinct().orderBy("x").limit(preview).agg(F.array_join(F.sort_array(F.collect_list("x")), ",").alias(f"{c}_preview"))
    sums = bad.agg(F.count(F.lit(1)).alias("bad_cells"), F.countDistinct("obs_id").alias("bad_rows"),
        F.countDistinct("feature").alias("bad_features"))
    return sums.crossJoin(top("feature")).crossJoin(top("obs_id"))


def select_classes(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """P10: rows of the listed classes."""
    return df.filter(F.col(column).isin(order))


def aggregate(rows: DataFrame, by: list[str], stats: tuple[str, ...] = ("mean", "median", "iqr", "mad")) -> DataFrame:
    """(by, feature, mean, median, iqr, mad, epoch_count); iqr by linear quartiles, mad about the median.

    The median is added to the rows by a window, so that rows that lie by one of `by` already are not shuffled again.
    """
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    found = [F.avg("value").alias("mean"), q.alias("_q"), F.count(F.lit(1)).alias("epoch_count")]
    if "mad" in stats:
        rows = rows.withColumn("_mid", F.median("value").over(Window.partitionBy(*by, "feature")))
        found.append(F.median(F.abs(F.col("value") - F.col("_mid"))).alias("mad"))
    s = rows.groupBy(*by, "feature").agg(*found).withColumn("median", F.col("_q")[1]).withColumn("iqr", F.col("_q")[2] - F.col("_q")[0])
    return s.select(*by, "feature", *stats, "epoch_count")


def widened(stats: DataFrame, by: list[str], features: list[str], names: tuple[str, ...]) -> DataFrame:
    """columns `{stat}_{feature}` from the long statistics, for a known list of features."""
    cells = [F.max(F.when(F.col("feature") == f, F.col(n))).alias(f"{n}_{f}") for f in features for n in names]
    return stats.groupBy(*by).agg(F.max("epoch_count").alias("epoch_count"), *cells)


def band_ratios(df: DataFrame, pairs: list[tuple[str, str, str]], floor: float = 1e-12) -> DataFrame:
    """columns name = numerator / denominator where the denominator passes the floor."""
    return df.withColumns({n: F.when(number(F.col(d)) > floor, number(F.col(a)) / number(F.col(d))) for n, a, d in pairs})


def pooled_channels(rows: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """mean over the sensors of each group; the feature's `_ch-<sensor>` becomes `_chgrp-<group>`."""
    table = rows.sparkSession.createDataFrame([(s, g) for g, ss in groups.items() for s in ss], "sensor string, grp string")
    j = rows.withColumn("sensor", F.regexp_extract("feature", "_ch-(.*)$", 1)).join(F.broadcast(table), "sensor")
    name = F.concat(F.regexp_replace("feature", "_ch-.*$", ""), F.lit("_chgrp-"), "grp")
    return j.groupBy("obs_id", name.alias("feature")).agg(F.avg("value").alias("value"))


def subject_means(df: DataFrame, by: list[str], features: list[str], constant: list[str]) -> DataFrame:
    """Means over recordings, first non-missing of constant columns (the least, so the result is stable)."""
    return df.groupBy(*by).agg(*[F.avg(number(F.col(f))).alias(f) for f in features], *[F.min(c).alias(c) for c in constant])


def shard_gate(columns: DataFrame) -> DataFrame:
    """(shard, consistent) of columns(shard, column): whether a shard has the columns that most shards have."""
    s = columns.groupBy("shard").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("column")), "\u0001"), 256).alias("shape"))
    top = s.groupBy("shape").agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "shape")).alias("m"))
    return s.crossJoin(F.broadcast(top)).select("shard", (F.col("shape") == F.col("m.shape")).alias("consistent"))


def shard_audit(files: DataFrame, expected: DataFrame, required: list[str]) -> DataFrame:
    """(shard, n_missing, missing, complete) for every expected shard against files(shard, file)."""
    need = expected.sparkSession.createDataFrame([(r,) for r in required], "file string")
    have = files.select("shard", "file").distinct().withColumn("_have", F.lit(True))
    grid = expected.select("shard").distinct().crossJoin(F.broadcast(need)).join(have, ["shard", "file"], "left")
    absent = F.sort_array(F.collect_list(F.when(F.col("_have").isNull(), F.col("file"))))
    return grid.groupBy("shard").agg(absent.alias("m")).select("shard", F.size("m").alias("n_missing"), F.array_join("m", ",").alias("missing"),
        (F.size("m") == 0).alias("complete"))


def reason_rollup(failures: DataFrame, keys: list[str], message: str, top: int = 15) -> DataFrame:
    """the most frequent (keys, first 80 characters of the message)."""
    return failures.groupBy(*keys, F.substring(message, 1, 80).alias("message")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys,
        "message").limit(top)


def manifest(df: DataFrame, columns: list[str]) -> DataFrame:
    """F8: rows and distinct values of each column."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.countDistinct(c).alias(f"n_{c}") for c in columns])


def feature_health(rows: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """by feature the missing rate, whether it is all missing, constant (sd within tolerance) or nearly so (ten times that)."""
    s = rows.groupBy("feature").agg(F.avg(F.col("value").isNull().cast("int")).alias("missing_rate"), F.stddev_pop("value").alias("sd"),
        F.count(F.lit(1)).alias("n"))
    return s.withColumns({"all_missing": F.col("missing_rate") == 1, "constant": F.coalesce(F.col("sd") <= tolerance, F.lit(False)),
        "near_constant": F.coalesce((F.col("sd") > tolerance) & (F.col("sd") <= 10 * tolerance), F.lit(False))})


def family_health(health: DataFrame, names: DataFrame) -> DataFrame:
    """by family the features, mean missing rate, and constant and all-missing features."""
    j = health.join(F.broadcast(names.select("feature", "family")), "feature")
    return j.groupBy("family").agg(F.count(F.lit(1)).alias("features"), F.avg("missing_rate").alias("missing_rate"),
        F.count_if("constant").alias("constant"), F.count_if("all_missing").alias("all_missing"))


def distribution(rows: DataFrame) -> DataFrame:
    """mean, sample sd, minimum, median and maximum of each feature."""
    rows = rows.filter("value is not null")
    plain = rows.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("low"),
        F.max("value").alias("high"))
    return plain.join(medians(rows, ["feature"], "value", "median"), "feature")


def family_conditions(rows: DataFrame, names: DataFrame, failures: DataFrame) -> DataFrame:
    """(family, condition, subjects, missing_rate, failures), 0 failures where none."""
    j = rows.join(F.broadcast(names.select("feature", "family")), "feature").groupBy("family",
        "condition").agg(F.countDistinct("subject").alias("subjects"), F.avg(F.col("value").isNull().cast("int")).alias("missing_rate"))
    n = failures.groupBy("family", "condition").agg(F.count(F.lit(1)).alias("failures"))
    return j.join(n, ["family", "condition"], "left").na.fill(0, ["failures"])


def flags(metrics: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """(scope, code, value, threshold, severity) of metrics(scope, metrics...) against (warn, fail) limits."""
    wide = metrics.select("scope", *[number(F.col(m)).alias(m) for m in limits]).unpivot(["scope"], list(limits), "code", "value")
    t = metrics.sparkSession.createDataFrame([(m, float(a), float(b)) for m, (a, b) in limits.items()], "code string, warn double, fail double")
    j = wide.join(F.broadcast(t), "code")
    severity = F.when(F.col("value") > F.col("fail"), "fail").when(F.col("value") > F.col("warn"), "warn").otherwise("pass")
    return j.select("scope", "code", "value", F.when(F.col("value") > F.col("fail"), F.col("fail")).otherwise(F.col("warn")).alias("threshold"),
        severity.alias("severity"))


def robust_z(rows: DataFrame, within: list[str]) -> DataFrame:
    """Add z = 0.6745 (value - median) / MAD by (within, feature); NULL where MAD is 0 or the value is missing.

    Without `within` a group is a whole feature, so medians are selected from counts; else groups are a subject's.
    """
    keys = [*within, "feature"]
    if not within:
        off = rows.join(medians(rows, keys, "value", "_mid"), keys, "left").withColumn("_off", F.abs(F.col("value") - F.col("_mid")))
        both = off.join(medians(off, keys, "_off", "_mad"), keys, "left")
    else:
        w = Window.partitionBy(*keys)  # both medians over one layout of the rows
        both = rows.withColumn("_mid", F.median("value").over(w)).withColumn("_off", F.abs(F.col("value") - F.col("_mid"))).withColumn("_mad",
            F.median("_off").over(w))
    return both.withColumn("z", F.when(F.col("_mad") > 0, ROBUST * (F.col("value") - F.col("_mid")) / F.col("_mad"))).drop("_mid", "_mad", "_off")


def outlier_fractions(rows: DataFrame, within: list[str], obs: list[str], groups: DataFrame, z: float) -> DataFrame:
    """(obs, grp, fraction): the fraction of an observation's features in each group beyond z; groups: (feature, grp)."""
    j = robust_z(rows, within).join(F.broadcast(groups), "feature")
    return j.groupBy(*obs, "grp").agg((F.count_if(F.abs("z") > z) / F.count(F.lit(1))).alias("fraction"))


def kept_epochs(rows: DataFrame, groups: DataFrame, z: float = 5.0, most: float = 0.5, least: int = 2) -> DataFrame:
    """(subject, obs_id) whose fraction passes the limit in no group; a subject left with fewer than `least` keeps all."""
    f = outlier_fractions(rows, ["subject"], ["subject", "obs_id"], groups, z)
    ok = f.groupBy("subject", "obs_id").agg((F.max("fraction") <= most).alias("ok"))
    n = F.count_if("ok").over(Window.partitionBy("subject"))
    return ok.withColumn("_n", n).filter(F.col("ok") | (F.col("_n") < least)).select("subject", "obs_id")


def outlier_masks(rows: DataFrame, groups: DataFrame, z: float = 5.0, most: float = 0.5) -> DataFrame:
    """(grp, obs_id) to leave out of a group: epochs of outlying subjects (by subject means), and outlying epochs of
    subjects with several. An outlier in one group stays for the others. `rows` are read three times, so that their layout by
    subject, if they have one, serves each time; write them first if they are costly."""
    mean = scratch(rows.groupBy("subject", "feature").agg(F.avg("value").alias("value")), "means")
    bad_subject = outlier_fractions(mean, [], ["subject"], groups, z).filter(F.col("fraction") > most).select("subject", "grp")
    own = rows.select("subject", "obs_id").distinct()
    w = Window.partitionBy("subject")
    several = F.min("obs_id").over(w) != F.max("obs_id").over(w)
    epoch = outlier_fractions(rows, ["subject"], ["subject", "obs_id"], groups, z).withColumn("_several", several).filter(F.col("_several")
        & (F.col("fraction") > most)).select("grp", "obs_id")
    return own.join(bad_subject, "subject").select("grp", "obs_id").union(epoch).distinct()


def without_bad(rows: DataFrame, groups: DataFrame, bad: DataFrame) -> DataFrame:
    """Long rows (with grp) without the observations flagged for their group."""
    return rows.join(F.broadcast(groups), "feature").join(bad, ["grp", "obs_id"], "left_anti")


def subject_burden(rows: DataFrame, z: float = 5.0) -> DataFrame:
    """F16: (subject, burden): fraction of a subject's mean features that are outliers among subjects."""
    mean = scratch(rows.groupBy("subject", "feature").agg(F.avg("value").alias("value")), "means")
    return robust_z(mean, []).groupBy("subject").agg((F.count_if(F.abs("z") > z) / F.count(F.lit(1))).alias("burden"))


def units(names: DataFrame) -> DataFrame:
    """(mode, unit, feature): the features of every analysis unit, from the feature schema."""
    f = lambda *cs: F.concat_ws("|", *[F.col(c) for c in cs])
    modes = {
        "flat": F.lit("all"), "sensor": f("sensor"), "family": f("family"), "subfamily": f("subfamily"),
            "sensor_within_family": f("family", "sensor"), "sensor_within_subfamily": f("subfamily", "sensor"),
        "feature": f("feature"), "feature_within_family": f("family", "feature"), "descriptor": f("measure"),
            "descriptor_sensor": f("measure", "sensor"),
    }
    needs = {"sensor", "sensor_within_family", "sensor_within_subfamily", "descriptor_sensor"}
    each = F.array(*[F.when(F.col("sensor").isNotNull() | F.lit(m not in needs), F.struct(F.lit(m).alias("mode"), k.alias("unit"))) for m,
        k in modes.items()])
    return names.select("feature", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("u")).select("u.mode", "u.unit", "feature")


def pooled_conditions(rows: DataFrame) -> DataFrame:
    """rows of the features that every condition has; more than one grouping level is an error."""
    n = rows.agg(F.countDistinct("condition").alias("_n"), F.countDistinct(F.col("feature").contains("_chgrp-")).alias("_levels"))
    common = rows.groupBy("feature").agg(F.countDistinct("condition").alias("_c")).crossJoin(F.broadcast(n))
    ok = common.filter(F.col("_c") == F.when(F.col("_levels") > 1,
        F.raise_error(F.lit("mixed grouping levels")).cast("long")).otherwise(F.col("_n"))).select("feature")
    return rows.join(F.broadcast(ok), "feature", "left_semi")


def balanced(df: DataFrame, label: str, ids: list[str], seed: int = 0) -> DataFrame:
    """as many rows of each class as the smallest has, those of least seeded hash; equal ids are interchangeable."""
    rows = df.filter(F.col(label).isNotNull()).withColumn("_h", F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in ids], F.lit(str(seed)))))
    least = rows.groupBy(label).agg(F.count(F.lit(1)).alias("c")).agg(F.min("c").alias("_m"))
    dealt = ranked(rows, [label], hash_bucket(F.col("_h")), [F.col("_h"), *[F.col(c) for c in ids]], "_rank")
    return dealt.crossJoin(F.broadcast(least)).filter("_rank < _m").drop("_rank", "_m", "_h")


def time_features(signal: DataFrame, keys: list[str]) -> DataFrame:
    """activity, mobility, complexity, zero crossings, kurtosis (population excess), Petrosian dimension and order-3
    permutation entropy of each epoch and channel, by lags over sample_idx."""
    w = Window.partitionBy(*keys).orderBy("sample_idx")
    s = signal.withColumn("d1", F.col("value") - F.lag("value").over(w)).withColumn("a", F.lag("value", 2).over(w)).withColumn("b",
        F.lag("value").over(w))
    s = s.withColumn("d2", F.col("d1") - F.lag("d1").over(w))
    sign = lambda c: (F.col(c) >= 0).cast("int")
    s = s.withColumn("cross", (sign("value") != sign("b")).cast("int")).withColumn("turn", (sign("d1") != F.lag(sign("d1")).over(w)).cast("int"))
    order = lambda x, y: F.when(F.col(x) <= F.col(y), 1).otherwise(0)
    s = s.withColumn("pattern", F.when(F.col("a").isNotNull(), order("a", "b") * 4 + order("b", "value") * 2 + order("a", "value")))
    v, v1, v2 = F.var_pop("value"), F.var_pop("d1"), F.var_pop("d2")
    n, turns = F.count(F.lit(1)).cast("double"), F.coalesce(F.sum("turn"), F.lit(0))
    base = s.groupBy(*keys).agg(
        v.alias("activity"), F.sqrt(v1 / F.when(v > 0, v)).alias("mobility"),
            F.sqrt(v2 / F.when(v1 > 0, v1) * (v / F.when(v1 > 0, v1))).alias("complexity"),
        F.coalesce(F.sum("cross"), F.lit(0)).alias("zero_crossings"), F.kurtosis("value").alias("kurtosis"),
            F.try_divide(F.log10(n), F.log10(n) + F.log10(n / (n + 0.4 * turns))).alias("petrosian_fd"))
    p = s.filter("pattern is not null").groupBy(*keys, "pattern").agg(F.count(F.lit(1)).alias("c"))
    share = F.col("c") / F.sum("c").over(Window.partitionBy(*keys))
    entropy = p.withColumn("p", share).groupBy(*keys).agg((F.lit(0.0) - F.sum(F.col("p") * F.log2("p")) / F.log2(F.lit(6.0))).alias("permutation_entropy"))
    return base.join(entropy, keys, "left")


def band_features(powers: DataFrame, keys: list[str]) -> DataFrame:
    """absolute, log and relative power of (keys, band, band_power)."""
    total = F.sum("band_power").over(Window.partitionBy(*keys))
    p = F.col("band_power")
    return powers.withColumn("log_power", F.when(p > 0, F.log10(p))).withColumn("rel_power", p / F.when(total > 0, total))


def vector_means(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Element-wise means of vectors."""
    e = df.select(*by, F.posexplode(vector).alias("i", "x")).groupBy(*by, "i").agg(F.avg("x").alias("x"))
    return e.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vector))


def missing_failures(failures: DataFrame, ids: DataFrame) -> DataFrame:
    """Failures with their subject by obs_id."""
    one = ids.select("obs_id", "subject").dropDuplicates(["obs_id"])
    return failures.join(one, "obs_id", "left")


def condition(c: Column) -> Column:
    """Condition names in one form: trimmed lower case, empty is NULL."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))
