"""Signal-quality statistics and their rollup (Q1-Q22). Missing and NaN values are NULL and skipped."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metadata import number
from ..session import scratch
from .ranks import medians

#: Bands in Hz and limits of the usability flag.
BANDS = {"delta": (1.0, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 12.0), "beta": (12.0, 30.0), "gamma": (30.0, 45.0)}
STATUS_ORDER = {"usable": 0, "borderline": 1, "unusable": 2}


def peak_to_peak(signal: DataFrame, key: tuple[str, ...] = ("recording_id",), channel: str = "channel", value: str = "value") -> DataFrame:
    """Q1: per channel the range of values; over channels mean, median, population sd, minimum and maximum."""
    each = signal.groupBy(*key, channel).agg((F.max(value) - F.min(value)).alias("ptp"))
    return each.groupBy(*key).agg(F.avg("ptp").alias("ptp_mean"), F.median("ptp").alias("ptp_median"), F.stddev_pop("ptp").alias("ptp_std"),
        F.min("ptp").alias("ptp_min"), F.max("ptp").alias("ptp_max"))


def bad_channels(signal: DataFrame, key: tuple[str, ...] = ("recording_id",), channel: str = "channel", value: str = "value", low: float = 0.01,
    high: float = 0.99) -> DataFrame:
    """Q2: channels whose variance lies below the 1st (flat) or above the 99th (noisy) percentile of the recording's channels."""
    each = signal.groupBy(*key, channel).agg(F.var_pop(value).alias("v"))
    bounds = each.groupBy(*key).agg(F.percentile("v", F.array(F.lit(low), F.lit(high))).alias("q"))
    j = each.join(bounds, list(key))
    flat, noisy = F.col("v") < F.col("q")[0], F.col("v") > F.col("q")[1]
    names = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(c, F.col(channel).cast("string")))), ",")
    return j.groupBy(*key).agg(F.count_if(flat).alias("n_flat"), F.count_if(noisy).alias("n_noisy"), names(flat).alias("flat"),
        names(noisy).alias("noisy"), (100.0 * F.count_if(flat | noisy) / F.count(F.lit(1))).alias("pct_bad"))


def _trapezoid(psd: DataFrame, keys: list[str], freq: str, power: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(freq)
    return psd.withColumn("_area", (F.lead(freq).over(w) - F.col(freq)) * (F.lead(power).over(w) + F.col(power)) / 2)


def band_power(psd: DataFrame, bands: dict[str, tuple[float, float]] = BANDS, keys: tuple[str, ...] = ("recording_id", "channel"),
    freq: str = "freq", power: str = "power", scale: float = 1e12) -> DataFrame:
    """Q3: (keys, band, power): trapezoid over the bins inside each band (both ends included), scaled to square microvolts."""
    table = psd.sparkSession.createDataFrame([(b, lo, hi) for b, (lo, hi) in bands.items()], "band string, lo double, hi double")
    inside = psd.join(F.broadcast(table), (F.col(freq) >= F.col("lo")) & (F.col(freq) <= F.col("hi")))
    area = _trapezoid(inside, [*keys, "band"], freq, power)
    return area.groupBy(*keys, "band").agg((F.coalesce(F.sum("_area"), F.lit(0.0)) * scale).alias("band_power"))


def alpha_peak(psd: DataFrame, lo: float = 8.0, hi: float = 12.0, key: str = "recording_id") -> DataFrame:
    """Q3: the frequency of the largest channel mean in the alpha band; of equal ones the lowest."""
    mean = psd.filter((F.col("freq") >= lo) & (F.col("freq") <= hi)).groupBy(key, "freq").agg(F.avg("power").alias("p"))
    return mean.groupBy(key).agg(F.max(F.struct("p", (-F.col("freq")).alias("f"))).alias("m")).select(key, (-F.col("m.f")).alias("alpha_peak_hz"))


def line_noise(psd: DataFrame, f0: float = 60.0, key: tuple[str, ...] = ("recording_id",), eps: float = 1e-20) -> DataFrame:
    """Q4: mean power within 1 Hz of f0 over the mean in the 2 Hz flanks beside it."""
    away = F.abs(F.col("freq") - f0)
    inner, flank = F.avg(F.when(away <= 1, F.col("power"))), F.avg(F.when((away > 1) & (away <= 3), F.col("power")))
    return psd.groupBy(*key).agg((inner / (flank + eps)).alias("line_noise_ratio"))


def high_low(psd: DataFrame, key: tuple[str, ...] = ("recording_id",), keys: tuple[str, ...] = ("recording_id", "channel")) -> DataFrame:
    """Q5: power in 30-100 Hz over power in 1-30 Hz."""
    both = band_power(psd, {"high": (30.0, 100.0), "low": (1.0, 30.0)}, keys)
    high, low = F.sum(F.when(F.col("band") == "high", F.col("band_power"))), F.sum(F.when(F.col("band") == "low", F.col("band_power")))
    return both.groupBy(*key).agg((high / F.when(low > 0, low)).alias("hf_lf_ratio"))


def spectral_distance(a: DataFrame, b: DataFrame, key: tuple[str, ...] = ("recording_id", "channel"), lo: float = 0.0, hi: float = 1e9) -> DataFrame:
    """Q6: root mean square of the difference of 10 log10 power over common frequencies in [lo, hi]."""
    j = a.filter(F.col("freq").between(lo, hi)).join(b.select(*key, "freq", F.col("power").alias("_other")), [*key, "freq"])
    return j.groupBy(*key).agg(F.sqrt(F.avg(F.pow(10 * F.log10("power") - 10 * F.log10("_other"), 2))).alias("log_spectral_distance"))


def welch(signal: DataFrame, sfreq: float, segment: int = 256, overlap: float = 0.5,
    keys: tuple[str, ...] = ("recording_id", "channel")) -> DataFrame:
    """Q7: power spectral density (keys, freq, power) by Welch's method with a Hann window.

    signal(keys, sample_idx, value): each sample is sent to the segments that hold it, and a task works on one segment
    at a time; the segments' periodograms are averaged by Spark, so no whole recording is gathered.
    """
    import numpy as np
    import pandas as pd

    step = int(segment * (1 - overlap))
    back = -(-segment // step) - 1
    at = F.floor(F.col("sample_idx") / step)
    rows = signal.withColumn("w", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), at - back),
        at))).filter(F.col("sample_idx") < F.col("w") * step + segment)
    parts = rows.groupBy(*keys, "w").agg(F.array_sort(F.collect_list(F.struct("sample_idx",
        "value"))).alias("s")).filter(F.size("s") == segment).select(*keys, F.col("s.value").alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hann = np.hanning(segment + 1)[:-1]
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["v"].to_numpy())
            p = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * hann, axis=1)) ** 2 / (sfreq * (hann**2).sum())
            p[:, 1 : None if segment % 2 else -1] *= 2
            yield b[list(keys)].assign(p=list(p))

    kinds = ", ".join(f"{k} {t}" for k, t in signal.dtypes if k in keys)
    spectra = parts.mapInPandas(run, f"{kinds}, p array<double>")
    return spectra.select(*keys, F.posexplode("p").alias("bin", "power")).groupBy(*keys, "bin").agg(F.avg("power").alias("power")).select(*keys,
        (F.col("bin") * sfreq / segment).alias("freq"), "power")


def segment_flag(df: DataFrame) -> DataFrame:
    """Q8: flag and `;`-joined reasons of hf_lf_ratio, aperiodic_slope and pct_bad_channels."""
    reasons = F.concat_ws(
        ";", F.when(F.col("hf_lf_ratio") > 0.5, "high_hf_lf_ratio"),
            F.when((F.col("aperiodic_slope") < 0.5) | (F.col("aperiodic_slope") > 3), "atypical_slope"), F.when(F.col("pct_bad_channels") > 30, "many_bad_channels"))
    return df.withColumn("flag_reasons", reasons).withColumn("flagged", reasons != "")


#: Limits of the usability flag.
LIMITS = {"n_bad_unusable": 7, "n_bad_borderline": 4, "amplitude_max_uv": 800.0, "line_noise_ratio": 5.0, "hf_lf_ratio": 0.5,
    "duration_retention_pct": 50.0, "condition_coverage_retention_pct": 80.0}


def usability(df: DataFrame, retention: bool = False, limits: dict[str, float] = LIMITS) -> DataFrame:
    """Q9: usable, borderline or unusable, with `;`-joined reasons. Missing metrics give no reason.

    Columns n_flat_channels, n_noisy_channels, amplitude_max_uv, line_noise_ratio, hf_lf_ratio; with `retention` (stages
    after cleaning) also duration_retention_pct and condition_coverage_retention_pct.
    """
    bad = F.coalesce("n_flat_channels", F.lit(0)) + F.coalesce("n_noisy_channels", F.lit(0))
    above = lambda c: F.coalesce(number(F.col(c)) > limits[c], F.lit(False))
    below = lambda c: F.coalesce(number(F.col(c)) < limits[c], F.lit(False))
    many, loud = bad >= limits["n_bad_unusable"], above("amplitude_max_uv")
    notes = [F.when(many, "too_many_bad_channels").when(bad >= limits["n_bad_borderline"], "many_bad_channels"),
        F.when(loud, "amplitude_above_threshold"), F.when(above("line_noise_ratio"), "line_noise_residual"), F.when(above("hf_lf_ratio"), "high_hf_ratio")]
    unusable = many | loud
    if retention:
        short = below("duration_retention_pct")
        notes += [F.when(short, "low_duration_retention"), F.when(below("condition_coverage_retention_pct"), "low_condition_retention")]
        unusable = unusable | short
    reasons = F.concat_ws(";", *notes)
    return df.withColumn("reasons", reasons).withColumn("status",
        F.when(unusable, "unusable").when(F.col("reasons") != "", "borderline").otherwise("usable"))


def qc_score(count: Column, count_limit: float, others: list[tuple[Column, float]]) -> Column:
    """Q10: mean of capped ratios: the bad-channel count by its limit, the others by twice theirs; missing ones are skipped."""
    capped = lambda r: F.when(r.isNotNull(), F.least(F.lit(1.0), r))  # noqa: E731  least() alone would skip a NULL
    ratios = F.array_compact(F.array(capped(number(count) / count_limit), *[capped(number(c) / (2.0 * limit)) for c, limit in others]))
    return F.when(F.size(ratios) > 0, F.aggregate(ratios, F.lit(0.0), lambda a, x: a + x) / F.size(ratios))


def rollup(df: DataFrame, by: list[str], weight: str, means: list[str], maxima: list[str], status: str, reasons: str, unknown: int = 0) -> DataFrame:
    """Q11: duration-weighted means, maxima, the worst status and the sorted union of reasons. `unknown` ranks other statuses."""
    w = F.when(number(F.col(weight)) > 0, number(F.col(weight)))
    rank = F.when(F.lit(False), 0)
    for s, i in STATUS_ORDER.items():
        rank = rank.when(F.col(status) == s, i)
    weighted = lambda c: (F.sum(number(F.col(c)) * w) / F.sum(F.when(number(F.col(c)).isNotNull(), w))).alias(c)
    words = F.array_remove(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split(F.coalesce(reasons, F.lit("")), ";"))))), "")
    return df.groupBy(*by).agg(*[weighted(c) for c in means], *[F.max(number(F.col(c))).alias(f"max_{c}") for c in maxima],
        F.max_by(status, F.struct(rank.otherwise(unknown), F.col(status))).alias(status), F.array_join(words, ";").alias(reasons))


def channel_maps(df: DataFrame, metric: str = "metric", values: str = "channel_values", weight: str = "weight") -> DataFrame:
    """Q12: (metric, channel, value): weighted means of finite values in arrays of (channel, value)."""
    e = df.select(metric, F.col(weight).alias("_w"), F.explode(values).alias("c")).select(metric, "_w", F.col("c.channel").alias("channel"),
        number(F.col("c.value")).alias("v")).filter("v is not null and _w > 0")
    return e.groupBy(metric, "channel").agg((F.sum(F.col("v") * F.col("_w")) / F.sum("_w")).alias("value"))


def top_channels(df: DataFrame, by: list[str], channel: str, value: str, k: int = 5) -> DataFrame:
    """Q13: the k channels of largest finite value of each group, with their place; ties by name."""
    w = Window.partitionBy(*by).orderBy(F.desc("_v"), channel)
    return df.withColumn("_v", number(F.col(value))).filter("_v is not null").withColumn("place",
        F.row_number().over(w)).filter(F.col("place") <= k).drop("_v")


def failure_rate(df: DataFrame, flat: str, noisy: str) -> DataFrame:
    """Q14: (channel, rate): flat plus noisy hits by the number of records; it can pass 1."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    hits = df.select(F.explode(F.concat(F.coalesce(flat, F.array().cast("array<string>")),
        F.coalesce(noisy, F.array().cast("array<string>")))).alias("channel")).groupBy("channel").agg(F.count(F.lit(1)).alias("hits"))
    return hits.crossJoin(F.broadcast(total)).select("channel", "hits", (F.col("hits") / F.col("_n")).alias("rate"))


def reactivity(df: DataFrame, by: list[str], state: str, power: str) -> DataFrame:
    """Q15: mean alpha power with eyes closed over eyes open, where the latter is above 0."""
    m = lambda s: F.avg(F.when(F.col(state) == s, number(F.col(power))))
    return df.groupBy(*by).agg(m("EC").alias("_c"), m("EO").alias("_o")).select(*by,
        F.when(F.col("_o") > 0, F.col("_c") / F.col("_o")).alias("alpha_reactivity"))


def deltas(df: DataFrame, other: DataFrame, keys: list[str], metrics: list[str], prefix: str) -> DataFrame:
    """Q16: each metric less that of another stage, as `<prefix>_<metric>`; without a match NULL."""
    o = other.select(*keys, *[F.col(m).alias(f"_{m}") for m in metrics])
    return df.join(o, keys, "left").withColumns({f"{prefix}_{m}": F.col(m) - F.col(f"_{m}") for m in metrics}).drop(*[f"_{m}" for m in metrics])


def robust_outliers(df: DataFrame, ids: list[str], metrics: list[str], limit: float = 3.5) -> DataFrame:
    """Q17: (ids, metric, value, z) where |0.6745 (value - median) / MAD| reaches limit; a metric with MAD 0 is skipped."""
    long = df.select(*ids, *[number(F.col(m)).alias(m) for m in metrics]).unpivot(ids, metrics, "metric", "value").filter("value is not null")
    long = scratch(long, "metrics")
    off = long.join(medians(long, ["metric"], "value", "mid"), "metric").withColumn("off", F.abs(F.col("value") - F.col("mid")))
    mad = medians(off, ["metric"], "off", "mad").filter("mad > 0")
    z = 0.6745 * (F.col("value") - F.col("mid")) / F.col("mad")
    return off.join(mad, "metric").withColumn("z", z).filter(F.abs("z") >= limit).select(*ids, "metric", "value",
        "z").orderBy(F.desc(F.abs("z")), "metric", *ids)


def reason_counts(df: DataFrame, reasons: str) -> DataFrame:
    """Q18: (reason, n) of `;`-joined reasons."""
    return df.select(F.explode(F.split(F.coalesce(reasons, F.lit("")),
        ";")).alias("reason")).select(F.trim("reason").alias("reason")).filter("reason <> ''").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def status_counts(df: DataFrame, status: str) -> DataFrame:
    """Q19: rows in all and by each known status."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == s).alias(s) for s in STATUS_ORDER])


def dataset_metrics(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Q20: (metric, mean, median, n) over non-missing values."""
    long = df.select(*[number(F.col(m)).alias(m) for m in metrics]).unpivot([], metrics, "metric", "value").filter("value is not null")
    plain = long.groupBy("metric").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return plain.join(medians(long, ["metric"], "value", "median"), "metric").select("metric", "mean", "median", "n")


def verdicts(values: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """Q21: (metric, value, limit, verdict) of one-row `values`; limits: metric -> (`max` or `min`, limit)."""
    long = values.select(*[number(F.col(m)).alias(m) for m in limits]).unpivot([], list(limits), "metric", "value")
    table = values.sparkSession.createDataFrame([(m, k, float(x)) for m, (k, x) in limits.items()], "metric string, kind string, limit double")
    ok = F.when(F.col("kind") == "max", F.col("value") <= F.col("limit")).otherwise(F.col("value") >= F.col("limit"))
    return long.join(F.broadcast(table), "metric").select("metric", "value", "limit",
        F.when(F.col("value").isNull(), "unknown").when(ok, "pass").otherwise("fail").alias("verdict"))


def run_means(df: DataFrame, by: list[str], metrics: list[str], usable: Column) -> DataFrame:
    """Q22: means over runs and the number of usable runs."""
    return df.groupBy(*by).agg(*[F.avg(number(F.col(m))).alias(m) for m in metrics], F.count_if(usable).alias("usable_runs"))
