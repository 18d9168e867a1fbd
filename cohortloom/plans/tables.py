"""Queries over lineitem, orders, supplier and embeddings as quality metrics, features, vectors and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embeddings as E
from ..operators import evaluation as T
from ..operators import features as X
from ..operators import joins as J
from ..operators import quality as Q
from ..operators.sums import in_table_order, steady_mean
from ..session import scratch
from .derive import query, read

#: Line items as a signal: supplier = recording, line number = channel.
SIG = "sig AS (SELECT l_suppkey AS recording_id, l_linenumber AS channel, l_extendedprice AS value FROM lineitem)"


def _signal(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_suppkey").alias("recording_id"), F.col("l_linenumber").alias("channel"), F.col("l_extendedprice").alias("value"))


def rounded(df, digits=6, skip=()):
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t in ("double", "float") and c not in skip})


@query("q01_peak_to_peak", f"WITH {SIG}, p AS (SELECT recording_id, max(value) - min(value) AS p FROM sig GROUP BY recording_id, channel) SELECT recording_id, round(avg(p), 6) AS ptp_mean, round(median(p), 6) AS ptp_median, round(stddev_pop(p), 6) AS ptp_std, round(min(p), 6) AS ptp_min, round(max(p), 6) AS ptp_max FROM p GROUP BY 1")
def _(spark, d):
    return rounded(Q.peak_to_peak(_signal(spark, d)))


@query("q02_bad_channels", f"""WITH {SIG}, v AS (SELECT recording_id, channel, var_pop(value) AS v FROM sig GROUP BY ALL), q AS (SELECT recording_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM v GROUP BY 1)
    SELECT recording_id, count(*) FILTER (WHERE v < lo) AS n_flat, count(*) FILTER (WHERE v > hi) AS n_noisy, coalesce(string_agg(channel::VARCHAR, ',' ORDER BY channel::VARCHAR) FILTER (WHERE v < lo), '') AS flat, coalesce(string_agg(channel::VARCHAR, ',' ORDER BY channel::VARCHAR) FILTER (WHERE v > hi), '') AS noisy, round(100.0::DOUBLE * count(*) FILTER (WHERE v < lo OR v > hi) / count(*), 6) AS pct_bad FROM v JOIN q USING (recording_id) GROUP BY 1""")
def _(spark, d):
    return rounded(Q.bad_channels(_signal(spark, d)))


#: A spectrum from line items: bins of 1 Hz by part, power from price.
PSD = "psd AS (SELECT l_suppkey AS recording_id, l_linenumber AS channel, (l_partkey % 100)::DOUBLE AS freq, avg(l_extendedprice) / 3141592653589::DOUBLE AS power FROM lineitem GROUP BY ALL)"


def _psd(spark, d):
    li = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("recording_id"), F.col("l_linenumber").alias("channel"), (F.col("l_partkey") % 100).cast("double").alias("freq"))
    return li.agg((F.avg("l_extendedprice") / F.lit(3141592653589.0)).alias("power"))


_bands = ", ".join(f"('{b}', {lo}::DOUBLE, {hi}::DOUBLE)" for b, (lo, hi) in Q.BANDS.items())
POWER = lambda bands, keys: f"(SELECT {keys}, band, coalesce(sum(area), 0) * 1e12 AS band_power FROM (SELECT *, (lead(freq) OVER w - freq) * (lead(power) OVER w + power) / 2 AS area FROM psd JOIN (VALUES {bands}) b(band, lo, hi) ON freq BETWEEN lo AND hi WINDOW w AS (PARTITION BY recording_id, channel, band ORDER BY freq)) GROUP BY {keys}, band)"


@query("q03_f22_band_power", f"""WITH {PSD}, p AS {POWER(_bands, 'recording_id, channel')} SELECT recording_id, channel, band, round(band_power, 1) AS band_power, round(CASE WHEN band_power > 0 THEN log10(band_power) END, 4) AS log_power, round(band_power / nullif(sum(band_power) OVER (PARTITION BY recording_id, channel), 0), 4) AS rel_power FROM p""")
def _(spark, d):
    out = X.band_features(Q.band_power(_psd(spark, d)), ["recording_id", "channel"])
    return rounded(out.withColumn("band_power", F.round("band_power", 1)), 4)


@query("q03_alpha_peak", f"WITH {PSD}, m AS (SELECT recording_id, freq, avg(power) AS p FROM psd WHERE freq BETWEEN 8 AND 12 GROUP BY ALL) SELECT recording_id, arg_max(freq, p) AS alpha_peak_hz FROM m GROUP BY 1")
def _(spark, d):
    return Q.alpha_peak(_psd(spark, d))


@query("q04_line_noise", f"WITH {PSD} SELECT recording_id, round(avg(power) FILTER (WHERE abs(freq - 60) <= 1) / (avg(power) FILTER (WHERE abs(freq - 60) > 1 AND abs(freq - 60) <= 3) + 1e-20), 6) AS line_noise_ratio FROM psd GROUP BY 1")
def _(spark, d):
    return rounded(Q.line_noise(_psd(spark, d)))


@query("q05_high_low", f"WITH {PSD}, p AS {POWER(chr(40) + chr(39) + 'high' + chr(39) + ', 30.0, 100.0), (' + chr(39) + 'low' + chr(39) + ', 1.0, 30.0)', 'recording_id, channel')} SELECT recording_id, round(sum(band_power) FILTER (WHERE band = 'high') / nullif(sum(band_power) FILTER (WHERE band = 'low'), 0), 6) AS hf_lf_ratio FROM p GROUP BY 1")
def _(spark, d):
    return rounded(Q.high_low(_psd(spark, d)))


@query("q06_spectral_distance", f"WITH {PSD} SELECT a.recording_id, a.channel, round(sqrt(avg(pow(10 * log10(a.power) - 10 * log10(b.power), 2))), 6) AS log_spectral_distance FROM psd a JOIN (SELECT recording_id + 1 AS recording_id, channel, freq, power FROM psd) b USING (recording_id, channel, freq) GROUP BY ALL")
def _(spark, d):
    p = _psd(spark, d)
    return rounded(Q.spectral_distance(p, p.withColumn("recording_id", F.col("recording_id") + 1)))


@query("q07_welch", """WITH s AS (SELECT l_suppkey AS recording_id, l_linenumber % 2 AS channel, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) % 64 AS i, avg(l_quantity) AS v FROM lineitem GROUP BY ALL),
    g AS (SELECT recording_id, channel, w, i - 8 * w AS j, v FROM s, (SELECT unnest(range(8)) AS w) WHERE i >= 8 * w AND i < 8 * w + 16),
    m AS (SELECT *, (v - avg(v) OVER p) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 16)) AS x, count(*) OVER p AS n FROM g WINDOW p AS (PARTITION BY recording_id, channel, w)),
    f AS (SELECT recording_id, channel, w, k, sum(x * cos(2 * pi() * k * j / 16)) AS a, sum(x * sin(2 * pi() * k * j / 16)) AS b FROM m, (SELECT unnest(range(9)) AS k) WHERE n = 16 GROUP BY ALL)
    SELECT recording_id, channel, k * 4.0::DOUBLE AS freq, round(avg((a * a + b * b) * CASE WHEN k BETWEEN 1 AND 7 THEN 2 ELSE 1 END / 384.0::DOUBLE), 6) AS power FROM f GROUP BY ALL""")
def _(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("recording_id"), (F.col("l_linenumber") % 2).alias("channel"), (F.datediff("l_shipdate", F.lit("1990-01-01")) % 64).cast("long").alias("sample_idx"), "l_quantity")
    signal = li.groupBy("recording_id", "channel", "sample_idx").agg(F.avg("l_quantity").alias("value"))
    return rounded(Q.welch(signal, 64.0, 16))


#: Quality metrics of a supplier's lines.
QC = """qc AS (SELECT l_suppkey AS recording_id, l_suppkey % 10 AS subject, CASE l_linenumber % 2 WHEN 0 THEN 'EO' ELSE 'EC' END AS state, count(*)::DOUBLE AS duration, (sum(l_linenumber) % 5)::INT AS n_flat_channels, (sum(l_orderkey) % 5)::INT AS n_noisy_channels, avg(l_extendedprice) / 60 AS amplitude_max_uv, avg(l_quantity) / 5 AS line_noise_ratio,
    avg(l_discount) * 10 AS hf_lf_ratio, avg(l_tax) * 60 AS aperiodic_slope, avg(l_quantity) AS pct_bad_channels FROM lineitem GROUP BY 1, 2, 3)"""
METRICS = ["amplitude_max_uv", "line_noise_ratio", "hf_lf_ratio", "aperiodic_slope", "pct_bad_channels"]


def _qc(spark, d):
    li = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("recording_id"), (F.col("l_suppkey") % 10).alias("subject"), F.when(F.col("l_linenumber") % 2 == 0, "EO").otherwise("EC").alias("state"))
    return li.agg(
        F.count(F.lit(1)).cast("double").alias("duration"), (F.sum("l_linenumber") % 5).cast("int").alias("n_flat_channels"), (F.sum("l_orderkey") % 5).cast("int").alias("n_noisy_channels"), (steady_mean("l_extendedprice") / 60).alias("amplitude_max_uv"),
        (steady_mean("l_quantity") / 5).alias("line_noise_ratio"), (steady_mean("l_discount") * 10).alias("hf_lf_ratio"), (steady_mean("l_tax") * 60).alias("aperiodic_slope"), steady_mean("l_quantity").alias("pct_bad_channels"))


@query("q08_segment_flag", f"WITH {QC} SELECT recording_id, state, concat_ws(';', CASE WHEN hf_lf_ratio > 0.5 THEN 'high_hf_lf_ratio' END, CASE WHEN aperiodic_slope < 0.5 OR aperiodic_slope > 3 THEN 'atypical_slope' END, CASE WHEN pct_bad_channels > 30 THEN 'many_bad_channels' END) AS flag_reasons, flag_reasons <> '' AS flagged FROM qc")
def _(spark, d):
    return Q.segment_flag(_qc(spark, d)).select("recording_id", "state", "flag_reasons", "flagged")


USABLE = f"""{QC}, us AS (SELECT *, concat_ws(';', CASE WHEN n_flat_channels + n_noisy_channels >= 7 THEN 'too_many_bad_channels' WHEN n_flat_channels + n_noisy_channels >= 4 THEN 'many_bad_channels' END, CASE WHEN amplitude_max_uv > 800 THEN 'amplitude_above_threshold' END, CASE WHEN line_noise_ratio > 5 THEN 'line_noise_residual' END, CASE WHEN hf_lf_ratio > 0.5 THEN 'high_hf_ratio' END) AS reasons,
    CASE WHEN n_flat_channels + n_noisy_channels >= 7 OR amplitude_max_uv > 800 THEN 'unusable' WHEN reasons <> '' THEN 'borderline' ELSE 'usable' END AS status FROM qc)"""


@query("q09_usability", f"WITH {USABLE} SELECT recording_id, state, status, reasons FROM us")
def _(spark, d):
    return Q.usability(_qc(spark, d)).select("recording_id", "state", "status", "reasons")


@query("q10_qc_score", f"WITH {QC} SELECT recording_id, state, round((least(1.0::DOUBLE, (n_flat_channels + n_noisy_channels) / 7.0::DOUBLE) + least(1.0::DOUBLE, amplitude_max_uv / 1600) + least(1.0::DOUBLE, line_noise_ratio / 10)) / 3, 6) AS score FROM qc")
def _(spark, d):
    score = Q.qc_score(F.col("n_flat_channels") + F.col("n_noisy_channels"), 7.0, [(F.col("amplitude_max_uv"), 800.0), (F.col("line_noise_ratio"), 5.0)])
    return _qc(spark, d).select("recording_id", "state", F.round(score, 6).alias("score"))


@query("q11_rollup", f"""WITH {USABLE}, r AS (SELECT subject, string_agg(DISTINCT r, ';' ORDER BY r) AS reasons FROM (SELECT subject, unnest(string_split(reasons, ';')) AS r FROM us) WHERE r <> '' GROUP BY 1)
    SELECT subject, round(sum(line_noise_ratio * duration) / sum(duration), 6) AS line_noise_ratio, round(max(amplitude_max_uv), 6) AS max_amplitude_max_uv, arg_max(status, CASE status WHEN 'usable' THEN 0 WHEN 'borderline' THEN 1 ELSE 2 END) AS status, coalesce(any_value(r.reasons), '') AS reasons FROM us LEFT JOIN r USING (subject) GROUP BY 1""")
def _(spark, d):
    return rounded(Q.rollup(Q.usability(_qc(spark, d)), ["subject"], "duration", ["line_noise_ratio"], ["amplitude_max_uv"], "status", "reasons"))


@query("q12_channel_maps", "SELECT l_returnflag AS metric, 'c' || l_linenumber AS channel, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS value FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("metric"), F.col("l_quantity").alias("weight"), F.array(F.struct(F.concat(F.lit("c"), "l_linenumber").alias("channel"), F.col("l_extendedprice").alias("value"))).alias("channel_values"))
    return rounded(Q.channel_maps(li), 4)


@query("q13_top_channels", "SELECT s AS supplier, p AS part, v, row_number() OVER (PARTITION BY s ORDER BY v DESC, p) AS place FROM (SELECT l_suppkey AS s, l_partkey AS p, max(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2) QUALIFY place <= 5")
def _(spark, d):
    v = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part")).agg(F.max("l_extendedprice").alias("v"))
    return Q.top_channels(v, ["supplier"], "part", "v")


@query("q14_failure_rate", "WITH h AS (SELECT 'c' || l_linenumber AS channel FROM lineitem WHERE l_discount > 0.05 UNION ALL SELECT 'c' || l_linenumber FROM lineitem WHERE l_tax > 0.05) SELECT channel, count(*) AS hits, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS rate FROM h GROUP BY 1")
def _(spark, d):
    c = F.concat(F.lit("c"), "l_linenumber")
    li = read(spark, d, "lineitem").select(F.when(F.col("l_discount") > 0.05, F.array(c)).alias("flat"), F.when(F.col("l_tax") > 0.05, F.array(c)).alias("noisy"))
    return rounded(Q.failure_rate(li, "flat", "noisy"))


@query("q15_reactivity", f"WITH {QC} SELECT subject, round(avg(line_noise_ratio) FILTER (WHERE state = 'EC') / nullif(avg(line_noise_ratio) FILTER (WHERE state = 'EO'), 0), 6) AS alpha_reactivity FROM qc GROUP BY 1")
def _(spark, d):
    return rounded(Q.reactivity(_qc(spark, d), ["subject"], "state", "line_noise_ratio"))


@query("q16_deltas", f"WITH {QC} SELECT a.recording_id, round(a.hf_lf_ratio - b.hf_lf_ratio, 6) AS raw_hf_lf_ratio FROM (FROM qc WHERE state = 'EC') a LEFT JOIN (FROM qc WHERE state = 'EO' AND recording_id % 3 > 0) b USING (recording_id)")
def _(spark, d):
    q = scratch(_qc(spark, d), "quality")
    return rounded(Q.deltas(q.filter("state = 'EC'"), q.filter("state = 'EO' and recording_id % 3 > 0"), ["recording_id"], ["hf_lf_ratio"], "raw").select("recording_id", "raw_hf_lf_ratio"))


@query("q17_outliers", """WITH l AS (UNPIVOT (SELECT l_suppkey, sum(l_extendedprice) AS price, sum(l_quantity) AS qty, sum(l_tax) AS tax FROM lineitem GROUP BY 1) ON price, qty, tax INTO NAME metric VALUE value), m AS (SELECT metric, median(value) AS mid FROM l GROUP BY 1),
    o AS (SELECT l.*, mid, median(abs(value - mid)) OVER (PARTITION BY metric) AS mad FROM l JOIN m USING (metric)) SELECT l_suppkey, metric, round(value, 4) AS value, round(0.6745::DOUBLE * (value - mid) / mad, 6) AS z FROM o WHERE mad > 0 AND abs(0.6745::DOUBLE * (value - mid) / mad) >= 2""")
def _(spark, d):
    s = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("price"), F.sum("l_quantity").alias("qty"), F.sum("l_tax").alias("tax"))
    return rounded(Q.robust_outliers(s, ["l_suppkey"], ["price", "qty", "tax"], 2.0).withColumn("value", F.round("value", 4)))


@query("q18_q19_reasons", f"WITH {USABLE} SELECT r AS reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ';')) AS r FROM us) WHERE r <> '' GROUP BY 1 UNION ALL SELECT 'status:' || status, count(*) FROM us GROUP BY 1")
def _(spark, d):
    u = scratch(Q.usability(_qc(spark, d)), "usability")
    s = Q.status_counts(u, "status").drop("total").unpivot([], ["usable", "borderline", "unusable"], "reason", "n").filter("n > 0").withColumn("reason", F.concat(F.lit("status:"), "reason"))
    return Q.reason_counts(u, "reasons").unionByName(s)


@query("q20_q21_dataset", f"WITH {QC}, l AS (UNPIVOT (SELECT {', '.join(METRICS)} FROM qc) ON COLUMNS(*) INTO NAME metric VALUE value), s AS (SELECT metric, round(avg(value), 6) AS mean, round(median(value), 6) AS median, count(*) AS n FROM l GROUP BY 1) SELECT s.*, CASE metric WHEN 'hf_lf_ratio' THEN CASE WHEN mean <= 0.5 THEN 'pass' ELSE 'fail' END WHEN 'aperiodic_slope' THEN CASE WHEN mean >= 0.5 THEN 'pass' ELSE 'fail' END END AS verdict FROM s")
def _(spark, d):
    q = scratch(_qc(spark, d), "quality")
    v = Q.verdicts(q.agg(F.avg("hf_lf_ratio").alias("hf_lf_ratio"), F.avg("aperiodic_slope").alias("aperiodic_slope")), {"hf_lf_ratio": ("max", 0.5), "aperiodic_slope": ("min", 0.5)})
    return rounded(Q.dataset_metrics(q, METRICS)).join(v.select("metric", "verdict"), "metric", "left")


@query("q22_run_means", f"WITH {USABLE} SELECT subject, round(avg(line_noise_ratio), 6) AS line_noise_ratio, count(*) FILTER (WHERE status = 'usable') AS usable_runs FROM us GROUP BY 1")
def _(spark, d):
    return rounded(Q.run_means(Q.usability(_qc(spark, d)), ["subject"], ["line_noise_ratio"], F.col("status") == "usable"))


#: Line items as features: subject = supplier, condition = return flag.
NAMES = {"l_quantity": "band_log_abs_ch-Fz", "l_extendedprice": "band_rel_alpha_ch-Cz", "l_discount": "complexity_entropy_ch-Fz", "l_tax": "complexity_entropy_ch-Cz"}
FEAT = f"""feat AS (SELECT obs_id, subject, condition, feature, value FROM (UNPIVOT (SELECT l_orderkey * 1000 + l_suppkey AS obs_id, l_suppkey AS subject, l_returnflag AS condition, {', '.join(f'avg({c}) / 7 AS "{n}"' for c, n in NAMES.items())} FROM lineitem GROUP BY ALL) ON {', '.join(f'"{n}"' for n in NAMES.values())} INTO NAME feature VALUE value))"""


def _features(spark, d):
    """Laid out by subject once: the groups of an observation, a subject and its conditions all lie within that."""
    columns = ["l_orderkey", "l_suppkey", "l_returnflag", *NAMES]
    li = read(spark, d, "lineitem").select(*columns).repartition("l_suppkey").groupBy((F.col("l_orderkey") * 1000 + F.col("l_suppkey")).alias("obs_id"), F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("condition"))
    return X.long(li.agg(*[(F.avg(c) / 7).alias(n) for c, n in NAMES.items()]), ["obs_id", "subject", "condition"], list(NAMES.values()))


def _names(spark):
    return X.schema(spark.createDataFrame([(n,) for n in NAMES.values()], "feature string"))


@query("f01_aggregate", f"WITH {FEAT}, m AS (SELECT subject, condition, feature, avg(value) AS mean, median(value) AS median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, count(*) AS epoch_count FROM feat GROUP BY ALL) SELECT m.subject, m.condition, m.feature, round(mean, 3) AS mean, round(any_value(m.median), 3) AS median, round(iqr, 3) AS iqr, round(median(abs(value - m.median)), 3) AS mad, epoch_count FROM m JOIN feat USING (subject, condition, feature) GROUP BY ALL".replace("any_value(m.median)", "m.median").replace("GROUP BY ALL), m", "GROUP BY ALL), m"))
def _(spark, d):
    return rounded(X.aggregate(_features(spark, d), ["subject", "condition"]), 3)


@query("f02_f03_pooled", f"WITH {FEAT} SELECT obs_id * 0 + subject AS subject, 'complexity_entropy_chgrp-midline' AS feature, round(avg(value), 6) AS value FROM feat WHERE feature LIKE 'complexity%' GROUP BY 1, 2".replace("obs_id * 0 + subject", "subject"))
def _(spark, d):
    rows = X.aggregate(_features(spark, d).filter("feature like 'complexity%'"), ["subject"], ("mean",)).select(F.col("subject").alias("obs_id"), "feature", F.col("mean").alias("value"))
    return rounded(X.pooled_channels(rows, {"midline": ["Fz", "Cz"]})).withColumnRenamed("obs_id", "subject")


@query("f04_j07_subject_means", "SELECT l_suppkey, l_returnflag, round(avg(l_quantity), 6) AS l_quantity, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return rounded(X.subject_means(read(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], ["l_quantity"], ["l_linestatus"]))


@query("f05_shard_gate", "WITH s AS (SELECT o_custkey AS shard, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS shape FROM orders GROUP BY 1), t AS (SELECT arg_max(shape, n) AS top FROM (SELECT shape, count(*) AS n FROM s GROUP BY 1)) SELECT shard, shape = top AS consistent FROM s, t")
def _(spark, d):
    return X.shard_gate(read(spark, d, "orders").select(F.col("o_custkey").alias("shard"), F.col("o_orderstatus").alias("column")))


@query("f06_j12_shard_audit", """WITH g AS (SELECT c_custkey AS shard, f FROM customer, (SELECT unnest(['F', 'O', 'P']) AS f)), m AS (SELECT shard, string_agg(f, ',' ORDER BY f) AS missing, count(*) AS n FROM g WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = shard AND o_orderstatus = f) GROUP BY 1)
    SELECT c_custkey AS shard, coalesce(n, 0) AS n_missing, coalesce(missing, '') AS missing, n IS NULL AS complete FROM customer LEFT JOIN m ON shard = c_custkey""")
def _(spark, d):
    files = read(spark, d, "orders").select(F.col("o_custkey").alias("shard"), F.col("o_orderstatus").alias("file"))
    return X.shard_audit(files, read(spark, d, "customer").select(F.col("c_custkey").alias("shard")), ["F", "O", "P"])


@query("f07_f08_rollup", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus AS message, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 15) UNION ALL SELECT 'rows', '', count(*) FROM orders UNION ALL SELECT 'n_o_custkey', '', count(DISTINCT o_custkey) FROM orders")
def _(spark, d):
    o = read(spark, d, "orders")
    m = X.manifest(o, ["o_custkey"]).unpivot([], ["rows", "n_o_custkey"], "o_orderpriority", "n").select("o_orderpriority", F.lit("").alias("message"), "n")
    return X.reason_rollup(o, ["o_orderpriority"], "o_orderstatus").unionByName(m)


@query("f09_f10_health", f"WITH {FEAT}, n AS (SELECT *, CASE WHEN obs_id % 7 = 0 AND feature LIKE 'band%' THEN NULL WHEN feature LIKE '%entropy_ch-Cz' THEN 1.0 ELSE value END AS v FROM feat) SELECT string_split(feature, '_')[1] AS family, count(DISTINCT feature) AS features, round(avg((v IS NULL)::INT), 6) AS missing_rate, count(DISTINCT CASE WHEN feature LIKE '%entropy_ch-Cz' THEN feature END) AS constant, 0 AS all_missing FROM n GROUP BY 1")
def _(spark, d):
    v = F.when((F.col("obs_id") % 7 == 0) & F.col("feature").startswith("band"), None).when(F.col("feature").endswith("entropy_ch-Cz"), 1.0).otherwise(F.col("value"))
    return rounded(X.family_health(X.feature_health(_features(spark, d).withColumn("value", v)), _names(spark)))


@query("f11_distribution", f"WITH {FEAT} SELECT feature, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS low, round(median(value), 6) AS median, round(max(value), 6) AS high FROM feat GROUP BY 1")
def _(spark, d):
    return rounded(X.distribution(_features(spark, d)))


@query("f12_family_conditions", f"WITH {FEAT} SELECT string_split(feature, '_')[1] AS family, condition, count(DISTINCT subject) AS subjects, 0.0::DOUBLE AS missing_rate, CASE WHEN condition = 'A' AND family = 'band' THEN (SELECT count(*) FROM supplier) ELSE 0 END AS failures FROM feat GROUP BY 1, 2")
def _(spark, d):
    fail = read(spark, d, "supplier").select(F.lit("band").alias("family"), F.lit("A").alias("condition"))
    return X.family_conditions(_features(spark, d), _names(spark), fail)


@query("f13_flags", """WITH m AS (SELECT l_suppkey AS scope, avg(l_discount) * 4 AS missing, avg(l_tax) * 4 AS outliers FROM lineitem GROUP BY 1), l AS (UNPIVOT m ON missing, outliers INTO NAME code VALUE value), t(code, warn, fail) AS (VALUES ('missing', 0.19::DOUBLE, 0.21::DOUBLE), ('outliers', 0.15::DOUBLE, 0.17::DOUBLE))
    SELECT scope, code, round(value, 6) AS value, CASE WHEN value > fail THEN fail ELSE warn END AS threshold, CASE WHEN value > fail THEN 'fail' WHEN value > warn THEN 'warn' ELSE 'pass' END AS severity FROM l JOIN t USING (code)""")
def _(spark, d):
    li = in_table_order(read(spark, d, "lineitem"), "l_suppkey", "l_discount", "l_tax")
    m = li.groupBy(F.col("l_suppkey").alias("scope")).agg((F.avg("l_discount") * 4).alias("missing"), (F.avg("l_tax") * 4).alias("outliers"))
    return rounded(X.flags(m, {"missing": (0.19, 0.21), "outliers": (0.15, 0.17)}))


Z = lambda name, rel, keys: f"""{name} AS (SELECT *, CASE WHEN mad > 0 THEN 0.6745::DOUBLE * (value - mid) / mad END AS z FROM (SELECT *, median(abs(value - mid)) OVER (PARTITION BY {keys}) AS mad FROM (SELECT *, median(value) OVER (PARTITION BY {keys}) AS mid FROM {rel})))"""


@query("f14_epoch_rejection", f"WITH {FEAT}, {Z('z', 'feat', 'subject, feature')}, f AS (SELECT subject, obs_id, string_split(feature, '_')[1] AS grp, count(*) FILTER (WHERE abs(z) > 1.2) / count(*) AS fr FROM z GROUP BY ALL) SELECT subject, obs_id FROM f GROUP BY ALL HAVING max(fr) <= 0.5")
def _(spark, d):
    groups = _names(spark).select("feature", F.col("family").alias("grp"))
    return X.kept_epochs(_features(spark, d), groups, 1.2, 0.5)


@query("f15_j11_masks", f"""WITH {FEAT}, sm AS (SELECT subject, feature, avg(value) AS value FROM feat GROUP BY ALL), {Z('zs', 'sm', 'feature')}, {Z('ze', 'feat', 'subject, feature')},
    bs AS (SELECT subject, string_split(feature, '_')[1] AS grp FROM zs GROUP BY ALL HAVING count(*) FILTER (WHERE abs(z) > 1.5) / count(*) > 0.5), be AS (SELECT obs_id, string_split(feature, '_')[1] AS grp FROM ze GROUP BY obs_id, subject, grp HAVING count(*) FILTER (WHERE abs(z) > 1.5) / count(*) > 0.5),
    bad AS (SELECT grp, obs_id FROM bs JOIN (SELECT DISTINCT subject, obs_id FROM feat) USING (subject) UNION SELECT grp, obs_id FROM be) SELECT string_split(feature, '_')[1] AS grp, feature, count(*) AS rows, round(sum(value), 4) AS total FROM feat WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.obs_id = feat.obs_id AND bad.grp = string_split(feature, '_')[1]) GROUP BY 1, 2""")
def _(spark, d):
    groups = _names(spark).select("feature", F.col("family").alias("grp"))
    rows = _features(spark, d)
    kept = X.without_bad(rows, groups, X.outlier_masks(rows, groups, 1.5, 0.5))
    return kept.groupBy("grp", "feature").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("total"))


@query("f16_burden", f"WITH {FEAT}, sm AS (SELECT subject, feature, avg(value) AS value FROM feat GROUP BY ALL), {Z('zs', 'sm', 'feature')} SELECT subject, round(count(*) FILTER (WHERE abs(z) > 1.5) / count(*), 6) AS burden FROM zs GROUP BY 1")
def _(spark, d):
    return rounded(X.subject_burden(_features(spark, d), 1.5))


@query("f17_p11_units", f"""WITH {FEAT}, n AS (SELECT feature, split_part(feature, '_', 1) AS family, split_part(feature, '_', 1) || '_' || split_part(feature, '_', 2) AS subfamily, regexp_replace(feature, '_ch-.*$', '') AS measure, regexp_extract(feature, '_ch-(.*)$', 1) AS sensor, count(*) AS c FROM feat GROUP BY 1)
    SELECT mode, unit, sum(c)::BIGINT AS rows FROM (SELECT unnest([('flat', 'all', c), ('sensor', sensor, c), ('family', family, c), ('subfamily', subfamily, c), ('sensor_within_family', family || '|' || sensor, c), ('sensor_within_subfamily', subfamily || '|' || sensor, c), ('feature', feature, c), ('feature_within_family', family || '|' || feature, c), ('descriptor', measure, c), ('descriptor_sensor', measure || '|' || sensor, c)]::STRUCT(mode VARCHAR, unit VARCHAR, c BIGINT)[], recursive := true) FROM n) GROUP BY ALL""")
def _(spark, d):
    n = _features(spark, d).groupBy("feature").agg(F.count(F.lit(1)).alias("c"))
    return X.units(_names(spark)).join(F.broadcast(n), "feature").groupBy("mode", "unit").agg(F.sum("c").alias("rows"))


@query("f18_p10_pooled_conditions", f"WITH {FEAT}, f AS (FROM feat WHERE condition IN ('A', 'N') AND NOT (condition = 'A' AND feature LIKE 'band_rel%')) SELECT condition, feature, count(*) AS rows FROM f WHERE feature NOT LIKE 'band_rel%' GROUP BY ALL")
def _(spark, d):
    rows = X.select_classes(_features(spark, d), "condition", ["A", "N"]).filter("not (condition = 'A' and feature like 'band_rel%')")
    return X.pooled_conditions(rows).groupBy("condition", "feature").agg(F.count(F.lit(1)).alias("rows"))


@query("f19_balanced", "SELECT o_orderstatus, (SELECT min(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)) AS n FROM orders GROUP BY 1")
def _(spark, d):
    return X.balanced(read(spark, d, "orders"), "o_orderstatus", ["o_orderkey"]).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("f21_time_features", """WITH s AS (SELECT o_custkey AS recording_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_totalprice - 200000 AS v FROM orders), l AS (SELECT *, lag(v) OVER w AS b, lag(v, 2) OVER w AS a, v - lag(v) OVER w AS d1 FROM s WINDOW w AS (PARTITION BY recording_id ORDER BY i)),
    m AS (SELECT *, d1 - lag(d1) OVER w AS d2, (d1 >= 0) <> lag(d1 >= 0) OVER w AS turn FROM l WINDOW w AS (PARTITION BY recording_id ORDER BY i)),
    p AS (SELECT recording_id, 0 - sum(c / t * log2(c / t)) / log2(6) AS pe FROM (SELECT recording_id, count(*) AS c, sum(count(*)) OVER (PARTITION BY recording_id) AS t FROM m WHERE a IS NOT NULL GROUP BY recording_id, a <= b, b <= v, a <= v) GROUP BY 1)
    SELECT recording_id, round(var_pop(v) / 1e6, 3) AS activity, round(sqrt(var_pop(d1) / nullif(var_pop(v), 0)), 6) AS mobility, count(*) FILTER (WHERE (v >= 0) <> (b >= 0)) AS zero_crossings, round(log10(count(*)) / nullif(log10(count(*)) + log10(count(*) / (count(*) + 0.4::DOUBLE * count(*) FILTER (WHERE turn))), 0), 6) AS petrosian_fd, round(any_value(pe), 6) AS permutation_entropy FROM m LEFT JOIN p USING (recording_id) GROUP BY 1""")
def _(spark, d):
    s = read(spark, d, "orders").select(F.col("o_custkey").alias("recording_id"), F.col("o_orderkey").alias("sample_idx"), (F.col("o_totalprice") - 200000).alias("value"))
    t = X.time_features(s, ["recording_id"]).select("recording_id", F.round(F.col("activity") / 1e6, 3).alias("activity"), "mobility", F.col("zero_crossings"), "petrosian_fd", "permutation_entropy")
    return rounded(t, 6, ("activity",))


@query("p12_p14_prune", f"WITH {FEAT}, n AS (SELECT *, CASE WHEN obs_id % 7 = 0 AND feature LIKE 'band%' THEN NULL WHEN feature LIKE '%entropy_ch-Cz' THEN 1.0 ELSE value END AS v FROM feat) SELECT feature, avg((v IS NULL)::INT) <= 0.1 AND coalesce(stddev_pop(v), 0) > 1e-12 AS kept, count(*) FILTER (WHERE v IS NULL) AS bad_cells FROM n GROUP BY 1")
def _(spark, d):
    v = F.when((F.col("obs_id") % 7 == 0) & F.col("feature").startswith("band"), None).when(F.col("feature").endswith("entropy_ch-Cz"), 1.0).otherwise(F.col("value"))
    rows = scratch(_features(spark, d).withColumn("value", v), "features")
    bad = rows.groupBy("feature").agg(F.count_if(F.col("value").isNull()).alias("bad_cells"))
    return bad.join(X.prune(rows, 0.1).withColumn("kept", F.lit(True)), "feature", "left").na.fill(False, ["kept"])


@query("p13_purge", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice <= 50000")
def _(spark, d):
    return X.purge(read(spark, d, "lineitem"), ["l_extendedprice", "l_tax"], 50000.0).select("l_orderkey", "l_linenumber", "l_extendedprice")


EMB = "emb AS (SELECT vec_id, vec_id % 20 AS subject, CASE vec_id % 2 WHEN 0 THEN 'EO' ELSE 'EC' END AS condition, label, embedding FROM embeddings)"


def _emb(spark, d):
    e = read(spark, d, "embeddings")
    return e.select("vec_id", (F.col("vec_id") % 20).alias("subject"), F.when(F.col("vec_id") % 2 == 0, "EO").otherwise("EC").alias("condition"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


@query("e01_e02_vector_means", f"WITH {EMB}, x AS (SELECT subject, condition, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM emb) SELECT subject, condition, i::INT AS i, round(avg(v), 6) AS v FROM x GROUP BY ALL")
def _(spark, d):
    m = E.levels(_emb(spark, d).withColumns({"model_key": F.lit("m"), "recording_id": F.col("subject")}))["subject"]
    return rounded(m.select("subject", "condition", F.posexplode("embedding").alias("i", "v")))


@query("e03_centred", f"WITH {EMB}, x AS (SELECT vec_id, subject, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM emb), c AS (SELECT vec_id, v - avg(v) OVER (PARTITION BY subject, i) AS v FROM x) SELECT vec_id, round(sum(v), 5) AS total, round(sum(v * v), 5) AS energy FROM c GROUP BY 1")
def _(spark, d):
    c = E.centred(_emb(spark, d), "subject", ["vec_id"])
    return c.select("vec_id", F.explode("embedding").alias("v")).groupBy("vec_id").agg(F.round(F.sum("v"), 5).alias("total"), F.round(F.sum(F.col("v") * F.col("v")), 5).alias("energy"))


def _energy(df, vector):
    """Width, sum and sum of squares of each vector."""
    total = lambda f: F.round(F.aggregate(vector, F.lit(0.0), lambda a, x: a + f(x)), 4)
    return df.select("vec_id", F.size(vector).alias("width"), total(lambda x: x).alias("total"), total(lambda x: x * x).alias("energy"))


@query("e03_whitened")
def _(spark, d):
    return _energy(E.whitened(_emb(spark, d), "subject", ["vec_id"]), "embedding")


@query("e04_erased")
def _(spark, d):
    return _energy(E.erased(_emb(spark, d), "label", ["vec_id"]), "embedding")


@query("e05_token_covariance")
def _(spark, d):
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    return _energy(E.token_covariance(_emb(spark, d).withColumn("tokens", tokens), ["vec_id"]), "vector")


LANE_SUMS = ", ".join(f"(sum(('0x' || substr(sha256(m || ':{i // 4}'), {1 + 16 * (i % 4)}, 16))::UBIGINT::HUGEINT) % 18446744073709551616)::VARCHAR" for i in range(16))


@query("e07_fingerprint", f"""WITH {EMB}, k AS (SELECT label, length(vec_id::VARCHAR) || ':' || vec_id || '|' || length(subject::VARCHAR) || ':' || subject AS m FROM emb)
    SELECT label, count(*) AS n, sha256(label || '|' || count(*) || '|' || concat_ws(',', {LANE_SUMS})) AS selection_fingerprint FROM k GROUP BY 1""")
def _(spark, d):
    return E.fingerprint(_emb(spark, d), ["label"], ["vec_id", "subject"])


@query("e08_variance", f"""WITH {EMB}, x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM emb), s AS (SELECT label, i, count(*) AS k, sum(v) AS sv, sum(v * v) AS q FROM x GROUP BY ALL), t AS (SELECT i, sum(k) AS n, sum(sv) AS t, sum(q) AS q, sum(sv * sv / k) AS b FROM s GROUP BY 1)
    SELECT round(sum(q / n - (t / n) ** 2), 6) AS total_variance, round(sum(b / n - (t / n) ** 2), 6) AS between_variance, round(sum(b / n - (t / n) ** 2) / sum(q / n - (t / n) ** 2), 6) AS eta2 FROM t""")
def _(spark, d):
    return rounded(E.variance_parts(_emb(spark, d), [], "label"))


@query("e08_excess")
def _(spark, d):
    return rounded(E.excess_eta2(_emb(spark, d), "label", ["vec_id"]))


@query("e11_retention", f"""WITH {EMB}, q AS (SELECT vec_id AS i, embedding::DOUBLE[] AS h FROM emb WHERE vec_id % 100 = 0), o AS (SELECT vec_id AS j, embedding::DOUBLE[] AS h2 FROM emb),
    p AS (SELECT i, j, list_sum(list_transform(list_zip(h, h2), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dh, list_sum(list_transform(list_zip(h[1:8], h2[1:8]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dl FROM q, o WHERE i <> j),
    r AS (SELECT i, row_number() OVER (PARTITION BY i ORDER BY dh, j) AS rh, row_number() OVER (PARTITION BY i ORDER BY dl, j) AS rl FROM p),
    s AS (SELECT (SELECT count(*) FROM q) AS a, (SELECT count(*) FROM o) AS n, coalesce(sum(rh - 10) FILTER (WHERE rl <= 10 AND rh > 10), 0) AS t, coalesce(sum(rl - 10) FILTER (WHERE rh <= 10 AND rl > 10), 0) AS c FROM r)
    SELECT round(1 - 2.0::DOUBLE / (a * 10 * (2 * n - 31)) * t, 6) AS trustworthiness, round(1 - 2.0::DOUBLE / (a * 10 * (2 * n - 31)) * c, 6) AS continuity FROM s""")
def _(spark, d):
    e = _emb(spark, d).withColumn("low", F.slice("embedding", 1, 8))
    return rounded(E.neighbour_retention(e, "vec_id", "embedding", "low", 10, F.col("vec_id") % 100 == 0))


@query("e12_pca_sweep")
def _(spark, d):
    s = E.pca_sweep(_emb(spark, d), ["vec_id"], [2, 5, 500])
    return s.select("vec_id", "size", F.round(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x * x), 5).alias("energy"))  # signs are free


@query("t01_t04_folds", "SELECT label % 2 AS y, count(*) AS rows FROM embeddings GROUP BY 1")
def _(spark, d):
    df = T.target(_emb(spark, d).withColumn("name", (F.col("label") % 2).cast("string")), "name", {"0": 0, "1": 1}).withColumn("group", F.col("subject"))
    f = T.group_folds(df, 5)
    leak = f.groupBy("group").agg(F.countDistinct("fold").alias("n")).agg(F.max("n").alias("n"))
    return f.crossJoin(F.broadcast(leak)).filter("n = 1").groupBy("y").agg(F.count(F.lit(1)).alias("rows"))


@query("t02_t03_validity", "WITH g AS (SELECT label, count(DISTINCT vec_id % 20) AS g, count(*) AS n FROM embeddings GROUP BY 1) SELECT least(50, min(g))::INT AS folds, count(*) >= 2 AND min(n) >= 2 AS valid FROM g")
def _(spark, d):
    e = _emb(spark, d).withColumns({"y": F.col("label"), "group": F.col("subject"), "unit": F.lit("u")})
    return T.safe_folds(e, 50).crossJoin(T.validity(e, ["unit"]).select("valid"))


@query("t06_t10_decoding")
def _(spark, d):
    df = T.target(_emb(spark, d).withColumn("name", F.col("label") < 5), "name", positive="true").withColumn("group", F.col("subject"))
    p = T.fold_predictions(T.group_folds(df.select("vec_id", "y", "group", "embedding"), 3), "embedding", maxIter=10)
    return rounded(T.metric_summary(T.fold_metrics(p, []), []), 4)


FITS = "fits AS (SELECT o_orderkey AS fit_id, o_custkey % 30 AS grp, CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'success' END AS status, CASE o_orderkey % 3 WHEN 0 THEN 'PCA' WHEN 1 THEN 'UMAP' ELSE 'other' END AS reducer, sqrt(o_totalprice) AS trust FROM orders)"


def _fits(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("fit_id"), (F.col("o_custkey") % 30).alias("grp"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("success").alias("status"), F.when(F.col("o_orderkey") % 3 == 0, "PCA").when(F.col("o_orderkey") % 3 == 1, "UMAP").otherwise("other").alias("reducer"), F.sqrt("o_totalprice").alias("trust"))


@query("t12_j13_best_runs", f"WITH {FITS}, e AS (SELECT l_orderkey AS fit_id, max(l_quantity) AS score FROM lineitem GROUP BY 1) SELECT grp, fit_id, reducer, score FROM fits JOIN e USING (fit_id) WHERE status = 'success' AND reducer <> 'other' QUALIFY row_number() OVER (PARTITION BY grp ORDER BY score DESC, trust DESC, fit_id) = 1")
def _(spark, d):
    e = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("fit_id")).agg(F.max("l_quantity").alias("m")).withColumns({"eval_name": F.lit("x"), "status": F.lit("success")})
    return T.best_runs(_fits(spark, d), e, ["grp"], "x", ["PCA", "UMAP"], "m", ["trust"]).select("grp", "fit_id", "reducer", "score")


@query("t13_best_decoding", f"WITH {FITS} SELECT grp, fit_id FROM fits QUALIFY row_number() OVER (PARTITION BY grp ORDER BY floor(trust / 100) DESC, fit_id % 7, fit_id) = 1")
def _(spark, d):
    f = _fits(spark, d).withColumn("accuracy_mean", F.floor(F.col("trust") / 100).cast("double")).withColumn("p_adjusted", F.col("fit_id") % 7)
    return T.best_decoding(f, ["grp"], ids=("fit_id",)).select("grp", "fit_id")


@query("t14_t17_leaderboard", f"WITH {FITS} SELECT fit_id, 'm' AS model, CASE WHEN fit_id % 2 = 0 THEN 'coral' ELSE 'none' END AS transform, 'all_dimensions' AS reduction_mode, reducer AS family FROM fits WHERE reducer <> 'other'")
def _(spark, d):
    key = F.when(F.col("fit_id") % 2 == 0, "m_align-coral").otherwise("m")
    f = _fits(spark, d)
    board = T.leaderboard({"PCA": f.filter("reducer = 'PCA'").select("fit_id"), "UMAP": f.filter("reducer = 'UMAP'").select("fit_id", F.lit(None).cast("string").alias("reduction_mode"))})
    model, transform = T.model_parts(key)
    return T.with_defaults(board.withColumns({"model": model, "transform": transform})).select("fit_id", "model", "transform", "reduction_mode", "family")


@query("t18_compatibility", "SELECT o_custkey, concat_ws(',', CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'o_orderstatus' END, CASE WHEN count(DISTINCT o_orderpriority) > 1 THEN 'o_orderpriority' END) AS differing, differing = '' AS comparable FROM orders GROUP BY 1")
def _(spark, d):
    return T.compatibility(read(spark, d, "orders"), ["o_custkey"], ["o_orderstatus", "o_orderpriority"])


@query("t19_j14_deltas", f"WITH {FITS} SELECT fit_id, round(trust - (SELECT avg(trust) FROM fits b WHERE b.grp = f.grp AND b.reducer = 'PCA'), 4) AS delta FROM fits f")
def _(spark, d):
    return rounded(T.deltas(_fits(spark, d), ["grp"], "reducer", "PCA", "trust").select("fit_id", "delta"), 4)


@query("t20_resume", f"WITH {FITS} SELECT * FROM (SELECT reducer AS reason, count(*) AS n FROM fits WHERE status <> 'success' GROUP BY 1) UNION ALL SELECT 'pending', count(*) FILTER (WHERE status <> 'success') FROM fits")
def _(spark, d):
    f = _fits(spark, d)
    left = T.resume(f, f.filter("status = 'success'"), ["fit_id"]).select(F.lit("pending").alias("reason"), F.col("pending").alias("n"))
    return T.failures(f, "reducer").unionByName(left)


CMP = "cmp AS (SELECT l_suppkey AS subject, CASE l_linenumber % 2 WHEN 0 THEN 'dss' ELSE 'ica' END AS method, 1 - avg(l_discount) * 2 AS corr, avg(l_tax) * 8 AS slope, (sum(l_orderkey) % 12)::INT AS eog, avg(l_quantity) AS var FROM lineitem GROUP BY 1, 2), sc AS (SELECT *, round(CASE WHEN corr > 0.98 THEN 0.4 WHEN corr > 0.95 THEN 0.3 WHEN corr > 0.9 THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN slope < 0.15 THEN 0.3 WHEN slope < 0.3 THEN 0.2 WHEN slope < 0.5 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN eog <= 4 THEN 0.2 WHEN eog <= 7 THEN 0.15 WHEN eog <= 10 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN var BETWEEN 5 AND 25 THEN 0.1 WHEN var <= 40 THEN 0.05 ELSE 0 END::DOUBLE, 6) AS score FROM cmp)"


def _cmp(spark, d):
    li = in_table_order(read(spark, d, "lineitem"), "l_suppkey", "l_linenumber", "l_orderkey", "l_quantity", "l_discount", "l_tax")
    li = li.groupBy(F.col("l_suppkey").alias("subject"), F.when(F.col("l_linenumber") % 2 == 0, "dss").otherwise("ica").alias("method"))
    return li.agg((1 - F.avg("l_discount") * 2).alias("mean_dss_ica_corr"), (F.avg("l_tax") * 8).alias("slope_distortion"), (F.sum("l_orderkey") % 12).cast("int").alias("eog_components"), F.avg("l_quantity").alias("variance_removed_pct")).withColumns({"ecg_components": F.lit(None).cast("int"), "emg_components": F.lit(0)})


@query("t21_winners", f"WITH {CMP} SELECT subject, method, score FROM sc QUALIFY row_number() OVER (PARTITION BY subject ORDER BY score DESC, method) = 1")
def _(spark, d):
    return T.winners(T.step_scores(_cmp(spark, d)))


@query("t22_method_means", f"WITH {CMP} SELECT method, count(*) AS subjects, round(avg(corr), 6) AS mean_mean_dss_ica_corr, round(avg(score), 6) AS mean_score FROM sc GROUP BY 1")
def _(spark, d):
    return rounded(T.method_means(T.step_scores(_cmp(spark, d)), ["mean_dss_ica_corr", "score"]))


@query("t23_signal_change", "WITH a AS (SELECT l_suppkey AS r, l_linenumber AS channel, l_orderkey * 3000 + l_partkey AS i, avg(l_extendedprice) AS a, avg(l_quantity * 900) AS b FROM lineitem GROUP BY 1, 2, 3) SELECT r AS recording_id, channel, round(corr(a, b), 6) AS correlation, round(greatest(0, least(100, 100.0::DOUBLE * (1 - var_pop(b) / nullif(var_pop(a), 0)))), 6) AS variance_removed_pct FROM a GROUP BY 1, 2")
def _(spark, d):
    s = scratch(read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("recording_id"), F.col("l_linenumber").alias("channel"), (F.col("l_orderkey") * 3000 + F.col("l_partkey")).alias("sample_idx")).agg(F.avg("l_extendedprice").alias("a"), F.avg(F.col("l_quantity") * 900).alias("b")), "signals")
    one = lambda c: s.select("recording_id", "channel", "sample_idx", F.col(c).alias("value"))
    return rounded(T.signal_change(one("a"), one("b"), ["recording_id"]))


@query("t24_scope_stats", "SELECT o_orderstatus, count(*) AS rows, count(DISTINCT o_custkey) AS subjects, count(DISTINCT o_orderkey) AS recordings FROM orders GROUP BY 1")
def _(spark, d):
    o = read(spark, d, "orders").select("o_orderstatus", F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("recording_id"))
    return T.scope_stats(o, "o_orderstatus")


@query("t25_t26_provenance", "SELECT event_id, round(value + (props->>'k')::DOUBLE, 4) AS total_seconds, (props->>'k')::INT AS eog_components, 0 AS ecg_components, 'run_' || event_type AS variant FROM events")
def _(spark, d):
    k = F.get_json_object("props", "$.k")
    e = read(spark, d, "events").select("event_id", "event_type", F.concat(F.lit('{"timing": {"a": '), "value", F.lit(', "b": '), k, F.lit('}, "components": {"eog": '), k, F.lit("}}")).alias("j"))
    p = T.provenance(e, "j")
    path = F.concat(F.lit("/x/run_"), "event_type", F.lit("/r.csv"))
    return p.select("event_id", F.round("total_seconds", 4).alias("total_seconds"), "eog_components", "ecg_components", T.run_variant(path).alias("variant"))


@query("j04_reference_row", "WITH r AS (SELECT o_custkey AS k, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1) SELECT l.l_id AS run_id, coalesce(a.price, b.price) AS o_totalprice, CASE WHEN a.k IS NOT NULL THEN 0 WHEN b.k IS NOT NULL THEN 1 END AS priority FROM (SELECT c_custkey AS l_id, c_custkey * 2 AS k1, c_custkey // 2 AS k2 FROM customer) l LEFT JOIN r a ON a.k = k1 LEFT JOIN r b ON b.k = k2")
def _(spark, d):
    runs = read(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), (F.col("c_custkey") * 2).alias("k1"), F.floor(F.col("c_custkey") / 2).alias("k2"))
    ref = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_totalprice")
    return J.reference_row(runs, ["k1", "k2"], ref, "k", "o_orderkey").select("run_id", "o_totalprice", "priority")


@query("j05_stages", "SELECT l_returnflag, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'O'), 6) AS post, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'F' AND l_returnflag <> 'R'), 6) AS pre FROM lineitem GROUP BY 1")
def _(spark, d):
    li = read(spark, d, "lineitem")
    return rounded(J.stage_comparison(li.filter("l_linestatus = 'O'"), li.filter("l_linestatus = 'F' and l_returnflag <> 'R'"), "l_returnflag", "l_quantity").select("l_returnflag", "post", "pre"))


@query("j16_occurrences", "WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS j FROM orders) SELECT a.o_custkey, a.o_orderkey, b.o_orderkey AS other FROM n a JOIN n b ON a.o_custkey = b.o_custkey AND a.i = b.j")
def _(spark, d):
    o = read(spark, d, "orders")
    a = o.select("o_custkey", "o_orderkey")
    b = o.select("o_custkey", F.col("o_orderkey").alias("other"), (-F.col("o_orderkey")).alias("back"))
    return J.occurrence_matched(a, b, "o_custkey", "o_orderkey", "back").select("o_custkey", "o_orderkey", "other")


@query("p07_p08_subjects", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT c_custkey % 50 FROM customer) AND ((s_suppkey BETWEEN 1 AND 30) OR s_suppkey = 41)")
def _(spark, d):
    s = read(spark, d, "supplier")
    asked = read(spark, d, "customer").select(F.format_string("sub-%04d", F.col("c_custkey") % 50).alias("subject"))
    ok = J.valid_subjects(asked, s.select(F.col("s_suppkey").cast("string").alias("subject")))
    return J.row_ranges(s, "s_suppkey", "1-30,41").join(ok, F.col("s_suppkey").cast("string") == ok.subject, "left_semi").select("s_suppkey", "s_name")


@query("p15_truthy", "SELECT o_orderstatus, count(*) FILTER (WHERE o_orderkey % 4 < 2) AS n FROM orders GROUP BY 1")
def _(spark, d):
    from ..functions.predicates import truthy

    text = F.element_at(F.array(F.lit(" Yes"), F.lit("1"), F.lit("no"), F.lit("absent")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return read(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_if(truthy(text)).alias("n"))


@query("e06_e10_tasks", f"""WITH {EMB}, p AS (SELECT *, 'all' AS population FROM emb UNION ALL SELECT *, 'low' FROM emb WHERE label IN (0, 1, 2)), s AS (SELECT *, condition AS scope FROM p UNION ALL SELECT *, 'pooled' FROM p)
    SELECT 'diagnosis' AS eval_name, population, scope, count(*) AS n, sum((label = 1)::INT)::BIGINT AS positives FROM s WHERE label IN (0, 1) GROUP BY ALL
    UNION ALL SELECT 'condition_separation', population, scope, count(*), sum((condition = 'EC')::INT)::BIGINT FROM s WHERE scope = 'pooled' GROUP BY ALL""")
def _(spark, d):
    evals = {"diagnosis": {"column": "label", "mapping": {"0": 0, "1": 1}}, "condition_separation": {"column": "condition", "positive": "EC"}}
    tasks = E.diagnostic_tasks(_emb(spark, d), evals, {"all": {}, "low": {"all_of": {"label": [0, 1, 2]}}}, ["EO", "EC"], ["vec_id"])
    rows = tasks.withColumns({"cohort_name": F.lit("c"), "model_key": F.lit("m")})
    kept = E.selected_diagnostics(rows, "c", "all").unionByName(E.selected_diagnostics(rows, "c", "low"))
    return kept.groupBy("eval_name", "population", "scope").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))


@query("t05_t11_units", f"WITH {FITS}, m AS (SELECT DISTINCT reducer AS mode FROM fits), g AS (SELECT DISTINCT grp AS model FROM fits) SELECT mode, model FROM m, g WHERE (mode = 'PCA') = (model % 2 = 0)")
def _(spark, d):
    f = _fits(spark, d)
    modes, models = f.select(F.col("reducer").alias("mode")).distinct(), f.select(F.col("grp").alias("model")).distinct()
    allowed = f.select(F.col("reducer").alias("mode")).distinct().join(f.select(F.col("grp").alias("model")).distinct(), (F.col("mode") == "PCA") == (F.col("model") % 2 == 0))
    return T.unit_grid(modes, models, allowed).select("mode", "model")


@query("s02_table", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def _(spark, d):
    from ..sources.tables import table

    rich = read(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, f"{d}/orders.parquet", F.col("o_orderstatus") == "F", rich, "o_custkey").select("o_orderkey", "o_totalprice")
