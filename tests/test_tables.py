import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import evaluation as T
from cohortloom.operators import features as X
from cohortloom.operators import quality as Q
from cohortloom.sources import tables as S
from cohortloom.sources import versions as V

A, B = "band_log_abs_alpha_ch-Fz", "complexity_sample_entropy_ch-Fz"


def six_subjects(spark):
    values = {A: [0, 0, 0, 0, 0, 100], B: [1, 1.1, 0.9, 1.05, 0.95, 1]}
    return spark.createDataFrame([(f"r{i}", f"s{i}", "eo", f, float(v)) for f, vs in values.items() for i, v in enumerate(vs)], "obs_id string, subject string, condition string, feature string, value double")


def test_an_outlier_in_one_group_stays_for_the_others(spark):
    rows = six_subjects(spark).withColumn("value", F.when((F.col("feature") == A) & (F.col("subject") != "s5"), F.expr("cast(substr(subject, 2) as int) * 0.1")).otherwise(F.col("value")))
    names = X.schema(rows.select("feature").distinct())
    for level in ("family", "subfamily", "measure", "feature"):
        groups = names.select("feature", F.col(level).alias("grp"))
        bad = X.outlier_masks(rows, groups, 3.0, 0.5)
        assert {(r.obs_id) for r in bad.collect()} == {"r5"}
        left = {(r.feature, r.n) for r in X.without_bad(rows, groups, bad).groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert left == {(A, 5), (B, 6)}


def test_schema_of_names(spark):
    df = spark.createDataFrame([("mean_band_log_abs_alpha_chgrp-midline",), (B,)], "feature string")
    got = {r.feature: r for r in X.schema(df).collect()}
    r = got["mean_band_log_abs_alpha_chgrp-midline"]
    assert (r.family, r.subfamily, r.measure, r.sensor, r.grouped) == ("band", "band_log", "band_log_abs_alpha", "midline", True)
    assert got[B].sensor == "Fz" and not got[B].grouped


def test_all_missing_feature_is_pruned_and_no_row(spark):
    df = spark.createDataFrame([(1, 1.0, float("nan")), (2, 2.0, None), (3, 3.0, None)], "obs_id int, a double, b double")
    assert [r.feature for r in X.prune(X.long(df, ["obs_id"], ["a", "b"]), 0.5).collect()] == ["a"]
    assert X.purge(df, ["a"]).count() == 3 and X.purge(df, ["a", "b"]).count() == 2


def test_aggregation_by_recording(spark):
    rows = spark.createDataFrame([(e // 2, "f", float(v)) for e, v in enumerate((0, 7, 14, 21))], "rec int, feature string, value double")
    got = {r.rec: r for r in X.aggregate(rows, ["rec"]).collect()}
    assert (got[0].mean, got[0].median, got[0].iqr, got[0].mad, got[0].epoch_count) == (3.5, 3.5, 3.5, 3.5, 2)
    wide = X.widened(X.aggregate(rows, ["rec"]), ["rec"], ["f"], ("mean", "iqr")).columns
    assert wide == ["rec", "epoch_count", "mean_f", "iqr_f"]


def test_usability_and_score(spark):
    nan = float("nan")
    rows = [(0, 1, 100.0, 1.0, 0.1), (4, 3, 100.0, 1.0, 0.1), (2, 2, nan, 1.0, 0.1), (0, 0, 900.0, 6.0, 0.6), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "n_flat_channels int, n_noisy_channels int, amplitude_max_uv double, line_noise_ratio double, hf_lf_ratio double")
    got = [(r.status, r.reasons) for r in Q.usability(df).collect()]
    assert got == [("usable", ""), ("unusable", "too_many_bad_channels"), ("borderline", "many_bad_channels"), ("unusable", "amplitude_above_threshold;line_noise_residual;high_hf_ratio"), ("usable", "")]
    s = df.select(Q.qc_score(F.col("n_flat_channels"), 7.0, [(F.col("amplitude_max_uv"), 800.0)]).alias("s")).collect()
    assert abs(s[1].s - (4 / 7 + 100 / 1600) / 2) < 1e-12 and abs(s[2].s - 2 / 7) < 1e-12 and s[4].s is None


def test_welch_matches_numpy(spark):
    r = np.random.default_rng(1)
    x = r.normal(0, 20, 640) + 10 * np.sin(2 * np.pi * 10 * np.arange(640) / 64)
    df = spark.createDataFrame([("a", "Fz", i, float(v)) for i, v in enumerate(x)], "recording_id string, channel string, sample_idx long, value double")
    got = {round(p.freq, 6): p.power for p in Q.welch(df, 64.0, 64).collect()}
    w = np.hanning(65)[:-1]
    parts = []
    for s in range(0, 640 - 64 + 1, 32):
        seg = x[s : s + 64]
        p = np.abs(np.fft.rfft((seg - seg.mean()) * w)) ** 2 / (64 * (w**2).sum())
        p[1:-1] *= 2
        parts.append(p)
    want = np.mean(parts, axis=0)
    assert all(math.isclose(got[float(i)], v, rel_tol=1e-9) for i, v in enumerate(want))
    assert Q.alpha_peak(Q.welch(df, 64.0, 64)).first().alpha_peak_hz == 10.0


def test_targets_and_folds(spark):
    df = spark.createDataFrame([("Control", "a"), ("Control", "b"), ("Control", "c"), ("ADHD", "d"), ("ADHD", "e"), ("Other", "f")], "label string, group string")
    t = T.target(df, "label", {"Control": 0, "ADHD": 1})
    assert t.count() == 5 and T.safe_folds(t, 5).first().folds == 2
    folds = T.group_folds(t, 2).groupBy("group").agg(F.countDistinct("fold").alias("n")).collect()
    assert all(r.n == 1 for r in folds)
    assert [r.y for r in T.target(df, "label", order=["ADHD", "Control"]).orderBy("group").collect()] == [1, 1, 1, 0, 0]


def test_best_run_ignores_other_evaluations(spark):
    fits = spark.createDataFrame([(1, "g", "success", "UMAP"), (2, "g", "success", "PCA"), (3, "g", "failed", "PCA")], "fit_id int, grp string, status string, reducer string")
    evals = spark.createDataFrame([(1, "sel", "success", 0.73), (2, "sel", "success", 0.64), (2, "off", "success", 0.99), (3, "sel", "success", 1.0)], "fit_id int, eval_name string, status string, m double")
    assert [r.fit_id for r in T.best_runs(fits, evals, ["grp"], "sel", ["PCA", "UMAP"], "m", []).collect()] == [1]
    rows = spark.createDataFrame([("a", "g", 0.8, 0.04), ("b", "g", 0.8, 0.01)], "model string, grp string, balanced_accuracy_mean double, p_adjusted double")
    assert T.best_decoding(rows, ["grp"]).first().model == "b"


def test_chance_and_adjustment(spark):
    df = spark.createDataFrame([("s", 8, 10), ("s", 5, 10), ("s", 0, 10)], "sweep string, hits int, n int")
    got = {r.hits: r for r in T.adjusted(T.chance_p(df, "hits", "n"), "p", ["sweep"]).collect()}
    tail = lambda k: sum(math.comb(10, i) for i in range(k, 11)) / 1024
    assert all(abs(r.p - tail(h)) < 1e-9 for h, r in got.items())
    assert abs(got[8].p_adjusted - 3 * tail(8)) < 1e-9 and abs(got[5].p_adjusted - 1.5 * tail(5)) < 1e-9


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Study ID;Age\n1;10\n2;\n")
    (tmp_path / "empty.csv").write_text("obs_id,message\n")
    (tmp_path / "full.csv").write_text("obs_id,message\nx,failed\n")
    df = S.csv(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in df.collect()] == [("1", "10"), ("2", None)]
    assert S.failure_shards(spark, [str(tmp_path / "empty.csv"), str(tmp_path / "full.csv")], "obs_id string, message string").count() == 1
    shard = tmp_path / "sub-01" / "ses-02" / "eeg" / "eo"
    shard.mkdir(parents=True)
    df.coalesce(1).write.parquet(str(shard / "t"))
    (shard / "f.parquet").write_bytes(b"x")
    got = [r for r in S.shards(spark, str(tmp_path)).collect() if r.path.endswith("eo/f.parquet")][0]
    assert (got.sub, got.ses, got.condition) == ("01", "02", "eo")
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.json").write_text('{"model_key": "k"}')
    assert S.sidecars(spark, str(tmp_path / "m"), "model_key string").first().model_key == "k"
    e = spark.createDataFrame([("m", "eo", [1.0, 2.0])], "model_key string, condition string, embedding array<double>")
    S.write_tables(e, str(tmp_path / "out"), text=True)
    assert S.table(spark, str(tmp_path / "out" / "parquet"), F.col("condition") == "eo").count() == 1
    S.write_participants(df.withColumnRenamed("Study ID", "id"), str(tmp_path / "p"), "id", ["Age"])
    text = "".join(p.read_text() for p in (tmp_path / "p").glob("part-*"))
    assert "2\tn/a" in text
    (tmp_path / "r.pnt").write_bytes("x\0 id=77 2024/03/05 10:20:30".encode("latin-1"))
    r = S.record_headers(spark, str(tmp_path / "r.pnt")).first()
    assert r.record_id == "77" and str(r.recorded_at) == "2024-03-05 10:20:30"


def test_a_failure_between_the_writes_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/table"
    rows = lambda at=None: sorted((tuple(r) for r in V.current(spark, path, at).collect()), key=str)
    table = lambda *r: spark.createDataFrame(list(r), "k string, v int, t int")
    with pytest.raises(ValueError):
        V.current(spark, path)
    assert V.upsert_table(table(("a", 1, 1), ("b", 2, 1)), path, ["k"]) == 1
    assert V.upsert_table(table(("b", 3, 2), (None, 4, 2)), path, ["k"]) == 2
    assert rows() == sorted([("a", 1, 1), ("b", 3, 2), (None, 4, 2)], key=str)
    commit, before = V._commit, sorted(map(str, V.current(spark, path).collect()))

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(V, "_commit", killed)
    with pytest.raises(KeyboardInterrupt):
        V.replace_table(V.current(spark, path).limit(0), path)
    assert V.version(spark, path) == 2 and sorted(map(str, V.current(spark, path).collect())) == before
    monkeypatch.setattr(V, "_commit", commit)
    with pytest.raises(V.Conflict):  # made from version 1, but 2 has been made since
        V.replace_table(table(("z", 0, 0)), path, after=1)
    assert V.upsert_latest(table(("a", 9, 0), ("b", 9, 3)), path, ["k"], "t", ["k"]) == 3
    assert sorted((r.k or "", r.v) for r in V.current(spark, path).collect()) == [("", 4), ("a", 1), ("b", 9)]
    assert rows(1) == [("a", 1, 1), ("b", 2, 1)]
    assert V.expire(spark, path, keep=1) == 2 and V.version(spark, path) == 3 and V.current(spark, path).count() == 3
