"""Queries over events as annotations of recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import inventory as R
from ..functions.predicates import unignored
from .derive import MARKS_SQL, marks, query, read, recordings, spans

W = f"WITH {MARKS_SQL}"
#: Merged intervals (DuckDB) of a relation of (recording_id, start, stop).
MERGE = lambda name, rel: f"""{name} AS (SELECT recording_id, min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(fresh) OVER (PARTITION BY recording_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT recording_id, start, stop, CASE WHEN start <= max(stop) OVER (PARTITION BY recording_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {rel} WHERE stop > start)) GROUP BY recording_id, g)"""  # noqa: E731
BAD = "bad AS (SELECT recording_id, start, stop FROM iv WHERE label = 'post_hv')"
EYES = "eyes AS (SELECT recording_id, start, stop, place FROM iv WHERE label IN ('eyes_open', 'eyes_closed'))"


def _parts(spark, d):
    s = spans(marks(spark, d))
    return s, s.filter("label = 'post_hv'").select("recording_id", "start", "stop"), s.filter("label in ('eyes_open', 'eyes_closed')").select("recording_id", "start", "stop", "place")


def six(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("i01_merge", f"{W}, {MERGE('m', 'iv')} SELECT recording_id, round(start, 6) AS start, round(stop, 6) AS stop FROM m")
def _(spark, d):
    return six(I.merged(_parts(spark, d)[0].select("recording_id", "start", "stop")), "start", "stop")


@query("i02_subtract", f"""{W}, {BAD}, {MERGE('mb', 'bad')}, {EYES},
    o AS (SELECT e.recording_id, e.place, e.start, e.stop, b.start AS a, b.stop AS b FROM eyes e JOIN mb b ON e.recording_id = b.recording_id AND e.start < b.stop AND b.start < e.stop WHERE e.stop > e.start),
    cuts AS (SELECT recording_id, place, a AS stop_at, coalesce(lag(b) OVER w, start) AS start_at FROM o WINDOW w AS (PARTITION BY recording_id, place ORDER BY a)
             UNION ALL SELECT recording_id, place, stop, max(b) FROM o GROUP BY recording_id, place, stop
             UNION ALL SELECT recording_id, place, stop, start FROM eyes e WHERE stop > start AND NOT EXISTS (SELECT 1 FROM mb b WHERE e.recording_id = b.recording_id AND e.start < b.stop AND b.start < e.stop))
    SELECT recording_id, place, round(start_at, 6) AS start, round(stop_at, 6) AS stop FROM cuts WHERE stop_at > start_at""")
def _(spark, d):
    _, bad, eyes = _parts(spark, d)
    return six(I.subtracted(eyes, bad), "start", "stop").select("recording_id", "place", "start", "stop")


@query("i03_duration", f"{W}, {MERGE('m', 'iv')} SELECT recording_id, round(sum(stop - start), 4) AS seconds FROM m GROUP BY 1")
def _(spark, d):
    return I.duration(_parts(spark, d)[0].select("recording_id", "start", "stop")).withColumn("seconds", F.round("seconds", 4))


@query("i04_clean_fractions", f"""{W}, c AS (SELECT recording_id, label, greatest(0.0::DOUBLE, start) AS start, least(stop, raw_end) AS stop FROM iv JOIN recs USING (recording_id) WHERE label IN ('post_hv', 'hv_end', 'hv_start')),
    al AS (FROM c), au AS (FROM c WHERE label = 'post_hv'), ma AS (FROM c WHERE label = 'hv_end'), {MERGE('m1', 'al')}, {MERGE('m2', 'au')}, {MERGE('m3', 'ma')},
    s AS (SELECT recording_id, raw_end, coalesce((SELECT sum(stop - start) FROM m1 WHERE m1.recording_id = recs.recording_id), 0) AS a, coalesce((SELECT sum(stop - start) FROM m2 WHERE m2.recording_id = recs.recording_id), 0) AS u, coalesce((SELECT sum(stop - start) FROM m3 WHERE m3.recording_id = recs.recording_id), 0) AS m FROM recs)
    SELECT recording_id, round(greatest(0, raw_end - a), 4) AS clean_seconds, round(a / raw_end, 6) AS bad_fraction, round(u / raw_end, 6) AS automatic_fraction, round(m / raw_end, 6) AS manual_fraction FROM s""")
def _(spark, d):
    m = marks(spark, d)
    name = F.when(F.col("label") == "post_hv", "BAD_epoch_x").when(F.col("label") == "hv_end", "BAD_manual").when(F.col("label") == "hv_start", "BAD_boundary").otherwise(F.col("label"))
    a = m.select("recording_id", "onset", F.col("length").alias("duration"), name.alias("description"), F.array().cast("array<string>").alias("ch_names"))
    out = I.clean_fractions(a, recordings(m))
    return six(out.withColumn("clean_seconds", F.round("clean_seconds", 4)), "bad_fraction", "automatic_fraction", "manual_fraction")


@query("i05_j08_coverage", f"""{W}, {BAD}, {MERGE('mb', 'bad')}, {EYES},
    x AS (SELECT e.recording_id, e.place, any_value(e.stop - e.start) AS len, coalesce(sum(least(e.stop, b.stop) - greatest(e.start, b.start)) FILTER (WHERE b.start IS NOT NULL), 0) AS bad FROM eyes e LEFT JOIN mb b ON e.recording_id = b.recording_id AND e.start < b.stop AND b.start < e.stop GROUP BY 1, 2)
    SELECT recording_id, place % 2 AS condition, round(sum(greatest(0, len - bad)), 2) AS usable_seconds FROM x GROUP BY ALL""")
def _(spark, d):
    _, bad, eyes = _parts(spark, d)
    return I.coverage(eyes.withColumn("condition", F.col("place") % 2), bad, "condition").withColumn("usable_seconds", F.round("usable_seconds", 2))


STATES = "ev AS (SELECT recording_id, onset, CASE label WHEN 'eyes_open' THEN 'EO' ELSE 'EC' END AS state FROM marks WHERE label IN ('eyes_open', 'eyes_closed')), st AS (SELECT recording_id, state, onset AS start, coalesce(lead(onset) OVER (PARTITION BY recording_id ORDER BY onset, state), raw_end) AS stop FROM ev JOIN recs USING (recording_id))"


def _states(m):
    eyes = m.filter("label in ('eyes_open', 'eyes_closed')").select("recording_id", "onset", F.when(F.col("label") == "eyes_open", "EO").otherwise("EC").alias("state"))
    return I.states(eyes, recordings(m))


@query("i06_states", f"{W}, {STATES} SELECT recording_id, state, round(start, 6) AS start, round(stop, 6) AS stop FROM st WHERE stop > start")
def _(spark, d):
    return six(_states(marks(spark, d)), "start", "stop").select("recording_id", "state", "start", "stop")


PAIRS = """pe AS (SELECT recording_id, onset, place, label, max(CASE WHEN label = 'hv_start' THEN onset END) OVER (PARTITION BY recording_id ORDER BY onset, place ROWS UNBOUNDED PRECEDING) AS last FROM marks WHERE label IN ('hv_start', 'hv_end')),
    pl AS (SELECT *, lag(label) OVER (PARTITION BY recording_id ORDER BY onset, place) AS before FROM pe WHERE label = 'hv_start' OR onset > last),
    hv AS (SELECT recording_id, last AS start, onset AS stop FROM pl WHERE label = 'hv_end' AND before = 'hv_start')"""


def _pairs(m):
    return I.paired(m.filter("label in ('hv_start', 'hv_end')").select("recording_id", "onset", "place", F.when(F.col("label") == "hv_start", "start").otherwise("end").alias("kind")))


@query("i07_pairs", f"{W}, {PAIRS} SELECT recording_id, round(start, 6) AS start, round(stop, 6) AS stop FROM hv")
def _(spark, d):
    return six(_pairs(marks(spark, d)), "start", "stop")


@query("i09_inferred", f"""{W}, {PAIRS}, b AS (SELECT DISTINCT hv.*, raw_end FROM hv JOIN recs USING (recording_id)),
    l AS (SELECT b.*, coalesce((SELECT min(h.start) FROM hv h WHERE h.recording_id = b.recording_id AND h.start > 0 AND h.start > b.stop + 0.1::DOUBLE), raw_end) AS lim FROM b),
    e AS (SELECT *, coalesce((SELECT max(onset) FROM marks m WHERE m.label = 'post_hv' AND m.recording_id = l.recording_id AND onset >= l.stop AND onset < lim), least(stop + 0.25::DOUBLE * (stop - start), lim)) AS fin FROM l)
    SELECT recording_id, round(stop, 8) AS start, round(fin, 8) AS stop FROM e WHERE fin - stop > 1""")
def _(spark, d):
    m = marks(spark, d)
    hv = _pairs(m)
    out = I.inferred_blocks(hv, hv.select("recording_id", "start"), m.filter("label = 'post_hv'").select("recording_id", "onset"), recordings(m))
    return out.withColumns({c: F.round(c, 8) for c in ("start", "stop")})


FLASH = """fm AS (SELECT recording_id, onset, CASE label WHEN 'hv_end' THEN 'photo_stim_' || (place % 30) || 'Hz' WHEN 'post_hv' THEN 'photo_off' END AS state FROM marks WHERE label IN ('hv_end', 'post_hv')),
    fl AS (SELECT recording_id, state, onset AS start, coalesce(lead(onset) OVER (PARTITION BY recording_id ORDER BY onset, state), raw_end) AS stop FROM fm JOIN recs USING (recording_id))"""


@query("i08_photo_blocks", f"{W}, {FLASH} SELECT recording_id, state, round(start, 6) AS start, round(stop, 6) AS stop, try_cast(nullif(regexp_extract(lower(state), '([0-9]+(?:[.][0-9]+)?) *hz', 1), '') AS DOUBLE) AS freq_hz FROM fl WHERE stop > start")
def _(spark, d):
    m = marks(spark, d)
    state = F.when(F.col("label") == "hv_end", F.concat(F.lit("photo_stim_"), F.col("place") % 30, F.lit("Hz"))).when(F.col("label") == "post_hv", "photo_off")
    blocks = I.states(m.select("recording_id", "onset", state.alias("state")).filter("state is not null"), recordings(m))
    return six(blocks.select("recording_id", "state", "start", "stop", I.frequency(F.col("state")).alias("freq_hz")), "start", "stop")


#: Parts of a base interval that no cut touches, by subtracting the merged cuts.
SEGMENTS = f"""{W}, {STATES}, {PAIRS}, eye AS (SELECT recording_id, state, start, stop FROM st WHERE stop > start),
    b AS (SELECT DISTINCT hv.*, raw_end FROM hv JOIN recs USING (recording_id)),
    l AS (SELECT b.*, coalesce((SELECT min(h.start) FROM hv h WHERE h.recording_id = b.recording_id AND h.start > 0 AND h.start > b.stop + 0.1::DOUBLE), raw_end) AS lim FROM b),
    e AS (SELECT *, coalesce((SELECT max(onset) FROM marks m WHERE m.label = 'post_hv' AND m.recording_id = l.recording_id AND onset >= l.stop AND onset < lim), least(stop + 0.25::DOUBLE * (stop - start), lim)) AS fin FROM l),
    blk AS (SELECT recording_id, start, stop, 'HV' AS block FROM hv UNION ALL SELECT recording_id, stop, fin, 'POSTHV' FROM e WHERE fin - stop > 1),
    isl AS (SELECT *, coalesce(max(stop) OVER (PARTITION BY recording_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < start, true) AS fresh FROM blk WHERE stop > start),
    num AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY recording_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS k FROM isl),
    cut AS (SELECT recording_id, min(start) AS start, max(stop) AS stop FROM num GROUP BY recording_id, k),
    base AS (SELECT recording_id, 'RAW_' || state AS segment_type, start, stop FROM eye
        UNION ALL SELECT recording_id, 'RAW_baseline', 0.0::DOUBLE, coalesce((SELECT min(onset) FROM marks m WHERE m.recording_id = recs.recording_id AND label IN ('eyes_open', 'eyes_closed')), raw_end) FROM recs),
    edge AS (SELECT base.*, cut.start AS cs, cut.stop AS ce FROM base LEFT JOIN cut ON cut.recording_id = base.recording_id AND cut.start < base.stop AND cut.stop > base.start),
    piece AS (SELECT recording_id, segment_type, coalesce(lag(ce) OVER w, start) AS start, coalesce(cs, stop) AS stop FROM edge WINDOW w AS (PARTITION BY recording_id, segment_type, start, stop ORDER BY cs)
        UNION ALL SELECT recording_id, segment_type, max(ce) AS start, stop FROM edge WHERE ce IS NOT NULL GROUP BY recording_id, segment_type, start, stop),
    parts AS (SELECT recording_id, segment_type, start, stop FROM piece WHERE stop > start
        UNION ALL SELECT blk.recording_id, block || '_' || coalesce(state, 'UNKNOWN'), greatest(blk.start, coalesce(eye.start, blk.start)), least(blk.stop, coalesce(eye.stop, blk.stop))
        FROM blk LEFT JOIN eye ON eye.recording_id = blk.recording_id AND blk.start < eye.stop AND eye.start < blk.stop)"""


@query("i10_segments", f"{SEGMENTS} SELECT recording_id, segment_type, round(start, 3) AS start, round(stop, 3) AS stop FROM parts")
def _(spark, d):
    m = marks(spark, d)
    found = I.segments(m.select("recording_id", "onset", F.col("label").alias("description")), recordings(m))
    return found.select("recording_id", "segment_type", F.round("start", 3).alias("start"), F.round("stop", 3).alias("stop"))


@query("j09_intersection", f"""{W}, {STATES}, {PAIRS} SELECT hv.recording_id, 'HV_' || coalesce(state, 'UNKNOWN') AS segment_type, round(greatest(hv.start, coalesce(st.start, hv.start)), 6) AS start, round(least(hv.stop, coalesce(st.stop, hv.stop)), 6) AS stop
    FROM hv LEFT JOIN (FROM st WHERE stop > start) st ON st.recording_id = hv.recording_id AND hv.start < st.stop AND st.start < hv.stop""")
def _(spark, d):
    m = marks(spark, d)
    return six(I.intersected(_pairs(m).withColumn("block", F.lit("HV")), _states(m).select("recording_id", "start", "stop", "state")), "start", "stop")


@query("i11_block_windows", f"""{W} SELECT recording_id, 'HV' AS block_family, CASE label WHEN 'hv_start' THEN 'EO' WHEN 'hv_end' THEN 'EC' ELSE 'UNKNOWN' END AS eye_state, round(greatest(0.0::DOUBLE, start), 6) AS start, round(least(raw_end, stop), 6) AS stop
    FROM iv JOIN recs USING (recording_id) WHERE label NOT IN ('eyes_open', 'eyes_closed') AND least(raw_end, stop) > greatest(0, start)""")
def _(spark, d):
    m = marks(spark, d)
    name = F.when(F.col("label") == "hv_start", "BLOCK_HV_EO").when(F.col("label") == "hv_end", "BLOCK_HV_EC").when(F.col("label") == "post_hv", "BLOCK_HV").otherwise("x")
    return six(I.block_windows(m.select("recording_id", "onset", F.col("length").alias("duration"), name.alias("description")), recordings(m)), "start", "stop")


@query("i12_windows", f"""{W}, {EYES} SELECT recording_id, place, count(*) AS windows, round(sum(start + k * 900), 2) AS starts FROM (SELECT recording_id, place, start, unnest(range(0, (floor((stop - start - 1800) / 900 + 1e-9) + 1)::BIGINT)) AS k FROM eyes WHERE stop - start >= 1800 - 1e-9) GROUP BY ALL""")
def _(spark, d):
    w = I.windows(_parts(spark, d)[2], 1800.0, 900.0)
    return w.groupBy("recording_id", "place").agg(F.count(F.lit(1)).alias("windows"), F.round(F.sum("start"), 2).alias("starts"))


@query("i13_epochs", f"""{W}, {BAD}, {EYES}, w AS (SELECT recording_id, start + k * 1800 AS start FROM (SELECT recording_id, start, unnest(range(0, (floor((stop - start - 1800) / 1800 + 1e-9) + 1)::BIGINT)) AS k FROM eyes WHERE stop - start >= 1800 - 1e-9)),
    o AS (SELECT recording_id, round(start * 2)::BIGINT AS start_sample, min(start) AS start, min(start + 1800) AS stop FROM w GROUP BY 1, 2)
    SELECT recording_id, start_sample, round(start, 6) AS start, round(stop, 6) AS stop FROM o WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.recording_id = o.recording_id AND o.start < b.stop AND b.start < o.stop)""")
def _(spark, d):
    _, bad, eyes = _parts(spark, d)
    return six(I.epochs(I.windows(eyes, 1800.0), bad, 2.0), "start", "stop")


@query("i14_yield", f"{W}, {EYES} SELECT place % 3 AS condition, sum(floor((stop - start) / 2000))::BIGINT AS epochs FROM eyes GROUP BY 1")
def _(spark, d):
    return I.epoch_yield(_parts(spark, d)[2].withColumn("condition", F.col("place") % 3), 2000.0, ["condition"])


@query("i15_i16_rejects", """WITH t AS (SELECT DISTINCT o_custkey AS recording_id, o_orderkey % 40 AS epoch, 'ch' || o_orderkey % 3 AS channel FROM orders WHERE o_orderstatus = 'F'),
    g AS (SELECT *, epoch - row_number() OVER (PARTITION BY recording_id, channel ORDER BY epoch) AS g FROM t)
    SELECT recording_id, min(epoch) * 2.0::DOUBLE AS onset, count(*) * 2.0::DOUBLE AS duration, 'BAD_channel' AS description, channel AS ch_names FROM g GROUP BY recording_id, channel, g
    UNION ALL SELECT DISTINCT o_custkey, (o_orderkey % 40) * 2.0::DOUBLE, 2.0, 'BAD_epoch', '' FROM orders WHERE o_orderstatus = 'P'""")
def _(spark, d):
    o = read(spark, d, "orders")
    t = o.select(F.col("o_custkey").alias("recording_id"), (F.col("o_orderkey") % 40).alias("epoch"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("ch"), F.col("o_orderkey") % 3)).alias("channel"), F.col("o_orderstatus").isin("F", "P").alias("bad"))
    return I.reject_annotations(t, 2.0).withColumn("ch_names", F.array_join("ch_names", ","))


@query("i17_chunks", """WITH n AS (SELECT o_custkey AS recording_id, o_orderkey, floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / 4)::BIGINT AS chunk FROM orders)
    SELECT * FROM n QUALIFY count(*) OVER (PARTITION BY recording_id, chunk) >= 3""")
def _(spark, d):
    return I.chunks(read(spark, d, "orders").select(F.col("o_custkey").alias("recording_id"), "o_orderkey"), "o_orderkey", 4, 3)


@query("i18_inflated", """SELECT event_id, CASE event_type WHEN 'view' THEN 5.0 WHEN 'click' THEN 3.0 WHEN 'error' THEN 3.0 ELSE 0.0 END::DOUBLE AS duration, CASE event_type WHEN 'view' THEN 'BAD_Blink' WHEN 'click' THEN 'BAD_cough' WHEN 'error' THEN 'BAD_manual' ELSE event_type END AS description FROM events""")
def _(spark, d):
    name = F.when(F.col("event_type") == "view", "BAD_Blink").when(F.col("event_type") == "click", "bad_Cough").when(F.col("event_type") == "error", "bad").otherwise(F.col("event_type"))
    return I.inflated(read(spark, d, "events").select("event_id", F.lit(0.0).alias("duration"), name.alias("description")))


@query("i19_grid_overlap", f"""{W}, c AS (SELECT DISTINCT label, recording_id, unnest(range(floor(start / 100)::BIGINT, ceil(stop / 100)::BIGINT)) AS cell FROM iv WHERE label IN ('hv_end', 'post_hv') AND stop > start)
    SELECT a.recording_id, round(100.0::DOUBLE * count(b.cell) / count(*), 6) AS overlap_pct FROM c a LEFT JOIN c b ON b.label = 'hv_end' AND a.recording_id = b.recording_id AND a.cell = b.cell WHERE a.label = 'post_hv' GROUP BY 1""")
def _(spark, d):
    s = spans(marks(spark, d))
    return six(I.grid_overlap(s.filter("label = 'hv_end'"), s.filter("label = 'post_hv'"), step=100.0), "overlap_pct")


@query("i20_recovery", f"""{W}, b1 AS (FROM iv WHERE label = 'post_hv'), b2 AS (FROM iv WHERE label = 'hv_end'), {MERGE('o', 'b1')}, {MERGE('n', 'b2')},
    x AS (SELECT o.recording_id, o.start, o.stop, coalesce(sum(least(o.stop, n.stop) - greatest(o.start, n.start)) FILTER (WHERE n.start IS NOT NULL), 0) AS shared FROM o LEFT JOIN n ON o.recording_id = n.recording_id AND o.start < n.stop AND n.start < o.stop GROUP BY ALL)
    SELECT recording_id, round(sum(stop - start), 4) AS bad_seconds, round(sum(stop - start - shared), 4) AS recovered_seconds, count(*) FILTER (WHERE shared = 0) AS recovered_segments, round(100.0::DOUBLE * sum(stop - start - shared) / sum(stop - start), 4) AS recovery_pct FROM x GROUP BY 1""")
def _(spark, d):
    s = spans(marks(spark, d)).select("recording_id", "start", "stop", "label")
    out = I.recovery(s.filter("label = 'post_hv'").drop("label"), s.filter("label = 'hv_end'").drop("label"))
    return out.withColumns({c: F.round(c, 4) for c in ("bad_seconds", "recovered_seconds", "recovery_pct")})


@query("i21_calibration", """WITH s AS (SELECT l_suppkey AS recording_id, l_linenumber AS channel, (l_orderkey * 7 + l_partkey) % 20 AS i, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
    e AS (SELECT recording_id, w, channel, var_pop(v) AS v FROM s, (SELECT unnest(range(10)) AS w) WHERE i // 2 BETWEEN w AND w + 3 GROUP BY ALL HAVING count(*) >= 8),
    f AS (SELECT recording_id, w, avg(v) AS variance, NOT (recording_id = 3 AND w < 6) AS clean FROM e GROUP BY ALL)
    SELECT recording_id, w * 1.0::DOUBLE AS start, w + 4.0::DOUBLE AS stop, round(variance / 1e6, 4) AS variance, clean FROM f QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY NOT clean, variance, w) = 1""")
def _(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("recording_id"), F.col("l_linenumber").alias("channel"), ((F.col("l_orderkey") * 7 + F.col("l_partkey")) % 20).alias("sample_idx"), F.col("l_extendedprice").alias("value"))
    signal = li.groupBy("recording_id", "channel", "sample_idx").agg(F.avg("value").alias("value"))
    bad = spark.range(1).select(F.lit(3).cast("long").alias("recording_id"), F.lit(0.0).alias("start"), F.lit(6.0).alias("stop"))
    return I.calibration(signal, bad, 2.0, 4.0).withColumn("variance", F.round(F.col("variance") / 1e6, 4))


@query("i22_crop", f"""{W}, f AS (SELECT recording_id, min(onset) AS t FROM marks WHERE label = 'eyes_open' AND onset <= 40000 GROUP BY 1) SELECT place, round(onset - coalesce(t, 0), 6) AS onset FROM marks LEFT JOIN f USING (recording_id) WHERE t IS NULL OR onset >= t""")
def _(spark, d):
    a = marks(spark, d).select("recording_id", "place", "onset", F.col("label").alias("description"))
    return six(I.crop_start(a, "eyes_open", 40000.0), "onset").select("place", "onset")


RULES = [("ignore", ["de la*"]), ("eyes", ["the", "les"]), ("photo_{f}hz", ["photo"]), ("clinical", ["der", "en", "el"])]


@query("i23_canonical", r"""WITH t AS (SELECT doc_id, regexp_replace(trim(translate(replace(lower(text), 'ß', 'q'), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')), '\s+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, CASE WHEN t LIKE 'de la%' THEN NULL WHEN regexp_matches(t, '\b(the|les)\b') THEN 'eyes' WHEN regexp_matches(t, '\bphoto\b') THEN 'photo' WHEN regexp_matches(t, '\b(der|en|el)\b') THEN 'clinical' END AS label FROM t""")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", I.canonical(F.col("text"), RULES).alias("label"))


@query("i24_event_counts", """SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL) GROUP BY 1""")
def _(spark, d):
    e = I.event_counts(read(spark, d, "events"), ["error"], ("user_id",), "event_type")
    return e.select("user_id", F.array_join(F.transform(F.map_entries("counts"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("counts"))


@query("r01_run_numbers", "SELECT o_orderkey, lpad(CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS LAST, o_orderkey) AS VARCHAR), 2, '0') AS run FROM orders")
def _(spark, d):
    return R.numbered_runs(read(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "run")


SUMMARY = f"""{W}, k AS (SELECT recording_id || '|' || label AS recording_id, start, stop FROM iv), {MERGE('m', 'k')},
    sm AS (SELECT iv.recording_id, label AS segment_type, count(DISTINCT (start, stop)) AS blocks, count(*) AS rows, coalesce((SELECT sum(stop - start) FROM m WHERE m.recording_id = iv.recording_id || '|' || label), 0) AS seconds FROM iv GROUP BY iv.recording_id, label)"""


def _summary(spark, d):
    return R.condition_summary(spans(marks(spark, d)).withColumnRenamed("label", "segment_type"), ["recording_id"])


@query("r02_conditions", f"{SUMMARY} SELECT recording_id, segment_type, blocks, rows, round(seconds, 4) AS seconds FROM sm")
def _(spark, d):
    return _summary(spark, d).withColumn("seconds", F.round("seconds", 4))


@query("r03_r04_availability", """SELECT 'high' AS category, count(*) FILTER (WHERE value > 50) AS n, round(100.0::DOUBLE * count(*) FILTER (WHERE value > 50) / count(*), 2) AS pct FROM events UNION ALL SELECT 'error', count(*) FILTER (WHERE event_type = 'error'), round(100.0::DOUBLE * count(*) FILTER (WHERE event_type = 'error') / count(*), 2) FROM events
    UNION ALL SELECT 'ids:' || c, count(*), sum(event_id)::DOUBLE FROM (SELECT 'high' AS c, event_id FROM events WHERE value > 50 UNION ALL SELECT 'error', event_id FROM events WHERE event_type = 'error') GROUP BY 1""")
def _(spark, d):
    e = read(spark, d, "events")
    tests = {"high": F.col("value") > 50, "error": F.col("event_type") == "error"}
    ids = R.missing_ids(e, "event_id", tests).groupBy(F.concat(F.lit("ids:"), "category").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum("id").cast("double").alias("pct"))
    return R.availability(e, tests).unionByName(ids)


@query("r05_event_rates", """WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT event_type AS event, count(*) AS records, sum(n)::BIGINT AS total, round(100.0::DOUBLE * count(*) / (SELECT count(DISTINCT user_id) FROM events), 2) AS pct FROM n GROUP BY 1""")
def _(spark, d):
    return R.event_rates(I.event_counts(read(spark, d, "events"), [], ("user_id",), "event_type"), "counts")


@query("r06_group_table", """SELECT coalesce(nullif(trim(o_orderpriority), ''), 'Unknown') AS "group", count(*) AS runs, count(DISTINCT o_custkey) AS subjects, round(avg(o_totalprice), 4) AS mean_seconds, round(100.0::DOUBLE * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 2) AS done FROM orders GROUP BY 1""")
def _(spark, d):
    return R.group_table(read(spark, d, "orders"), "o_orderpriority", "o_custkey", "o_totalprice", {"done": F.col("o_orderstatus") == "F"})


@query("r07_r12_day_span", "SELECT strftime(min(ts::TIME), '%H:%M:%S') AS earliest, strftime(max(ts::TIME), '%H:%M:%S') AS latest FROM events".replace("strftime(min(ts::TIME), '%H:%M:%S')", "left(min(ts::TIME)::VARCHAR, 8)").replace("strftime(max(ts::TIME), '%H:%M:%S')", "left(max(ts::TIME)::VARCHAR, 8)"))
def _(spark, d):
    return R.day_span(read(spark, d, "events"), "ts")


@query("r08_repeated", "SELECT 'h' || h AS kind, count(event_id) AS n FROM (SELECT unnest(range(24)) AS h) LEFT JOIN events ON hour(ts) = h GROUP BY 1 UNION ALL SELECT 'subjects', count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 2)")
def _(spark, d):
    h = R.hour_histogram(read(spark, d, "events"), "ts").select(F.concat(F.lit("h"), "hour").alias("kind"), "n")
    return h.unionByName(R.repeated_subjects(read(spark, d, "orders"), "o_custkey").agg(F.count(F.lit(1)).alias("n")).select(F.lit("subjects").alias("kind"), "n"))


@query("r09_totals", "SELECT count(DISTINCT o_custkey) AS subjects, count(DISTINCT (o_custkey, o_orderstatus)) AS sessions, count(*) AS runs, round(sum(o_totalprice), 2) AS total_seconds, round(avg(o_totalprice), 4) AS mean_seconds, round(median(o_totalprice), 4) AS median_seconds FROM orders")
def _(spark, d):
    return R.totals(read(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_totalprice").withColumn("total_seconds", F.round("total_seconds", 2))


@query("r10_consistency", "SELECT o_custkey, count(DISTINCT o_orderstatus) > 1 AS mixed_o_orderstatus, count(DISTINCT o_orderpriority) > 1 AS mixed_o_orderpriority FROM orders GROUP BY 1")
def _(spark, d):
    return R.consistency(read(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], ["o_custkey"])


@query("r11_type_pivot", f"""{W} SELECT label, round(coalesce(sum(stop - start) FILTER (WHERE place % 2 = 0), 0), 4) AS "0", round(coalesce(sum(stop - start) FILTER (WHERE place % 2 = 1), 0), 4) AS "1" FROM iv GROUP BY 1""")
def _(spark, d):
    t = R.type_pivot(spans(marks(spark, d)).withColumn("side", (F.col("place") % 2).cast("string")), "label", "side", ["0", "1"])
    return t.withColumns({c: F.round(c, 4) for c in ("0", "1")})


@query("r12_formats", "SELECT o_orderkey, (CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' ELSE '' END) || (CASE WHEN s >= 60 THEN (s // 60) % 60 || 'm ' ELSE '' END) || s % 60 || 's' AS span FROM (SELECT o_orderkey, floor(o_totalprice / 20)::BIGINT AS s FROM orders)")
def _(spark, d):
    return read(spark, d, "orders").select("o_orderkey", R.span(F.col("o_totalprice") / 20).alias("span"))


@query("r13_summed_counts", """WITH n AS (SELECT user_id % 10 AS subject, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT subject, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM n GROUP BY 1""")
def _(spark, d):
    c = I.event_counts(read(spark, d, "events"), [], ("user_id",), "event_type").withColumn("subject", F.col("user_id") % 10)
    s = R.summed_counts(c, ["subject"], "counts")
    return s.select("subject", F.array_join(F.transform(F.map_entries("counts"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("counts"))


@query("r14_session_rollup", f"""{SUMMARY}, r AS (SELECT recording_id, raw_end, recording_id % 20 AS subject FROM recs)
    SELECT subject, count(*) AS runs, round(sum(raw_end), 4) AS raw_seconds, arg_min(recording_id, recording_id) AS first_run, round(sum((SELECT sum(seconds) FROM sm WHERE sm.recording_id = r.recording_id)), 2) AS condition_seconds, sum((SELECT sum(blocks) FROM sm WHERE sm.recording_id = r.recording_id))::BIGINT AS blocks FROM r GROUP BY 1""")
def _(spark, d):
    m = marks(spark, d)
    runs = recordings(m).withColumn("subject", F.col("recording_id") % 20).withColumn("first_run", F.col("recording_id"))
    out = R.session_rollup(runs, _summary(spark, d).withColumn("subject", F.col("recording_id") % 20), ["subject"], "recording_id", "raw_end", ["first_run"])
    return out.withColumns({"raw_seconds": F.round("raw_seconds", 4), "condition_seconds": F.round("condition_seconds", 2)})


@query("r15_run_metrics", f"""{SUMMARY} SELECT recording_id, 'seconds:' || segment_type AS metric, round(seconds, 4) AS value FROM sm UNION ALL SELECT recording_id, 'blocks:' || segment_type, blocks FROM sm
    UNION ALL SELECT recording_id, 'coverage_pct', round(100.0::DOUBLE * u / raw_end, 4) FROM (SELECT recording_id, sum(seconds) AS u FROM sm GROUP BY 1) JOIN recs USING (recording_id)
    UNION ALL SELECT recording_id, 'discarded_seconds', round(greatest(0, raw_end - u), 4) FROM (SELECT recording_id, sum(seconds) AS u FROM sm GROUP BY 1) JOIN recs USING (recording_id)""")
def _(spark, d):
    return R.run_metrics(_summary(spark, d), recordings(marks(spark, d)), "recording_id", "raw_end").withColumn("value", F.round("value", 4))


@query("p09_ignored_events", "SELECT event_id, event_type FROM events WHERE NOT regexp_matches(event_type, '(?i)err|^sign')")
def _(spark, d):
    return read(spark, d, "events").filter(unignored("event_type", ("err", "^SIGN"))).select("event_id", "event_type")
