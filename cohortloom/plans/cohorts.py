"""Queries over patient rows: metadata, predicates, cohorts and opportunities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import predicates as P
from ..operators import cohort as C
from ..operators import joins as J
from ..operators import opportunities as O
from ..sources import tables as S
from ..session import scratch
from .derive import SQL, WITH, clean, patients, query, raw, read

COLUMNS = ["study_id", "patient_id", "source_dataset", "eeg_date", "first_eeg", "age", "age_group", "sex", "adhd", "autism", "epilepsy", "combined_diagnosis", "psychostimulant", "psychostimulant_category", "asm", "asm_types", "other_asm", "meds_summary", "asm_resistant", "drop_reason"]


@query("m01_m12_waterfall", f"{WITH} SELECT {', '.join(COLUMNS)} FROM allrows")
def _(spark, d):
    return patients(spark, d).select(*COLUMNS)


@query("m12_s12_removed", f"""{WITH}, r AS (SELECT * FROM allrows WHERE drop_reason IS NOT NULL)
    SELECT 'all' AS kind, 'all' AS value, count(*) AS n FROM r UNION ALL SELECT 'reason', drop_reason, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'source', source_dataset, count(*) FROM r GROUP BY 2""")
def _(spark, d):
    return S.removed_summary(patients(spark, d), "drop_reason", "source_dataset")


@query("m13_group_ids", f"""{WITH}, k AS (SELECT *, CASE WHEN patient_id IS NOT NULL THEN 'patient:' || patient_id ELSE 'missing_patient_study:' || study_id END AS key FROM allrows WHERE patient_id IS NOT NULL OR study_id IS NOT NULL),
    g AS (SELECT key, row_number() OVER (ORDER BY bool_or(drop_reason IS NULL) DESC, key) - 1 AS patient_group_id FROM k GROUP BY key)
    SELECT study_id, patient_id, patient_group_id FROM k JOIN g USING (key)""")
def _(spark, d):
    df = patients(spark, d).filter("patient_id is not null or study_id is not null")
    return M.group_ids(df, F.col("drop_reason").isNull()).select("study_id", "patient_id", "patient_group_id")


@query("m14_m18_names", """SELECT c_custkey, CAST(c_custkey AS STRING) AS subject, lpad(CAST(c_custkey AS STRING), greatest(4, length(CAST(c_custkey AS STRING)))::INT, '0') AS padded, regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g') AS token,
    CASE c_custkey % 3 WHEN 0 THEN 'bids:///sub-1/x.csv' WHEN 1 THEN 'relative:///a/b' ELSE 'external:///y.csv' END AS path,
    'subject-' || c_custkey || '_session-01_run-' || c_nationkey AS recording_id, CASE WHEN c_mktsegment ILIKE 'eo%' THEN 'EO' WHEN c_mktsegment ILIKE 'ec%' THEN 'EC' ELSE c_mktsegment END AS eye FROM customer""")
def _(spark, d):
    k = F.col("c_custkey")
    spelled = F.when(k % 2 == 0, F.concat(F.lit("sub-"), F.lpad(k.cast("string"), 8, "0"))).otherwise(F.lpad(k.cast("string"), 8, "0"))
    path = F.when(k % 3 == 0, "/data/bids/sub-1/x.csv").when(k % 3 == 1, "a/b").otherwise("/other/y.csv")
    ids = read(spark, d, "customer").withColumn("session", F.lit("01")).withColumn("p", path)
    return ids.select("c_custkey", M.subject(spelled).alias("subject"), M.padded_subject(spelled).alias("padded"), M.token(F.col("c_name")).alias("token"), M.portable_path(F.col("p"), "/data/bids").alias("path"), M.recording_id("c_custkey", "session", "c_nationkey").alias("recording_id"), M.eye_state(F.col("c_mktsegment")).alias("eye"))


@query("p01_row_filter", f"{WITH} SELECT study_id, sex, age FROM clean WHERE (sex IS NULL OR sex <> 'F') AND age >= 3 AND source_dataset IN ('adhd') AND (patient_id IS NULL OR patient_id NOT IN (1003, 1006))")
def _(spark, d):
    tests = [("sex", "!=", "F"), ("age", ">=", 3), ("source_dataset", "==", ["adhd"]), ("patient_id", "not in", [1003, 1006])]
    return P.rows(clean(spark, d), [{"column": c, "operator": o, "values": v} for c, o, v in tests]).select("study_id", "sex", "age")


@query("p02_cohort_filter", f"{WITH} SELECT study_id, combined_diagnosis, asm FROM clean WHERE ((adhd = 1 AND psychostimulant = 0) OR combined_diagnosis = 'Control') AND age_group IN ('5-8', '9-12')")
def _(spark, d):
    return P.cohort(clean(spark, d), [{"adhd": 1, "psychostimulant": 0}, {"combined_diagnosis": "Control"}], {"age_group": ["5-8", "9-12"]}).select("study_id", "combined_diagnosis", "asm")


@query("p03_p06_pools", f"{WITH} SELECT " + ", ".join(f"count(*) FILTER (WHERE {p}) AS {n}" for n, p in [*[(f"is_{k}", v) for k, v in P.CONSTRAINTS.items()], *[(k, v[4]) for k, v in P.POOLS.items()]]) + " FROM clean")
def _(spark, d):
    df = clean(spark, d)
    held = P.constraint_columns(df).agg(*[F.count_if(f"is_{n}").alias(f"is_{n}") for n in P.CONSTRAINTS])
    return held.crossJoin(P.pool_counts(df))


def _status(names: set[str]) -> str:
    bad, spare = "contradictory_constraints", "redundant_constraint_set"
    if len(names & set(P.EXCLUSIVE)) > 1 or len(names & set(P.SINGLE_STIMULANTS)) > 1 or {"Combined_Amphetamine", "Methylphenidate"} <= names:
        return bad
    if "Combined_Amphetamine" in names and names & {"Dextroamphetamine", "Lisdexamfetamine"}:
        return spare
    return spare if any(set(p) <= names for p in P.IMPLIES) else bad if any(set(p) <= names for p in P.CONTRADICTS) else ""


_arms = ", ".join(
    f"CASE WHEN {' AND '.join('(' + P.CONSTRAINTS[n] + ')' for n in c.split('+'))} THEN {{'spec': {i}, 'one': coalesce({one}, false), 'two': coalesce({two}, false)}} END"
    for i, (c, one, two) in enumerate((s, x[3], x[4]) for x in P.COMPARISONS for s in x[5])
)
_specs = ", ".join(f"({i}, '{a}', '{g1}', '{g2}', '{c}', {repr(s) if (s := _status(set(c.split('+')))) else 'NULL'})" for i, a, g1, g2, c in O.SPECS)
_q = lambda names: ", ".join(f"'{n}'" for n in names)
OPPORTUNITIES = f"""{WITH}, spec(spec, analysis, group_1, group_2, "constraint", status) AS (VALUES {_specs}),
    m AS (SELECT study_id, patient_id, unnest(list_filter(['All', CASE sex WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female' END], lambda x: x IS NOT NULL)) AS sex, age_group, list_filter([{_arms}], lambda x: x IS NOT NULL) AS met FROM clean),
    r AS (SELECT study_id, patient_id, sex, age_group, unnest(met) AS a FROM (SELECT study_id, patient_id, sex, unnest(list_filter(['All', age_group], lambda x: x IS NOT NULL)) AS age_group, met FROM m)),
    p AS (SELECT *, a.spec AS spec, a.one AS one, a.two AS two, bool_or(a.one) OVER w AND bool_or(a.two) OVER w AND patient_id IS NOT NULL AS both_arms FROM r WINDOW w AS (PARTITION BY sex, age_group, a.spec, patient_id)),
    q AS (SELECT p.*, analysis <> '{O.LONGITUDINAL}' OR both_arms AS counts, analysis = '{O.LONGITUDINAL}' AS pairs FROM p JOIN spec USING (spec)),
    s AS (SELECT sex, age_group, spec, count(*) AS cohort_n, count(*) FILTER (WHERE counts AND one) AS n1, count(*) FILTER (WHERE counts AND two) AS n2, count(DISTINCT patient_id) FILTER (WHERE counts AND pairs) AS paired_patients,
          coalesce(string_agg(study_id::VARCHAR, ',' ORDER BY study_id) FILTER (WHERE counts AND one), '') AS ids1, coalesce(string_agg(study_id::VARCHAR, ',' ORDER BY study_id) FILTER (WHERE counts AND two), '') AS ids2 FROM q GROUP BY ALL),
    grid AS (SELECT * FROM (VALUES ('All', 0), ('Male', 1), ('Female', 2)) x(sex, sp) CROSS JOIN (SELECT DISTINCT age_group, split_part(age_group, '-', 1)::INT AS ap FROM clean WHERE age_group IS NOT NULL UNION ALL SELECT 'All', -1) CROSS JOIN spec),
    j AS (SELECT grid.*, CASE WHEN status IS NULL THEN coalesce(cohort_n, 0) ELSE 0 END AS cohort_n, CASE WHEN status IS NULL THEN coalesce(n1, 0) ELSE 0 END AS n1, CASE WHEN status IS NULL THEN coalesce(n2, 0) ELSE 0 END AS n2,
          CASE WHEN status IS NULL THEN coalesce(paired_patients, 0) ELSE 0 END AS paired_patients, ids1, ids2 FROM grid LEFT JOIN s USING (sex, age_group, spec)),
    t AS (SELECT *, CASE WHEN status IS NOT NULL THEN status WHEN cohort_n = 0 THEN 'empty_filtered_cohort'
          WHEN n1 = 0 OR n2 = 0 THEN CASE WHEN analysis = '{O.LONGITUDINAL}' THEN 'insufficient_longitudinal_pairs' WHEN analysis IN ({_q(O.BY_CATEGORY)}) OR (analysis IN ({_q(O.BY_SECOND_ARM)}) AND n2 = 0) THEN 'insufficient_category_support' ELSE 'one_group_empty' END
          WHEN CASE WHEN analysis = '{O.LONGITUDINAL}' THEN paired_patients < 3 ELSE n1 < 3 OR n2 < 3 END THEN 'too_small_group' WHEN ids1 = ids2 THEN 'same_group_membership' END AS reason FROM j),
    u AS (SELECT *, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY analysis, ids1, ids2, reason IS NULL ORDER BY sp, ap, spec) > 1 THEN 'redundant_constraint_set' END) AS skip_reason FROM t)"""


@query("o01_o04_opportunities", f"""{OPPORTUNITIES} SELECT analysis, sex, age_group, "constraint", group_1, group_2, cohort_n, n1, n2, paired_patients, skip_reason IS NULL AS is_valid, skip_reason FROM u""")
def _(spark, d):
    df = clean(spark, d).filter("study_id is not null")
    return O.ordered(O.opportunities(df, 3))


SQL["o01_o04_opportunities"] = SQL["o01_o04_opportunities"].replace("AS (SELECT * FROM allrows WHERE drop_reason IS NULL)", "AS (SELECT * FROM allrows WHERE drop_reason IS NULL AND study_id IS NOT NULL)")
#: O6, fixed values: arm sizes that each comparison needs at 1500, 2000, 3000 and 5000 rows.
ONE_TO_ONE = ((75, 75), (125, 125), (200, 200), (400, 400))
MONO, DRUG = ((125, 125), (175, 175), (300, 300), (575, 575)), ((100, 75), (150, 125), (200, 200), (200, 400))
UNMED_MONO = ((100, 125), (150, 175), (200, 300), (200, 575))
REQUIRED = {
    "ADHD_Psychostim_Effect_Any": ((100, 150), (150, 250), (200, 400), (200, 800)),
    "ADHD_Psychostim_Effect_Methylphenidate": DRUG, "ADHD_Psychostim_Effect_Lisdexamfetamine": DRUG, "ADHD_Psychostim_Effect_Dextroamphetamine": DRUG,
    "ADHD_Methylphenidate_vs_Lisdexamfetamine": ONE_TO_ONE, "ADHD_Methylphenidate_vs_Amphetamine": ONE_TO_ONE,
    "Control_vs_ADHD_Medicated_Any": ((150, 150), (250, 250), (400, 400), (800, 800)),
    "Control_vs_ADHD_Methylphenidate": ONE_TO_ONE, "Control_vs_ADHD_Lisdexamfetamine": ONE_TO_ONE, "Control_vs_ADHD_Amphetamine": ONE_TO_ONE,
    "Epilepsy_ASM_Effect_Any": ((100, 250), (150, 350), (200, 600), (200, 1150)), "Epilepsy_ASM_Effect_LEV_Only": UNMED_MONO, "Epilepsy_ASM_Effect_VPA_Only": UNMED_MONO,
    "Epilepsy_LEV_vs_VPA_Only": MONO,
    "NonEpilepsy_vs_Epilepsy_Unmedicated": ((100, 100), (150, 150), (200, 200), (200, 200)), "NonEpilepsy_vs_Epilepsy_ASM_Any": ((250, 250), (350, 350), (600, 600), (1150, 1150)),
    "NonEpilepsy_vs_Epilepsy_LEV_Only": MONO, "NonEpilepsy_vs_Epilepsy_VPA_Only": MONO, "DrugResistance_Status": ((150, 100), (200, 150), (350, 250), (700, 450)),
}
_need = [(a, m, *n) for a, ns in REQUIRED.items() for m, n in zip(P.MILESTONES, ns, strict=True)]


@query("o05_o09_projection", f"""{OPPORTUNITIES.replace('drop_reason IS NULL)', 'drop_reason IS NULL AND study_id IS NOT NULL)')},
    need(analysis, milestone, need1, need2) AS (VALUES {', '.join(map(str, _need))}),
    tr AS (SELECT analysis || '|' || "constraint" AS label, analysis, n1, n2 FROM u WHERE sex = 'All' AND age_group = 'All' AND skip_reason IS NULL AND analysis IN (SELECT analysis FROM need)),
    pr AS (SELECT label, tr.analysis, n.milestone, greatest(0, n.milestone - 1200) AS rows_to_add, n1, n2, floor(n1 * greatest(1.0::DOUBLE, n.milestone / 1200.0::DOUBLE))::BIGINT AS projected1, floor(n2 * greatest(1.0::DOUBLE, n.milestone / 1200.0::DOUBLE))::BIGINT AS projected2,
           n.need1, n.need2, t.need1 AS t1, t.need2 AS t2 FROM tr JOIN need n USING (analysis) JOIN need t ON t.analysis = tr.analysis AND t.milestone = 1500),
    z AS (SELECT *, greatest(0, need1 - projected1) AS short1, greatest(0, need2 - projected2) AS short2, projected1 >= need1 AND projected2 >= need2 AS feasible FROM pr)
    SELECT label, analysis, CASE WHEN analysis = 'DrugResistance_Status' THEN 'Drug Resistance' WHEN analysis LIKE '%ADHD%' THEN 'ADHD' WHEN analysis LIKE '%Epilepsy%' THEN 'Epilepsy' ELSE 'Other' END AS family, milestone, rows_to_add, n1, n2, projected1, projected2, need1, need2, short1, short2, feasible,
           feasible AND NOT coalesce(lag(feasible) OVER (PARTITION BY label ORDER BY milestone), n1 >= t1 AND n2 >= t2) AS newly_feasible,
           CASE WHEN feasible THEN 'none' WHEN short1 > 0 AND short2 > 0 THEN 'both' WHEN short1 > 0 THEN 'group_1' ELSE 'group_2' END AS limiting_group FROM z""")
def _(spark, d):
    found = scratch(O.opportunities(clean(spark, d).filter("study_id is not null"), 3), "opportunities")
    required = spark.createDataFrame(_need, "analysis string, milestone int, need1 int, need2 int")
    names = found.filter("is_valid and sex = 'All' and age_group = 'All'").join(F.broadcast(required.select("analysis").distinct()), "analysis", "left_semi")
    tracked = O.resolved(found, names.select("analysis", "constraint", "sex", "age_group")).select(F.concat_ws("|", "analysis", "constraint").alias("label"), "analysis", "n1", "n2")
    return O.projection(tracked, required, 1200)


@query("o08_pools", f"""{WITH}, p(pool, depth, parent, milestone, target_n) AS (VALUES {', '.join(str((k, v[1], v[2] or '', m, t)) for k, v in P.POOLS.items() for m, t in zip(P.MILESTONES, v[3], strict=True))}),
    c AS (UNPIVOT (SELECT {', '.join(f"count(*) FILTER (WHERE {v[4]}) AS {k}" for k, v in P.POOLS.items())} FROM clean) ON COLUMNS(*) INTO NAME pool VALUE current_n),
    g AS (SELECT p.*, current_n, greatest(0, target_n - current_n) AS raw_gap FROM p JOIN c USING (pool)),
    d2 AS (SELECT *, 0::BIGINT AS child_planned, raw_gap AS net_needed FROM g WHERE depth = 2),
    d1 AS (SELECT *, greatest(0, raw_gap - child_planned) AS net_needed FROM (SELECT g.*, coalesce(x.s, 0)::BIGINT AS child_planned FROM g LEFT JOIN (SELECT parent, milestone, sum(net_needed) AS s FROM d2 GROUP BY ALL) x ON x.parent = g.pool AND x.milestone = g.milestone WHERE depth = 1)),
    d0 AS (SELECT *, greatest(0, raw_gap - child_planned) AS net_needed FROM (SELECT g.*, coalesce(x.s, 0)::BIGINT AS child_planned FROM g LEFT JOIN (SELECT parent, milestone, sum(net_needed) AS s FROM d1 GROUP BY ALL) x ON x.parent = g.pool AND x.milestone = g.milestone WHERE depth = 0))
    SELECT milestone, pool, depth, nullif(parent, '') AS parent, current_n, target_n, raw_gap, child_planned, net_needed FROM (FROM d2 UNION ALL FROM d1 UNION ALL FROM d0)""")
def _(spark, d):
    return O.pools(clean(spark, d))


@query("c01_c03_summary", f"""{WITH} SELECT (SELECT count(*) FROM clean) AS rows, (SELECT count(DISTINCT source_dataset) FROM clean) AS sources, (SELECT round(avg(age), 2) FROM clean) AS mean_age, (SELECT round(median(age), 2) FROM clean) AS median_age,
    string_agg(combined_diagnosis || '=' || n, ', ' ORDER BY combined_diagnosis || '=' || n) AS counts FROM (SELECT combined_diagnosis, count(*) AS n FROM clean GROUP BY 1)""")
def _(spark, d):
    return C.summary(clean(spark, d), "combined_diagnosis")


@query("c02_prevalence", f"""{WITH}, f AS (UNPIVOT (SELECT count(*) AS rows, sum(adhd) AS adhd, sum(autism) AS autism, sum(epilepsy) AS epilepsy FROM clean) ON adhd, autism, epilepsy INTO NAME diagnosis VALUE n) SELECT diagnosis, n::BIGINT AS n, round(100.0::DOUBLE * n / rows, 2) AS pct FROM f""")
def _(spark, d):
    return C.prevalence(clean(spark, d), ["adhd", "autism", "epilepsy"])


STIMULANTS = ["No Psychostimulant", "Lisdexamfetamine", "Methylphenidate", "Lisdexamfetamine + Methylphenidate", "Dextroamphetamine"]


@query("c03_value_counts", f"""{WITH} SELECT v AS value, count(study) AS n FROM (SELECT unnest({STIMULANTS}) AS v) LEFT JOIN (SELECT psychostimulant_category, 1 AS study FROM clean) ON v = psychostimulant_category GROUP BY 1""")
def _(spark, d):
    return C.value_counts(clean(spark, d), "psychostimulant_category", STIMULANTS)


@query("c04_demographics", f"""{WITH}, f AS (UNPIVOT (SELECT count(*)::DOUBLE AS rows, count(*) FILTER (WHERE sex = 'M')::DOUBLE AS male, count(*) FILTER (WHERE sex = 'F')::DOUBLE AS female, count(*) FILTER (WHERE sex IS NULL)::DOUBLE AS unknown_sex, round(avg(age), 2) AS mean_age, round(median(age), 2) AS median_age, min(age) AS min_age, max(age) AS max_age FROM clean) ON COLUMNS(*) INTO NAME metric VALUE value)
    SELECT metric, value, -1 AS place FROM f UNION ALL SELECT 'age_group:' || age_group, count(*)::DOUBLE, split_part(age_group, '-', 1)::INT FROM clean WHERE age_group IS NOT NULL GROUP BY age_group""")
def _(spark, d):
    return C.demographics(clean(spark, d))


@query("c05_medication", f"""{WITH} UNPIVOT (SELECT count(*)::DOUBLE AS rows, count(*) FILTER (WHERE psychostimulant = 1)::DOUBLE AS psychostimulant, count(*) FILTER (WHERE asm = 1)::DOUBLE AS asm, count(*) FILTER (WHERE asm = 1 AND psychostimulant = 1)::DOUBLE AS "both", count(*) FILTER (WHERE asm = 0 AND psychostimulant = 0)::DOUBLE AS neither,
    count(*) FILTER (WHERE asm_resistant = 1)::DOUBLE AS asm_resistant, count(*) FILTER (WHERE asm = 1 AND asm_types NOT LIKE '%+%')::DOUBLE AS single_asm FROM clean) ON COLUMNS(*) INTO NAME metric VALUE value""")
def _(spark, d):
    return C.medication(clean(spark, d))


@query("c06_resistance", f"""{WITH}, e AS (SELECT *, 'all' AS population FROM clean UNION ALL SELECT *, 'resistant' FROM clean WHERE asm_resistant = 1),
    p AS (SELECT population, patient_id, count(*) AS n, count(*) FILTER (WHERE first_eeg = 1) AS f, count(*) FILTER (WHERE first_eeg = 0) AS l, sum(adhd) AS a, sum(autism) AS u, sum(epilepsy) AS e FROM e GROUP BY ALL),
    w AS (SELECT population, sum(n)::BIGINT AS recordings, count(patient_id) AS patients, sum(f)::BIGINT AS first_recordings, sum(l)::BIGINT AS later_recordings, count(patient_id) FILTER (WHERE f > 0 AND l > 0) AS patients_both_kinds, count(patient_id) FILTER (WHERE n >= 2) AS patients_repeated,
      coalesce(max(n) FILTER (WHERE patient_id IS NOT NULL), 0) AS most_recordings, sum(a)::BIGINT AS adhd, sum(u)::BIGINT AS autism, sum(e)::BIGINT AS epilepsy FROM p GROUP BY 1) UNPIVOT w ON COLUMNS(* EXCLUDE population) INTO NAME metric VALUE value""")
def _(spark, d):
    return C.resistance_overview(clean(spark, d))


@query("c07_first_later", f"""{WITH} SELECT CASE first_eeg WHEN 1 THEN 'first' ELSE 'later' END AS kind, count(*) AS n, sum(adhd)::BIGINT AS adhd, sum(epilepsy)::BIGINT AS epilepsy, sum(asm)::BIGINT AS asm, round(avg(age), 2) AS mean_age, round(median(age), 2) AS median_age FROM clean GROUP BY 1""")
def _(spark, d):
    return C.first_versus_later(clean(spark, d))


@query("c08_source_overlap", f"""{WITH} SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_adhd' ELSE 'only_drug_resistant' END AS overlap, count(*) AS n FROM (SELECT bool_or(source_dataset = 'adhd') AS a, bool_or(source_dataset = 'drug_resistant') AS b FROM clean WHERE patient_id IS NOT NULL GROUP BY patient_id) GROUP BY 1""")
def _(spark, d):
    return C.source_overlap(clean(spark, d), "patient_id", "source_dataset", "adhd", "drug_resistant")


@query("c09_longitudinal", f"""{WITH} SELECT patient_id, count(*) AS n, sum(first_eeg)::BIGINT AS n_first, count(*) - sum(first_eeg)::BIGINT AS n_later, string_agg(coalesce(study_id::VARCHAR, ''), ',' ORDER BY eeg_date, study_id NULLS FIRST) AS study_ids, string_agg(eeg_date, ',' ORDER BY eeg_date, study_id) AS dates
    FROM clean WHERE patient_id IS NOT NULL GROUP BY 1 HAVING sum(first_eeg) > 0 AND sum(first_eeg) < count(*)""")
def _(spark, d):
    return C.longitudinal(clean(spark, d))


@query("c10_crosstab", f"""{WITH} SELECT age_group, count(*) FILTER (WHERE sex = 'M') AS "M", count(*) FILTER (WHERE sex = 'F') AS "F" FROM clean WHERE age_group IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return C.crosstab(clean(spark, d), "age_group", "sex", ["M", "F"])


@query("c11_timeline", f"""{WITH} SELECT strftime(date_trunc('month', eeg_date::DATE), '%Y-%m-%d') AS month, source_dataset, count(*) AS n FROM clean GROUP BY ALL""")
def _(spark, d):
    return C.timeline(clean(spark, d), F.try_to_date("eeg_date", "yyyy-MM-dd"), "source_dataset").withColumn("month", F.date_format("month", "yyyy-MM-dd"))


@query("c12_provenance", f"""{WITH} SELECT drop_reason AS reason, CASE drop_reason WHEN 'no_eeg_files' THEN 'No recording' ELSE drop_reason END AS label, count(*) AS n FROM allrows WHERE drop_reason IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    return C.provenance(patients(spark, d), "drop_reason", {"no_eeg_files": "No recording"})


@query("c13_class_cohort", f"""{WITH}, f AS (SELECT *, row_number() OVER (PARTITION BY coalesce('p' || patient_id, 's' || study_id) ORDER BY study_id NULLS FIRST, combined_diagnosis) AS r FROM clean)
    SELECT combined_diagnosis AS class, count(*) AS n, round(avg(age), 6) AS mean_age, round(stddev_pop(age), 6) AS sd_age, count(*) FILTER (WHERE sex = 'M') AS male, count(*) FILTER (WHERE sex = 'F') AS female, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS pct FROM f WHERE r = 1 GROUP BY 1""")
def _(spark, d):
    return C.class_cohort(clean(spark, d), "combined_diagnosis").withColumns({c: F.round(c, 6) for c in ("mean_age", "sd_age")})


@query("c14_age_boxes", f"""{WITH} SELECT combined_diagnosis, count(*) AS n, min(age) AS low, round(quantile_cont(age, 0.25), 6) AS q1, round(quantile_cont(age, 0.5), 6) AS median, round(quantile_cont(age, 0.75), 6) AS q3, max(age) AS high FROM clean WHERE age IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return C.age_boxes(clean(spark, d), "combined_diagnosis").withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query("j01_j02_enrichment", """SELECT o_orderkey, c_name, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'fast' ELSE 'slow' END AS speed FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def _(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    table = spark.createDataFrame([("1-URGENT", "fast"), ("2-HIGH", "fast"), ("3-MEDIUM", "slow"), ("4-NOT SPECIFIED", "slow"), ("5-LOW", "slow")], "o_orderpriority string, speed string")
    return J.enriched(J.lookup(o, table, ["o_orderpriority"]), read(spark, d, "customer"), "o_custkey", "c_custkey").select("o_orderkey", "c_name", "speed")


@query("j03_resolution", f"""{WITH}, m AS (SELECT * FROM clean), st AS (SELECT DISTINCT study_id AS s FROM m WHERE study_id IS NOT NULL), pt AS (SELECT patient_id AS p, min(study_id) AS ps FROM m WHERE patient_id IS NOT NULL GROUP BY 1)
    SELECT o_orderkey, coalesce(a.s, CASE WHEN pt.p IS NOT NULL THEN ps ELSE f.s END) AS resolved_study_id, CASE WHEN a.s IS NOT NULL THEN 'study_id' WHEN pt.p IS NOT NULL THEN 'patient_id' WHEN f.s IS NOT NULL THEN 'folder_id' END AS resolved_by,
           CASE WHEN a.s IS NULL AND pt.p IS NULL AND f.s IS NULL THEN 'unresolved_subject' ELSE 'ready' END AS status
    FROM orders LEFT JOIN st a ON o_custkey = a.s LEFT JOIN pt ON 1000 + o_custkey % 900 = pt.p LEFT JOIN st f ON o_orderkey % 2000 = f.s AND o_orderstatus = 'F'""")
def _(spark, d):
    rec = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("study_id"), (1000 + F.col("o_custkey") % 900).alias("patient_id"), (F.col("o_orderkey") % 2000).alias("folder_id"), F.when(F.col("o_orderstatus") == "F", "drug_resistant").otherwise("adhd").alias("source"))
    return J.resolved(rec, clean(spark, d).select("study_id", "patient_id")).select("o_orderkey", "resolved_study_id", "resolved_by", "status")


@query("j10_both_arms", f"""{WITH} SELECT study_id, patient_id, first_eeg FROM clean WHERE patient_id IN (SELECT patient_id FROM clean GROUP BY 1 HAVING count(DISTINCT first_eeg) = 2)""")
def _(spark, d):
    return J.in_both_arms(clean(spark, d).filter("patient_id is not null"), "patient_id", "first_eeg").select("study_id", "patient_id", "first_eeg")


@query("s01_two_sources", "SELECT s_suppkey::VARCHAR AS study_id, s_name AS name, 'a' AS source_dataset, '0' AS first_eeg FROM supplier UNION ALL SELECT c_custkey::VARCHAR, c_name, 'b', '0' FROM customer")
def _(spark, d):
    a = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("Study ID"), F.col("s_name").alias("Name"))
    b = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("ID"), F.col("c_name").alias("Patient"))
    return S.two_sources(S.renamed(a, {"Study ID": "study_id", "Name": "name"}, {"first_eeg": "0"}, "a"), S.renamed(b, {"ID": "study_id", "Patient": "name"}, {"first_eeg": "0"}, "b"))


@query("s09_participants", f"""{WITH} SELECT patient_id, age, sex FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY age NULLS FIRST, sex NULLS FIRST) AS r FROM clean WHERE patient_id IS NOT NULL) WHERE r = 1""")
def _(spark, d):
    return S.participants(clean(spark, d).filter("patient_id is not null"), "patient_id", ["age", "sex"])


@query("s10_upsert", "SELECT o_custkey, o_orderstatus, max(o_totalprice) AS value, 'new' AS tag FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2 UNION ALL SELECT o_custkey, o_orderstatus, min(o_totalprice), 'old' FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2")
def _(spark, d):
    o = read(spark, d, "orders")
    cell = lambda df, f, tag: df.groupBy("o_custkey", "o_orderstatus").agg(f("o_totalprice").alias("value")).withColumn("tag", F.lit(tag))
    return S.upserted(cell(o, F.min, "old"), cell(o.filter("o_orderstatus = 'F'"), F.max, "new"), ["o_custkey", "o_orderstatus"])


@query("s11_last_wins", "SELECT o_custkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1")
def _(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderdate")
    return S.last_wins(o.filter("o_orderdate < timestamp '1999-01-01'"), o.filter("o_orderdate >= timestamp '1999-01-01'"), ["o_custkey"], "o_orderdate", ["o_custkey"])


@query("s07_path_entities", """SELECT page_id, nullif(regexp_extract('sub-' || page_id || '/ses-02/eeg/x_task-' || regexp_extract(url, '/([a-z]{2})/', 1), '(^|[_/])sub-([A-Za-z0-9]+)', 2), '') AS sub, '02' AS ses, nullif(regexp_extract(url, '/([a-z]{2})/', 1), '') AS task FROM pages""")
def _(spark, d):
    p = read(spark, d, "pages").withColumn("path", F.concat(F.lit("sub-"), "page_id", F.lit("/ses-02/eeg/x_task-"), F.regexp_extract("url", "/([a-z]{2})/", 1)))
    e = S.entities(F.col("path"))
    return p.select("page_id", e["sub"].alias("sub"), e["ses"].alias("ses"), e["task"].alias("task"))


def entry(spark, sf_dir):
    """Prevalence after the removal waterfall."""
    return C.prevalence(clean(spark, sf_dir), ["adhd", "autism", "epilepsy"])


__all__ = ["entry", "raw"]
