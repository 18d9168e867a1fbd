import pytest
from pyspark.sql import functions as F

from cohortloom.functions import metadata as M
from cohortloom.functions import predicates as P
from cohortloom.operators import opportunities as O


def col(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_flags(spark):
    raw = ["1", "1.0", "0", "2", "0 (potentiel)", None, "", "NaN"]
    assert col(spark, raw, M.flag) == [1, 1, 0, 0, None, None, None, None]
    assert col(spark, raw, M.flag_or_zero) == [1, 1, 0, 0, 0, 0, 0, 0]


def test_ages(spark):
    assert col(spark, ["04m16d", "07y00m", "08y00m", "1y6m12d", "8y3m", "10", "7.5", "adult", "", None, "N/A"], M.age_years) == [0.38, 7.0, 8.0, 1.53, 8.25, 10.0, 7.5, None, None, None, None]
    assert col(spark, [0.0, 4.99, 5.0, 8.9, 9.0, 12.9, 13.0, 18.9, 19.0, -1.0, None], M.age_group, "double") == ["0-4", "0-4", "5-8", "5-8", "9-12", "9-12", "13-18", "13-18", None, None, None]


def test_names(spark):
    assert col(spark, [" m ", "F", "", None], M.sex) == ["M", "F", None, None]
    assert col(spark, ["1", "0001", "sub-0001", "sub-0"], M.subject) == ["1", "1", "1", "0"]
    assert col(spark, ["7", "sub-12345"], M.padded_subject) == ["0007", "12345"]
    assert col(spark, ["EO_base", "ec2", "HV"], M.eye_state) == ["EO", "EC", "HV"]
    with pytest.raises(Exception, match="not a subject"):
        col(spark, ["x1"], M.padded_subject)
    with pytest.raises(Exception, match="empty token"):
        col(spark, ["--"], M.token)


def raw_row(**over):
    base = {"study_id": "1", "patient_id": "1001", "source_dataset": "adhd", "eeg_date": "1/1/2024", "first_eeg": "0", "age": "10", "sex": "F", "adhd": "0", "autism": "0", "epilepsy": "0",
            "psychostimulant_description": None, "psychostimulant_code": None, "other_asm": None, "asm_resistant": None, **dict.fromkeys(M.DRUGS)}
    return {**base, **over}


def test_waterfall_takes_the_first_rule(spark):
    rows = [
        raw_row(study_id="1", adhd="1", psychostimulant_description="Methylphenidate - Ritalin", psychostimulant_code="2"), raw_row(study_id="2", adhd="0 (Potentiel)", eeg_date="no eeg"),
        raw_row(study_id="3", eeg_date=" seeg "), raw_row(study_id="4", adhd=""), raw_row(study_id="5", LEV="1.0"), raw_row(study_id="6", epilepsy="1", LEV="1", VPA="1"), raw_row(study_id="77"),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{k} string" for k in rows[0]))
    got = {r.study_id: r for r in M.normalised(df, excluded=(77,)).collect()}
    assert {k: r.drop_reason for k, r in got.items()} == {1: None, 2: "non_confirmed_diagnosis", 3: "no_eeg_files", 4: "missing_diagnosis", 5: "medication_mismatch", 6: None, 77: "missing_or_corrupt_eeg_file"}
    assert (got[1].combined_diagnosis, got[1].psychostimulant_category, got[1].meds_summary) == ("ADHD", "Methylphenidate", "Psychostim")
    assert (got[6].asm_types, got[6].meds_summary, got[6].age_group) == ("LEV+VPA", "ASM", "9-12")
    with pytest.raises(Exception, match="unknown medication pair"):
        M.normalised(spark.createDataFrame([raw_row(psychostimulant_description="new", psychostimulant_code="9")], df.schema)).collect()


def test_group_ids_sort_as_text_clean_first(spark):
    df = spark.createDataFrame([(1, 10, True), (2, 9, True), (3, 10, False), (4, 1, False), (5, None, True)], "study_id long, patient_id long, ok boolean")
    got = {r.study_id: r.patient_group_id for r in M.group_ids(df, F.col("ok")).collect()}
    assert got == {5: 0, 1: 1, 3: 1, 2: 2, 4: 3}


def test_row_filter_keeps_missing_for_negations(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, v string")
    ids = lambda op, v: sorted(r.i for r in P.rows(df, [{"column": "v", "operator": op, "values": v}]).collect())
    assert ids("!=", "a") == [2, 3] and ids("not in", ["a"]) == [2, 3] and ids("==", ["a", "b"]) == [1, 2] and ids("==", "a") == [1] and ids(">", "a") == [2]
    with pytest.raises(ValueError, match="unknown operator"):
        ids("~", "a")


def test_constraint_sets(spark):
    sets = ["No_Constraint", "No_ADHD+Psychostim_False", "No_ADHD+Methylphenidate", "Control_Only+ADHD_Only", "Combined_Amphetamine+Lisdexamfetamine", "No_Autism+No_Epilepsy"]
    df = spark.createDataFrame([(s,) for s in sets], "s string")
    got = {r.s: r.x for r in df.select("s", P.set_status(F.split("s", "\\+")).alias("x")).collect()}
    bad, spare = "contradictory_constraints", "redundant_constraint_set"
    assert [got[s] for s in sets] == [None, spare, bad, bad, spare, None]


def cohort(spark):
    """Controls, ADHD with and without drugs, epilepsy by drug, and resistant patients with two visits."""
    rows, n = [], 0

    def add(k, **over):
        nonlocal n
        for _ in range(k):
            n += 1
            base = {"study_id": n, "patient_id": 1000 + n, "sex": "M" if n % 2 else "F", "age_group": "5-8" if n % 3 else "9-12", "adhd": 0, "autism": 0, "epilepsy": 0, "psychostimulant": 0,
                    "psychostimulant_category": "No Psychostimulant", "asm": 0, "asm_resistant": 0, "first_eeg": 0, "asm_types": "No_ASM", "combined_diagnosis": "Control"}
            rows.append({**base, **over})

    add(11)
    add(7, adhd=1, combined_diagnosis="ADHD")
    for drug, k in (("Methylphenidate", 4), ("Lisdexamfetamine", 3), ("Dextroamphetamine", 2)):
        add(k, adhd=1, psychostimulant=1, psychostimulant_category=drug, combined_diagnosis="ADHD")
    add(4, epilepsy=1, combined_diagnosis="Epilepsy")
    for drug, k in (("LEV", 3), ("VPA", 3), ("LEV+VPA", 2)):
        add(k, epilepsy=1, asm=1, asm_types=drug, combined_diagnosis="Epilepsy")
    for p in range(3):
        add(1, patient_id=5000 + p, epilepsy=1, asm=1, asm_resistant=1, first_eeg=1, asm_types="CBZ", combined_diagnosis="Epilepsy")
        add(1, patient_id=5000 + p, epilepsy=1, asm=1, asm_resistant=1, first_eeg=0, asm_types="CBZ", combined_diagnosis="Epilepsy")
    add(2, adhd=1, autism=1, combined_diagnosis="ADHD+ASD")
    return spark.createDataFrame(rows)


def test_opportunities(spark):
    got = {(r.analysis, r.constraint): r for r in O.opportunities(cohort(spark), 2).filter("sex = 'All' and age_group = 'All'").collect()}
    assert len(got) == 137
    r = got["DrugResistance_Status", "No_Constraint"]
    assert (r.n1, r.n2, r.is_valid) == (8, 6, True)
    r = got["Epilepsy_ASM_Effect_LEV_Only", "No_ADHD"]
    assert (r.n1, r.n2) == (4, 3)
    r = got["DrugResistance_First_vs_Later", "No_Constraint"]
    assert (r.n1, r.n2, r.paired_patients, r.is_valid) == (3, 3, 3, True)
    assert got["DrugResistance_Status", "No_ADHD"].skip_reason == "redundant_constraint_set"
    assert got["Epilepsy_ASM_Effect_Any", "No_ADHD+Psychostim_False"].cohort_n == 0


def test_first_valid_row_wins_across_strata(spark):
    one = cohort(spark).withColumn("sex", F.lit("M"))
    got = O.opportunities(one, 2).filter("analysis = 'DrugResistance_Status' and constraint = 'No_Constraint' and age_group = 'All'").collect()
    assert {r.sex: r.skip_reason for r in got} == {"All": None, "Male": "redundant_constraint_set", "Female": "empty_filtered_cohort"}


def test_selectors_and_pools(spark):
    found = O.opportunities(cohort(spark), 2)
    good = spark.createDataFrame([("DrugResistance_Status", "No_Constraint", "All", "All")], "analysis string, constraint string, sex string, age_group string")
    assert O.resolved(found, good).first().n1 == 8
    with pytest.raises(Exception, match="selector without"):
        O.resolved(found, good.withColumn("sex", F.lit("Other"))).collect()
    pools = {r.pool: r for r in O.pools(cohort(spark), (1500,)).collect()}
    assert pools["adhd_total"].current_n == 16 and pools["adhd_med_any"].child_planned == (75 - 4) + (75 - 5)
    assert pools["adhd_total"].net_needed == max(0, 250 - 16 - pools["adhd_unmed"].net_needed - pools["adhd_med_any"].net_needed)


def test_projection_floors_and_compares_with_today(spark):
    tracked = spark.createDataFrame([("a", "ADHD_Psychostim_Effect_Any", 90, 140)], "label string, analysis string, n1 int, n2 int")
    need = spark.createDataFrame([("ADHD_Psychostim_Effect_Any", m, a, b) for m, a, b in ((1500, 100, 150), (2000, 150, 250), (3000, 200, 400), (5000, 200, 800))], "analysis string, milestone int, need1 int, need2 int")
    got = {r.milestone: r for r in O.projection(tracked, need, 1300).collect()}
    assert (got[1500].projected1, got[1500].projected2, got[1500].feasible, got[1500].newly_feasible) == (103, 161, True, True)
    assert (got[2000].projected1, got[2000].limiting_group, got[2000].rows_to_add) == (138, "both", 700)
    assert not got[3000].newly_feasible
