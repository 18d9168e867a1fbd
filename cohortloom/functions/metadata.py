"""Patient-metadata normalisation: columns from columns (M1-M18). Missing is NULL throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch

#: The drug flags in printing order, the ages at which groups begin, and the display order of diagnoses.
DRUGS = ("LEV", "LTG", "LCS", "CLB", "CBZ", "VPA", "ETH", "TPM", "RUF", "BRV", "STP", "OXZ", "CBM")
AGE_GROUPS = ((0, 5, "0-4"), (5, 9, "5-8"), (9, 13, "9-12"), (13, 19, "13-18"))
DIAGNOSES = (("ADHD", "adhd"), ("ASD", "autism"), ("Epilepsy", "epilepsy"))
#: Descriptions that go with a category, by category code (comma and point are the same).
STIMULANTS = {
    ("", ""): "No Psychostimulant",
    ("", "0"): "No Psychostimulant",
    ("Amphetamine/dextroamphetamine salt (Adderall)", "3.2"): "Dextroamphetamine",
    ("Dextroamphetamine (Dexedrine)", "3.1"): "Dextroamphetamine",
    ("Dextroamphetamine", "3.1"): "Dextroamphetamine",
    ("Lisdexamfetamine", "1"): "Lisdexamfetamine",
    ("Lisdexamfetamine - Vyvanse", "1"): "Lisdexamfetamine",
    ("Lisdexamfetamine (d/c)", "1"): "Lisdexamfetamine",
    ("Methylphenidate", "2"): "Methylphenidate",
    ("Methylphenidate (d/c 2019)", "2"): "Methylphenidate",
    ("Methylphenidate (d/c)", "2"): "Methylphenidate",
    ("Methylphenidate, Methylphenidate", "2"): "Methylphenidate",
    ("Methylphenidate - Biphentin", "2"): "Methylphenidate",
    ("Methylphenidate - Biphentin, Methylphenidate - Ritalin", "2"): "Methylphenidate",
    ("Methylphenidate - Concerta", "2"): "Methylphenidate",
    ("Methylphenidate - Concerta, Methylphenidate - Ritalin", "2"): "Methylphenidate",
    ("Methylphenidate - Ritalin", "2"): "Methylphenidate",
    ("Methylphenidate - Ritalin, Methylphenidate - Biphentin", "2"): "Methylphenidate",
    ("Lisdexamfetamine, Methylphenidate", "mixed"): "Lisdexamfetamine + Methylphenidate",
}


def number(c: Column) -> Column:
    """The value as a double; text that is no number and NaN become NULL."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def flag(c: Column) -> Column:
    """M1: 1 if the number is 1, 0 for another number, NULL without a number."""
    return F.when(number(c).isNotNull(), (number(c) == 1).cast("int"))


def flag_or_zero(c: Column) -> Column:
    """M2: as M1, but 0 where M1 is NULL."""
    return F.coalesce(flag(c), F.lit(0))


def age_years(c: Column) -> Column:
    """M3: a number as it is; `8y3m`, `1y6m12d`, `04m16d` as years to two decimals; anything else NULL."""
    text = F.trim(c.cast("string"))
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(text, rf"(\d+){unit}", 1), F.lit("")).cast("int"), F.lit(0))
    spelled = text.rlike(r"^(\d+y)?(\d+m)?(\d+d)?$") & (text != "")
    return F.coalesce(number(text), F.when(spelled, F.round(part("y") + part("m") / 12.0 + part("d") / 365.25, 2)))


def sex(c: Column) -> Column:
    """M4: trimmed upper case, empty is NULL."""
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def age_group(c: Column) -> Column:
    """M5: the left-closed group of an age, NULL outside all of them."""
    out = F.when(F.lit(False), F.lit(""))
    for low, high, label in AGE_GROUPS:
        out = out.when((c >= low) & (c < high), label)
    return out


def age_group_order(c: Column) -> Column:
    """Sort key of a group's label: its first number."""
    return F.split(c, "-")[0].cast("int")


def combined_diagnosis() -> Column:
    """M6: names of the set diagnosis flags joined by +, Control without one."""
    return F.coalesce(F.nullif(F.concat_ws("+", *[F.when(F.col(c) == 1, n) for n, c in DIAGNOSES]), F.lit("")), F.lit("Control"))


def drug_types(drugs: tuple[str, ...] = DRUGS) -> Column:
    """M7: names of the set drug flags joined by + in fixed order, No_ASM without one."""
    return F.coalesce(F.nullif(F.concat_ws("+", *[F.when(F.col(d) == 1, d) for d in drugs]), F.lit("")), F.lit("No_ASM"))


def medication_summary(asm: Column, stimulant: Column) -> Column:
    """M8."""
    return F.when((asm == 1) & (stimulant == 1), "ASM+Psychostim").when(asm == 1, "ASM").when(stimulant == 1, "Psychostim").otherwise("No Med")


def any_drug(drugs: tuple[str, ...] = DRUGS, other: str = "other_asm") -> Column:
    """M9: 1 if any drug flag or the other-drug flag is set."""
    total = sum((F.coalesce(F.col(d), F.lit(0)) for d in drugs), F.lit(0))
    return ((total > 0) | F.coalesce(F.col(other) == 1, F.lit(False))).cast("int")


def tentative(*cols: str) -> Column:
    """Any raw diagnosis text reads `0 (potentiel)`. Evaluate it before the flags are coerced."""
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.col(c).rlike(r"(?i)^\s*0\s*\(potentiel\)\s*$"), F.lit(False))
    return hit


def medication_mismatch() -> Column:
    """A stimulant without ADHD or a drug without epilepsy; NULL counts as 0."""
    v = lambda c: F.coalesce(F.col(c), F.lit(0))
    return ((v("adhd") == 0) & (v("psychostimulant") == 1)) | ((v("epilepsy") == 0) & (v("asm") == 1))


def drop_reason(rules: list[tuple[Column, str]]) -> Column:
    """The reason of the first rule that holds, NULL if none does."""
    return F.coalesce(*[F.when(c, r) for c, r in rules])


def waterfall_rules(excluded: tuple[int, ...] = ()) -> list[tuple[Column, str]]:
    """The five ordered removal rules over normalised rows with a boolean column `tentative`."""
    return [
        (F.col("tentative"), "non_confirmed_diagnosis"),
        (F.upper(F.trim(F.coalesce("eeg_date", F.lit("")))).isin("NO EEG", "SEEG"), "no_eeg_files"),
        (F.col("study_id").isin(*excluded) if excluded else F.lit(False), "missing_or_corrupt_eeg_file"),
        (F.col("adhd").isNull() | F.col("autism").isNull(), "missing_diagnosis"),
        (medication_mismatch(), "medication_mismatch"),
    ]


def category_key(c: Column) -> Column:
    """Category codes in one form: comma to point, numbers without trailing zeros (2.0 is 2)."""
    text = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), ",", ".")
    return F.when(text.rlike(r"^\d+(\.\d+)?$"), F.regexp_replace(text, r"\.0+$", "")).otherwise(text)


def normalised(raw: DataFrame, drugs: tuple[str, ...] = DRUGS, excluded: tuple[int, ...] = ()) -> DataFrame:
    """The canonical table from raw rows of text, with drop_reason (NULL for rows that stay)."""
    out = raw.withColumn("tentative", tentative("adhd", "autism", "epilepsy"))
    out = out.withColumns({
        "study_id": F.col("study_id").try_cast("long"), "patient_id": F.col("patient_id").try_cast("long"), "age": age_years(F.col("age")),
            "sex": sex(F.col("sex")),
        **{c: flag(F.col(c)) for _, c in DIAGNOSES}, **{c: flag_or_zero(F.col(c)) for c in ("first_eeg", *drugs, "other_asm", "asm_resistant")},
    })
    key = F.concat_ws("|", F.trim(F.coalesce("psychostimulant_description", F.lit(""))), category_key(F.col("psychostimulant_code")))
    table = F.create_map(*[F.lit(x) for (d, c), v in STIMULANTS.items() for x in (f"{d}|{c}", v)])
    out = out.withColumn("psychostimulant_category",
        F.coalesce(F.try_element_at(table, key), F.raise_error(F.concat(F.lit("unknown medication pair: "), key))))
    out = out.withColumn("psychostimulant", (F.col("psychostimulant_category") != "No Psychostimulant").cast("int")).withColumn("asm",
        any_drug(drugs))
    out = out.withColumns({
        "age_group": age_group(F.col("age")), "combined_diagnosis": combined_diagnosis(), "asm_types": drug_types(drugs),
        "meds_summary": medication_summary(F.col("asm"), F.col("psychostimulant")),
    })
    return out.withColumn("drop_reason", drop_reason(waterfall_rules(excluded))).drop("tentative", "psychostimulant_description",
        "psychostimulant_code")


def dense_ids(keys: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Number the rows of keys from 0 in order, without a window over all rows: sorted partitions and their counts."""
    rows = scratch(keys.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "sorted")
    parts = rows.groupBy(F.shiftright("_m", 33).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    start = parts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_start"))
    return rows.join(start, F.shiftright("_m", 33) == F.col("_p")).withColumn(out,
        F.col("_start") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_start")


def group_ids(df: DataFrame, clean: Column) -> DataFrame:
    """Add patient_group_id, dense over string-sorted keys, keys of clean rows first.

    Key: the patient id, else the study id, else a hash of the row (a position is not reproducible).
    """
    key = F.coalesce(
        F.when(F.col("patient_id").isNotNull(), F.concat(F.lit("patient:"), F.col("patient_id"))),
            F.when(F.col("study_id").isNotNull(), F.concat(F.lit("missing_patient_study:"), F.col("study_id"))),
        F.concat(F.lit("missing_both:"), F.hex(F.xxhash64(*df.columns))))
    keyed = df.withColumn("_key", key)
    keys = keyed.groupBy("_key").agg(F.bool_or(clean).alias("_clean"))
    return keyed.join(dense_ids(keys, [F.desc("_clean"), F.asc("_key")], "patient_group_id").drop("_clean"), "_key").drop("_key")


def subject(c: Column) -> Column:
    """`1`, `0001` and `sub-0001` are one subject: no prefix, no leading zeros."""
    return F.regexp_replace(F.regexp_replace(F.trim(c.cast("string")), "^sub-", ""), r"^0+(?=.)", "")


def padded_subject(c: Column) -> Column:
    """Four digits; anything but digits is an error."""
    s = subject(c)
    return F.when(s.rlike(r"^\d+$"), F.when(F.length(s) >= 4,
        s).otherwise(F.lpad(s, 4, "0"))).otherwise(F.raise_error(F.concat(F.lit("not a subject number: "), s)))


def token(c: Column) -> Column:
    """Letters and digits only; nothing left is an error."""
    s = F.regexp_replace(c, "[^A-Za-z0-9]", "")
    return F.when(s != "", s).otherwise(F.raise_error(F.lit("empty token")))


def portable_path(c: Column, root: str) -> Column:
    """Inside root bids:///rel, relative relative:///, else external:///name."""
    base = root.rstrip("/") + "/"
    return (
        F.when(c.startswith(base), F.concat(F.lit("bids:///"), F.substring(c, len(base) + 1, 1 << 20))).when(~c.startswith("/"),
            F.concat(F.lit("relative:///"), c))
        .otherwise(F.concat(F.lit("external:///"), F.substring_index(c, "/", -1)))
    )


def recording_id(subject_col: str = "subject", session_col: str = "session", run_col: str = "run") -> Column:
    """`subject-<s>_session-<ss>_run-<r>`; a missing part is an error."""
    parts = [F.coalesce(F.concat(F.lit(f"{n}-"), F.col(c).cast("string")), F.raise_error(F.lit(f"missing {n}"))) for n,
        c in (("subject", subject_col), ("session", session_col), ("run", run_col))]
    return F.concat_ws("_", *parts)


def eye_state(c: Column) -> Column:
    """EO for eo*, EC for ec*, else the value itself."""
    return F.when(F.lower(c).startswith("eo"), "EO").when(F.lower(c).startswith("ec"), "EC").otherwise(c)
