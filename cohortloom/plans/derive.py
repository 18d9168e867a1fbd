"""Views of the driver's tables in the library's shapes.

RAW and MARKS are SQL that Spark and DuckDB read alike; CLEAN and REC are written for DuckDB only, apart from the
library's functions, and serve as oracles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Raw patient rows as text, one for each customer.
RAW = """
SELECT CASE WHEN c_custkey % 23 = 0 THEN '' ELSE CAST(c_custkey + 1 AS STRING) END AS study_id,
       CASE WHEN c_custkey % 11 = 0 THEN 'n/a' ELSE CAST(1000 + c_custkey - c_custkey % 3 AS STRING) END AS patient_id,
       CASE WHEN c_nationkey < 13 THEN 'adhd' ELSE 'drug_resistant' END AS source_dataset,
       CASE WHEN c_custkey % 29 = 0 THEN ' no eeg ' WHEN c_custkey % 31 = 0 THEN 'SEEG' ELSE concat('2024-0', CAST(1 + c_custkey % 9 AS STRING), '-15') END AS eeg_date,
       CASE WHEN c_custkey % 2 = 0 THEN '1' ELSE '0.0' END AS first_eeg,
       CASE c_custkey % 5 WHEN 0 THEN CAST(c_custkey % 19 AS STRING) WHEN 1 THEN concat(CAST(c_custkey % 17 AS STRING), 'y', CAST(c_custkey % 12 AS STRING), 'm')
            WHEN 2 THEN concat('0', CAST(c_custkey % 9 AS STRING), 'm16d') WHEN 3 THEN 'adult' ELSE concat(CAST(c_custkey % 15 AS STRING), '.5') END AS age,
       CASE c_custkey % 4 WHEN 0 THEN ' m ' WHEN 1 THEN 'F' WHEN 2 THEN 'f' ELSE '' END AS sex,
       CASE WHEN c_custkey % 37 = 0 THEN '0 (Potentiel)' WHEN c_custkey % 41 = 0 THEN 'unknown' WHEN c_custkey % 3 = 0 THEN '1' ELSE '0' END AS adhd,
       CASE WHEN c_custkey % 43 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '1.0' ELSE '0' END AS autism,
       CASE WHEN c_custkey % 5 IN (1, 2) THEN '1' ELSE '0' END AS epilepsy,
       CASE WHEN c_custkey % 101 = 0 THEN 'Methylphenidate' WHEN c_custkey % 3 > 0 THEN NULL WHEN c_custkey % 4 = 0 THEN 'Methylphenidate - Ritalin'
            WHEN c_custkey % 4 = 1 THEN 'Lisdexamfetamine' WHEN c_custkey % 4 = 2 THEN 'Dextroamphetamine' ELSE NULL END AS psychostimulant_description,
       CASE WHEN c_custkey % 101 = 0 THEN '2' WHEN c_custkey % 3 > 0 THEN '0' WHEN c_custkey % 4 = 0 THEN '2.0' WHEN c_custkey % 4 = 1 THEN '1' WHEN c_custkey % 4 = 2 THEN '3,1' ELSE NULL END AS psychostimulant_code,
       CASE WHEN c_custkey % 5 = 1 AND c_custkey % 2 = 0 THEN '1' ELSE '0' END AS LEV, CASE WHEN c_custkey % 5 = 2 AND c_custkey % 6 = 0 THEN '1' ELSE '0' END AS LTG,
       CASE WHEN c_custkey % 97 = 0 THEN '1' ELSE NULL END AS CBZ, CASE WHEN c_custkey % 5 = 1 AND c_custkey % 4 = 1 THEN '1.0' ELSE '0' END AS VPA,
       '0' AS LCS, '0' AS CLB, '0' AS ETH, '0' AS TPM, '0' AS RUF, '0' AS BRV, '0' AS STP, '0' AS OXZ, '0' AS CBM,
       CASE WHEN c_custkey % 53 = 0 THEN '1' ELSE NULL END AS other_asm,
       CASE WHEN c_nationkey >= 13 AND c_custkey % 5 = 1 THEN '1' ELSE '0' END AS asm_resistant
FROM {customer}"""

_drugs = ", ".join(f"coalesce((try_cast({d} AS DOUBLE) = 1)::INT, 0) AS {d}" for d in M.DRUGS)
_types = ", ".join(f"CASE WHEN {d} = 1 THEN '{d}' END" for d in M.DRUGS)
_any = " + ".join(M.DRUGS)
_num = lambda p: f"coalesce(try_cast(nullif(regexp_extract(trim(age), '(\\d+){p}', 1), '') AS INT), 0)"
#: Canonical rows with drop_reason (DuckDB).
ALL = f"""
a AS (SELECT * REPLACE (try_cast(study_id AS BIGINT) AS study_id, try_cast(patient_id AS BIGINT) AS patient_id,
         coalesce(try_cast(trim(age) AS DOUBLE), CASE WHEN regexp_full_match(trim(age), '(\\d+y)?(\\d+m)?(\\d+d)?') AND trim(age) <> '' THEN round({_num('y')} + {_num('m')} / 12.0::DOUBLE + {_num('d')} / 365.25::DOUBLE, 2) END) AS age,
         nullif(upper(trim(sex)), '') AS sex, (try_cast(adhd AS DOUBLE) = 1)::INT AS adhd, (try_cast(autism AS DOUBLE) = 1)::INT AS autism, (try_cast(epilepsy AS DOUBLE) = 1)::INT AS epilepsy,
         coalesce((try_cast(first_eeg AS DOUBLE) = 1)::INT, 0) AS first_eeg, coalesce((try_cast(other_asm AS DOUBLE) = 1)::INT, 0) AS other_asm, coalesce((try_cast(asm_resistant AS DOUBLE) = 1)::INT, 0) AS asm_resistant,
         {_drugs}),
         regexp_full_match(lower(coalesce(adhd, '')), '\\s*0\\s*\\(potentiel\\)\\s*') AS tentative,
         CASE WHEN psychostimulant_description IS NULL THEN 'No Psychostimulant' WHEN psychostimulant_description LIKE 'Methyl%' THEN 'Methylphenidate' WHEN psychostimulant_description LIKE 'Lisdex%' THEN 'Lisdexamfetamine' ELSE 'Dextroamphetamine' END AS psychostimulant_category
      FROM raw),
b AS (SELECT *, (psychostimulant_category <> 'No Psychostimulant')::INT AS psychostimulant, ({_any} > 0 OR other_asm = 1)::INT AS asm,
         CASE WHEN age >= 0 AND age < 5 THEN '0-4' WHEN age >= 5 AND age < 9 THEN '5-8' WHEN age >= 9 AND age < 13 THEN '9-12' WHEN age >= 13 AND age < 19 THEN '13-18' END AS age_group,
         coalesce(nullif(concat_ws('+', CASE WHEN adhd = 1 THEN 'ADHD' END, CASE WHEN autism = 1 THEN 'ASD' END, CASE WHEN epilepsy = 1 THEN 'Epilepsy' END), ''), 'Control') AS combined_diagnosis,
         coalesce(nullif(concat_ws('+', {_types}), ''), 'No_ASM') AS asm_types FROM a),
allrows AS (SELECT *, CASE WHEN asm = 1 AND psychostimulant = 1 THEN 'ASM+Psychostim' WHEN asm = 1 THEN 'ASM' WHEN psychostimulant = 1 THEN 'Psychostim' ELSE 'No Med' END AS meds_summary,
         CASE WHEN tentative THEN 'non_confirmed_diagnosis' WHEN upper(trim(coalesce(eeg_date, ''))) IN ('NO EEG', 'SEEG') THEN 'no_eeg_files' WHEN study_id IN (50, 60) THEN 'missing_or_corrupt_eeg_file'
              WHEN adhd IS NULL OR autism IS NULL THEN 'missing_diagnosis'
              WHEN (coalesce(adhd, 0) = 0 AND psychostimulant = 1) OR (coalesce(epilepsy, 0) = 0 AND asm = 1) THEN 'medication_mismatch' END AS drop_reason FROM b)"""
RAW_SQL = RAW.replace("{customer}", "customer")
WITH = f"WITH raw AS ({RAW_SQL}), {ALL}, clean AS (SELECT * FROM allrows WHERE drop_reason IS NULL)"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RAW, customer=read(spark, sf_dir, "customer"))


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All canonical rows with drop_reason."""
    return M.normalised(raw(spark, sf_dir), excluded=(50, 60))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patients(spark, sf_dir).filter("drop_reason is null")


#: Events of a user as marks of a recording: seconds since the user's first event, a label and a length.
MARKS_SQL = """marks AS (SELECT user_id AS recording_id, event_id AS place, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS onset,
  CASE event_type WHEN 'view' THEN 'eyes_open' WHEN 'click' THEN 'eyes_closed' WHEN 'signup' THEN 'hv_start' WHEN 'purchase' THEN 'hv_end' ELSE 'post_hv' END AS label, value * 1000 AS length FROM events),
recs AS (SELECT recording_id, max(onset) + 600.0 AS raw_end FROM marks GROUP BY 1),
iv AS (SELECT recording_id, place, label, onset AS start, onset + length AS stop FROM marks)"""


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    label = F.when(F.col("event_type") == "view", "eyes_open").when(F.col("event_type") == "click", "eyes_closed").when(F.col("event_type") == "signup", "hv_start").when(F.col("event_type") == "purchase", "hv_end").otherwise("post_hv")
    first = F.min(us).over(Window.partitionBy("user_id"))
    return e.select(F.col("user_id").alias("recording_id"), F.col("event_id").alias("place"), ((us - first) / F.lit(1e6)).alias("onset"), label.alias("label"), (F.col("value") * 1000).alias("length"))


def recordings(m: DataFrame) -> DataFrame:
    return m.groupBy("recording_id").agg((F.max("onset") + 600.0).alias("raw_end"))


def spans(m: DataFrame) -> DataFrame:
    return m.select("recording_id", "place", "label", F.col("onset").alias("start"), (F.col("onset") + F.col("length")).alias("stop"))
