"""Study enumeration and recruitment projection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metadata import age_group_order
from ..functions.predicates import COMPARISONS, CONSTRAINTS, MILESTONES, POOLS, bits, pool_counts, set_status
from ..session import scratch
from .ranks import LANES, lane_values, lanes_text

LONGITUDINAL = "DrugResistance_First_vs_Later"
#: Comparisons of named drugs, whose empty arm is a lack of that category; then those that lack it by arm 2.
BY_CATEGORY = (
    "Epilepsy_ASM_Effect_LEV_Only", "Epilepsy_ASM_Effect_VPA_Only", "Epilepsy_LEV_vs_VPA_Only", "NonEpilepsy_vs_Epilepsy_LEV_Only",
        "NonEpilepsy_vs_Epilepsy_VPA_Only",
    "ADHD_Psychostim_Effect_Methylphenidate", "ADHD_Psychostim_Effect_Lisdexamfetamine", "ADHD_Psychostim_Effect_Dextroamphetamine",
    "ADHD_Methylphenidate_vs_Lisdexamfetamine", "ADHD_Methylphenidate_vs_Amphetamine", "Control_vs_ADHD_Methylphenidate",
        "Control_vs_ADHD_Lisdexamfetamine", "Control_vs_ADHD_Amphetamine",
)
BY_SECOND_ARM = ("NonEpilepsy_vs_Epilepsy_Unmedicated", "NonEpilepsy_vs_Epilepsy_ASM_Any", "Control_vs_ADHD_Medicated_Any")
SPECS = [(i, *x) for i, x in enumerate((c[0], c[1], c[2], s) for c in COMPARISONS for s in c[5])]


def specs(spark) -> DataFrame:
    """(spec, analysis, group_1, group_2, constraint, status): the fixed list of comparisons and constraint sets."""
    return spark.createDataFrame(SPECS, "spec int, analysis string, group_1 string, group_2 string, constraint string").withColumn("status",
        set_status(F.split("constraint", "\\+")))


ARMS = list(dict.fromkeys(p for c in COMPARISONS for p in (c[3], c[4])))


LATER = [i for i, a, *_ in SPECS if a == LONGITUDINAL]
ASKED = [(c[3], c[4], s) for c in COMPARISONS for s in c[5]]  # arms and constraints of each spec


def _needs(keep: list[int]) -> Column:
    """The specs listed, as an array of (spec, need, a, b): bits of the constraints asked for and places of the arms."""
    names = list(CONSTRAINTS)
    table = [f"named_struct('spec', {i}, 'need', {sum(1 << names.index(n) for n in s.split('+'))}L, 'a', {ARMS.index(a)}, 'b', {ARMS.index(b)})" for i in keep for a, b, s in ASKED[i : i + 1]]
    return F.expr(f"array({', '.join(table)})")


def _spread(cells: DataFrame, keep: list[int], rest: list[str]) -> DataFrame:
    """A row for each listed spec that a cell (sex, age_group, _bits, _arms) meets, in its own stratum and in All."""
    sexes = F.array(F.lit("All"), F.when(F.col("sex") == "M", "Male").when(F.col("sex") == "F", "Female"))
    known = lambda a: F.filter(a, lambda x: x.isNotNull())
    met = cells.select(
        known(sexes).alias("_sexes"), known(F.array(F.lit("All"), "age_group")).alias("_ages"), "_arms",
        F.filter(_needs(keep), lambda x: F.col("_bits").bitwiseAND(x["need"]) == x["need"]).alias("_met"), *rest)
    met = met.select("_sexes", "_ages", "_arms", F.explode("_met").alias("_m"), *rest)
    arm = lambda k: F.expr(f"shiftright(_arms, _m.{k}) & 1L = 1L")
    met = met.select(F.explode("_sexes").alias("sex"), "_ages", F.col("_m.spec").alias("spec"), arm("a").alias("one"), arm("b").alias("two"), *rest)
    return met.select("sex", F.explode("_ages").alias("age_group"), "spec", "one", "two", *rest)


def _paired(held: DataFrame, marks: list[str], sums: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Of the longitudinal specs, in which a patient counts in an arm if the other arm holds rows of the same patient: the
    rows that count, added up by signature, and the patients that do.

    A patient's specs are bits of two numbers for each sex and age group that it has rows in, so a patient of any number
    of rows is a few; what it counts in goes back to its rows as the bits of four strata."""
    table = [(k, 1 << ARMS.index(a), 1 << ARMS.index(b), sum(1 << list(CONSTRAINTS).index(n) for n in s.split("+"))) for k, (a, b, s) in enumerate(ASKED[i] for i in LATER)]
    met = lambda j: F.expr(" | ".join(f"if(_bits & {x[3]}L = {x[3]}L and _arms & {x[j]}L <> 0L, {1 << x[0]}L, 0L)" for x in table))
    by = ["_pair", "_sex", "age_group"]
    rows = held.select(F.col("patient_id").cast("string").alias("_pair"), F.when(F.col("sex") == "M", "Male").when(F.col("sex") == "F", "Female").alias("_sex"), "age_group", *marks, met(1).alias("_one"), met(2).alias("_two"))
    rows = rows.filter("_pair is not null and (_one | _two) <> 0")
    cells = rows.groupBy(*by).agg(F.bit_or("_one").alias("_one"), F.bit_or("_two").alias("_two"))
    strata = {"_aa": by[:1], "_sa": by[:2], "_ag": [by[0], by[2]], "_sg": by}
    for name, keys in strata.items():
        w, rest = Window.partitionBy(*keys), [k for k in by if k not in keys] or by[:1]
        cells = cells.withColumns({name: F.bit_or("_one").over(w).bitwiseAND(F.bit_or("_two").over(w)), f"{name}_first": F.row_number().over(w.orderBy(*rest)) == 1})
    cells = scratch(cells.filter("_aa <> 0").drop("_one", "_two"), "pairs")
    places = [("_aa", F.lit("All"), F.lit("All")), ("_sa", F.col("_sex"), F.lit("All")), ("_ag", F.lit("All"), F.col("age_group")), ("_sg", F.col("_sex"), F.col("age_group"))]

    def spread(table: DataFrame, mask, rest: list) -> DataFrame:
        """A row for each stratum and each longitudinal spec that a signature counts in."""
        at = F.filter(F.array(*[F.struct(s.alias("sex"), a.alias("age_group"), mask(m).alias("mask")) for m, s, a in places]), lambda x: x["sex"].isNotNull() & x["age_group"].isNotNull() & (x["mask"] != 0))
        specs = F.array(*[F.struct(F.lit(i).alias("spec"), F.lit(k).alias("bit")) for k, i in enumerate(LATER)])
        return table.select(F.explode(at).alias("_at"), *rest).select("_at.*", F.explode(specs).alias("_s"), *rest).filter("shiftright(mask, _s.bit) & 1L = 1L").select("sex", "age_group", "_s.spec", "_s.bit", *rest)

    keep = [k.alias(f"_r{i}") for i, k in enumerate(map(F.col, by))]
    joined = rows.join(cells.select(*keep, *strata), (F.col("_pair") == F.col("_r0")) & F.col("_sex").eqNullSafe(F.col("_r1")) & F.col("age_group").eqNullSafe(F.col("_r2")))
    signed = joined.groupBy("_sex", "age_group", "_one", "_two", *strata).agg(*sums)
    bit = lambda c: F.expr(f"shiftright({c}, bit) & 1L = 1L")
    members = spread(signed, F.col, ["_one", "_two", "n", *marks]).select("sex", "age_group", "spec", "n", F.lit(0).alias("paired"), bit("_one").alias("one"), bit("_two").alias("two"), *marks)
    counted = cells.groupBy("_sex", "age_group", *strata, *[f"{m}_first" for m in strata]).agg(F.count(F.lit(1)).alias("n"))
    once = spread(counted, lambda m: F.when(F.col(f"{m}_first"), F.col(m)).otherwise(F.lit(0).cast("long")), ["n"])
    patients = once.select("sex", "age_group", "spec", F.lit(0).cast("long").alias("n"), F.col("n").alias("paired"), F.lit(False).alias("one"), F.lit(False).alias("two"), *[F.lit(0).cast("decimal(28,0)").alias(m) for m in marks])
    return members, patients


def opportunities(df: DataFrame, least: int) -> DataFrame:
    """Every sex and age stratum, comparison and constraint set with its sizes, validity and skip reason.

    Rows are added up first by signature: sex, age group, and the constraints and arms that they meet, as bits. Specs and
    strata are then spread over the few distinct signatures, so the work for a row does not grow with them. For the
    longitudinal specs, which pair a patient's rows, the signature also holds which specs the patient counts in. Each
    signature is counted in its own stratum and in All. Membership is compared by multiset hashes; no member list is
    gathered.
    """
    spark = df.sparkSession
    used = set(re.findall(r"\w+", " ".join([*CONSTRAINTS.values(), *ARMS]).lower()))
    own = ["sex", "age_group", "patient_id", "study_id"]
    # Written before and after the predicates and hashes are added: what makes the columns, these, and the sums are too much
    # code for one method, which the JVM then interprets.
    held = scratch(df.select(*own, *[c for c in df.columns if c.lower() in used and c not in own]), "patients")
    held = held.select(*own, bits(list(CONSTRAINTS.values())).alias("_bits"), bits(ARMS).alias("_arms"))
    held = scratch(held.withColumns({f"_m{i}": x for i, x in enumerate(lane_values(F.col("study_id")))}), "signatures")
    marks = [f"_m{i}" for i in range(LANES)]
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(m).cast("decimal(28,0)").alias(m) for m in marks]]
    plain = _spread(held.groupBy("sex", "age_group", "_bits", "_arms").agg(*sums), [i for i, *_ in SPECS], ["n", *marks])
    plain = plain.withColumns({c: F.col(c) & ~F.col("spec").isin(LATER) for c in ("one", "two")}).select("sex", "age_group", "spec", "n", F.lit(0).alias("paired"), F.col("n").alias("_n"), "one", "two", *marks)
    longitudinal = [x.select("sex", "age_group", "spec", F.lit(0).cast("long").alias("n"), "paired", F.col("n").alias("_n"), "one", "two", *marks) for x in _paired(held, marks, sums)]
    lane = lambda arm, m: F.coalesce(F.when(F.col(arm), F.col(m)), F.lit(0)).cast("decimal(28,0)")
    rows = plain.unionByName(longitudinal[0]).unionByName(longitudinal[1]).select(
        "sex", "age_group", "spec", "n", "paired", F.when(F.col("one"), F.col("_n")).otherwise(0).alias("n1"), F.when(F.col("two"), F.col("_n")).otherwise(0).alias("n2"),
        *[lane(arm, m).alias(f"{m}{s}") for s, arm in (("a", "one"), ("b", "two")) for m in marks])
    sized = rows.groupBy("sex", "age_group", "spec").agg(
        F.sum("n").alias("cohort_n"), F.sum("n1").alias("n1"), F.sum("n2").alias("n2"), F.sum("paired").alias("paired"),
        lanes_text([F.sum(f"{m}a") for m in marks]).alias("f1"), lanes_text([F.sum(f"{m}b") for m in marks]).alias("f2"))
    ages = held.select("age_group").filter("age_group is not null").distinct().select("age_group", age_group_order(F.col("age_group")).alias("place"))
    ages = ages.union(spark.createDataFrame([("All", -1)], "age_group string, place int"))
    grid = spark.createDataFrame([("All", 0), ("Male", 1), ("Female", 2)],
        "sex string, sex_place int").crossJoin(ages).crossJoin(F.broadcast(specs(spark)))
    both = grid.join(sized, ["sex", "age_group", "spec"], "left").na.fill(0, ["cohort_n", "n1", "n2", "paired"])
    both = both.withColumns({c: F.when(F.col("status").isNull(), F.col(c)).otherwise(0) for c in ("cohort_n", "n1", "n2", "paired")})
    empty = F.when(F.col("analysis") == LONGITUDINAL, "insufficient_longitudinal_pairs").when(F.col("analysis").isin(*BY_CATEGORY),
        "insufficient_category_support")
    empty = empty.when(F.col("analysis").isin(*BY_SECOND_ARM) & (F.col("n2") == 0), "insufficient_category_support").otherwise("one_group_empty")
    small = F.when(F.col("analysis") == LONGITUDINAL, F.col("paired") < least).otherwise((F.col("n1") < least) | (F.col("n2") < least))
    reason = (
        F.when(F.col("status").isNotNull(), F.col("status")).when(F.col("cohort_n") == 0,
            "empty_filtered_cohort").when((F.col("n1") == 0) | (F.col("n2") == 0), empty)
        .when(small, "too_small_group").when((F.col("f1") == F.col("f2")) & (F.col("n1") == F.col("n2")), "same_group_membership")
    )
    judged = both.withColumn("reason", reason)
    same = Window.partitionBy(F.when(F.col("reason").isNull(), F.col("analysis")), "f1", "n1", "f2", "n2").orderBy("sex_place", "place", "spec")
    judged = judged.withColumn("first", F.when(F.col("reason").isNull(), F.row_number().over(same) == 1))
    final = F.coalesce("reason", F.when(~F.col("first"), "redundant_constraint_set"))
    return judged.select(
        "analysis", "sex", "age_group", "constraint", "group_1", "group_2", "cohort_n", "n1", "n2", F.col("paired").alias("paired_patients"),
        final.isNull().alias("is_valid"), final.alias("skip_reason"))


def ordered(found: DataFrame) -> DataFrame:
    """Valid first, then larger arms, then names."""
    return found.orderBy(F.desc("is_valid"), F.desc("n1"), F.desc("n2"), "analysis", "sex", "age_group", "constraint")


def resolved(found: DataFrame, selectors: DataFrame) -> DataFrame:
    """The one valid opportunity of each selector (analysis, constraint, sex, age_group); none or several is an error."""
    keys = ["analysis", "constraint", "sex", "age_group"]
    hits = selectors.join(found.filter("is_valid"), keys, "left").withColumn("hits", F.count("is_valid").over(Window.partitionBy(*keys)))
    return hits.withColumn("n1", F.when(F.col("hits") == 1,
        F.col("n1")).otherwise(F.raise_error(F.concat(F.lit("selector without exactly one valid opportunity: "), *keys)).cast("long"))).drop("hits")


def family(c: Column) -> Column:
    """The family of a comparison by its name."""
    return (
        F.when(c == "DrugResistance_Status", "Drug Resistance").when(c.startswith("ADHD_") | c.startswith("Control_vs_ADHD"), "ADHD")
        .when(c.startswith("Epilepsy_") | c.startswith("NonEpilepsy_vs_Epilepsy"), "Epilepsy").otherwise("Other")
    )


def projection(tracked: DataFrame, required: DataFrame, cohort_n: int, milestones: tuple[int, ...] = MILESTONES) -> DataFrame:
    """tracked(label, analysis, n1, n2) scaled to each milestone against required(analysis, milestone, need1, need2).

    The first milestone is compared with feasibility today, judged by the largest milestone that the cohort reaches (else
    the smallest).
    """
    if cohort_n <= 0:
        raise ValueError("an empty cohort cannot be projected")
    now = max([m for m in milestones if m <= cohort_n], default=min(milestones))
    steps = tracked.sparkSession.createDataFrame([(m,) for m in milestones], "milestone int")
    rows = tracked.crossJoin(F.broadcast(steps)).join(required, ["analysis", "milestone"])
    today = required.filter(F.col("milestone") == now).select("analysis", F.col("need1").alias("t1"), F.col("need2").alias("t2"))
    rows = rows.join(today, "analysis").withColumn("scale", F.greatest(F.lit(1.0), F.col("milestone") / F.lit(float(cohort_n))))
    rows = rows.withColumns({"projected1": F.floor(F.col("n1") * F.col("scale")), "projected2": F.floor(F.col("n2") * F.col("scale"))})
    rows = rows.withColumns({"short1": F.greatest(F.lit(0), F.col("need1") - F.col("projected1")),
        "short2": F.greatest(F.lit(0), F.col("need2") - F.col("projected2"))})
    rows = rows.withColumn("feasible", (F.col("short1") == 0) & (F.col("short2") == 0)).withColumn("rows_to_add",
        F.greatest(F.lit(0), F.col("milestone") - cohort_n))
    before = F.coalesce(F.lag("feasible").over(Window.partitionBy("label").orderBy("milestone")),
        (F.col("n1") >= F.col("t1")) & (F.col("n2") >= F.col("t2")))
    limiting = F.when(F.col("feasible"), "none").when((F.col("short1") > 0) & (F.col("short2") > 0), "both").when(F.col("short1") > 0,
        "group_1").otherwise("group_2")
    return rows.withColumn("newly_feasible", F.col("feasible") & ~before).select(
        "label", "analysis", family(F.col("analysis")).alias("family"), "milestone", "rows_to_add", "n1", "n2", "projected1", "projected2", "need1",
            "need2", "short1", "short2", "feasible", "newly_feasible", limiting.alias("limiting_group"))


def pools(df: DataFrame, milestones: tuple[int, ...] = MILESTONES) -> DataFrame:
    """Current and needed sizes of the pool tree; a pool's net need is its gap less its children's, bottom up."""
    spark = df.sparkSession
    counts = pool_counts(df).unpivot([], list(POOLS), "pool", "current_n")
    targets = spark.createDataFrame([(k, p[1], p[2], m, t) for k, p in POOLS.items() for m,
        t in zip(MILESTONES, p[3], strict=True) if m in milestones], "pool string, depth int, parent string, milestone int, target_n int")
    rows = targets.join(counts, "pool").withColumn("raw_gap",
        F.greatest(F.lit(0), F.col("target_n") - F.col("current_n"))).withColumn("child_planned", F.lit(0).cast("long"))
    rows = rows.withColumn("net_needed", F.col("raw_gap"))
    for depth in (1, 0):
        child = rows.filter(F.col("depth") == depth + 1).groupBy(F.col("parent").alias("_p"),
            F.col("milestone").alias("_m")).agg(F.sum("net_needed").alias("_net"))
        rows = rows.join(F.broadcast(child), (F.col("pool") == F.col("_p")) & (F.col("milestone") == F.col("_m")), "left")
        planned = F.when(F.col("depth") == depth, F.coalesce("_net", F.lit(0))).otherwise(F.col("child_planned"))
        rows = rows.withColumn("child_planned", planned).withColumn("net_needed",
            F.greatest(F.lit(0), F.col("raw_gap") - F.col("child_planned"))).drop("_p", "_m", "_net")
    return rows.select("milestone", "pool", "depth", "parent", "current_n", "target_n", "raw_gap", "child_planned", "net_needed")
