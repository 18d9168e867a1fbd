"""Row predicates as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one(column: str, operator: str, values) -> Column:
    """One declarative test. A list makes == and != membership; != and not in keep missing values, the others drop them."""
    c, many = F.col(column), isinstance(values, (list, tuple, set))
    if operator in ("==", "in"):
        test = c.isin(list(values)) if many else c == values
        return F.coalesce(test, F.lit(False))
    if operator in ("!=", "not in"):
        return ~F.coalesce(c.isin(list(values)), F.lit(False)) if many else ~c.eqNullSafe(values)
    compare: dict[str, Callable[[], Column]] = {">": lambda: c > values, ">=": lambda: c >= values, "<": lambda: c < values, "<=": lambda: c <= values}
    if operator not in compare:
        raise ValueError(f"unknown operator {operator!r}")
    return F.coalesce(compare[operator](), F.lit(False))


def rows(df: DataFrame, tests: list[dict]) -> DataFrame:
    """Rows that pass every test {column, operator, values}."""
    keep = F.lit(True)
    for t in tests:
        keep = keep & one(t["column"], t["operator"], t["values"])
    return df.filter(keep)


def _match(wanted: dict) -> Column:
    out = F.lit(True)
    for c, v in wanted.items():
        out = out & F.coalesce(F.col(c).cast("string").isin([str(x) for x in (v if isinstance(v, (list, tuple)) else [v])]), F.lit(False))
    return out


def cohort(df: DataFrame, any_of: list[dict] = (), all_of: dict | None = None) -> DataFrame:
    """Rows in any AND-group of any_of, then in every list of all_of; compared as text."""
    keep = _match(all_of or {})
    if any_of:
        either = F.lit(False)
        for group in any_of:
            either = either | _match(group)
        keep = keep & either
    return df.filter(keep)


def _flags(adhd: int, autism: int, epilepsy: int) -> str:
    return f"adhd = {adhd} AND autism = {autism} AND epilepsy = {epilepsy}"


AMPHETAMINE = "psychostimulant_category IN ('Lisdexamfetamine', 'Dextroamphetamine')"
#: P3, fixed values: the named cohort constraints.
CONSTRAINTS = {
    "No_Constraint": "TRUE",
    "No_ADHD": "adhd = 0",
    "No_Autism": "autism = 0",
    "No_Epilepsy": "epilepsy = 0",
    "Psychostim_True": "psychostimulant = 1",
    "Psychostim_False": "psychostimulant = 0",
    "ASM_True": "asm = 1",
    "ASM_False": "asm = 0",
    "ASM_Resistant_True": "asm_resistant = 1",
    "ASM_Resistant_False": "asm_resistant = 0",
    "First_EEG": "first_eeg = 1",
    "DrugResistant_First_EEG": "coalesce(asm_resistant, 0) <> 1 OR first_eeg = 1",
    "Control_Only": _flags(0, 0, 0),
    "ADHD_Only": _flags(1, 0, 0),
    "Epilepsy_Only": _flags(0, 0, 1),
    "Autism_Only": _flags(0, 1, 0),
    "ADHD_Epilepsy": _flags(1, 0, 1),
    "ADHD_Autism": _flags(1, 1, 0),
    "Epilepsy_Autism": _flags(0, 1, 1),
    "ADHD_Epilepsy_Autism": _flags(1, 1, 1),
    "Methylphenidate": "psychostimulant_category = 'Methylphenidate'",
    "Dextroamphetamine": "psychostimulant_category = 'Dextroamphetamine'",
    "Lisdexamfetamine": "psychostimulant_category = 'Lisdexamfetamine'",
    "Combined_Amphetamine": AMPHETAMINE,
}
#: P5, fixed values.
EXCLUSIVE = ("Control_Only", "ADHD_Only", "Epilepsy_Only", "Autism_Only", "ADHD_Epilepsy", "ADHD_Autism", "Epilepsy_Autism", "ADHD_Epilepsy_Autism")
SINGLE_STIMULANTS = ("Methylphenidate", "Dextroamphetamine", "Lisdexamfetamine")
IMPLIES = (
    ("No_ADHD", "Psychostim_False"), ("No_Epilepsy", "ASM_False"), ("ASM_Resistant_True", "ASM_True"), ("Methylphenidate", "Psychostim_True"),
    ("Dextroamphetamine", "Psychostim_True"), ("Lisdexamfetamine", "Psychostim_True"), ("Combined_Amphetamine", "Psychostim_True"),
)
CONTRADICTS = (
    ("Psychostim_True", "Psychostim_False"), ("ASM_True", "ASM_False"), ("ASM_Resistant_True", "ASM_False"), ("ASM_Resistant_True", "No_Epilepsy"),
    ("No_ADHD", "Methylphenidate"), ("No_ADHD", "Dextroamphetamine"), ("No_ADHD", "Lisdexamfetamine"), ("No_ADHD", "Combined_Amphetamine"),
)


def set_status(names: Column) -> Column:
    """P5: `contradictory_constraints`, `redundant_constraint_set` or NULL for an array of constraint names.

    The implications stand before the contradictions, so the first that applies decides.
    """
    held = lambda group: F.size(F.array_intersect(F.array_distinct(names), F.array(*[F.lit(x) for x in group])))
    has = lambda *xs: held(xs) == len(xs)
    bad, spare = F.lit("contradictory_constraints"), F.lit("redundant_constraint_set")
    out = F.when((held(EXCLUSIVE) > 1) | (held(SINGLE_STIMULANTS) > 1) | has("Combined_Amphetamine", "Methylphenidate"), bad)
    out = out.when(has("Combined_Amphetamine", "Dextroamphetamine") | has("Combined_Amphetamine", "Lisdexamfetamine"), spare)
    for pair in IMPLIES:
        out = out.when(has(*pair), spare)
    for pair in CONTRADICTS:
        out = out.when(has(*pair), bad)
    return out


LEV, VPA = "epilepsy = 1 AND asm_types = 'LEV'", "epilepsy = 1 AND asm_types = 'VPA'"
UNMEDICATED_EPILEPSY, UNMEDICATED_ADHD = "epilepsy = 1 AND asm = 0", "adhd = 1 AND psychostimulant = 0"
CONTROL, NO_EPILEPSY = "combined_diagnosis = 'Control'", "epilepsy = 0"
#: The background constraint sets of each kind of comparison.
ADHD_BACKGROUND = ("No_Epilepsy", "No_Autism", "No_Autism+No_Epilepsy", "ASM_False", "No_Autism+ASM_False", "ASM_Resistant_False", "No_Autism+ASM_Resistant_False")
EPILEPSY_BACKGROUND = ("No_ADHD", "No_Autism", "No_ADHD+No_Autism", "Psychostim_False", "No_ADHD+Psychostim_False", "No_Autism+Psychostim_False")
MEDICATED_BACKGROUND = (*EPILEPSY_BACKGROUND, "ASM_Resistant_False")
LATER_BACKGROUND = ("No_Constraint", "No_ADHD", "No_Autism", "No_ADHD+No_Autism", "Psychostim_False")
STATUS_BACKGROUND = tuple(x for s in LATER_BACKGROUND for x in (s, "DrugResistant_First_EEG" if s == "No_Constraint" else f"{s}+DrugResistant_First_EEG"))
ON = lambda drug: f"adhd = 1 AND psychostimulant_category = '{drug}'"
ON_AMPHETAMINE = f"adhd = 1 AND {AMPHETAMINE}"
#: P4, fixed values: name, the two arms' labels and predicates, and the constraint sets to try.
COMPARISONS = (
    ("DrugResistance_Status", "Not Resistant", "Resistant", "epilepsy = 1 AND asm = 1 AND asm_resistant = 0", "epilepsy = 1 AND asm_resistant = 1", STATUS_BACKGROUND),
    ("DrugResistance_First_vs_Later", "First EEG", "Later EEG", "asm_resistant = 1 AND first_eeg = 1", "asm_resistant = 1 AND first_eeg = 0", LATER_BACKGROUND),
    ("Epilepsy_ASM_Effect_Any", "Epilepsy Unmedicated", "Epilepsy on ASM", UNMEDICATED_EPILEPSY, "epilepsy = 1 AND asm = 1", MEDICATED_BACKGROUND),
    ("Epilepsy_ASM_Effect_LEV_Only", "Epilepsy Unmedicated", "LEV Only", UNMEDICATED_EPILEPSY, LEV, MEDICATED_BACKGROUND),
    ("Epilepsy_ASM_Effect_VPA_Only", "Epilepsy Unmedicated", "VPA Only", UNMEDICATED_EPILEPSY, VPA, MEDICATED_BACKGROUND),
    ("Epilepsy_LEV_vs_VPA_Only", "LEV Only", "VPA Only", LEV, VPA, MEDICATED_BACKGROUND),
    ("NonEpilepsy_vs_Epilepsy_Unmedicated", "Non Epilepsy", "Epilepsy Unmedicated", NO_EPILEPSY, UNMEDICATED_EPILEPSY, EPILEPSY_BACKGROUND),
    ("NonEpilepsy_vs_Epilepsy_ASM_Any", "Non Epilepsy", "Epilepsy on ASM", NO_EPILEPSY, "epilepsy = 1 AND asm = 1", EPILEPSY_BACKGROUND),
    ("NonEpilepsy_vs_Epilepsy_LEV_Only", "Non Epilepsy", "LEV Only", NO_EPILEPSY, LEV, EPILEPSY_BACKGROUND),
    ("NonEpilepsy_vs_Epilepsy_VPA_Only", "Non Epilepsy", "VPA Only", NO_EPILEPSY, VPA, EPILEPSY_BACKGROUND),
    ("ADHD_Psychostim_Effect_Any", "ADHD Unmedicated", "ADHD Medicated", UNMEDICATED_ADHD, "adhd = 1 AND psychostimulant = 1", ADHD_BACKGROUND),
    ("ADHD_Psychostim_Effect_Methylphenidate", "ADHD Unmedicated", "Methylphenidate", UNMEDICATED_ADHD, ON("Methylphenidate"), ADHD_BACKGROUND),
    ("ADHD_Psychostim_Effect_Lisdexamfetamine", "ADHD Unmedicated", "Lisdexamfetamine", UNMEDICATED_ADHD, ON("Lisdexamfetamine"), ADHD_BACKGROUND),
    ("ADHD_Psychostim_Effect_Dextroamphetamine", "ADHD Unmedicated", "Dextroamphetamine", UNMEDICATED_ADHD, ON("Dextroamphetamine"), ADHD_BACKGROUND),
    ("ADHD_Methylphenidate_vs_Lisdexamfetamine", "Methylphenidate", "Lisdexamfetamine", ON("Methylphenidate"), ON("Lisdexamfetamine"), ADHD_BACKGROUND),
    ("ADHD_Methylphenidate_vs_Amphetamine", "Methylphenidate", "Amphetamine", ON("Methylphenidate"), ON_AMPHETAMINE, ADHD_BACKGROUND),
    ("Control_vs_ADHD_Medicated_Any", "Controls", "Any Medicated ADHD", CONTROL, "adhd = 1 AND psychostimulant = 1", ADHD_BACKGROUND),
    ("Control_vs_ADHD_Methylphenidate", "Controls", "Methylphenidate", CONTROL, ON("Methylphenidate"), ADHD_BACKGROUND),
    ("Control_vs_ADHD_Lisdexamfetamine", "Controls", "Lisdexamfetamine", CONTROL, ON("Lisdexamfetamine"), ADHD_BACKGROUND),
    ("Control_vs_ADHD_Amphetamine", "Controls", "Amphetamine", CONTROL, ON_AMPHETAMINE, ADHD_BACKGROUND),
)
PURE_ADHD, PURE_EPILEPSY = _flags(1, 0, 0), _flags(0, 0, 1)
#: P6, fixed values: recruitment pools: label, depth, parent, targets at 1500, 2000, 3000 and 5000 rows, predicate.
POOLS = {
    "controls": ("Controls", 0, None, (350, 500, 1000, 1650), CONTROL),
    "adhd_total": ("Pure ADHD (Total)", 0, None, (250, 400, 600, 1000), PURE_ADHD),
    "adhd_unmed": ("ADHD Unmedicated", 1, "adhd_total", (100, 150, 200, 200), f"{PURE_ADHD} AND psychostimulant = 0"),
    "adhd_med_any": ("ADHD Medicated Any", 1, "adhd_total", (150, 250, 400, 800), f"{PURE_ADHD} AND psychostimulant = 1"),
    "adhd_methyl": ("ADHD Methylphenidate", 2, "adhd_med_any", (75, 125, 200, 400), f"{PURE_ADHD} AND psychostimulant_category = 'Methylphenidate'"),
    "adhd_amphetamine": ("ADHD Amphetamine", 2, "adhd_med_any", (75, 125, 200, 400), f"{PURE_ADHD} AND {AMPHETAMINE}"),
    "epilepsy_total": ("Pure Epilepsy (Total)", 0, None, (350, 500, 800, 1350), PURE_EPILEPSY),
    "epilepsy_unmed": ("Epilepsy Unmedicated", 1, "epilepsy_total", (100, 150, 200, 200), f"{PURE_EPILEPSY} AND asm = 0"),
    "epilepsy_asm_any": ("Epilepsy ASM Any", 1, "epilepsy_total", (250, 350, 600, 1150), f"{PURE_EPILEPSY} AND asm = 1"),
    "epilepsy_lev_only": ("Epilepsy LEV Only", 2, "epilepsy_asm_any", (125, 175, 300, 575), f"{PURE_EPILEPSY} AND asm_types = 'LEV'"),
    "epilepsy_vpa_only": ("Epilepsy VPA Only", 2, "epilepsy_asm_any", (125, 175, 300, 575), f"{PURE_EPILEPSY} AND asm_types = 'VPA'"),
    "drug_resistant_epilepsy": ("Drug Resistant Epilepsy", 0, None, (100, 150, 250, 450), "epilepsy = 1 AND asm_resistant = 1"),
}
MILESTONES = (1500, 2000, 3000, 5000)


def holds(predicate: str) -> Column:
    """A named predicate's text as a boolean column, false where it is unknown."""
    return F.coalesce(F.expr(predicate), F.lit(False))


def constraint_columns(df: DataFrame) -> DataFrame:
    """One boolean column `is_<name>` for each named constraint."""
    return df.select("*", *[holds(p).alias(f"is_{n}") for n, p in CONSTRAINTS.items()])


def bits(predicates: list[str]) -> Column:
    """Predicates as the bits of one number, folded from an array, whose code Spark splits into methods of its own."""
    held = F.array(*[holds(p).cast("long") for p in reversed(predicates)])
    return F.aggregate(held, F.lit(0).cast("long"), lambda number, bit: number * 2 + bit)


def pool_counts(df: DataFrame) -> DataFrame:
    """One row with the size of each recruitment pool."""
    return df.agg(*[F.count_if(holds(p[4])).alias(k) for k, p in POOLS.items()])


#: P9, fixed values: event labels that reports leave out.
IGNORED_EVENTS = (r"^HV\s+\d{2}:\d{2}$", r"^POST\s*HV\s+\d{2}:\d{2}$", r"^PHOTO\s+\d+(?:\.\d+)?(?:Hz)?$", r"^\d+\s*min\s+post\s+hv$", r"^fin\s+post\s+hv$")


def unignored(label: str, patterns: tuple[str, ...] = IGNORED_EVENTS) -> Column:
    """No pattern is found in the label, whatever the case; a missing label is kept."""
    return ~F.coalesce(F.col(label).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def truthy(c: Column) -> Column:
    """The value reads 1, true, yes, y or present."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "y", "present"), F.lit(False))
