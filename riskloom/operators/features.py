"""Clinical feature derivation as single projections."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.clinical import (
    A1C_ORDINAL, AGE_MIDPOINTS, GLU_ORDINAL, count_in, count_not_equal,
    diagnosis_code_number, diagnosis_group, flag, map_values, row_nunique, row_sum,
)
from riskloom.sources.encounters import DRUG_COLUMNS

DIAG_COLUMNS = ["diag_1", "diag_2", "diag_3"]

# --- fixed values: the 24 model features, in model order ---
FEATURES = [
    "time_in_hospital", "num_lab_procedures", "num_procedures", "num_medications",
    "number_outpatient", "number_emergency", "number_inpatient", "number_diagnoses",
    "num_active_medications", "medication_change_count", "has_insulin", "insulin_changed",
    "total_visits_prior", "high_utilizer", "diabetes_primary", "num_comorbidities",
    "long_stay", "emergency_admission", "age_numeric", "med_changed", "on_diabetes_med",
    "a1c_ordinal", "glu_ordinal", "gender_male",
]


def group_diagnoses(df: DataFrame, cols: Sequence[str] = DIAG_COLUMNS) -> DataFrame:
    """D1 on each diagnosis column -> <col>_group."""
    present = [c for c in cols if c in df.columns]
    # parse each code once (own projection), then map the number to its range
    nums = df.select("*", *[diagnosis_code_number(c).alias(f"__num_{c}") for c in present])
    return nums.select(*[F.col(c) for c in df.columns],
                       *[diagnosis_group(c, f"__num_{c}").alias(f"{c}_group") for c in present])


def encode_medications(df: DataFrame, drugs: Sequence[str] = DRUG_COLUMNS,
                       focus: str = "insulin") -> DataFrame:
    """Active-drug count, dose-change count, insulin flags; the raw
    drug columns are dropped."""
    meds = [c for c in drugs if c in df.columns]
    has = F.col(focus) if focus in df.columns else F.lit("No")
    return df.select(
        *[c for c in df.columns if c not in meds],
        count_not_equal(meds, "No").alias("num_active_medications"),
        count_in(meds, ["Up", "Down"]).alias("medication_change_count"),
        flag(~has.eqNullSafe(F.lit("No"))).alias("has_insulin"),
        flag(has.isin("Up", "Down")).alias("insulin_changed"))


@dataclass(frozen=True)
class Derived:
    """A feature: its name, the columns it reads and its expression. Without
    those columns it is left out, unless ``always`` (then a column that is
    absent counts as ``absent``)."""

    name: str
    needs: tuple[str, ...]
    value: Callable[[dict[str, Column]], Column]
    always: bool = False
    absent: object = 0


def _ordinal(col: str, codes: dict, default, kind: str) -> Callable[[dict[str, Column]], Column]:
    return lambda c: F.coalesce(map_values(c[col], codes), F.lit(default)).cast(kind)


_VISITS = ("number_outpatient", "number_emergency", "number_inpatient")
_GROUPS = tuple(f"{c}_group" for c in DIAG_COLUMNS)

DERIVED = (
    Derived("total_visits_prior", _VISITS, lambda c: row_sum([c[v] for v in _VISITS]), always=True),
    Derived("high_utilizer", _VISITS, lambda c: flag(row_sum([c[v] for v in _VISITS]) >= 3), always=True),
    Derived("diabetes_primary", ("diag_1",), lambda c: flag(c["diag_1"].cast("string").startswith("250")), always=True),
    Derived("num_comorbidities", _GROUPS, lambda c: row_nunique([c[g] for g in _GROUPS]), always=True,
            absent=None),
    Derived("long_stay", ("time_in_hospital",), lambda c: flag(c["time_in_hospital"] > 7)),
    Derived("emergency_admission", ("admission_type_id",), lambda c: flag(c["admission_type_id"] == 1)),
    Derived("age_numeric", ("age",), _ordinal("age", AGE_MIDPOINTS, 55, "double")),
    Derived("med_changed", ("change",), lambda c: flag(c["change"] == "Ch")),
    Derived("on_diabetes_med", ("diabetesMed",), lambda c: flag(c["diabetesMed"] == "Yes")),
    Derived("a1c_ordinal", ("A1Cresult",), _ordinal("A1Cresult", A1C_ORDINAL, 0, "int")),
    Derived("glu_ordinal", ("max_glu_serum",), _ordinal("max_glu_serum", GLU_ORDINAL, 0, "int")),
)


def derive_features(df: DataFrame) -> DataFrame:
    """The features of ``DERIVED`` that the columns allow, in
    one projection."""
    have = {c: F.col(c) for c in df.columns}
    use = [f for f in DERIVED if f.always or all(c in have for c in f.needs)]
    return df.select("*", *[f.value({c: have.get(c, F.lit(f.absent)) for c in f.needs}).alias(f.name) for f in use])


def gender_flag(df: DataFrame, col: str = "gender", out: str = "gender_male") -> DataFrame:
    """D9 on gender."""
    if col not in df.columns:
        return df.withColumn(out, F.lit(0))
    return df.withColumn(out, flag(F.col(col) == "Male"))
