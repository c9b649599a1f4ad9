"""Row-wise column functions (JVM expressions only, so they stay inside
whole-stage codegen). Each returns a ``Column``."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: ICD-9 clinical groups, both ends inclusive, in order ---
ICD9_GROUPS = [
    ("Infectious", 1, 139),
    ("Neoplasms", 140, 239),
    ("Endocrine_Other", 240, 249),
    ("Diabetes", 250, 250),
    ("Endocrine_Post", 251, 279),
    ("Blood", 280, 289),
    ("Mental", 290, 319),
    ("Nervous", 320, 389),
    ("Circulatory", 390, 459),
    ("Respiratory", 460, 519),
    ("Digestive", 520, 579),
    ("Genitourinary", 580, 629),
    ("Pregnancy", 630, 679),
    ("Skin", 680, 709),
    ("Musculoskeletal", 710, 739),
    ("Congenital", 740, 759),
    ("Perinatal", 760, 779),
    ("Ill_Defined", 780, 799),
    ("Injury", 800, 999),
]

# --- fixed values: age bracket midpoints, A1C and glucose ordinals ---
AGE_MIDPOINTS = {
    "[0-10)": 5, "[10-20)": 15, "[20-30)": 25, "[30-40)": 35, "[40-50)": 45,
    "[50-60)": 55, "[60-70)": 65, "[70-80)": 75, "[80-90)": 85, "[90-100)": 95,
}
AGE_ORDER = list(AGE_MIDPOINTS)
A1C_ORDINAL = {"None": 0, "Norm": 1, ">7": 2, ">8": 3}
GLU_ORDINAL = {"None": 0, "Norm": 1, ">200": 2, ">300": 3}
OUTCOME_LABELS = {"NO": "No Readmission", "<30": "Readmitted <30 days", ">30": "Readmitted >30 days"}

# --- fixed values: age-group bins for fairness, right-closed ---
AGE_BIN_EDGES = [0, 40, 60, 75, 100]
AGE_BIN_LABELS = ["<40", "40-60", "60-75", "75+"]

# A decimal number the way a float parser takes it (no 'inf'/'nan', no
# trailing type letters such as '5d', which Spark's cast would accept).
NUMBER_PATTERN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def range_label(n: str | Column, ranges: Sequence[tuple[str, int, int]],
                default: str = "Other") -> Column:
    """C4 for a short fixed list: label of the first range lo <= n <= hi."""
    n = _c(n)
    expr = None
    for label, lo, hi in ranges:
        cond = (n >= lo) & (n <= hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def diagnosis_code_number(code: str | Column) -> Column:
    """Integer part of a diagnosis code written as a plain decimal number,
    else null (so '5d', 'inf', 'nan' and E/V codes give null)."""
    t = F.trim(_c(code))
    return F.when(t.rlike(NUMBER_PATTERN), t.try_cast("double").try_cast("bigint"))


def diagnosis_group(code: str | Column, number: str | Column | None = None) -> Column:
    """ICD-9 code -> clinical group.

    null / blank / '?' -> Unknown; leading E or V -> External; a parsable
    number -> integer part -> range group; anything else -> Other. Pass the
    precomputed ``diagnosis_code_number`` column as ``number`` to keep the
    parse out of every range branch.
    """
    t = F.trim(_c(code))
    n = _c(number) if number is not None else diagnosis_code_number(code)
    return (F.when(t.isNull() | (t == "") | (t == "?"), F.lit("Unknown"))
            .when(t.startswith("E") | t.startswith("V"), F.lit("External"))
            .when(n.isNotNull(), range_label(n, ICD9_GROUPS))
            .otherwise(F.lit("Other")))


def count_not_equal(cols: Iterable[str], value: str) -> Column:
    """Number of columns whose value is not ``value``; a null counts."""
    terms = [(~_c(c).eqNullSafe(F.lit(value))).cast("int") for c in cols]
    return sum(terms[1:], terms[0]) if terms else F.lit(0)


def count_in(cols: Iterable[str], values: Sequence[str]) -> Column:
    """D3: number of columns whose value is in ``values`` (null -> no)."""
    terms = [F.coalesce(_c(c).isin(list(values)), F.lit(False)).cast("int") for c in cols]
    return sum(terms[1:], terms[0]) if terms else F.lit(0)


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 int, null -> 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def row_sum(cols: Iterable[str | Column]) -> Column:
    """Sum of columns."""
    cols = [_c(c) for c in cols]
    return sum(cols[1:], cols[0]) if cols else F.lit(0)


def row_nunique(cols: Iterable[str | Column]) -> Column:
    """Distinct non-null values across the given columns of one row."""
    return F.size(F.array_distinct(F.array_compact(F.array(*[_c(c) for c in cols]))))


def map_values(col: str | Column, mapping: Mapping, default=None) -> Column:
    """Constant-map lookup, unmatched/null -> ``default``."""
    col = _c(col)
    expr = None
    for k, v in mapping.items():
        cond = col == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    out = expr.otherwise(F.lit(default)) if default is not None else expr
    return out


def bin_right_closed(col: str | Column, edges: Sequence[float], labels: Sequence[str],
                     outside: str = "nan") -> Column:
    """Right-closed bins (edges[i], edges[i+1]] -> labels[i];
    outside or null -> the text ``outside`` (what the source's string cast of
    a missing category gives)."""
    col = _c(col)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (col > lo) & (col <= hi)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(outside))


def hash_unit(key: str | Column, salt: str) -> Column:
    """Deterministic uniform number in [0, 1) from (key, salt): the first 32
    bits of md5(key || ':' || salt). Same value in DuckDB with
    ('0x' || substring(md5(..), 1, 8))::bigint / 4294967296."""
    h = F.conv(F.substring(F.md5(F.concat(_c(key).cast("string"), F.lit(":" + salt))), 1, 8), 16, 10)
    return h.cast("bigint").cast("double") / F.lit(4294967296.0)


def hash_bits(key: str | Column, salt: str) -> Column:
    """The 32-bit integer behind ``hash_unit``."""
    return F.conv(F.substring(F.md5(F.concat(_c(key).cast("string"), F.lit(":" + salt))), 1, 8),
                  16, 10).cast("bigint")
