"""Column expressions shared by the operators. All of them stay in generated JVM code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGING_LABELS = ("0-30", "31-60", "61-90", "91-120", "120+")
AGING_LIMITS = (30, 60, 90, 120)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def iso_date(c: Column | str) -> Column:
    """``yyyy-MM-dd`` text to date; any other text becomes NULL.

    The plain cast is many times faster than parsing with a pattern, but also takes
    shorter and longer forms; the checks on the shape leave those out.
    """
    c = _col(c)
    shape = (F.length(c) == 10) & (F.substring(c, 5, 1) == "-") & (F.substring(c, 8, 1) == "-")
    return F.when(shape & F.substring(c, 10, 1).between("0", "9"), c.try_cast("date"))


def period(c: Column | str) -> Column:
    """ISO date text to its ``yyyy-MM`` month, NULL if unparseable."""
    return F.when(iso_date(c).isNotNull(), F.substring(_col(c), 1, 7))


def days_between(start: Column | str, end: Column | str) -> Column:
    """Whole days from one ISO date text to another."""
    return F.datediff(iso_date(end), iso_date(start))


def pct(part: Column, whole: Column) -> Column:
    """``part / whole`` in percent, 0 when the whole is not positive (or NULL)."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def per(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 when the whole is not positive (or NULL)."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as double, NULL when the whole is zero or NULL."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def total(c: Column | str) -> Column:
    """Sum that is 0.0 for no rows."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def count_when(condition: Column) -> Column:
    """Rows for which the condition is true (0, not NULL, for none)."""
    return F.count(F.when(condition, F.lit(1)))


def sum_when(condition: Column, value: Column | str) -> Column:
    """Sum of the value over matching rows, 0 contributed by the others."""
    value = F.col(value) if isinstance(value, str) else value
    return F.sum(F.when(condition, value).otherwise(F.lit(0.0)))


def denied_or_appealed(status: Column | str = "claim_status") -> Column:
    """The KPI definition of a denial (the gold views count 'Denied' only)."""
    status = F.col(status) if isinstance(status, str) else status
    return status.isin("Denied", "Appealed")


def aging_bucket(age: Column, suffix: str = "") -> Column:
    """Age in days to its bucket; a NULL age lands in the oldest one."""
    first, *rest = zip(AGING_LIMITS, AGING_LABELS)
    chain = F.when(age <= first[0], F.lit(first[1] + suffix))
    for limit, label in rest:
        chain = chain.when(age <= limit, F.lit(label + suffix))
    return chain.otherwise(F.lit(AGING_LABELS[-1] + suffix))


def lookup(key: Column, table: dict, default: Column) -> Column:
    """Value of a small fixed dictionary for a key column."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def grade(value: Column, good: Column, warn: Column) -> Column:
    """Three-step status from two conditions."""
    return F.when(good, F.lit("good")).when(warn, F.lit("warn")).otherwise(F.lit("bad"))


def side_by_side(*one_row_frames: DataFrame) -> DataFrame:
    """Put one-row frames next to each other without a join.

    Every input has exactly one row and its own columns. The union has one row per
    input, and ``max`` picks the only non-NULL value of every column.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row_frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def to_rows(one_row: DataFrame, name: str, value: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Unpivot columns of a one-row frame: ``pairs`` are (label, column)."""
    entries = F.array(*[
        F.struct(F.lit(label).alias(name), F.col(column).cast("double").alias(value)) for label, column in pairs
    ])
    return one_row.select(F.inline(entries))


def steady_round(c: Column, digits: int) -> Column:
    """Round half up, after dropping the noise that summing doubles leaves in the last places.

    A sum that is exactly half a cent is then rounded the same way on every run.
    """
    return F.round(F.round(c, 6), digits)


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    """Round the double columns for display."""
    doubles = {n: steady_round(F.col(n), digits) for n, t in df.dtypes if t == "double"}
    return df.withColumns(doubles) if doubles else df
