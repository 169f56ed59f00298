"""Metrics x dimensions x filters over the declared joins.

The model is data: additive parts of metrics per table, many-to-one joins, time dimensions. Joins run from the table of a
metric outward, so grouping a fact never multiplies it. Parts are summed per foreign key before every join, so the rows
that meet a looked-up table are one per key, however many rows a key has; distinct counts keep the counted key.
Metrics of several tables are aggregated table by table and then aligned on the dimensions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlake.functions.columns import days_between, denied_or_appealed, iso_date, ratio
from remitlake.operators.ledger import is_open, with_payments
from remitlake.sources.schemas import TABLES
from remitlake.sources.silver import Silver


@dataclass(frozen=True)
class Part:
    """A number that is added up over rows: the values of an expression, or how many of them there are."""

    value: Callable[[], Column]
    counts: bool = False

    def of_rows(self) -> Column:
        return F.count(self.value()) if self.counts else F.sum(self.value())

    def of_sums(self, name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)) if self.counts else F.sum(name)


@dataclass(frozen=True)
class Metric:
    """Parts and what is computed from their totals; or a column whose distinct values are counted."""

    parts: tuple[Part, ...] = ()
    final: Callable[..., Column] = lambda total: total
    distinct: str | None = None


def _value(column: str) -> Part:
    return Part(lambda: F.col(column))


def _count_of(column: str) -> Part:
    return Part(lambda: F.col(column), True)


def _rows_where(condition: Callable[[], Column]) -> Part:
    return Part(lambda: F.when(condition(), F.lit(1)), True)


_ROWS = Part(lambda: F.lit(1), True)


def _sum(part: Part) -> Metric:
    return Metric((part,))


def _percent(part: Part, whole: Part) -> Metric:
    return Metric((part, whole), lambda p, w: ratio(p * 100.0, w))


def _mean(value: Callable[[], Column]) -> Metric:
    return Metric((Part(value), Part(value, True)), ratio)


def _is(column: str, value: str) -> Column:
    return F.col(column) == value


def _sum_of(column: str, code: str) -> Metric:
    return _sum(Part(lambda: F.when(_is("adjustment_type_code", code), F.col(column)).otherwise(0.0)))


def _short() -> Column:
    return F.col("payment_amount") < F.col("allowed_amount")


# Metrics per table. Functions inside, because columns can only be built with a session.
METRICS = {
    "claims": {
        "total_claims": Metric(distinct="claim_id"),
        "total_charges": _sum(_value("total_charge_amount")),
        "denied_count": _sum(_rows_where(denied_or_appealed)),
        "clean_count": _sum(_value("is_clean_claim")),
        "denial_rate": _percent(_rows_where(denied_or_appealed), _count_of("claim_id")),
        "clean_claim_rate": _percent(_value("is_clean_claim"), _count_of("claim_id")),
        "avg_charge_lag": _mean(lambda: days_between("date_of_service", "submission_date")),
    },
    "payments": {
        "total_payments": _sum(_value("payment_amount")),
        "total_allowed": _sum(_value("allowed_amount")),
        "payment_accuracy_rate": _percent(_value("is_accurate_payment"), _ROWS),
        "total_underpaid": _sum(
            Part(lambda: F.when(_short(), F.col("allowed_amount") - F.col("payment_amount")).otherwise(0.0))
        ),
        "underpayment_rate": _percent(_rows_where(_short), _ROWS),
    },
    "denials": {
        "total_denials": _sum(_ROWS),
        "total_denied": _sum(_value("denied_amount")),
        "total_recovered": _sum(_value("recovered_amount")),
        "appeal_success_rate": _percent(
            _rows_where(lambda: _is("appeal_status", "Won")), _rows_where(lambda: F.col("appeal_status") != "Not Appealed")
        ),
    },
    "charges": {
        "total_charge_amount": _sum(_value("charge_amount")),
        "total_units": _sum(_value("units")),
        "charge_line_count": _sum(_ROWS),
    },
    "adjustments": {
        "total_adjustments": _sum(_value("adjustment_amount")),
        "bad_debt_total": _sum_of("adjustment_amount", "WRITEOFF"),
        "contractual_total": _sum_of("adjustment_amount", "CONTRACTUAL"),
    },
    "operating_costs": {"total_rcm_cost": _sum(_value("total_rcm_cost"))},
    "encounters": {"total_encounters": Metric(distinct="encounter_id")},
}

# Numeric columns that can be summed as they are.
FACTS = {
    "claims": ["total_charge_amount", "is_clean_claim"],
    "payments": ["payment_amount", "allowed_amount", "is_accurate_payment"],
    "denials": ["denied_amount", "recovered_amount"],
    "charges": ["units", "charge_amount"],
    "adjustments": ["adjustment_amount"],
    "operating_costs": [
        "billing_staff_cost", "software_cost", "outsourcing_cost", "supplies_overhead", "total_rcm_cost",
    ],
}

# Date-typed names for date texts.
TIME_DIMENSIONS = {
    "claims": {"date_of_service_time": "date_of_service", "submission_date_time": "submission_date"},
    "payments": {"payment_date_time": "payment_date"},
    "denials": {"denial_date_time": "denial_date"},
    "charges": {"service_date_time": "service_date"},
    "adjustments": {"adjustment_date_time": "adjustment_date"},
    "encounters": {"encounter_date": "date_of_service"},
}

# Many-to-one joins (name, left table, right table, left column, right column).
RELATIONSHIPS = [
    ("claims_to_encounters", "claims", "encounters", "encounter_id", "encounter_id"),
    ("claims_to_payers", "claims", "payers", "payer_id", "payer_id"),
    ("claims_to_patients", "claims", "patients", "patient_id", "patient_id"),
    ("payments_to_claims", "payments", "claims", "claim_id", "claim_id"),
    ("payments_to_payers", "payments", "payers", "payer_id", "payer_id"),
    ("denials_to_claims", "denials", "claims", "claim_id", "claim_id"),
    ("adjustments_to_claims", "adjustments", "claims", "claim_id", "claim_id"),
    ("charges_to_encounters", "charges", "encounters", "encounter_id", "encounter_id"),
    ("encounters_to_patients", "encounters", "patients", "patient_id", "patient_id"),
    ("encounters_to_providers", "encounters", "providers", "provider_id", "provider_id"),
    ("patients_to_payers", "patients", "payers", "primary_payer_id", "payer_id"),
]


def dimensions(table: str) -> list[str]:
    """Columns to group by: all that are no facts, plus the time dimensions."""
    plain = [c for c, _ in TABLES[table] if c not in FACTS.get(table, [])]
    return plain + list(TIME_DIMENSIONS.get(table, {}))


def join_path(start: str, goal: str, via: str | None = None) -> list[tuple]:
    """Shortest chain of relationships, through ``via`` if given."""
    if via:
        return join_path(start, via) + join_path(via, goal)
    paths, seen = [(start, [])], {start}
    while paths:
        table, path = paths.pop(0)
        if table == goal:
            return path
        for relationship in RELATIONSHIPS:
            _, left, right, *_ = relationship
            if left == table and right not in seen:
                seen.add(right)
                paths.append((right, path + [relationship]))
    raise ValueError(f"No many-to-one path from {start} to {goal}")


class Dimension:
    """``table.column``, ``table.column@month`` or ``table.column@month=alias``; ``table!via.column`` forces a path."""

    def __init__(self, text: str):
        head, _, alias = text.partition("=")
        head, _, self.grain = head.partition("@")
        table, _, self.column = head.partition(".")
        self.table, _, via = table.partition("!")
        self.via = via or None
        self.alias = alias or (f"{self.column}_{self.grain}" if self.grain else self.column)

    @property
    def source(self) -> str:
        """The column that is read for it."""
        return TIME_DIMENSIONS.get(self.table, {}).get(self.column, self.column)

    def expression(self, column: str) -> Column:
        """Its value from the column ``column``, which holds the source."""
        timed = self.source != self.column
        c = iso_date(column) if timed else F.col(column)
        if not self.grain:
            return c
        day = c if timed else iso_date(c)
        return F.date_format(day, {"month": "yyyy-MM", "year": "yyyy", "day": "yyyy-MM-dd"}[self.grain])


ISO_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")

_COMPARE = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(*v),
    "between": lambda c, v: c.between(*v),
}


def _filtered(frame: DataFrame, d: Dimension, op: str, value: object, column: str) -> DataFrame:
    days = all(ISO_DATE.fullmatch(str(v)) for v in (value if isinstance(value, list) else [value]))
    if d.source != d.column and not d.grain and days:
        # Days compare like their ISO text; stated on the text too, the condition reaches the scan.
        frame = frame.filter(_COMPARE[op](F.col(column), value))
    return frame.filter(_COMPARE[op](d.expression(column), value))


class Plan:
    """Metrics of one table over the chains of joins that its dimensions and filters need.

    A stop is a chain of relationships from the table; stop ``()`` is the table itself. A joined table brings its columns
    under the name of its stop, and only those that a dimension, a filter or a further join needs.
    """

    def __init__(self, base: str, names: list[str], by: list[str], where: list[tuple]) -> None:
        self.base = base
        self.metrics = {n: METRICS[base].get(n) or _sum(_value(n)) for n in names}
        self.dims = [(d, join_path(base, d.table, d.via)) for d in map(Dimension, by)]
        self.where = [(d, op, v, join_path(base, d.table, d.via)) for d, op, v in ((Dimension(t), op, v) for t, op, v in where)]
        chains = [path for _, path in self.dims] + [w[-1] for w in self.where]
        stops = {tuple(r[0] for r in path[:i]): path[i - 1] for path in chains for i in range(1, len(path) + 1)}
        self.joins = dict(sorted(stops.items(), key=lambda x: len(x[0])))  # nearer tables first
        self.parts = {f"_{n}_{i}": p for n, m in self.metrics.items() for i, p in enumerate(m.parts)}
        self.distinct = sorted({m.distinct for m in self.metrics.values() if m.distinct})

    @staticmethod
    def name(stop: tuple[str, ...], column: str) -> str:
        return "__".join((*stop, column))

    def needed(self, stop: tuple[str, ...]) -> list[str]:
        """Columns of a stop's table that something needs after it is joined."""
        key = lambda path: tuple(r[0] for r in path)
        own = [d.source for d, path in self.dims if key(path) == stop]
        own += [d.source for d, _, _, path in self.where if key(path) == stop]
        own += [r[3] for s, r in self.joins.items() if s[:-1] == stop]
        return list(dict.fromkeys(own))

    def tested(self, frame: DataFrame, stop: tuple[str, ...]) -> DataFrame:
        for d, op, value, path in self.where:
            if tuple(r[0] for r in path) == stop:
                frame = _filtered(frame, d, op, value, self.name(stop, d.source))
        return frame

    def kept(self, joined: list[tuple[str, ...]]) -> list[str]:
        """Columns that dimensions and joins still need when these stops are joined."""
        keys = [self.name(s[:-1], r[3]) for s, r in self.joins.items() if s not in joined and s[:-1] in joined]
        shown = [self.name(p, d.source) for d, p in ((d, tuple(r[0] for r in path)) for d, path in self.dims) if p in joined]
        return list(dict.fromkeys([*keys, *shown]))

    def run(self, silver: Silver) -> DataFrame:
        frame = self.tested(getattr(silver, self.base), ())
        if not self.joins:
            return self.result(frame, lambda name: self.parts[name].of_rows())
        # A distinct count's column and a key of the same name are one column.
        keys = dict.fromkeys([*self.kept([()]), *self.distinct])
        summed = [p.of_rows().alias(n) for n, p in self.parts.items()] or [F.count(F.lit(1)).alias("_rows")]
        frame = frame.groupBy(*keys).agg(*summed)
        joined: list[tuple[str, ...]] = [()]
        for stop, (_, _, right, left_column, right_column) in self.joins.items():
            key = self.name((*stop, "key"), right_column)
            columns = [F.col(c).alias(self.name(stop, c)) for c in self.needed(stop)]
            other = getattr(silver, right).select(F.col(right_column).alias(key), *columns)
            left_key = self.name(stop[:-1], left_column)
            frame = self.tested(frame.join(other, F.col(left_key) == F.col(key), "left").drop(key), stop)
            joined.append(stop)
            if len(joined) <= len(self.joins):  # fewer rows for the next table
                again = [p.of_sums(n).alias(n) for n, p in self.parts.items()] or [F.sum("_rows").alias("_rows")]
                frame = frame.groupBy(*dict.fromkeys([*self.kept(joined), *self.distinct])).agg(*again)
        return self.result(frame, lambda name: self.parts[name].of_sums(name))

    def result(self, frame: DataFrame, total: Callable[[str], Column]) -> DataFrame:
        dims = [d.expression(self.name(tuple(r[0] for r in path), d.source)).alias(d.alias) for d, path in self.dims]
        aggregates = []
        for n, m in self.metrics.items():
            value = F.countDistinct(m.distinct) if m.distinct else m.final(*[total(f"_{n}_{i}") for i in range(len(m.parts))])
            aggregates.append(value.alias(n))
        return (frame.groupBy(*dims) if dims else frame).agg(*aggregates)


def _aggregate(silver: Silver, base: str, names: list[str], by: list[str], where: list[tuple]) -> DataFrame:
    return Plan(base, names, by, where).run(silver)


def metric_query(
    silver: Silver, metrics: list[str], by: list[str] | None = None, where: list[tuple] | None = None
) -> DataFrame:
    """Metrics as ``table.metric`` (or a fact, which is summed), one row per dimension value.

    A dimension that several tables reach by different columns is written as a tuple with
    one entry per table, all with the same alias. A filter applies to every table.
    """
    by, where = by or [], where or []
    per_table: dict[str, list[str]] = {}
    for metric in metrics:
        table, _, name = metric.partition(".")
        if name not in METRICS.get(table, {}) and name not in FACTS.get(table, []):
            raise ValueError(f"Unknown metric: {metric}")
        per_table.setdefault(table, []).append(name)

    parts = []
    for i, (table, names) in enumerate(per_table.items()):
        own = [d[i] if isinstance(d, tuple) else d for d in by]
        parts.append(_aggregate(silver, table, names, own, where))
    if len(parts) == 1:
        return parts[0]
    # One row per table and dimension value at most: the only non-NULL one is the value.
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = [n for ns in per_table.values() for n in ns]
    keys = [c for c in stacked.columns if c not in names]
    return stacked.groupBy(*keys).agg(*[F.max(n).alias(n) for n in names])


# ------------------------------------------------------------------ acceptance questions

def denial_rate_by_payer(silver: Silver) -> DataFrame:
    rates = metric_query(silver, ["claims.denial_rate", "claims.denied_count", "claims.total_claims"],
                         ["payers.payer_name"])
    return rates.orderBy(F.col("denial_rate").desc_nulls_last())


def top_denial_reasons(silver: Silver, n: int = 5) -> DataFrame:
    reasons = metric_query(silver, ["denials.total_denied", "denials.total_denials"], ["denials.denial_reason_code"])
    return reasons.orderBy(F.col("total_denied").desc_nulls_last(), "denial_reason_code").limit(n)


def denial_trend(silver: Silver, months: int = 12) -> DataFrame:
    """The latest months that have claims."""
    trend = metric_query(silver, ["claims.denial_rate"], ["claims.submission_date@month=period"])
    latest = trend.filter(F.col("period").isNotNull()).orderBy(F.col("period").desc()).limit(months)
    return latest.orderBy("period")


def revenue_per_encounter(silver: Silver) -> DataFrame:
    """Payments per encounter by department."""
    both = metric_query(
        silver, ["payments.total_payments", "encounters.total_encounters"], ["encounters.department"]
    )
    revenue = ratio(F.col("total_payments"), F.col("total_encounters"))
    return both.withColumn("revenue_per_encounter", revenue).orderBy(F.col("revenue_per_encounter").desc_nulls_last())


def days_in_ar_by_payer(silver: Silver) -> DataFrame:
    """Open positive balances over mean daily charges between first and last service date."""
    claims = with_payments(silver.claims, silver.payments)
    day = iso_date("date_of_service")
    sums = claims.groupBy("payer_id").agg(
        F.sum(F.when(is_open(), F.col("balance")).otherwise(0.0)).alias("open_ar"),
        F.sum("total_charge_amount").alias("charges"),
        F.greatest(F.datediff(F.max(day), F.min(day)) + 1, F.lit(1)).alias("days"),
    )
    named = silver.payers.select("payer_id", "payer_name").join(sums, "payer_id")
    return named.select(
        "payer_name", "open_ar", ratio(F.col("open_ar"), ratio(F.col("charges"), F.col("days"))).alias("days_in_ar")
    ).orderBy(F.col("days_in_ar").desc_nulls_last())


def charges_and_payments_by_month(silver: Silver, months: int = 12) -> DataFrame:
    both = metric_query(
        silver,
        ["claims.total_charges", "payments.total_payments"],
        [("claims.date_of_service@month=period", "payments.payment_date@month=period")],
    )
    latest = both.filter(F.col("period").isNotNull()).orderBy(F.col("period").desc()).limit(months)
    return latest.orderBy("period")
