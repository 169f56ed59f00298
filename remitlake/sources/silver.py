"""The typed layer as ten DataFrames, and the loader that checks and types it for use."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlake.functions.columns import iso_date
from remitlake.sources.schemas import DATE_COLUMNS, FLAG_COLUMNS, TABLES, missing_columns, typed_schema

Source = DataFrame | Callable[[], DataFrame]


class Silver:
    """Ten typed tables as attributes (``silver.claims``).

    A table is opened and checked when it is first used, so a measure over two tables
    touches the metadata of two. Nothing is read until a result is asked for.
    """

    def __init__(self, tables: Mapping[str, Source]):
        self._sources = {name: tables[name] for name in TABLES}
        self._opened: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._opened:
            source = self._sources[name]
            self._opened[name] = checked(name, source() if callable(source) else source)
        return self._opened[name]

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLES}

    def with_tables(self, **tables: Source) -> "Silver":
        return Silver({**self._sources, **self._opened, **tables})

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> "Silver":
        """Read ``root/<table>``; the declared schema saves the inference pass over the footers."""

        def opener(table: str) -> Source:
            names = [c for c, _ in TABLES[table]]  # without the batch, which names folders of a table loaded in batches
            return lambda: spark.read.schema(typed_schema(table)).parquet(f"{root}/{table}").select(*names)

        return cls({t: opener(t) for t in TABLES})

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str) -> "Silver":
        """Tables of one catalog database."""
        return cls({t: lambda t=t: spark.table(f"{database}.{t}") for t in TABLES})


def checked(table: str, frame: DataFrame) -> DataFrame:
    """Lower-case names; fails with the list of missing required columns."""
    missing = missing_columns(table, frame.columns)
    if missing:
        raise ValueError(f"Table '{table}' is missing required columns: {missing}")
    lower = [c.lower() for c in frame.columns]
    return frame if lower == frame.columns else frame.toDF(*lower)


def dashboard_types(silver: Silver) -> Silver:
    """The loader's view: date texts as dates, flags as booleans, cost month as its first day."""

    def typed(name: str) -> DataFrame:
        frame = getattr(silver, name)
        casts = {c: iso_date(c) for c in DATE_COLUMNS.get(name, [])}
        # A missing flag reads as true, like any non-zero number.
        casts |= {c: F.coalesce(F.col(c) != 0, F.lit(True)) for c in FLAG_COLUMNS.get(name, [])}
        if name == "operating_costs":
            casts["period"] = iso_date(F.concat("period", F.lit("-01")))
        return frame.withColumns(casts) if casts else frame

    return Silver({name: lambda name=name: typed(name) for name in TABLES})
