"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import Date, Instant, effective


def in_force(
    df: DataFrame,
    start: str = "effective_start_date",
    end: str = "effective_end_date",
    as_of: Date = None,
    now: Instant = None,
    null_start: str = "drop",
    null_end: str = "drop",
) -> DataFrame:
    """Rows in force on ``as_of`` (today by default); see ``functions.effective``."""
    return df.where(effective(F.col(start), F.col(end), as_of, now, null_start, null_end))


def given(values) -> bool:
    """False for no values, or 'ALL' as the first one."""
    wanted = _listed(values)
    return bool(wanted) and wanted[0] != "ALL"


def optional_filter(df: DataFrame, column: str, values) -> DataFrame:
    """Keep rows whose column is one of ``values``.

    No values, or 'ALL' as the first one given, switch the filter off.
    """
    return df.where(F.col(column).isin(_listed(values))) if given(values) else df


def required_filter(df: DataFrame, column: str, values) -> DataFrame:
    """Keep rows whose column is one of ``values``; at least one must be given."""
    wanted = _listed(values)
    if not wanted:
        raise ValueError(f"a value for {column} is required")
    return df.where(F.col(column).isin(wanted))


def _listed(values) -> list:
    if not isinstance(values, (list, tuple)):
        values = [values]
    return [v for v in values if v is not None and v != ""]


def missing_last(*columns: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def sorted_report(df: DataFrame, *columns: str) -> DataFrame:
    """Final order, missing values last. Rows that are equal in ``columns`` are ordered by a hash of all
    columns, so that one crowded value is cut over many tasks; the last key does the same for rows
    that are equal in everything."""
    hashed = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    ties = {"_tie": F.xxhash64(*hashed), "_copy": F.xxhash64(F.monotonically_increasing_id())}
    return df.withColumns(ties).orderBy(*missing_last(*columns), *ties).drop(*ties)
