"""Distinct head counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def headcount_by(
    df: DataFrame,
    keys: Sequence[str],
    entity: str,
    measures: dict[str, Column],
    emit_zero: bool = False,
) -> DataFrame:
    """Distinct entities per key for several conditions, one row per condition.

    Each (key, entity) pair is first reduced to one row of flags, combined on the
    map side, so that a key with very many rows is spread over its entities and no
    row is copied per condition. Columns: keys, count_type, count_results. A
    condition that no row of a key meets gives no row, unless ``emit_zero``.
    """
    met = {name: F.coalesce(cond, F.lit(False)) for name, cond in measures.items()}
    pairs = df.groupBy(*keys, entity).agg(
        *[F.bool_or(cond).alias(name) for name, cond in met.items()]
    )
    known = F.col(entity).isNotNull()
    totals = pairs.groupBy(*keys).agg(
        *[
            F.when(
                F.bool_or(F.col(name)) | F.lit(emit_zero),
                F.count(F.when(F.col(name) & known, 1)),
            ).alias(name)
            for name in met
        ]
    )
    long = totals.unpivot(list(keys), list(met), "count_type", "count_results")
    return long.where(F.col("count_results").isNotNull())
