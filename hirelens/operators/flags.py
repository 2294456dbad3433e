"""Multi-valued attributes as flags."""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .copies import expand_copies, join_copies


def code_flags(facts: DataFrame, key: str, code: str, mapping: dict[str, str]) -> DataFrame:
    """One row per key with a Yes/No flag per code and ``copies``, the number of
    ways to pick one row of each code that is present."""
    counts = facts.where(F.col(code).isin(list(mapping.values()))).groupBy(key).agg(
        *[F.count(F.when(F.col(code) == value, 1)).alias(name) for name, value in mapping.items()]
    )
    ways = reduce(mul, [F.greatest(F.col(name), F.lit(1)) for name in mapping])
    flags = [F.when(F.col(n) > 0, "Yes").otherwise("No").alias(n) for n in mapping]
    return counts.select(key, *flags, ways.alias("copies"))


def flags_by_code(
    entities: DataFrame,
    facts: DataFrame,
    key: str,
    code: str,
    mapping: dict[str, str],
    keep_multiplicity: bool = True,
) -> DataFrame:
    """Entities with a Yes/No flag per code, 'No' where no row has the code.

    With ``keep_multiplicity`` an entity is repeated as often as one left join per
    code would repeat it.
    """
    flags = code_flags(facts, key, code, mapping)
    if not keep_multiplicity:
        flags = flags.drop("copies")
    out = join_copies(entities, flags, [key]).fillna("No", list(mapping))
    return expand_copies(out).select(*entities.columns, *mapping)
