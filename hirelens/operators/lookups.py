"""Names and meanings of codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.labels import blank_to_null, medium_and_name


def translated_names(df: DataFrame, id: str, name: str, lang: str | None = None) -> DataFrame:
    """Distinct (id, name). Names that differ between languages all stay, unless
    one language is chosen."""
    if lang is not None:
        df = df.where(F.col("lang") == lang)
    return df.select(id, blank_to_null(name).alias(name)).distinct()


def meanings(lookups: DataFrame, type: str) -> DataFrame:
    """code, meaning: the entries of one lookup type."""
    return lookups.where(F.col("lookup_type") == type).select(
        F.col("lookup_code").alias("code"), "meaning"
    )


def decode(df: DataFrame, entries: DataFrame, code: str, out: str) -> DataFrame:
    """Add the meaning of a code as ``out``; null where the code is not listed."""
    entries = entries.select(F.col("code").alias("_code"), F.col("meaning").alias(out))
    return df.join(entries, F.col(code) == F.col("_code"), "left").drop("_code")


def lookup_decode(df: DataFrame, lookups: DataFrame, code: str, type: str, out: str) -> DataFrame:
    """``decode`` with the entries of one type, which are broadcast if a count shows few."""
    from .dimensions import guarded

    return decode(df, guarded(entries=meanings(lookups, type))["entries"], code, out)


def source_label(dims: DataFrame, names: DataFrame, lookups: DataFrame) -> DataFrame:
    """dimension_id, source_medium: 'medium - name', or the part that is known."""
    named = dims.join(names, "dimension_id")
    entries = meanings(lookups, C.LOOKUP_SOURCE_MEDIUM)
    decoded = decode(named, entries, "source_medium", "_medium")
    return decoded.select(
        "dimension_id",
        medium_and_name("_medium", "source_name").alias("source_medium"),
    )


def site_label(sites: DataFrame, names: DataFrame) -> DataFrame:
    """site_number, career_site."""
    return sites.join(names, "site_id").select(
        "site_number", F.col("site_name").alias("career_site")
    )
