"""Small tables that are joined to large ones on keys of a few values.

Such a join must not shuffle the large side: its rows would meet in as many tasks as there
are values. The rows of the small side are counted, all sides of a report in one job, and
those with no more than ``config.BROADCAST_ROWS`` are marked for broadcast. A larger one
stays as it is, and Spark joins it as it sees fit, with the same rows.
"""

from __future__ import annotations

from functools import reduce
from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..sources import Tables
from .lookups import meanings, site_label, source_label, translated_names

NAMED = {
    "phases": lambda t: translated_names(t.phases, "phase_id", "name"),
    "states": lambda t: translated_names(t.states, "state_id", "name"),
    "reasons": lambda t: t.reasons,
    "sources": lambda t: source_label(t.source_dimensions, t.source_dimension_names, t.lookups),
    "sites": lambda t: site_label(t.sites, t.site_names),
    "gender": lambda t: meanings(t.person_lookups, C.LOOKUP_GENDER),
    "ethnicity": lambda t: meanings(t.lookups, C.LOOKUP_ETHNICITY),
    "veterans_preference": lambda t: meanings(t.person_lookups, C.LOOKUP_VETERAN),
    "disability": lambda t: meanings(t.lookups, C.LOOKUP_DISABILITY),
}
STATUS = ("phases", "states")
MEANINGS = ("gender", "ethnicity", "veterans_preference", "disability")


def sizes(frames: dict[str, DataFrame]) -> dict[str, int]:
    """Rows of each frame, counted in one job."""
    if not frames:
        return {}
    names = [df.select(F.lit(name).alias("name")) for name, df in frames.items()]
    counted = reduce(DataFrame.unionAll, names).groupBy("name").count().collect()
    return dict.fromkeys(frames, 0) | {row["name"]: row["count"] for row in counted}


def guarded(**frames: DataFrame) -> dict[str, DataFrame]:
    """The frames, those marked for broadcast that a count has shown to be small."""
    return marked(frames, sizes(frames))


def marked(frames: dict[str, DataFrame], rows: dict[str, int]) -> dict[str, DataFrame]:
    few = {name for name in frames if rows[name] <= C.BROADCAST_ROWS}
    return {name: F.broadcast(df) if name in few else df for name, df in frames.items()}


def named(t: Tables, *names: str) -> dict[str, DataFrame]:
    """The named tables of labels, without marks."""
    return {name: NAMED[name](t) for name in names}


def dimensions(t: Tables, *names: str) -> SimpleNamespace:
    """The named tables of labels, guarded."""
    return SimpleNamespace(**guarded(**named(t, *names)))
