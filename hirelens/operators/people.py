"""What is known per person."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.dates import Date, Instant
from ..functions.labels import yes_no
from ..sources import Tables
from .filters import in_force
from .flags import code_flags
from .copies import join_copies, join_matches, with_copies


def current_names(t: Tables, as_of: Date = None) -> DataFrame:
    """person_id, candidate_name: global names in force."""
    names = t.person_names.where(F.col("name_type") == C.NAME_TYPE)
    return in_force(names, as_of=as_of).select(
        "person_id", F.col("full_name").alias("candidate_name")
    )


def veteran_profile(legislative: DataFrame, as_of: Date = None, now: Instant = None) -> DataFrame:
    """Four veteran flags per legislative record in force.

    A missing end date means still in force; a missing start date does not.
    """
    current = in_force(legislative, as_of=as_of, now=now, null_end="open")
    return current.select(
        "person_id", *[yes_no(column).alias(name) for name, column in C.VETERAN_FLAGS.items()]
    )


def person_profile(
    t: Tables, as_of: Date = None, how_name: str = "left", counted: bool = False
) -> DataFrame:
    """Candidates with number and current name.

    ``how_name`` is 'inner' to drop candidates without a name. ``counted`` folds equal
    names of a person into one counted row.
    """
    names = current_names(t, as_of)
    names = with_copies(names) if counted else names
    return join_copies(t.candidates, names, ["person_id"], how_name)


def extended_profile(
    t: Tables, as_of: Date = None, now: Instant = None, how_name: str = "left"
) -> DataFrame:
    """``person_profile`` with veteran flags and person-level ethnicity flags, as counted rows.

    Everything known per person is put together here, on the persons alone, so
    that the applications are moved to their persons only once.
    """
    veterans = veteran_profile(t.person_legislative, as_of, now)
    ethnicities = code_flags(t.person_ethnicities, "person_id", "ethnicity", C.ETHNICITY_CODES)
    people = person_profile(t, as_of, how_name, counted=True)
    people = join_matches(people, veterans, ["person_id"])
    return join_copies(people, ethnicities, ["person_id"]).fillna("No", list(C.ETHNICITY_CODES))
