"""Applications and what belongs to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.dates import Date
from ..functions.labels import blank_to_null, ethnicity_split, status_label, yes_no
from ..sources import Tables
from .copies import expand_copies, join_copies, join_matches
from .dimensions import MEANINGS, STATUS, dimensions, guarded
from .lookups import decode, meanings, site_label, source_label
from .people import person_profile
from .requisitions import requisition_profile

REASON_KEYS = ["submission_id", "state_id"]
SOURCE_KEYS = ["requisition_id", "submission_id", "candidate_number"]
REGULATORY_KEYS = ["submission_id", "person_id"]


def submission_status(t: Tables, dims=None) -> DataFrame:
    """Applications whose phase and state are known, with label and active flag.

    ``dims`` has phases and states, if they have been guarded already.
    """
    dims = dims or dimensions(t, *STATUS)
    phases, states = dims.phases, dims.states
    label = F.when(F.col("submission_id").isNotNull(), status_label("_phase", "_state"))
    return (
        t.submissions.join(
            phases.select(
                F.col("phase_id").alias("current_phase_id"), F.col("name").alias("_phase")
            ),
            "current_phase_id",
        )
        .join(
            states.select(
                F.col("state_id").alias("current_state_id"), F.col("name").alias("_state")
            ),
            "current_state_id",
        )
        .select(
            "submission_id",
            "requisition_id",
            "person_id",
            F.col("current_state_id").alias("state_id"),
            label.alias("sub_current_status"),
            yes_no("active_flag").alias("active"),
        )
    )


def counted_base(subs: DataFrame, requisitions: DataFrame, people: DataFrame) -> DataFrame:
    """Requisition - application - person spine, as counted rows.

    Crowded requisitions and people are on the left of inner joins, whose skewed
    partitions adaptive execution splits.
    """
    spine = join_copies(subs, requisitions, ["requisition_id"], "inner")
    return join_copies(spine, people, ["person_id"], "inner")


def application_base(
    t: Tables,
    as_of: Date = None,
    how_name: str = "left",
    with_department: bool = True,
    dims=None,
) -> DataFrame:
    """One row per application on a requisition, by title and candidate name."""
    dims = dims or dimensions(t, *STATUS)
    base = counted_base(
        submission_status(t, dims),
        requisition_profile(t, as_of, with_department, counted=True, dims=dims),
        person_profile(t, as_of, how_name, counted=True),
    )
    return expand_copies(base)


def reason_entries(history: DataFrame) -> DataFrame:
    """History entries that can give a reason: submission_id, state_id, reason_id."""
    complete = (
        F.col("subject_id").isNotNull()
        & F.col("state_id").isNotNull()
        & F.col("reason_id").isNotNull()
    )
    return history.where(complete).select(
        F.col("subject_id").alias("submission_id"), "state_id", "reason_id"
    )


def reason_rows(history: DataFrame, reasons: DataFrame) -> DataFrame:
    """submission_id, state_id, sub_status_reason.

    The name is attached before the rows meet the applications, so applications
    without a reason never travel under one common null.
    """
    return (
        reason_entries(history)
        .join(reasons, "reason_id", "left")
        .select("submission_id", "state_id", F.col("reason_name").alias("sub_status_reason"))
    )


def status_reason(subs: DataFrame, history: DataFrame, reasons: DataFrame) -> DataFrame:
    """Applications with the reasons given for the state they are in now.

    ``subs`` has submission_id and state_id; adds sub_status_reason, one row per
    history entry.
    """
    rows = reason_rows(history, guarded(reasons=reasons)["reasons"])
    out = expand_copies(join_matches(subs, rows, REASON_KEYS))
    return out.select(*subs.columns, "sub_status_reason")


def tracked(tracking: DataFrame) -> DataFrame:
    """Tracking records that belong to an application."""
    return tracking.where(F.col("requisition_id").isNotNull() & F.col("submission_id").isNotNull())


def source_rows(tracking: DataFrame, sources: DataFrame, sites: DataFrame) -> DataFrame:
    """requisition_id, submission_id, candidate_number, source_medium, career_site."""
    rows = tracked(tracking).join(sources, "dimension_id", "left").join(sites, "site_number", "left")
    return rows.select(*SOURCE_KEYS, "source_medium", "career_site")


def application_source(
    apps: DataFrame, tracking: DataFrame, sources: DataFrame, sites: DataFrame
) -> DataFrame:
    """Applications with source and career site, one row per tracking record.

    All three of requisition_id, submission_id and candidate_number must agree.
    """
    rows = source_rows(tracking, **guarded(sources=sources, sites=sites))
    out = expand_copies(join_matches(apps, rows, SOURCE_KEYS))
    return out.select(*apps.columns, "source_medium", "career_site")


def regulatory_profile(
    responses: DataFrame, lookups: DataFrame, person_lookups: DataFrame | None = None
) -> DataFrame:
    """Regulatory answers with code and meaning of gender, ethnicity, veteran
    preference and disability.

    Gender and veteran preference are looked up in ``person_lookups``, by default the
    same as ``lookups``.
    """
    person_lookups = lookups if person_lookups is None else person_lookups
    return decoded_answers(responses, **guarded(
        gender=meanings(person_lookups, C.LOOKUP_GENDER),
        ethnicity=meanings(lookups, C.LOOKUP_ETHNICITY),
        veterans_preference=meanings(person_lookups, C.LOOKUP_VETERAN),
        disability=meanings(lookups, C.LOOKUP_DISABILITY),
    ))


def decoded_answers(responses: DataFrame, **entries: DataFrame) -> DataFrame:
    """Regulatory answers with their codes and, of the four, the meanings by ``entries``."""
    codes = [f"{name}_code" for name in MEANINGS]
    out = responses.select(
        "person_id",
        "submission_id",
        *[blank_to_null(f"attribute_{i}").alias(code) for i, code in enumerate(codes, 1)],
    )
    for name, code in zip(MEANINGS, codes, strict=True):
        out = decode(out, entries[name], code, name)
    return out


def regulatory_rows(responses: DataFrame, dims) -> DataFrame:
    """What the detail report shows of the regulatory answers."""
    ethnicity, race = ethnicity_split("ethnicity_code", "ethnicity")
    entries = {name: getattr(dims, name) for name in MEANINGS}
    return decoded_answers(responses, **entries).select(
        *REGULATORY_KEYS,
        "gender",
        ethnicity.alias("ethnicity"),
        race.alias("race"),
        "veterans_preference",
        "disability",
    )


def labelled_sources(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Source labels and site labels."""
    return (
        source_label(t.source_dimensions, t.source_dimension_names, t.lookups),
        site_label(t.sites, t.site_names),
    )
