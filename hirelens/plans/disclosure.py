"""Disclosure reports: open applications and their questionnaire answers."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.dates import Date
from ..functions.labels import preference_verdict
from ..operators.answers import answers_wide
from ..operators.applications import counted_base
from ..operators.dimensions import STATUS, dimensions, named
from ..operators.filters import given, optional_filter
from ..operators.people import person_profile
from ..operators.requisitions import requisition_profile
from ..operators.scoping import narrowed
from ..sources import Tables
from .ordering import ordered_rows

SUBMISSION_IDS = ["submission_id", "requisition_id", "person_id"]


def disclosure_list(
    t: Tables, as_of: Date = None, req_number=None, req_name=None, req_status=None
) -> DataFrame:
    """Applications on open requisitions, for candidates with a current name.

    The three filters take one value or a list; None, an empty list or 'ALL' as
    the first value switch a filter off.
    """
    t = t.replace(
        requisitions=optional_filter(t.requisitions, "requisition_number", req_number),
        requisition_titles=optional_filter(t.requisition_titles, "title", req_name),
    )

    def opened(dims=None):
        profile = requisition_profile(t, as_of, counted=True, dims=dims)
        profile = profile.where(F.upper("req_phase") == C.OPEN_PHASE).drop("req_phase")
        return optional_filter(profile, "req_current_status", req_status)

    if given(req_number) or given(req_name) or given(req_status):
        unmarked = SimpleNamespace(**named(t, *STATUS))
        t, dims = narrowed(t, opened(unmarked).select("requisition_id").distinct(), *STATUS)
    else:
        dims = dimensions(t, *STATUS)
    people = person_profile(t, as_of, "inner", counted=True)
    rows = counted_base(t.submissions.select(*SUBMISSION_IDS), opened(dims), people)
    rows = ordered_rows(rows, "requisition_number", "candidate_name")
    return rows.select(
        "requisition_id",
        "submission_id",
        "person_id",
        "requisition_number",
        "requisition_name",
        "req_current_status",
        "open_date",
        "candidate_number",
        "candidate_name",
    )


def conviction_answers(
    t: Tables, codes: dict[str, str] | None = None, mode: str = "all"
) -> DataFrame:
    """Answers to the four conviction questions per application."""
    codes = codes or C.CONVICTION_CODES
    subs = t.submissions.select(*SUBMISSION_IDS)
    return answers_wide(subs, t.questionnaire_responses, codes, mode=mode)


def preference_answers(
    t: Tables, codes: dict[str, str] | None = None, mode: str = "all"
) -> DataFrame:
    """Answers to the three veterans preference questions and the verdict."""
    codes = codes or C.PREFERENCE_CODES
    subs = t.submissions.select(*SUBMISSION_IDS)
    wide = answers_wide(subs, t.questionnaire_responses, codes, mode=mode)
    verdict = preference_verdict("uw_state", "honorably", "spouse")
    return wide.withColumn("veterans_preference", verdict)
