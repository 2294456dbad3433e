"""Diversity reports: detail rows and head counts per requisition."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.dates import Date, Instant
from ..functions.labels import race_ethnicity
from ..operators.applications import (
    REASON_KEYS,
    REGULATORY_KEYS,
    SOURCE_KEYS,
    application_base,
    counted_base,
    reason_rows,
    regulatory_rows,
    source_rows,
    submission_status,
)
from ..operators.copies import join_matches
from ..operators.dimensions import MEANINGS, STATUS, dimensions
from ..operators.headcount import headcount_by
from ..operators.people import extended_profile, veteran_profile
from ..operators.requisitions import requisition_profile
from ..operators.scoping import for_requisitions
from ..sources import Tables
from .ordering import ordered_rows

DETAIL_COLUMNS = [
    "requisition_id",
    "person_id",
    "requisition_number",
    "requisition_name",
    "req_current_status",
    "open_date",
    "sub_current_status",
    "sub_status_reason",
    "active",
    "source_medium",
    "career_site",
    "department_name",
    "candidate_number",
    "candidate_name",
    "gender",
    "ethnicity",
    "race",
    "veterans_preference",
    "disability",
    *C.VETERAN_FLAGS,
    "new_ethnicity",
    "new_race",
]

REQUISITION = ["requisition_id", "requisition_number", "requisition_name"]
RESULT = ["count_type", "count_results"]


def _scope(t: Tables, req_number, all_requisitions: bool, *names: str) -> tuple:
    """The tables, cut down to the chosen requisitions, and the named tables of labels."""
    if all_requisitions:
        return t, dimensions(t, *names)
    return for_requisitions(t, req_number, *names)


def diversity_detail(
    t: Tables,
    req_number=None,
    as_of: Date = None,
    now: Instant = None,
    all_requisitions: bool = False,
    fix_labels: bool = False,
) -> DataFrame:
    """One row per application and match, for one requisition number or a list.

    The report has no meaning without a requisition, so a missing number is an
    error unless ``all_requisitions`` is set.
    """
    labels = (*STATUS, *MEANINGS, "reasons", "sources", "sites")
    t, dims = _scope(t, req_number, all_requisitions, *labels)

    # What hangs on the submission itself is joined while its rows are narrow.
    subs = submission_status(t, dims)
    subs = join_matches(subs, reason_rows(t.status_history, dims.reasons), REASON_KEYS)
    subs = join_matches(subs, regulatory_rows(t.regulatory_responses, dims), REGULATORY_KEYS)

    people = extended_profile(t, as_of, now)
    new_ethnicity, new_race = race_ethnicity({n: n for n in C.ETHNICITY_CODES}, fix_labels)
    people = people.select(
        "person_id",
        "candidate_number",
        "candidate_name",
        *C.VETERAN_FLAGS,
        new_ethnicity.alias("new_ethnicity"),
        new_race.alias("new_race"),
        "copies",
    )
    requisitions = requisition_profile(t, as_of, True, counted=True, dims=dims)
    rows = counted_base(subs, requisitions, people)
    sources = source_rows(t.source_tracking, dims.sources, dims.sites)
    rows = join_matches(rows, sources, SOURCE_KEYS)
    rows = rows.select(*DETAIL_COLUMNS, "submission_id", "copies")
    rows = ordered_rows(rows, "requisition_number", "candidate_name")
    return rows.select(*DETAIL_COLUMNS)


def _measures(veteran: Column) -> dict[str, Column]:
    """The five head counts, as conditions on regulatory codes."""
    return {
        "Candidate": F.lit(True),
        "Disability": F.col("attribute_4").isin(C.DISABILITY_YES),
        "Female": F.col("attribute_1") == C.FEMALE,
        # An empty code counts as missing; the bare column lets the scan use the conditions.
        "Minority": (F.col("attribute_2") != C.NON_MINORITY) & (F.col("attribute_2") != ""),
        "Veteran": (F.col("attribute_3") == C.PROTECTED_VETERAN) | veteran,
    }


def _any_veteran_flag() -> Column:
    return reduce(or_, [F.col(name) == "Yes" for name in C.VETERAN_FLAGS])


def diversity_counts(
    t: Tables,
    req_number=None,
    as_of: Date = None,
    now: Instant = None,
    emit_zero: bool = False,
    all_requisitions: bool = False,
) -> DataFrame:
    """Distinct people per requisition and title: candidates, disability, female,
    minority and veteran.

    One pass. Names, reasons, sources, sites and lookup meanings cannot change a
    distinct count, so their tables are not read. Rows are reduced to one set of
    flags per application and per person before they meet, and counts are made per
    requisition before the titles come in: all titles of a requisition
    share the same people. ``emit_zero`` gives 0 instead of no row where nobody is
    counted, also for requisitions without applications.
    """
    t, dims = _scope(t, req_number, all_requisitions, *STATUS)
    declared = _measures(veteran=F.lit(False))
    del declared["Candidate"]
    # Answers that meet no condition change nothing and are not moved at all.
    answered = (
        t.regulatory_responses.where(reduce(or_, declared.values()))
        .groupBy("submission_id", "person_id")
        .agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in declared.items()])
    )
    veterans = (
        veteran_profile(t.person_legislative, as_of, now)
        .where(_any_veteran_flag())
        .select("person_id")
        .distinct()
        .withColumn("_veteran", F.lit(True))
    )
    people = t.candidates.select("person_id").distinct().join(veterans, "person_id", "left")

    apps = (
        t.submissions.join(dims.phases, F.col("current_phase_id") == F.col("phase_id"), "left_semi")
        .join(dims.states, F.col("current_state_id") == F.col("state_id"), "left_semi")
        .select("submission_id", "requisition_id", "person_id")
        .join(answered, ["submission_id", "person_id"], "left")
        .join(people, "person_id")
    )
    flags = {"Candidate": F.lit(True), **{n: F.col(n) for n in declared}}
    flags["Veteran"] = F.col("Veteran") | F.col("_veteran")
    counts = headcount_by(apps, ["requisition_id"], "person_id", flags)
    titles = requisition_profile(t, as_of, with_department=True, dims=dims)
    titles = titles.select(*REQUISITION).distinct()
    if not emit_zero:
        return titles.join(counts, "requisition_id").select(*REQUISITION, *RESULT)
    types = F.explode(F.array(*[F.lit(name) for name in flags])).alias("count_type")
    every = titles.select(*REQUISITION, types)
    found = every.join(counts, ["requisition_id", "count_type"], "left")
    return found.fillna(0, ["count_results"]).select(*REQUISITION, *RESULT)


def diversity_counts_union(
    t: Tables,
    req_number=None,
    as_of: Date = None,
    now: Instant = None,
    all_requisitions: bool = False,
) -> DataFrame:
    """The same counts by joining everything first and tagging each row; a cross-check."""
    t, dims = _scope(t, req_number, all_requisitions, *STATUS)
    base = application_base(t, as_of, how_name="left", with_department=True, dims=dims)
    rows = base.join(t.regulatory_responses, ["submission_id", "person_id"], "left")
    rows = rows.join(veteran_profile(t.person_legislative, as_of, now), "person_id", "left")
    measures = _measures(veteran=_any_veteran_flag())
    met = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in measures.items()]))
    tagged = rows.select(*REQUISITION, "person_id", F.explode(met).alias("count_type"))
    return tagged.groupBy(*REQUISITION, "count_type").agg(
        F.count_distinct("person_id").alias("count_results")
    )
