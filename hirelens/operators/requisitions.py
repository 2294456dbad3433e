"""Requisitions with title, status and department."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.dates import Date
from ..functions.labels import blank_to_null, status_label
from ..sources import Tables
from .copies import join_copies, with_copies
from .dimensions import STATUS, dimensions
from .filters import in_force


def requisition_profile(
    t: Tables,
    as_of: Date = None,
    with_department: bool = False,
    counted: bool = False,
    dims=None,
) -> DataFrame:
    """One row per requisition and title, with phase and status label.

    ``with_department`` adds the department and drops requisitions whose
    department is not in force. ``counted`` folds equal titles of a requisition into
    one counted row. ``dims`` has phases and states, if they have been guarded already.
    """
    dims = dims or dimensions(t, *STATUS)
    phases = dims.phases.select(
        F.col("phase_id").alias("current_phase_id"), F.col("name").alias("req_phase")
    )
    states = dims.states.select(
        F.col("state_id").alias("current_state_id"), F.col("name").alias("req_state")
    )
    out = t.requisitions.where(F.col("req_usage_code") == C.REQUISITION_USAGE)
    out = out.join(phases, "current_phase_id").join(states, "current_state_id")
    department = []
    if with_department:
        current = in_force(t.departments, as_of=as_of).select(
            F.col("organization_id").alias("department_id"), F.col("name").alias("department_name")
        )
        out = out.join(current, "department_id")
        department = ["department_name"]
    titles = t.requisition_titles.select(
        "requisition_id", blank_to_null("title").alias("requisition_name")
    )
    titles = with_copies(titles) if counted else titles
    return join_copies(out, titles, ["requisition_id"], "inner").select(
        "requisition_id",
        blank_to_null("requisition_number").alias("requisition_number"),
        "requisition_name",
        "req_phase",
        status_label("req_phase", "req_state").alias("req_current_status"),
        "open_date",
        *department,
        *(["copies"] if counted else []),
    )
