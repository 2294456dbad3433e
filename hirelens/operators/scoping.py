"""Cutting all tables down to some requisitions."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..sources import Tables
from .dimensions import marked, named, sizes
from .filters import required_filter


def for_requisitions(t: Tables, req_number, *names: str) -> tuple[Tables, SimpleNamespace]:
    """``narrowed`` to the given requisition numbers."""
    wanted = required_filter(t.requisitions, "requisition_number", req_number)
    return narrowed(t.replace(requisitions=wanted), wanted.select("requisition_id"), *names)


def narrowed(t: Tables, ids: DataFrame, *names: str) -> tuple[Tables, SimpleNamespace]:
    """The tables reduced to what belongs to the requisitions in ``ids``, and the named tables of
    labels, guarded.

    One job counts the labels, and two bring the ids of the requisitions and of their applications and people,
    ``BROADCAST_ROWS`` at most each. Ids that are so few are kept as they came and sent to every task:
    the large tables are cut down while they are scanned, before any shuffle, and the applications are read
    once for their ids and once for the report. Ids that are more are left to the joins of the report, which
    drop the rest, with Spark's own choice of join and of filters at run time.
    """
    labels = named(t, *names)
    dims = SimpleNamespace(**marked(labels, sizes(labels)))
    ids = _few(ids)
    if ids is None:
        return t, dims
    titles = t.requisition_titles.join(ids, "requisition_id", "left_semi")
    subs = t.submissions.join(ids, "requisition_id", "left_semi").select(*t.submissions.columns)
    t = t.replace(requisition_titles=titles, submissions=subs)
    keys = _few(subs.select("submission_id", "person_id"))
    if keys is None:
        return t, dims

    def belonging(table: str, key: str, id: str) -> DataFrame:
        few = F.broadcast(keys.select(F.col(id).alias("_id")))
        return getattr(t, table).join(few, F.col(key) == F.col("_id"), "left_semi")

    by_submission = {
        "status_history": "subject_id",
        "source_tracking": "submission_id",
        "regulatory_responses": "submission_id",
    }
    of_people = ("candidates", "person_names", "person_legislative", "person_ethnicities")
    return t.replace(
        **{table: belonging(table, key, "submission_id") for table, key in by_submission.items()},
        **{table: belonging(table, "person_id", "person_id") for table in of_people},
    ), dims


def _few(ids: DataFrame) -> DataFrame | None:
    """The rows as a table of their own, for broadcast; None if they are more than ``BROADCAST_ROWS``."""
    found = ids.limit(C.BROADCAST_ROWS + 1).collect()
    if len(found) > C.BROADCAST_ROWS:
        return None
    return F.broadcast(ids.sparkSession.createDataFrame(found, ids.schema))
