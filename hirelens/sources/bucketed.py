"""Input tables written once in buckets, so that reports need not shuffle them again.

A table is bucketed by the key that reports join it by. The counting of equal rows that precedes
such a join groups by the key and more columns, so it needs no shuffle either.
"""

from __future__ import annotations

from .schemas import SCHEMAS
from .tables import Tables

BUCKET_KEYS = {
    "requisition_titles": ["requisition_id"],
    "submissions": ["submission_id", "person_id"],
    "questionnaire_responses": ["subject_id", "participant_id"],
    "regulatory_responses": ["submission_id", "person_id"],
    "status_history": ["subject_id", "state_id"],
    "candidates": ["person_id"],
    "person_names": ["person_id"],
    "person_legislative": ["person_id"],
    "person_ethnicities": ["person_id"],
}


def save_bucketed(t: Tables, database: str, buckets: int, path: str | None = None) -> None:
    """Write all tables as ``<database>.<table>`` for ``Tables.from_catalog``, those of ``BUCKET_KEYS``
    in ``buckets`` buckets; with ``path`` below that folder instead of the warehouse.

    All tables take the same number of buckets, else joins shuffle one side; choose the size
    of the largest divided by about 200 MB. A bucket is written by one task, and by several, into
    files of their own, where adaptive execution finds it skewed: rows of one key may be many.
    An existing table raises an error before anything is written. Tables that are not given are
    left out if another one can stand in for them.
    """
    if buckets < 1:
        raise ValueError("buckets must be at least 1")
    frames = {name: getattr(t, name) for name in SCHEMAS}  # raises where none stands in
    frames = {name: df for name, df in frames.items() if name in t}
    for name, df in frames.items():
        if df.sparkSession.catalog.tableExists(f"{database}.{name}"):
            raise ValueError(f"table {database}.{name} exists")
    for name, df in frames.items():
        keys = BUCKET_KEYS.get(name)
        if keys:
            writer = df.hint("rebalance", buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
        else:
            writer = df.write
        if path:
            writer = writer.option("path", f"{path}/{name}")
        writer.format("parquet").saveAsTable(f"{database}.{name}")
