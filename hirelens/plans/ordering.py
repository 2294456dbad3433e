"""Final order of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.copies import repeat_copies, split_copies, spread
from ..operators.filters import missing_last


def ordered_rows(rows: DataFrame, *columns: str) -> DataFrame:
    """Sort counted rows and write their copies out.

    The application breaks ties, so that equal names on one busy requisition can be
    cut into several partitions. Rows with very many copies are cut into pieces before
    the sort, which then places the pieces in different tasks.
    """
    order = missing_last(*columns, "submission_id", "piece")
    pieces = split_copies(rows).repartitionByRange(spread(rows), *order)
    return repeat_copies(pieces.sortWithinPartitions(*order))
