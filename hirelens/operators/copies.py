"""Counted rows: a frame with a ``copies`` column stands for each row that many times.

Identical rows that multiply others are folded into one row with a count before they are
joined. Counts multiply through the joins, and the rows are written out at the end, in
pieces that different tasks take. However many rows one key multiplies to, no task
has to write them all. A frame without the column is read as one copy per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C


def with_copies(df: DataFrame) -> DataFrame:
    """Distinct rows and how often each occurs."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))


def join_copies(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join counted frames: copies multiply, a row without a match counts once."""
    if "copies" not in right.columns:
        return left.join(right, list(on), how)
    counted = "copies" in left.columns
    right = right.withColumnRenamed("copies", "_copies")
    copies = F.coalesce(F.col("_copies"), F.lit(1).cast("long"))
    if counted:
        copies = F.col("copies") * copies
    return left.join(right, list(on), how).withColumn("copies", copies).drop("_copies")


def join_matches(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join that multiplies rows. The right side is folded first: adaptive execution can
    split a crowded key on the left of such a join, but not on its right."""
    return join_copies(left, with_copies(right), on)


def split_copies(df: DataFrame) -> DataFrame:
    """Cut rows with many copies into rows with at most ``config.COPIES_PER_ROW``.

    Adds the number of the piece as ``piece``, so that a sort or a shuffle that
    includes it can place the pieces of one row in different tasks.
    """
    return _pieces(df, 0) if "copies" in df.columns else df


def _pieces(df: DataFrame, first: int) -> DataFrame:
    """Pieces of counted rows, from the one numbered ``first`` on."""
    per_row = C.COPIES_PER_ROW
    last = F.expr(f"cast((copies - 1) div {per_row} as int)")
    pieces = df.withColumn("piece", F.explode(F.sequence(F.lit(first), last)))
    rest = F.col("copies") - F.col("piece").cast("long") * F.lit(per_row)
    return pieces.withColumn("copies", F.least(rest, F.lit(per_row)))


def repeat_copies(df: DataFrame) -> DataFrame:
    """One output row per copy; ``copies`` is small after ``split_copies``."""
    if "copies" not in df.columns:
        return df
    times = F.array_repeat(F.lit(True), F.col("copies").cast("int"))
    return df.withColumn("_copy", F.explode(times)).drop("_copy", "copies", "piece")


def expand_copies(df: DataFrame) -> DataFrame:
    """Plain rows again. Every row writes its first ``config.COPIES_PER_ROW`` copies where the join
    left it; only the pieces beyond them, where there are any, are dealt to other tasks."""
    if "copies" not in df.columns:
        return df
    here = df.withColumn("copies", F.least("copies", F.lit(C.COPIES_PER_ROW)))
    beyond = _pieces(df.where(F.col("copies") > C.COPIES_PER_ROW), 1)
    beyond = beyond.repartition(spread(df), *beyond.columns)
    return repeat_copies(here).unionByName(repeat_copies(beyond))


def spread(df: DataFrame) -> int:
    """Tasks that counted rows are dealt to. Said outright, because adaptive execution would merge
    partitions that are small only until their rows are written out."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
