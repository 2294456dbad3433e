"""Small helpers shared by the operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Ids that are sent to every executor at most, and rows of an Arrow batch.
BROADCAST_IDS, BATCH_ROWS = 1_000_000, 1000


def chunks(lengths, limit: int) -> Iterator[tuple[int, int]]:
    """Cut a run of items into pieces of at most ``limit`` units; a longer item stands alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def pieces_of(column: pa.Array, limit: int) -> Iterator[tuple[int, int, list[str]]]:
    """A text column in pieces of at most ``limit`` bytes: from where, to where, and the texts."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for lo, hi in chunks(sizes, limit):
        yield lo, hi, texts_of(column.slice(lo, hi - lo))


def texts_of(column: pa.Array) -> list[str]:
    """The strings of an Arrow column, null as the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def small_batches(spark: SparkSession) -> SparkSession:
    """Whole texts are large rows. Python workers get ``BATCH_ROWS`` of them at a time, on both
    sides of the pipe, unless the session has a limit of its own."""
    key, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the session's checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def among(frame: DataFrame, columns: str | list[str], ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose id (one column or several) is among ``ids`` (as many), or with ``left_anti`` those whose
    id is not. The ids are broadcast once they are counted and found few; else Spark shuffles for the join."""
    columns = [columns] if isinstance(columns, str) else columns
    ids = checkpointed(ids.toDF(*[f"among_{c}" for c in columns]))
    on = [frame[c] == ids[f"among_{c}"] for c in columns]
    return frame.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without one gets its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="llm-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def crc_remainder(column: Column | str, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; null counts as the empty text."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")) % modulus
