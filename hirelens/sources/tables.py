"""The input tables as DataFrames with a fixed schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import blank_to_null
from .schemas import COMPARED_ONLY, SCHEMAS, STAND_INS


class Tables:
    """Read-only set of input frames, one attribute per table.

    ``t.submissions`` is a DataFrame. A table may also be given as a function
    without arguments; it is called when a report first asks for the table.
    """

    def __init__(self, frames: dict[str, DataFrame | Callable[[], DataFrame]]):
        unknown = sorted(set(frames) - set(SCHEMAS))
        if unknown:
            raise ValueError(f"unknown tables: {', '.join(unknown)}")
        self._frames = dict(frames)

    def __getattr__(self, name: str) -> DataFrame:
        frames = self.__dict__.get("_frames", {})
        if name not in frames:
            if STAND_INS.get(name) in frames:
                return getattr(self, STAND_INS[name])
            raise AttributeError(f"no table named {name!r}")
        if not isinstance(frames[name], DataFrame):
            frames[name] = frames[name]()
        return frames[name]

    def __contains__(self, name: str) -> bool:
        return name in self._frames

    def replace(self, **frames: DataFrame) -> Tables:
        """The same tables with some of them exchanged."""
        return Tables({**self._frames, **frames})

    @classmethod
    def from_frames(cls, frames: dict[str, DataFrame | Callable[[], DataFrame]]) -> Tables:
        """Wrap frames, casting them to the declared schema."""

        def conformed(name, given):
            return lambda: conform(name, given if isinstance(given, DataFrame) else given())

        return cls({name: conformed(name, given) for name, given in frames.items()})

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str) -> Tables:
        """Read ``<path>/<table>`` for every table. A table that another one can stand in for
        may be missing."""

        def read(name):
            return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")

        return cls._reading(read)

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str) -> Tables:
        """Read catalog tables ``<database>.<table>``, bucketed or partitioned as they are. A table
        that another one can stand in for may be missing."""
        return cls._reading(lambda name: spark.table(f"{database}.{name}"))

    @classmethod
    def _reading(cls, read: Callable[[str], DataFrame]) -> Tables:
        def reader(name):
            def frame():
                try:
                    return read(name)
                except AnalysisException:
                    if name not in STAND_INS:
                        raise
                    return read(STAND_INS[name])

            return frame

        return cls.from_frames({name: reader(name) for name in SCHEMAS})


def conform(name: str, df: DataFrame) -> DataFrame:
    """Declared columns and types only; empty text becomes null.

    ``lang`` may be missing, then it is null.
    """
    raw = COMPARED_ONLY.get(name, set())
    columns = []
    for field in T.StructType.fromDDL(SCHEMAS[name]):
        if field.name == "lang" and "lang" not in df.columns:
            column = F.lit(None).cast("string")
        else:
            column = F.col(field.name).cast(field.dataType)
            if isinstance(field.dataType, T.StringType) and field.name not in raw:
                column = blank_to_null(column)
        columns.append(column.alias(field.name))
    return df.select(*columns)
