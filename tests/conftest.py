from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from hirelens import Tables
from hirelens.sources import SCHEMAS
from testing.overlay import overlay_tables

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("hirelens-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.maxMetadataStringLength", "10000")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def overlay(spark):
    return overlay_tables(spark, SF_DIR)


@pytest.fixture
def make_tables(spark):
    """Tables from rows; the ones not given are empty."""

    def make(**rows) -> Tables:
        return Tables.from_frames(
            {
                name: spark.createDataFrame(rows.get(name, []), ddl)
                for name, ddl in SCHEMAS.items()
                if name in rows or name != "person_lookups"
            }
        )

    return make


@pytest.fixture
def low_limits(monkeypatch):
    """Limits so low that everything is cut into pieces and nothing counts as small."""
    from hirelens import config

    monkeypatch.setattr(config, "COPIES_PER_ROW", 2)
    monkeypatch.setattr(config, "BROADCAST_ROWS", 0)


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
