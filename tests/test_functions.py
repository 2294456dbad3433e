import datetime as dt

import pytest
from pyspark.sql import functions as F

from hirelens import functions as fn
from hirelens.config import ETHNICITY_CODES
from hirelens.operators import in_force
from tests.conftest import bag

DAY = dt.date(2024, 6, 30)
NOW = dt.datetime(2024, 6, 30, 10)
MIDNIGHT = dt.datetime(2024, 6, 30)
END = dt.date(4712, 12, 31)


def values(spark, rows, ddl, *columns):
    return bag(spark.createDataFrame(rows, ddl).select(*columns))


def test_status_label_keeps_missing_parts(spark):
    rows = [("Open", None), (None, "Closed"), (None, None), ("Open", "Posted")]
    got = values(spark, rows, "p string, s string", fn.status_label("p", "s"))
    assert got == sorted([("Open - ",), (" - Closed",), (" - ",), ("Open - Posted",)], key=repr)


def test_yes_no_passes_other_flags(spark):
    rows = [("Y",), ("N",), ("P",), (None,)]
    got = values(spark, rows, "f string", "f", fn.yes_no("f"))
    assert got == sorted([("Y", "Yes"), ("N", "No"), ("P", "P"), (None, None)], key=repr)


def test_blank_text_is_missing(spark):
    got = values(spark, [("",), (" ",), ("a",)], "f string", "f", fn.blank_to_null("f"))
    assert got == sorted([("", None), (" ", " "), ("a", "a")], key=repr)


def test_medium_and_name(spark):
    rows = [("m", "n"), ("m", None), (None, "n"), (None, None)]
    got = values(spark, rows, "m string, n string", fn.medium_and_name("m", "n"))
    assert got == sorted([("m - n",), ("m",), ("n",), (None,)], key=repr)


def test_ethnicity_split_compares_numbers(spark):
    rows = [("4",), ("04",), ("4.0",), ("1",), ("ORA_X",), (None,)]
    ethnicity, race = fn.ethnicity_split("c", F.lit("m"))
    got = dict((c, (e, r)) for c, e, r in values(spark, rows, "c string", "c", ethnicity, race))
    assert got == {
        "4": ("m", None), "04": ("m", None), "4.0": ("m", None), "1": (None, "m"),
        "ORA_X": (None, None), None: (None, None),
    }


@pytest.mark.parametrize(
    "answers, verdict",
    [
        ((None, None, None), None),
        (("Yes", "Yes", "Yes"), "No"),
        (("Yes", None, None), "No"),
        (("No", "Yes", None), "Yes"),
        ((None, None, "Yes"), "Yes"),
        (("No", None, None), "No"),
        ((None, "No", "No"), "No"),
        ((None, "yes", None), "No"),
    ],
)
def test_preference_verdict(spark, answers, verdict):
    got = values(
        spark, [answers], "u string, h string, s string", fn.preference_verdict("u", "h", "s")
    )
    assert got == [(verdict,)]


@pytest.mark.parametrize(
    "yes, ethnicity, race",
    [
        ([], None, "Did not provide"),
        (["unknown"], None, "Did not provide"),
        (["white"], None, "White"),
        (["black"], None, "Black or Afican American"),
        (["asian"], None, "Asian"),
        (["indian"], None, "American Indian or Alaska Native"),
        (["hawaiian"], None, "Native Hawaiian or other Pacific Islander"),
        (["white", "indian"], None, "Two or more races"),
        (["unknown", "asian"], None, "Asian"),
        (["hispanic"], "I am Hispanic or Latino", None),
        (["hispanic", "white", "black"], "I am Hispanic or Latino", None),
    ],
)
def test_race_ethnicity(spark, yes, ethnicity, race):
    names = list(ETHNICITY_CODES)
    row = tuple("Yes" if n in yes else ("No" if n != "indian" else None) for n in names)
    ddl = ", ".join(f"{n} string" for n in names)
    got = values(spark, [row], ddl, *fn.race_ethnicity({n: n for n in names}))
    assert got == [(ethnicity, race)]


def test_race_label_can_be_corrected(spark):
    names = list(ETHNICITY_CODES)
    row = tuple("Yes" if n == "black" else "No" for n in names)
    ddl = ", ".join(f"{n} string" for n in names)
    flags = {n: n for n in names}
    got = values(spark, [row], ddl, *fn.race_ethnicity(flags, fix_labels=True))
    assert got == [(None, "Black or African American")]


BOUNDS = [
    ("inside", dt.date(2000, 1, 1), END),
    ("starts today", DAY, END),
    ("ends today", dt.date(2000, 1, 1), DAY),
    ("ended", dt.date(2000, 1, 1), dt.date(2024, 6, 29)),
    ("to come", dt.date(2024, 7, 1), END),
    ("no start", None, END),
    ("no end", dt.date(2000, 1, 1), None),
    ("neither", None, None),
]
ALWAYS = {"inside", "starts today", "ends today"}


@pytest.mark.parametrize(
    "options, extra",
    [
        ({}, set()),
        ({"null_end": "open"}, {"no end"}),
        ({"null_start": "open"}, {"no start"}),
        ({"now": NOW}, {"no end"}),
        ({"now": NOW, "null_end": "open"}, {"no end"}),
        ({"now": NOW, "null_start": "open"}, {"no start", "no end", "neither"}),
        ({"now": MIDNIGHT}, {"no start", "no end", "neither"}),
    ],
)
def test_in_force(spark, options, extra):
    df = spark.createDataFrame(BOUNDS, "name string, s date, e date")
    got = {r.name for r in in_force(df, "s", "e", DAY, **options).collect()}
    assert got == ALWAYS | extra


def test_in_force_defaults_to_today(spark):
    today = dt.date.today()
    rows = [
        ("now", today - dt.timedelta(2), today + dt.timedelta(2)),
        ("old", today - dt.timedelta(9), today - dt.timedelta(5)),
        ("no end", today - dt.timedelta(2), None),
    ]
    df = spark.createDataFrame(rows, "name string, s date, e date")
    got = {r.name for r in in_force(df, "s", "e", null_end="open").collect()}
    assert got == {"now", "no end"}
