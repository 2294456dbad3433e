import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from hirelens import config as C
from hirelens import operators as op
from hirelens.operators import answers
from tests.conftest import bag

SUBS = "submission_id long, requisition_id long, person_id long"
ANSWERS = (
    "participant_id long, subject_id long, subscriber_id int, subject_code string, "
    "status string, participant_type string, question_code string, long_text string"
)
CODES = {"a": "1", "b": "2"}


def answer(sub, person, code, text, subscriber=4, subject="SUBMISSION", status="S",
           who="CANDIDATE"):
    return (person, sub, subscriber, subject, status, who, code, text)


def literal_answers(subs, rows, codes):
    """What one left join per question gives."""
    out = []
    for sub, req, person in subs:
        found = [
            [r[7] for r in rows
             if r[1] == sub and r[0] == person is not None
             and r[2:6] == (4, "SUBMISSION", "S", "CANDIDATE")
             and r[6] == code] or [None]
            for code in codes.values()
        ]
        out += [(sub, req, person, *combination) for combination in product(*found)]
    return sorted(out, key=repr)


CASES = {
    "no answers": [],
    "product": [answer(1, 7, "1", t) for t in ("x", "y")]
    + [answer(1, 7, "2", t) for t in ("u", "v")],
    "null text": [answer(1, 7, "1", None)],
    "null and text": [answer(1, 7, "1", None), answer(1, 7, "1", "x"), answer(1, 7, "2", "u")],
    "same twice": [answer(1, 7, "1", "x")] * 3 + [answer(1, 7, "2", "u")] * 2,
    "out of scope": [
        answer(1, 7, "1", "x", subscriber=5), answer(1, 7, "1", "x", subject="OTHER"),
        answer(1, 7, "1", "x", status="I"), answer(1, 7, "1", "x", who="EMPLOYEE"),
        answer(1, 7, "9", "x"),
    ],
    "other person": [answer(1, 8, "1", "x")],
}


@pytest.mark.parametrize("copies", [65_536, 2])
@pytest.mark.parametrize("case", CASES)
def test_answers_keep_multiplicity(spark, case, copies, monkeypatch):
    monkeypatch.setattr(C, "COPIES_PER_ROW", copies)
    subs = [(1, 10, 7), (2, 10, 9), (3, 11, None)]
    rows = CASES[case]
    got = op.answers_wide(
        spark.createDataFrame(subs, SUBS), spark.createDataFrame(rows, ANSWERS), CODES
    )
    assert got.columns == ["submission_id", "requisition_id", "person_id", "a", "b"]
    assert bag(got) == literal_answers(subs, rows, CODES)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_crowded_applications_equal_the_literal_joins(spark, seed, low_limits):
    pick = random.Random(seed)
    codes = {"a": "1", "b": "2", "c": "3"}
    subs = [(i, i % 3, i % 5 if i else None) for i in range(8)]
    rows = []
    for sub, _, person in subs:
        for code, most in zip(codes.values(), pick.choice([(1, 1, 1), (9, 2, 0), (5, 6, 3)])):
            rows += [
                answer(sub, person, code, pick.choice(["x", "y", "z", "w", "v", None]))
                for _ in range(pick.randint(0, most))
            ]
    got = op.answers_wide(
        spark.createDataFrame(subs, SUBS), spark.createDataFrame(rows, ANSWERS), codes
    )
    assert bag(got) == literal_answers(subs, rows, codes)


def busiest_task(df):
    """Rows of all tasks, and of the one that writes most."""
    rows = df.groupBy(F.spark_partition_id().alias("task")).count().collect()
    return sum(r["count"] for r in rows), max(r["count"] for r in rows)


@pytest.fixture
def sixteen_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("texts", [1, 2000])
def test_no_task_writes_a_crowded_application(spark, texts, sixteen_tasks):
    """Two questions with 2,000 answers each, the same or different ones, are 4 million rows."""
    text = (F.col("id") % texts).cast("string").alias("long_text")
    rows = spark.range(2000).select(
        F.lit(7).cast("long").alias("participant_id"), F.lit(1).cast("long").alias("subject_id"),
        F.lit(4).alias("subscriber_id"), F.lit("SUBMISSION").alias("subject_code"),
        F.lit("S").alias("status"), F.lit("CANDIDATE").alias("participant_type"),
        F.explode(F.array(F.lit("1"), F.lit("2"))).alias("question_code"), text,
    )
    subs = spark.createDataFrame([(1, 10, 7), (2, 10, 9)], SUBS)
    rows, most = busiest_task(op.answers_wide(subs, rows, CODES))
    assert rows == 4_000_001 and most <= rows / 4


def test_a_million_answers_of_one_application(spark, sixteen_tasks):
    """Distinct answers to one question, and one to another: every answer once, by all tasks, and counted through
    in ranges that are spread as well."""
    fixed = [
        F.lit(7).cast("long").alias("participant_id"), F.lit(1).cast("long").alias("subject_id"),
        F.lit(4).alias("subscriber_id"), F.lit("SUBMISSION").alias("subject_code"),
        F.lit("S").alias("status"), F.lit("CANDIDATE").alias("participant_type"),
    ]
    rows = spark.range(0, 1_000_000, 1, 16).select(*fixed, F.lit("1").alias("question_code"), F.col("id").cast("string").alias("long_text"))
    rows = rows.union(spark.range(1).select(*fixed, F.lit("2"), F.lit("one")))
    out = op.answers_wide(spark.createDataFrame([(1, 10, 7), (2, 10, 9)], SUBS), rows, CODES)
    tasks = out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.count_distinct("a").alias("a")).collect()
    assert sum(r.n for r in tasks) == 1_000_001 and sum(r.a for r in tasks) == 1_000_000
    assert max(r.n for r in tasks) <= 250_000
    entries = answers._blocks(
        rows.select(F.col("subject_id").alias("submission_id"), F.col("participant_id").alias("person_id"), "question_code",
                    "long_text", F.lit(1).cast("long").alias("copies")), 8)
    blocks = entries.groupBy("question_code", "_block").agg(F.sum("copies").alias("n"))
    sizes = blocks.groupBy("question_code").agg(F.max("n"), F.min("_block"), F.max("_block"), F.count("*")).collect()
    assert sorted(map(tuple, sizes)) == [("1", 8, 0, 124_999, 125_000), ("2", 1, 0, 0, 1)]


def test_one_crowded_value_is_sorted_by_all_tasks(spark, sixteen_tasks):
    df = spark.range(0, 64_000, 1, 4).select(F.lit("same").alias("k"), (F.col("id") % 8000).alias("v"))
    out = op.sorted_report(df, "k")
    merging = "spark.sql.adaptive.coalescePartitions.enabled"  # else so few rows go to one task again
    spark.conf.set(merging, "false")
    rows, most = busiest_task(out)
    spark.conf.unset(merging)
    assert rows == 64_000 and most <= rows / 4
    assert out.columns == ["k", "v"] and out.collect() == op.sorted_report(df.repartition(7), "k").collect()


def test_no_task_writes_a_crowded_person(spark, sixteen_tasks):
    rows = spark.range(2000).select(
        F.lit(7).cast("long").alias("person_id"), F.explode(F.array(F.lit("1"), F.lit("3"))).alias("ethnicity")
    )
    people = spark.createDataFrame([(1, 7), (2, 8)], "submission_id long, person_id long")
    rows, most = busiest_task(op.flags_by_code(people, rows, "person_id", "ethnicity", C.ETHNICITY_CODES))
    assert rows == 4_000_001 and most <= rows / 4


def test_a_dimension_above_the_bound_gives_the_same_rows(spark, monkeypatch):
    names = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    few = op.guarded(names=names)["names"]
    monkeypatch.setattr(C, "BROADCAST_ROWS", 1)
    many = op.guarded(names=names)["names"]
    assert many is names and bag(few) == bag(many)
    facts = spark.createDataFrame([(1,), (None,), (3,)], "id long")
    assert bag(facts.join(few, "id", "left")) == bag(facts.join(many, "id", "left"))


def test_one_answer_per_application(spark):
    subs = [(1, 10, 7), (2, 10, 9)]
    rows = CASES["product"] + [answer(2, 9, "1", None)]
    got = op.answers_wide(
        spark.createDataFrame(subs, SUBS), spark.createDataFrame(rows, ANSWERS), CODES, mode="one"
    )
    assert bag(got) == [(1, 10, 7, "y", "v"), (2, 10, 9, None, None)]


def test_unknown_answer_mode(spark):
    empty = spark.createDataFrame([], ANSWERS)
    with pytest.raises(ValueError):
        op.answers_wide(spark.createDataFrame([], SUBS), empty, CODES, mode="some")


@pytest.mark.parametrize("low", [False, True])
def test_flags_by_code(spark, request, low):
    if low:
        request.getfixturevalue("low_limits")
    people = [(s, s % 4) for s in range(12)]
    people = spark.createDataFrame(people, "submission_id long, person_id long")
    rows = [(0, "1"), (0, "1"), (0, "3"), (1, "2"), (2, "4"), (2, "1"), (9, "5"), (2, "8")]
    facts = spark.createDataFrame(rows, "person_id long, ethnicity string")
    codes = C.ETHNICITY_CODES

    want = []
    for s in range(12):
        counts = [sum(1 for r in rows if r == (s % 4, c)) for c in codes.values()]
        copies = 1
        for n in counts:
            copies *= max(n, 1)
        want += [(s, s % 4, *["Yes" if n else "No" for n in counts])] * copies
    got = op.flags_by_code(people, facts, "person_id", "ethnicity", codes)
    assert bag(got) == sorted(want, key=repr)
    once = op.flags_by_code(people, facts, "person_id", "ethnicity", codes, False)
    assert bag(once) == sorted(set(want), key=repr)


def test_headcount(spark):
    rows = [("a", 1, "F"), ("a", 1, "F"), ("a", 2, "M"), ("a", None, "F"), ("b", 3, "M"),
            ("c", None, "F")]
    df = spark.createDataFrame(rows, "k string, p long, g string")
    measures = {"all": F.lit(True), "female": F.col("g") == "F"}
    assert bag(op.headcount_by(df, ["k"], "p", measures)) == [
        ("a", "all", 2), ("a", "female", 1), ("b", "all", 1), ("c", "all", 0), ("c", "female", 0),
    ]
    zero = op.headcount_by(df, ["k"], "p", measures, emit_zero=True)
    assert ("b", "female", 0) in bag(zero)


def test_translated_names_collapse_equal_ones(spark):
    rows = [(1, "US", "Open"), (1, "FR", "Open"), (2, "US", "Offer"), (2, "FR", "Offre")]
    df = spark.createDataFrame(rows, "id long, lang string, name string")
    assert bag(op.translated_names(df, "id", "name")) == [(1, "Open"), (2, "Offer"), (2, "Offre")]
    assert bag(op.translated_names(df, "id", "name", "FR")) == [(1, "Open"), (2, "Offre")]


LOOKUPS = "lookup_type string, lookup_code string, meaning string"


def test_lookup_decode(spark):
    lookups = spark.createDataFrame([("T", "a", "A"), ("U", "b", "B"), ("T", "c", None)], LOOKUPS)
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "x string")
    assert bag(op.lookup_decode(df, lookups, "x", "T", "m")) == sorted(
        [("a", "A"), ("b", None), ("c", None), (None, None)], key=repr
    )


def test_source_label(spark):
    dims = spark.createDataFrame(
        [(1, "M1"), (2, "M1"), (3, "M9"), (4, None), (5, "M1")],
        "dimension_id long, source_medium string",
    )
    names = spark.createDataFrame(
        [(1, "N"), (2, None), (3, "N"), (4, None)], "dimension_id long, source_name string"
    )
    lookups = spark.createDataFrame(
        [("ORA_IRC_SOURCE_TRACKING_MEDIUM", "M1", "Board"), ("OTHER", "M9", "No")], LOOKUPS
    )
    assert bag(op.source_label(dims, names, lookups)) == sorted(
        [(1, "Board - N"), (2, "Board"), (3, "N"), (4, None)], key=repr
    )


@pytest.mark.parametrize("low", [False, True])
def test_reason_of_the_current_state_only(spark, request, low):
    if low:
        request.getfixturevalue("low_limits")
    subs = spark.createDataFrame([(1, 21), (2, 22), (3, 23)], "submission_id long, state_id long")
    history = spark.createDataFrame(
        [(1, 21, 5)] * 4 + [(1, 21, 6), (1, 22, 5), (2, 22, 9), (2, 22, None), (None, 23, 5),
                            (3, None, 5)],
        "subject_id long, state_id long, reason_id long",
    )
    reasons = spark.createDataFrame([(5, "five"), (6, "six")], "reason_id long, reason_name string")
    assert bag(op.status_reason(subs, history, reasons)) == sorted(
        [(1, 21, "five")] * 4 + [(1, 21, "six"), (2, 22, None), (3, 23, None)], key=repr
    )


@pytest.mark.parametrize("low", [False, True])
def test_application_source_needs_all_three_keys(spark, request, low):
    if low:
        request.getfixturevalue("low_limits")
    apps = spark.createDataFrame(
        [(10, 1, "C1"), (10, 2, "C2")],
        "requisition_id long, submission_id long, candidate_number string",
    )
    tracking = spark.createDataFrame(
        [(10, 1, 7, "C1", "S1")] * 3
        + [(10, 1, 8, "C1", "S9"), (10, 2, 7, "C1", "S1"), (11, 2, 7, "C2", "S1"),
           (None, 2, 7, "C2", "S1")],
        "requisition_id long, submission_id long, dimension_id long, candidate_number string, "
        "site_number string",
    )
    sources = spark.createDataFrame([(7, "Board")], "dimension_id long, source_medium string")
    sites = spark.createDataFrame([("S1", "Main")], "site_number string, career_site string")
    assert bag(op.application_source(apps, tracking, sources, sites)) == sorted(
        [(10, 1, "C1", "Board", "Main")] * 3
        + [(10, 1, "C1", None, None), (10, 2, "C2", None, None)],
        key=repr,
    )


@pytest.mark.parametrize(
    "values, kept",
    [
        (None, "ABC"), ([], "ABC"), (["ALL"], "ABC"), ("ALL", "ABC"), ([None, "ALL", "A"], "ABC"),
        (["A", "B"], "AB"), (["A", "ALL"], "A"), ("C", "C"), ([None, "B"], "B"), (["Z"], ""),
    ],
)
def test_optional_filter(spark, values, kept):
    df = spark.createDataFrame([("A",), ("B",), ("C",)], "x string")
    assert "".join(r.x for r in op.optional_filter(df, "x", values).orderBy("x").collect()) == kept


def test_required_filter(spark):
    df = spark.createDataFrame([("A",), ("B",)], "x string")
    assert bag(op.required_filter(df, "x", "A")) == [("A",)]
    assert bag(op.required_filter(df, "x", ["A", "B"])) == [("A",), ("B",)]
    for nothing in (None, [], "", [None]):
        with pytest.raises(ValueError):
            op.required_filter(df, "x", nothing)


def test_sorted_report_puts_missing_last(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "x string")
    assert [r.x for r in op.sorted_report(df, "x").collect()] == ["a", "b", None]
