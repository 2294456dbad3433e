import datetime as dt

import pytest

import __spark_entry__ as entry
import hirelens as H
from hirelens.plans.diversity import DETAIL_COLUMNS
from testing import oracle
from testing.compare import duck, duck_bag, spark_bag
from testing.overlay import AS_OF, CONVICTION, FIVE, NOW, PREFERENCE
from tests.conftest import SF_DIR, bag

END = dt.date(4712, 12, 31)
START = dt.date(2000, 1, 1)


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


OWN = {**entry.REPORTS, **entry.OPERATORS}


def test_every_query_has_an_oracle():
    assert set(OWN) <= set(entry.queries()) and set(OWN) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", list(OWN))
def test_query_equals_oracle(spark, con, name):
    got = spark_bag(entry.queries()[name](spark, SF_DIR))
    assert got == duck_bag(con, entry.oracle_sql()[name])
    assert got[1]


REWRITTEN = [n for n in OWN if n.startswith("r") or "answers" in n or "flags" in n
             or n in ("op_status_reason", "op_application_source", "op_application_base")]


@pytest.mark.parametrize("name", REWRITTEN)
def test_query_equals_oracle_when_nothing_is_small(spark, con, name, low_limits):
    got = spark_bag(entry.queries()[name](spark, SF_DIR))
    assert got == duck_bag(con, entry.oracle_sql()[name])


# Disclosure list, conviction, preference, and of five requisitions detail, counts, all counts.
ROWS = [439, 1588, 1585, 118, 25, 30]


def test_row_counts(overlay):
    assert H.disclosure_list(overlay, AS_OF).count() == ROWS[0]
    assert H.conviction_answers(overlay, CONVICTION).count() == ROWS[1]
    assert H.preference_answers(overlay, PREFERENCE).count() == ROWS[2]
    assert H.diversity_detail(overlay, FIVE, AS_OF, NOW).count() == ROWS[3]
    assert H.diversity_counts(overlay, FIVE, AS_OF, NOW).count() == ROWS[4]
    assert H.diversity_counts(overlay, FIVE, AS_OF, NOW, emit_zero=True).count() == ROWS[5]


@pytest.mark.parametrize("broadcast_rows", [500_000, 20, 0])
def test_chosen_requisitions_are_a_part_of_all(overlay, monkeypatch, broadcast_rows):
    """Small or not, the ids of the chosen requisitions give the same rows."""
    monkeypatch.setattr(H.config, "BROADCAST_ROWS", broadcast_rows)
    for report in (H.diversity_detail, H.diversity_counts, H.diversity_counts_union):
        every = report(overlay, as_of=AS_OF, now=NOW, all_requisitions=True)
        chosen = report(overlay, FIVE, AS_OF, NOW)
        assert bag(chosen) == bag(every.where(every.requisition_number.isin(FIVE)))
        one = report(overlay, "REQ-90", AS_OF, NOW)
        assert bag(one) == bag(every.where(every.requisition_number == "REQ-90"))


def test_disclosure_filters(overlay, con):
    every = H.disclosure_list(overlay, AS_OF)
    number, name = "requisition_number", "requisition_name"
    cases = [
        ({"req_number": "REQ-10"}, every[number] == "REQ-10"),
        ({"req_number": ["REQ-10", "REQ-43"]}, every[number].isin("REQ-10", "REQ-43")),
        ({"req_status": "Open - Closed"}, every.req_current_status == "Open - Closed"),
        ({"req_number": ["ALL", "REQ-10"]}, every[number].isNotNull()),
        ({"req_number": "REQ-11"}, every[number] == "REQ-11"),
    ]
    title = every.select(name).first()[0]
    cases.append(({"req_name": [title]}, every[name] == title))
    for arguments, condition in cases:
        assert bag(H.disclosure_list(overlay, AS_OF, **arguments)) == bag(every.where(condition))


@pytest.mark.parametrize(
    "report", [H.diversity_detail, H.diversity_counts, H.diversity_counts_union]
)
def test_requisition_number_is_required(overlay, report):
    with pytest.raises(ValueError):
        report(overlay)
    with pytest.raises(ValueError):
        report(overlay, [])


def test_counts_agree_and_stay_below_candidates(overlay):
    one_pass = H.diversity_counts(overlay, as_of=AS_OF, now=NOW, all_requisitions=True)
    union = H.diversity_counts_union(overlay, as_of=AS_OF, now=NOW, all_requisitions=True)
    rows = bag(one_pass)
    assert rows == bag(union)
    everyone = {r[:3]: r[4] for r in rows if r[3] == "Candidate"}
    assert all(r[4] <= everyone[r[:3]] for r in rows)


def test_reports_are_sorted(overlay):
    for report in (
        H.disclosure_list(overlay, AS_OF),
        H.diversity_detail(overlay, as_of=AS_OF, now=NOW, all_requisitions=True),
    ):
        got = [(r.requisition_number, r.candidate_name) for r in report.collect()]
        assert len(set(got)) > 10
        assert got == sorted(got, key=lambda r: (r[0], r[1] is None, r[1] or ""))


# --- hand-made rows -----------------------------------------------------------


@pytest.fixture
def one_application(make_tables):
    rows = {
        "requisitions": [(1, "R1", 1, 21, 5, dt.date(2020, 1, 1), "ORA_REQUISITION"),
                         (2, "R2", 1, 21, 6, dt.date(2020, 1, 1), "ORA_REQUISITION"),
                         (3, "R3", 1, 21, 5, dt.date(2020, 1, 1), "ORA_TEMPLATE")],
        "requisition_titles": [(1, "One", "US"), (2, "Two", "US"), (3, "Three", "US")],
        "phases": [(1, "oPen", "US"), (11, "New", "US")],
        "states": [(21, None, "US"), (22, "", "FR")],
        "departments": [(5, "Sales", START, END), (6, "Gone", START, dt.date(2010, 12, 31))],
        "submissions": [(100, 1, 7, 11, 21, "P"), (200, 2, 7, 11, 21, "Y"),
                        (300, 3, 7, 11, 21, "Y"), (400, 1, 8, 11, 22, "N")],
        "candidates": [(7, "C7"), (8, "C8")],
        "person_names": [(7, "GLOBAL", "Seven", START, END), (8, "GLOBAL", "", START, END),
                         (8, "LOCAL", "L8", START, END)],
        "person_ethnicities": [(7, "1"), (7, "1"), (7, "3")],
        "regulatory_responses": [(7, 100, "F", "ORA_X", "", None), (8, 400, None, "4", None, None)],
        "lookups": [("ORA_PER_ETHNICITY", "4", "Hispanic"), ("ORA_PER_ETHNICITY", "ORA_X", "?"),
                    ("SEX", "F", "Female")],
        "person_legislative": [(7, "Y", None, "N", "Q", START, None),
                               (7, "Y", "Y", "Y", "Y", None, END)],
    }
    return rows, make_tables


def test_detail_of_hand_made_rows(one_application):
    rows, make = one_application
    got = H.diversity_detail(make(**rows), "R1", AS_OF, NOW)
    assert got.columns == DETAIL_COLUMNS and len(got.columns) == 25
    got = got.collect()
    # Two rows of one ethnicity code double the application.
    assert [r.person_id for r in got] == [7, 7, 8]
    seven, eight = got[0], got[2]
    assert seven == got[1]
    assert seven.req_current_status == "oPen - " and seven.sub_current_status == "New - "
    assert seven.active == "P" and seven.department_name == "Sales"
    assert seven.new_race == "Two or more races" and seven.new_ethnicity is None
    assert (seven.ethnicity, seven.race, seven.gender) == (None, None, "Female")
    assert [seven.disabled_veteran, seven.active_duty_wartime, seven.armed_forces_medal,
            seven.recently_separated_veteran] == ["Yes", None, "No", "Q"]
    assert eight.candidate_name is None and eight.sub_current_status == "New - "
    assert (eight.ethnicity, eight.race) == ("Hispanic", None)
    assert eight.new_race == "Did not provide" and eight.disabled_veteran is None


def test_expired_department_and_template_vanish(one_application):
    rows, make = one_application
    assert H.diversity_detail(make(**rows), ["R2", "R3"], AS_OF, NOW).count() == 0
    assert H.diversity_counts(make(**rows), ["R2", "R3"], AS_OF, NOW).count() == 0


def test_counts_of_hand_made_rows(one_application):
    rows, make = one_application
    got = {r.count_type: r.count_results
           for r in H.diversity_counts(make(**rows), "R1", AS_OF, NOW).collect()}
    # 'ORA_X' is not '1' as text, so person 7 counts; nobody declared a disability.
    assert got == {"Candidate": 2, "Female": 1, "Minority": 2, "Veteran": 1}


def test_list_of_hand_made_rows(one_application):
    rows, make = one_application
    got = H.disclosure_list(make(**rows), AS_OF).collect()
    # Open in any spelling, any department; an empty name is still a name row.
    assert [(r.requisition_number, r.submission_id, r.candidate_name) for r in got] == [
        ("R1", 100, "Seven"), ("R1", 400, None), ("R2", 200, "Seven"),
    ]


def test_titles_and_history_multiply_rows(one_application):
    rows, make = one_application
    rows["requisition_titles"] += [(1, "Un", "FR")]
    rows["status_history"] = [(100, 21, 1), (100, 21, 1), (100, 22, 1)]
    rows["reasons"] = [(1, "Why")]
    rows["source_tracking"] = [(1, 400, 9, "C8", "S1")] * 3
    got = H.diversity_detail(make(**rows), "R1", AS_OF, NOW)
    assert got.where("person_id = 7").count() == 2 * 2 * 2
    assert got.where("person_id = 8").count() == 2 * 3
    assert got.where("sub_status_reason = 'Why'").count() == 8
    counts = H.diversity_counts(make(**rows), "R1", AS_OF, NOW)
    assert bag(counts) == bag(H.diversity_counts_union(make(**rows), "R1", AS_OF, NOW))
    assert counts.where("count_type = 'Candidate'").count() == 2


def test_answer_reports_take_installation_codes(make_tables):
    answers = [(7, 100, 4, "SUBMISSION", "S", "CANDIDATE", code, text) for code, text in [
        ("300000293743272", "No"), ("300000293743263", "Yes"), ("300000293742814", "Yes"),
        ("300000293742939", "Yes")]]
    t = make_tables(submissions=[(100, 1, 7, 11, 21, "P"), (400, 1, 8, 11, 22, "N")],
                    questionnaire_responses=answers)
    conviction = H.conviction_answers(t)
    assert conviction.columns == ["submission_id", "requisition_id", "person_id", "sex_crime",
                                  "felony", "misdemeanor", "regulation"]
    assert bag(conviction) == [(100, 1, 7, "No", "Yes", None, None),
                               (400, 1, 8, None, None, None, None)]
    preference = H.preference_answers(t)
    assert preference.columns[3:] == ["uw_state", "honorably", "spouse", "veterans_preference"]
    assert bag(preference) == [(100, 1, 7, "Yes", None, "Yes", "No"),
                               (400, 1, 8, None, None, None, None)]
