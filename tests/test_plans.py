import datetime as dt
import re

import pytest

import __spark_entry__ as entry
import hirelens as H
from hirelens.sources import SCHEMAS
from testing.overlay import AS_OF, CONVICTION, FIVE, NOW, PREFERENCE
from tests.conftest import bag

DAY = dt.date(2024, 6, 30)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """The overlay at the smallest scale, written as the twenty input tables."""
    from testing.overlay import overlay_tables
    from tests.conftest import SF_DIR

    path = str(tmp_path_factory.mktemp("tables"))
    overlay = overlay_tables(spark, SF_DIR)
    for name in SCHEMAS:
        getattr(overlay, name).write.parquet(f"{path}/{name}")
    return path


@pytest.fixture
def stored(spark, written):
    return H.Tables.from_parquet(spark, written)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def scans(df, table: str) -> list[str]:
    return [line for line in plan(df).splitlines()
            if "FileScan" in line and f"/{table}]" in line]


def test_no_python_and_no_cross_join(spark):
    for name in {**entry.REPORTS, **entry.OPERATORS}:
        text = plan(entry.queries()[name](spark, "/root/testdata/sf0.001"))
        for word in ("Python", "Pandas", "ArrowEval", "CartesianProduct", "NestedLoop"):
            assert word not in text, (name, word)


def test_stored_tables_give_the_same_reports(overlay, stored):
    for report, arguments in (
        (H.disclosure_list, {"as_of": AS_OF}),
        (H.diversity_detail, {"as_of": AS_OF, "now": NOW, "all_requisitions": True}),
        (H.diversity_counts, {"as_of": AS_OF, "now": NOW, "all_requisitions": True}),
    ):
        one, other = report(overlay, **arguments), report(stored, **arguments)
        assert one.exceptAll(other).count() == other.exceptAll(one).count() == 0


@pytest.mark.parametrize("report, codes", [
    (H.conviction_answers, CONVICTION), (H.preference_answers, PREFERENCE),
])
def test_answers_are_scanned_once_with_filters(stored, report, codes):
    (scan,) = scans(report(stored, codes), "questionnaire_responses")
    for pushed in ("EqualTo(subscriber_id,4)", "EqualTo(subject_code,SUBMISSION)",
                   "EqualTo(status,S)", "EqualTo(participant_type,CANDIDATE)",
                   "In(question_code"):
        assert pushed in scan


def test_ethnicities_are_scanned_once(stored):
    detail = H.diversity_detail(stored, as_of=AS_OF, now=NOW, all_requisitions=True)
    (scan,) = scans(detail, "person_ethnicities")
    assert "In(ethnicity, [1,2,3,4,5,6,7])" in scan


def test_counts_read_only_what_they_need(stored):
    df = H.diversity_counts(stored, as_of=AS_OF, now=NOW, all_requisitions=True)
    for table in ("status_history", "reasons", "source_tracking", "person_names", "lookups",
                  "person_ethnicities", "sites", "source_dimensions"):
        assert not scans(df, table)
    for table in ("submissions", "regulatory_responses", "person_legislative", "candidates"):
        assert len(scans(df, table)) == 1
    assert optimized(df).count("Join ") <= 10
    (scan,) = scans(df, "submissions")
    assert "active_flag" not in scan
    (scan,) = scans(df, "candidates")
    assert "candidate_number" not in scan


def test_filters_reach_the_scan(stored):
    df = H.disclosure_list(stored, AS_OF)
    (scan,) = scans(df, "requisitions")
    assert "EqualTo(req_usage_code,ORA_REQUISITION)" in scan
    (scan,) = scans(df, "person_names")
    assert "EqualTo(name_type,GLOBAL)" in scan
    assert "LessThanOrEqual(effective_start_date,2024-06-30)" in scan
    assert "GreaterThanOrEqual(effective_end_date,2024-06-30)" in scan
    detail = H.diversity_detail(stored, "REQ-10", AS_OF, NOW)
    assert "EqualTo(requisition_number,REQ-10)" in scans(detail, "requisitions")[0]
    (scan,) = scans(detail, "person_legislative")
    assert "LessThanOrEqual(effective_start_date,2024-06-30)" in scan
    (scan,) = scans(detail, "status_history")
    for column in ("subject_id", "state_id", "reason_id"):
        assert f"IsNotNull({column})" in scan


def test_one_requisition_cuts_large_tables_before_any_shuffle(stored):
    text = plan(H.diversity_detail(stored, "REQ-10", AS_OF, NOW))
    for table in ("status_history", "source_tracking", "regulatory_responses", "candidates",
                  "person_names", "person_legislative", "person_ethnicities"):
        lines = text.splitlines()
        at = next(i for i, line in enumerate(lines) if "FileScan" in line and f"/{table}]" in line)
        above = next(line for line in reversed(lines[:at]) if "Join" in line or "Exchange" in line)
        assert "BroadcastHashJoin" in above and "LeftSemi" in above, table


def test_actions_while_a_report_is_built(stored, monkeypatch):
    ran = []
    frame = type(stored.submissions)
    for name in ("collect", "count", "first", "checkpoint", "toPandas"):
        action = getattr(frame, name)
        monkeypatch.setattr(frame, name, lambda self, *a, f=action, n=name, **k: ran.append(n) or f(self, *a, **k))
    for jobs, build in (
        (1, lambda: H.conviction_answers(stored, CONVICTION)),
        (1, lambda: H.preference_answers(stored, PREFERENCE)),
        (3, lambda: H.diversity_detail(stored, FIVE, AS_OF, NOW)),
        (3, lambda: H.diversity_counts(stored, FIVE, AS_OF, NOW)),
        (1, lambda: H.diversity_detail(stored, as_of=AS_OF, now=NOW, all_requisitions=True)),
        (3, lambda: H.disclosure_list(stored, AS_OF, req_status="Open - Closed")),
    ):
        build()
        assert ran == ["collect"] * jobs
        ran.clear()


@pytest.fixture
def no_size_based_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchange_keys(df):
    found = re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan(df))
    return [[re.sub(r"#\d+L?$", "", k.strip()) for k in keys.split(", ")] for keys in found]


def test_no_exchange_on_keys_of_a_few_values(stored, no_size_based_broadcast):
    few = {"current_phase_id", "current_state_id", "site_number", "reason_id"}
    few |= {f"{name}_code" for name in ("gender", "ethnicity", "veterans_preference", "disability")}
    for report in (H.diversity_detail, H.diversity_counts):
        df = report(stored, as_of=AS_OF, now=NOW, all_requisitions=True)
        keys = exchange_keys(df)
        assert not [k for k in keys if len(k) == 1 and k[0] in few]
        # Two small tables meet on it before they are broadcast to the tracking records.
        assert keys.count(["dimension_id"]) <= 2
    detail = H.diversity_detail(stored, as_of=AS_OF, now=NOW, all_requisitions=True)
    assert "BroadcastHashJoin [dimension_id" in plan(detail)


def test_chosen_requisitions_take_no_more_exchanges(stored):
    for report in (H.diversity_detail, H.diversity_counts):
        chosen = report(stored, "REQ-10", AS_OF, NOW)
        every = report(stored, as_of=AS_OF, now=NOW, all_requisitions=True)
        assert len(exchange_keys(chosen)) <= len(exchange_keys(every))


def test_codes_and_titles_reach_the_scan(stored):
    df = H.diversity_counts(stored, as_of=AS_OF, now=NOW, all_requisitions=True)
    (scan,) = scans(df, "regulatory_responses")
    for pushed in ("In(attribute_4, [ORA_PER_YES_GB,ORA_PER_YES_US])", "EqualTo(attribute_1,F)",
                   "Not(EqualTo(attribute_2,1))", "EqualTo(attribute_3,ORA_PROTECT_VETS_NO_SELFID)"):
        assert pushed in scan, scan
    df = H.disclosure_list(stored, AS_OF, req_name=["A", "B"])
    assert all("In(title, [A,B])" in scan for scan in scans(df, "requisition_titles"))


def test_a_missing_lookup_table_is_stood_in_for(spark, written, tmp_path):
    import shutil

    for name in SCHEMAS:
        if name != "person_lookups":
            shutil.copytree(f"{written}/{name}", f"{tmp_path}/{name}")
    t = H.Tables.from_parquet(spark, str(tmp_path))
    assert bag(t.person_lookups) == bag(t.lookups)
    assert H.diversity_detail(t, "REQ-10", AS_OF, NOW).count() > 0
    frames = {name: getattr(t, name) for name in SCHEMAS if name != "lookups"}
    assert bag(H.Tables.from_frames(frames).lookups) == bag(t.person_lookups)


def test_catalog_tables(spark, stored, written):
    spark.sql("create database if not exists hr")
    for name in SCHEMAS:
        spark.sql(f"create table if not exists hr.{name} using parquet location '{written}/{name}'")
    try:
        t = H.Tables.from_catalog(spark, "hr")
        assert t.submissions.count() == stored.submissions.count()
        assert "phases" in t and "nothing" not in t
        with pytest.raises(AttributeError):
            t.nothing
    finally:
        for name in SCHEMAS:
            spark.sql(f"drop table if exists hr.{name}")
        spark.sql("drop database if exists hr")


def test_unknown_tables_are_refused():
    with pytest.raises(ValueError):
        H.Tables({"nothing": None})


@pytest.mark.parametrize("report, codes", [
    (H.conviction_answers, CONVICTION), (H.preference_answers, PREFERENCE),
])
def test_answers_take_one_exchange_a_side(stored, report, codes, no_size_based_broadcast):
    df = report(stored, codes)
    text = plan(df)
    assert exchange_keys(df) == [["submission_id", "person_id"]] * 2
    assert "Window" not in text and "REPARTITION" not in text


@pytest.mark.parametrize("build", [
    lambda t: H.diversity_detail(t, FIVE, AS_OF, NOW), lambda t: H.diversity_counts(t, FIVE, AS_OF, NOW),
])
def test_chosen_requisitions_read_applications_once_for_the_report(stored, build):
    assert len(scans(build(stored), "submissions")) == 1
