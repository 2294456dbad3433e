"""DuckDB statements for the registered queries, in the plain many-join form.

They share the overlay views with Spark but none of its rewrites: one join per
question and per ethnicity code, one pass per head count, all joins multiplying.
"""

from __future__ import annotations

from .overlay import FIVE, TITLES, with_overlay

DAY = "date '2024-06-30'"
MOMENT = "timestamp '2024-06-30 10:00:00'"

IN_SCOPE = """subscriber_id = 4 and subject_code = 'SUBMISSION' and status = 'S'
      and participant_type = 'CANDIDATE'"""

LABEL = "coalesce({0}, '') || ' - ' || coalesce({1}, '')"


def yes_no(column: str) -> str:
    return f"case {column} when 'Y' then 'Yes' when 'N' then 'No' else {column} end"


def answer_joins(columns: dict[str, str]) -> str:
    return "\n".join(
        f"""left join (select subject_id, participant_id, long_text {name}
      from questionnaire_responses where {IN_SCOPE} and question_code = '{code}') a_{name}
      on a_{name}.subject_id = s.submission_id and a_{name}.participant_id = s.person_id"""
        for name, code in columns.items()
    )


CONVICTION = {"sex_crime": "Q1", "felony": "Q2", "misdemeanor": "Q3", "regulation": "Q4"}
PREFERENCE = {"uw_state": "Q5", "honorably": "Q6", "spouse": "Q7"}
VERDICT = """case when coalesce(uw_state, honorably, spouse) is null then null
      when uw_state = 'Yes' then 'No'
      when 'Yes' in (honorably, spouse) then 'Yes' else 'No' end"""

REQUISITION = f"""
  select r.requisition_id, r.requisition_number, rt.title requisition_name, p.name req_phase,
    {LABEL.format('p.name', 's.name')} req_current_status, r.open_date, r.department_id
  from requisitions r
  join requisition_titles rt on rt.requisition_id = r.requisition_id
  join (select distinct phase_id, name from phases) p on p.phase_id = r.current_phase_id
  join (select distinct state_id, name from states) s on s.state_id = r.current_state_id
  where r.req_usage_code = 'ORA_REQUISITION'"""

NAMED = f"""
  select person_id, full_name candidate_name from person_names
  where name_type = 'GLOBAL' and {DAY} between effective_start_date and effective_end_date"""

DEPARTED = f"""
  select organization_id, name department_name from departments
  where {DAY} between effective_start_date and effective_end_date"""

VETERANS = f"""
  select person_id, {yes_no('per_information11')} disabled_veteran,
    {yes_no('per_information12')} active_duty_wartime,
    {yes_no('per_information13')} armed_forces_medal,
    {yes_no('per_information15')} recently_separated_veteran
  from person_legislative
  where cast({DAY} as timestamp)
    between coalesce(cast(effective_start_date as timestamp), {MOMENT})
    and coalesce(cast(effective_end_date as timestamp), {MOMENT})"""


def meaning(code: str, type: str, alias: str, table: str = "lookups") -> str:
    return f"""left join {table} {alias} on {alias}.lookup_code = {code}
    and {alias}.lookup_type = '{type}'"""


REGULATORY = f"""
  select g.person_id, g.submission_id,
    g.attribute_1 gender_code, g1.meaning gender,
    g.attribute_2 ethnicity_code, g2.meaning ethnicity_meaning,
    g.attribute_3 veterans_preference_code, g3.meaning veterans_preference,
    g.attribute_4 disability_code, g4.meaning disability
  from regulatory_responses g
  {meaning('g.attribute_1', 'SEX', 'g1', 'person_lookups')}
  {meaning('g.attribute_2', 'ORA_PER_ETHNICITY', 'g2')}
  {meaning('g.attribute_3', 'ORA_HRX_US_VETS_SELFID_STATUS', 'g3', 'person_lookups')}
  {meaning('g.attribute_4', 'ORA_PER_SELF_DISCLOSE_DISABILI', 'g4')}"""

SOURCES = f"""
  select d.dimension_id,
    nullif(concat_ws(' - ', m.meaning, n.source_name), '') source_medium
  from source_dimensions d
  join source_dimension_names n on n.dimension_id = d.dimension_id
  {meaning('d.source_medium', 'ORA_IRC_SOURCE_TRACKING_MEDIUM', 'm')}"""

SITES = """
  select b.site_number, n.site_name career_site
  from sites b join site_names n on n.site_id = b.site_id"""

ETHNICITY_NAMES = ["white", "unknown", "black", "hispanic", "asian", "hawaiian", "indian"]
FLAG_COLUMNS = ", ".join(
    f"case when f{i}.person_id is null then 'No' else 'Yes' end {name}"
    for i, name in enumerate(ETHNICITY_NAMES, 1)
)
FLAG_JOINS = "\n".join(
    f"""left join (select person_id from person_ethnicities where ethnicity = '{i}') f{i}
    on f{i}.person_id = s.person_id"""
    for i in range(1, 8)
)
FLAGS = f"select s.submission_id, s.person_id, {FLAG_COLUMNS} from submissions s {FLAG_JOINS}"

# Race by another route than the flags: distinct codes of a person.
PERSON_RACES = """
  select e.person_id, count(*) filter (where e.ethnicity = '4') hispanics,
    count(distinct r.code) races, min(r.label) label
  from person_ethnicities e
  left join (values ('1', 'White'), ('3', 'Black or Afican American'), ('5', 'Asian'),
    ('6', 'Native Hawaiian or other Pacific Islander'),
    ('7', 'American Indian or Alaska Native')) r(code, label) on r.code = e.ethnicity
  group by e.person_id"""
NEW_RACE = """case when pr.hispanics > 0 then null when pr.races = 1 then pr.label
      when pr.races > 1 then 'Two or more races' else 'Did not provide' end"""
NEW_ETHNICITY = "case when pr.hispanics > 0 then 'I am Hispanic or Latino' end"

SUBMITTED = f"""
  select s.submission_id, s.requisition_id, s.person_id, s.current_state_id state_id,
    {LABEL.format('p.name', 't.name')} sub_current_status,
    {yes_no('s.active_flag')} active
  from submissions s
  join (select distinct phase_id, name from phases) p on p.phase_id = s.current_phase_id
  join (select distinct state_id, name from states) t on t.state_id = s.current_state_id"""

REASONS = """
  select h.subject_id, h.state_id, r.reason_name sub_status_reason
  from status_history h left join reasons r on r.reason_id = h.reason_id
  where h.subject_id is not null and h.state_id is not null and h.reason_id is not null"""

TRACKED = f"""
  select k.requisition_id, k.submission_id, k.candidate_number, sl.source_medium, st.career_site
  from source_tracking k
  left join ({SOURCES}) sl on sl.dimension_id = k.dimension_id
  left join ({SITES}) st on st.site_number = k.site_number
  where k.requisition_id is not null and k.submission_id is not null"""

SPINE = f"""
  from ({REQUISITION}) q
  join ({DEPARTED}) dp on dp.organization_id = q.department_id
  join ({SUBMITTED}) a on a.requisition_id = q.requisition_id
  join candidates c on c.person_id = a.person_id
  left join ({NAMED}) nm on nm.person_id = c.person_id"""

# Joins that a distinct head count cannot notice, and those it needs.
DETAILS = f"""
  left join ({REASONS}) h on h.subject_id = a.submission_id and h.state_id = a.state_id
  left join ({TRACKED}) k on k.requisition_id = q.requisition_id
    and k.submission_id = a.submission_id and k.candidate_number = c.candidate_number
  left join ({REGULATORY}) g on g.submission_id = a.submission_id and g.person_id = c.person_id
  left join ({VETERANS}) v on v.person_id = c.person_id"""


def count_branch(name: str, condition: str) -> str:
    return f"""
  select q.requisition_id, q.requisition_number, q.requisition_name, '{name}' count_type,
    count(distinct a.person_id) count_results
  {SPINE} {DETAILS}
  where {condition}
  group by q.requisition_id, q.requisition_number, q.requisition_name"""


COUNTS = "\nunion\n".join(
    count_branch(name, condition)
    for name, condition in {
        "Candidate": "true",
        "Disability": "g.disability_code in ('ORA_PER_YES_GB', 'ORA_PER_YES_US')",
        "Female": "g.gender_code = 'F'",
        "Minority": "g.ethnicity_code <> '1'",
        "Veteran": """g.veterans_preference_code = 'ORA_PROTECT_VETS_NO_SELFID'
    or v.disabled_veteran = 'Yes' or v.active_duty_wartime = 'Yes'
    or v.armed_forces_medal = 'Yes' or v.recently_separated_veteran = 'Yes'""",
    }.items()
)

DISCLOSURE = f"""
  select q.requisition_id, s.submission_id, s.person_id, q.requisition_number,
    q.requisition_name, q.req_current_status, q.open_date, c.candidate_number, nm.candidate_name
  from ({REQUISITION}) q
  join submissions s on s.requisition_id = q.requisition_id
  join candidates c on c.person_id = s.person_id
  join ({NAMED}) nm on nm.person_id = c.person_id
  where upper(q.req_phase) = 'OPEN'"""

DETAIL = f"""
  select q.requisition_id, a.person_id, q.requisition_number, q.requisition_name,
    q.req_current_status, q.open_date, a.sub_current_status, h.sub_status_reason, a.active,
    k.source_medium, k.career_site, dp.department_name, c.candidate_number, nm.candidate_name,
    g.gender,
    case when try_cast(g.ethnicity_code as integer) = 4 then g.ethnicity_meaning end ethnicity,
    case when try_cast(g.ethnicity_code as integer) <> 4 then g.ethnicity_meaning end race,
    g.veterans_preference, g.disability, v.disabled_veteran, v.active_duty_wartime,
    v.armed_forces_medal, v.recently_separated_veteran, {NEW_ETHNICITY} new_ethnicity,
    {NEW_RACE} new_race
  {SPINE} {DETAILS}
  left join ({FLAGS}) f on f.submission_id = a.submission_id and f.person_id = c.person_id
  left join ({PERSON_RACES}) pr on pr.person_id = c.person_id"""

CONVICTION_ANSWERS = f"""
  select s.submission_id, s.requisition_id, s.person_id, {', '.join(CONVICTION)}
  from submissions s {answer_joins(CONVICTION)}"""

PREFERENCE_ANSWERS = f"""
  select s.submission_id, s.requisition_id, s.person_id, {', '.join(PREFERENCE)},
    {VERDICT} veterans_preference
  from submissions s {answer_joins(PREFERENCE)}"""


def best_answers(columns: dict[str, str]) -> str:
    best = ", ".join(
        f"max(case when question_code = '{code}' then long_text end) {name}"
        for name, code in columns.items()
    )
    codes = ", ".join(f"'{code}'" for code in columns.values())
    return f"""
  select s.submission_id, s.requisition_id, s.person_id, {', '.join(columns)}
  from submissions s
  left join (select subject_id, participant_id, {best} from questionnaire_responses
    where {IN_SCOPE} and question_code in ({codes}) group by subject_id, participant_id) b
    on b.subject_id = s.submission_id and b.participant_id = s.person_id"""


# Every requisition and title with every count, 0 where nobody is counted.
ZERO_COUNTS = f"""
  select e.requisition_id, e.requisition_number, e.requisition_name, e.count_type,
    coalesce(k.count_results, 0) count_results
  from (select distinct q.requisition_id, q.requisition_number, q.requisition_name, t.count_type
    from ({REQUISITION}) q join ({DEPARTED}) dp on dp.organization_id = q.department_id,
    (values ('Candidate'), ('Disability'), ('Female'), ('Minority'), ('Veteran')) t(count_type)) e
  left join ({COUNTS}) k on k.requisition_id = e.requisition_id and k.count_type = e.count_type
    and k.requisition_name is not distinct from e.requisition_name"""

QUERIES = {
    "r1_disclosure_list": DISCLOSURE,
    "r1_disclosure_list_filtered": f"""{DISCLOSURE}
    and q.req_current_status in ('Open - Posted', 'Open - ')""",
    "r1_disclosure_list_by_number": f"""{DISCLOSURE}
    and q.requisition_number in ({', '.join(f"'{n}'" for n in FIVE)})""",
    "r1_disclosure_list_by_name": f"""{DISCLOSURE}
    and q.requisition_name in ({', '.join(f"'{n}'" for n in TITLES)})""",
    "r2_conviction": CONVICTION_ANSWERS,
    "r3_preference": PREFERENCE_ANSWERS,
    "r4_diversity_detail": DETAIL,
    "r4_diversity_detail_chosen": f"""{DETAIL}
  where q.requisition_number in ({', '.join(f"'{n}'" for n in FIVE)})""",
    "r5_counts": COUNTS,
    "r5_counts_chosen": f"""select * from ({COUNTS}) where requisition_number = '{FIVE[0]}'""",
    "r5_counts_zero": ZERO_COUNTS,
    "r5_counts_union": COUNTS,
    "op_required_filter": """
  select person_id, name_type, full_name from person_names where name_type = 'GLOBAL'""",
    "op_sorted_report": """
  select person_id, ethnicity from person_ethnicities
  order by ethnicity nulls last, person_id nulls last""",
    "op_requisition_profile": f"""
  select q.requisition_id, q.requisition_number, q.requisition_name, q.req_phase,
    q.req_current_status, q.open_date, dp.department_name
  from ({REQUISITION}) q join ({DEPARTED}) dp on dp.organization_id = q.department_id""",
    "op_current_names": NAMED,
    "op_scoped_answers": f"""
  select subject_id submission_id, participant_id person_id, question_code, long_text
  from questionnaire_responses
  where {IN_SCOPE} and question_code in ({', '.join(f"'{c}'" for c in PREFERENCE.values())})""",
    "op_in_force": f"""
  select person_id, name_type, full_name from person_names
  where {DAY} between effective_start_date and effective_end_date""",
    "op_in_force_null_bounds": f"""
  select person_id, effective_start_date, effective_end_date from person_legislative
  where cast({DAY} as timestamp)
    between coalesce(cast(effective_start_date as timestamp), {MOMENT})
    and coalesce(cast(effective_end_date as timestamp), {MOMENT})""",
    "op_translated_names": "select distinct requisition_id, title from requisition_titles",
    "op_translated_names_lang": """
  select distinct requisition_id, title from requisition_titles where lang = 'FR'""",
    "op_lookup_decode": f"""
  select g.submission_id, g.attribute_1, l.meaning gender
  from regulatory_responses g {meaning('g.attribute_1', 'SEX', 'l', 'person_lookups')}""",
    "op_lookup_decode_other": f"""
  select g.submission_id, g.attribute_1, l.meaning gender
  from regulatory_responses g {meaning('g.attribute_1', 'SEX', 'l')}""",
    "op_yes_no": f"select submission_id, {yes_no('active_flag')} active from submissions",
    "op_status_label": f"select submission_id, sub_current_status from ({SUBMITTED}) a",
    "op_source_label": SOURCES,
    "op_site_label": f"""
  select k.submission_id, k.site_number, st.career_site
  from source_tracking k left join ({SITES}) st on st.site_number = k.site_number""",
    "op_answers_all": CONVICTION_ANSWERS,
    "op_answers_one": best_answers(CONVICTION),
    "op_flags_by_code": FLAGS,
    "op_flags_by_code_once": f"select distinct * from ({FLAGS}) f",
    "op_race_ethnicity": f"""
  select f.submission_id, f.person_id, {NEW_ETHNICITY} new_ethnicity, {NEW_RACE} new_race
  from ({FLAGS}) f left join ({PERSON_RACES}) pr on pr.person_id = f.person_id""",
    "op_ethnicity_split": f"""
  select g.submission_id,
    case when try_cast(g.ethnicity_code as integer) = 4 then g.ethnicity_meaning end ethnicity,
    case when try_cast(g.ethnicity_code as integer) <> 4 then g.ethnicity_meaning end race
  from ({REGULATORY}) g""",
    "op_preference_verdict": f"""
  select submission_id, {VERDICT} veterans_preference from ({best_answers(PREFERENCE)}) b""",
    "op_optional_filter": f"""
  select requisition_id, requisition_number, req_current_status from ({REQUISITION}) q
  where req_current_status in ('Open - Closed', 'Draft - Posted')""",
    "op_status_reason": f"""
  select a.submission_id, a.state_id, h.sub_status_reason
  from (select submission_id, current_state_id state_id from submissions) a
  left join ({REASONS}) h on h.subject_id = a.submission_id and h.state_id = a.state_id""",
    "op_application_source": f"""
  select a.requisition_id, a.submission_id, a.candidate_number, k.source_medium, k.career_site
  from (select s.requisition_id, s.submission_id, c.candidate_number
    from submissions s join candidates c on c.person_id = s.person_id) a
  left join ({TRACKED}) k on k.requisition_id = a.requisition_id
    and k.submission_id = a.submission_id and k.candidate_number = a.candidate_number""",
    "op_regulatory_profile": f"""
  select person_id, submission_id, gender_code, gender, ethnicity_code,
    ethnicity_meaning ethnicity, veterans_preference_code, veterans_preference,
    disability_code, disability
  from ({REGULATORY}) g""",
    "op_veteran_profile": VETERANS,
    "op_headcount_by": """
  select requisition_id, 'Applied' count_type, count(distinct person_id) count_results
  from submissions group by requisition_id
  union all
  select requisition_id, 'Active', count(distinct person_id)
  from submissions where active_flag = 'Y' group by requisition_id
  union all
  select requisition_id, 'Closed', count(distinct person_id)
  from submissions where current_state_id = 22 group by requisition_id""",
    "op_application_base": f"""
  select q.requisition_id, a.submission_id, a.person_id, q.requisition_number,
    q.requisition_name, q.req_phase, q.req_current_status, q.open_date, dp.department_name,
    a.state_id, a.sub_current_status, a.active, c.candidate_number, nm.candidate_name
  {SPINE}""",
}


def oracle_sql() -> dict[str, str]:
    return {name: with_overlay(text) for name, text in QUERIES.items()}
