"""The input tables as views over the given test tables.

The same text serves Spark and DuckDB; ``{orders}`` and the like stand for a base
table. No view drops a row of its base table. Rows that are to find no partner
carry a null or a negative key instead.
"""

from __future__ import annotations

import datetime as dt
from functools import cache

from pyspark.sql import SparkSession

from hirelens import Tables
from hirelens.sources import SCHEMAS

BASE = ["nation", "customer", "supplier", "part", "orders", "lineitem"]
AS_OF = dt.date(2024, 6, 30)
NOW = dt.datetime(2024, 6, 30, 10, 0, 0)

# Requisitions that reports are asked for, and titles (names of parts at every scale).
FIVE = ["REQ-10", "REQ-43", "REQ-90", "REQ-110", "REQ-150"]
TITLES = ["red rod", "hot ring", "new gear", "blue rod"]

CONVICTION = {"sex_crime": "Q1", "felony": "Q2", "misdemeanor": "Q3", "regulation": "Q4"}
PREFERENCE = {"uw_state": "Q5", "honorably": "Q6", "spouse": "Q7"}

VIEWS = {
    "requisitions": """
        select p_partkey requisition_id,
          concat('REQ-', cast(p_partkey as string)) requisition_number,
          p_partkey % 5 + 1 current_phase_id, p_partkey % 4 + 21 current_state_id,
          p_partkey % 25 department_id,
          case when p_partkey % 10 = 8 then 'ORA_TEMPLATE' else 'ORA_REQUISITION' end
            req_usage_code,
          date '2020-01-01' + cast(p_partkey % 365 as int) open_date
        from {part}""",
    "requisition_titles": """
        select p_partkey requisition_id, 'US' lang,
          case when p_partkey % 40 = 30 then '' else p_name end title
        from {part}
        union all
        select case when p_partkey % 50 = 0 then p_partkey else -p_partkey end, 'FR',
          concat('FR ', p_name)
        from {part}""",
    "phases": """
        select * from (values (1,'US','Open'), (1,'FR','Open'), (2,'US','Filled'),
          (3,'US','Draft'), (4,'US','OPEN'), (11,'US','New'), (12,'US','Interview'), (13,'US','Offer'),
          (13,'FR','Offre'), (14,'US','HR')) t(phase_id, lang, name)""",
    "states": """
        select * from (values (21,'US','In Progress'), (21,'FR','In Progress'),
          (22,'US','Closed'), (23,'US',null), (24,'US','Posted')) t(state_id, lang, name)""",
    "departments": """
        select n_nationkey organization_id, n_name name, date '2000-01-01' effective_start_date,
          case when n_nationkey % 12 = 11 then date '2010-12-31' else date '4712-12-31' end
            effective_end_date
        from {nation}""",
    "submissions": """
        select o_orderkey submission_id, o_custkey person_id, {requisition} requisition_id,
          o_orderkey % 4 + 11 current_phase_id, o_orderkey % 3 + 21 current_state_id,
          case o_orderstatus when 'F' then 'Y' when 'O' then 'N' else 'P' end active_flag
        from {orders}""",
    "status_history": """
        select case when o_orderkey % 17 = 0 then null else o_orderkey end subject_id,
          o_orderkey % 3 + 21 state_id,
          case when o_orderkey % 5 = 0 then null else o_orderkey % 7 end reason_id
        from {orders}
        union all
        select case when o_orderkey % 11 = 0 then o_orderkey end, o_orderkey % 3 + 21,
          o_orderkey % 6
        from {orders}
        union all
        select o_orderkey, (o_orderkey + 1) % 3 + 21, o_orderkey % 4 from {orders}""",
    "reasons": """
        select * from (values (0,'Hired'), (1,'Skills'), (2,'Pay'), (3,'Location'),
          (4,'Withdrew'), (5,'Other')) t(reason_id, reason_name)""",
    "source_tracking": """
        select case when o_orderkey % 13 = 0 then null when o_orderkey % 7 = 0 then -1
            else {requisition} end requisition_id,
          case when o_orderkey % 3 = 0 then o_orderkey end submission_id,
          o_orderkey % 10 dimension_id,
          concat(case when o_orderkey % 15 = 3 then 'D' else 'C' end, cast(o_custkey as string))
            candidate_number,
          concat('S', cast(o_orderkey % 4 as string)) site_number
        from {orders}""",
    "source_dimensions": """
        select s_suppkey dimension_id,
          case s_suppkey % 3 when 0 then 'M1' when 1 then 'M2' end source_medium
        from {supplier}""",
    "source_dimension_names": """
        select s_suppkey dimension_id,
          case when s_suppkey % 4 = 3 then null else s_name end source_name
        from {supplier}""",
    "sites": """
        select * from (values (1,'S0'), (2,'S1'), (3,'S2')) t(site_id, site_number)""",
    "site_names": """
        select * from (values (1,'Main'), (1,'Haupt'), (2,''), (3,'Field')) t(site_id, site_name)""",
    "candidates": """
        select case when c_custkey % 20 = 19 then -c_custkey else c_custkey end person_id,
          concat('C', cast(c_custkey as string)) candidate_number
        from {customer}""",
    "person_names": """
        select c_custkey person_id, 'GLOBAL' name_type,
          case when c_custkey % 40 = 3 then '' else c_name end full_name,
          date '1990-01-01' effective_start_date,
          case when c_custkey % 15 = 7 then date '2000-12-31' else date '4712-12-31' end
            effective_end_date
        from {customer}
        union all
        select c_custkey, case when c_custkey % 30 = 1 then 'GLOBAL' else 'LOCAL' end,
          concat('L ', c_name), date '1990-01-01', date '4712-12-31'
        from {customer}""",
    "regulatory_responses": """
        select case when o_orderkey % 10 = 1 then o_custkey + 1 else o_custkey end person_id,
          case when o_orderkey % 4 = 3 then -o_orderkey else o_orderkey end submission_id,
          case o_custkey % 3 when 0 then 'F' when 1 then 'M' end attribute_1,
          case when o_custkey % 8 = 0 then null when o_custkey % 16 = 9 then 'X'
            when o_custkey % 16 = 2 then '' else cast(o_custkey % 8 as string) end attribute_2,
          case when o_custkey % 6 = 0 then 'ORA_PROTECT_VETS_NO_SELFID'
            when o_custkey % 6 = 1 then 'ORA_NOT_VET' end attribute_3,
          case o_custkey % 9 when 0 then 'ORA_PER_YES_US' when 1 then 'ORA_PER_YES_GB'
            when 2 then 'ORA_PER_NO_US' end attribute_4
        from {orders}
        union all
        select o_custkey, case when o_orderkey % 20 = 0 then o_orderkey else -o_orderkey end,
          'F', '1', '', 'ORA_PER_NO_US'
        from {orders}""",
    "lookups": """
        select * from (values ('SEX','F','Not used'), ('OTHER','3','Not used'), ('ORA_PER_ETHNICITY','X','Ex'),
          ('ORA_PER_ETHNICITY','1','White'), ('ORA_PER_ETHNICITY','1','Weiss'), ('ORA_PER_ETHNICITY','3','Black'),
          ('ORA_PER_ETHNICITY','4','Hispanic'), ('ORA_PER_ETHNICITY','5','Asian'),
          ('ORA_PER_SELF_DISCLOSE_DISABILI','ORA_PER_YES_US','Yes'),
          ('ORA_IRC_SOURCE_TRACKING_MEDIUM','M1','Job board'))
          t(lookup_type, lookup_code, meaning)""",
    "person_lookups": """
        select * from (values ('SEX','F','Female'), ('SEX','F','Frau'), ('SEX','M',''),
          ('ORA_HRX_US_VETS_SELFID_STATUS','ORA_PROTECT_VETS_NO_SELFID','Protected'),
          ('ORA_PER_ETHNICITY','1','Not used'))
          t(lookup_type, lookup_code, meaning)""",
    "person_legislative": """
        select case when c_custkey % 5 = 4 then -c_custkey else c_custkey end person_id,
          case c_custkey % 10 when 0 then 'Y' when 1 then 'N' when 2 then 'D' end per_information11,
          case c_custkey % 11 when 0 then 'Y' else 'N' end per_information12,
          case c_custkey % 13 when 0 then 'Y' end per_information13,
          case c_custkey % 14 when 0 then 'Y' end per_information15,
          case when c_custkey % 6 = 5 then null else date '2000-01-01' end effective_start_date,
          case when c_custkey % 4 = 1 then null else date '4712-12-31' end effective_end_date
        from {customer}
        union all
        select case when c_custkey % 12 = 0 then c_custkey else -c_custkey end, 'N', '', 'Y', null,
          date '2001-01-01', date '4712-12-31'
        from {customer}""",
    "person_ethnicities": """
        select case when c_custkey % 9 = 8 then -c_custkey else c_custkey end person_id,
          cast(c_custkey % 7 + 1 as string) ethnicity
        from {customer}
        union all
        select case when c_custkey % 6 = 0 then c_custkey else -c_custkey end,
          cast((c_custkey + 2) % 7 + 1 as string)
        from {customer}
        union all
        select case when c_custkey % 8 = 0 then c_custkey else -c_custkey end,
          cast(c_custkey % 7 + 1 as string)
        from {customer}""",
    "questionnaire_responses": """
        select case when l_partkey % 9 = 4 then o_custkey + 1 else o_custkey end participant_id,
          l_orderkey subject_id, case when l_suppkey % 7 = 3 then 5 else 4 end subscriber_id,
          case when l_suppkey % 8 = 2 then 'OTHER' else 'SUBMISSION' end subject_code,
          case when l_linestatus = 'F' then 'S' else 'I' end status,
          case when l_partkey % 10 = 0 then 'EMPLOYEE' else 'CANDIDATE' end participant_type,
          concat('Q', cast(l_linenumber as string)) question_code,
          case l_returnflag when 'R' then 'Yes' when 'A' then 'No'
            else case when l_partkey % 3 = 0 then '' end end long_text
        from {lineitem} join {orders} on l_orderkey = o_orderkey""",
}


# The requisition of an order: a hundred busy ones, and more the more orders there are.
REQUISITION = """case when o_orderkey % 3 = 0 then o_orderkey % 100
            else cast(floor(o_orderkey / 8) as bigint) end"""
VIEWS = {name: text.replace("{requisition}", REQUISITION) for name, text in VIEWS.items()}


def overlay_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The views as DataFrames."""
    base = cache(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    def view(text: str):
        used = [name for name in BASE if f"{{{name}}}" in text]
        return lambda: spark.sql(text, **{name: base(name) for name in used})

    return Tables.from_frames({name: view(text) for name, text in VIEWS.items()})


def with_overlay(query: str) -> str:
    """A DuckDB statement: the views as one WITH list, an empty text as null, then the query."""
    names = {name: name for name in BASE}
    views = []
    for name, text in VIEWS.items():
        fields = [f.split() for f in SCHEMAS[name].split(", ")]
        texts = [column for column, kind in fields if kind == "string" and column != "lang"]
        blank = ", ".join(f"nullif({column}, '') as {column}" for column in texts)
        replaced = f" replace ({blank})" if texts else ""
        views.append(f"given_{name} as ({text.format(**names)})")
        views.append(f"{name} as (select *{replaced} from given_{name})")
    return "with " + ",\n".join(views) + "\n" + query
