"""Column lists of the input tables."""

SCHEMAS = {
    "requisitions": "requisition_id long, requisition_number string, current_phase_id long, "
    "current_state_id long, department_id long, open_date date, req_usage_code string",
    "requisition_titles": "requisition_id long, title string, lang string",
    "phases": "phase_id long, name string, lang string",
    "states": "state_id long, name string, lang string",
    "departments": "organization_id long, name string, effective_start_date date, "
    "effective_end_date date",
    "submissions": "submission_id long, requisition_id long, person_id long, "
    "current_phase_id long, current_state_id long, active_flag string",
    "status_history": "subject_id long, state_id long, reason_id long",
    "reasons": "reason_id long, reason_name string",
    "source_tracking": "requisition_id long, submission_id long, dimension_id long, "
    "candidate_number string, site_number string",
    "source_dimensions": "dimension_id long, source_medium string",
    "source_dimension_names": "dimension_id long, source_name string",
    "sites": "site_id long, site_number string",
    "site_names": "site_id long, site_name string",
    "candidates": "person_id long, candidate_number string",
    "person_names": "person_id long, name_type string, full_name string, "
    "effective_start_date date, effective_end_date date",
    "regulatory_responses": "person_id long, submission_id long, attribute_1 string, "
    "attribute_2 string, attribute_3 string, attribute_4 string",
    "lookups": "lookup_type string, lookup_code string, meaning string",
    "person_lookups": "lookup_type string, lookup_code string, meaning string",
    "person_legislative": "person_id long, per_information11 string, per_information12 string, "
    "per_information13 string, per_information15 string, effective_start_date date, "
    "effective_end_date date",
    "person_ethnicities": "person_id long, ethnicity string",
    "questionnaire_responses": "participant_id long, subject_id long, subscriber_id int, "
    "subject_code string, status string, participant_type string, question_code string, "
    "long_text string",
}

# Where one of these tables is not given, the other one stands in for it.
STAND_INS = {"person_lookups": "lookups", "lookups": "person_lookups"}

# Text columns that are compared with constants. They are read as they are, so the
# comparison can be pushed down to the file scan, and an empty string becomes null only
# where the value is put out or joined; in every other text column it is read as null.
COMPARED_ONLY = {
    "requisitions": {"requisition_number", "req_usage_code"},
    "requisition_titles": {"title"},
    "regulatory_responses": {"attribute_1", "attribute_2", "attribute_3", "attribute_4"},
    "person_names": {"name_type"},
    "lookups": {"lookup_type"},
    "person_lookups": {"lookup_type"},
    "person_ethnicities": {"ethnicity"},
    "questionnaire_responses": {"subject_code", "status", "participant_type", "question_code"},
}
