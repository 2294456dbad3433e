"""Fixed values of the reports: codes, labels and size limits.

Question codes belong to one installation; pass your own dictionaries to the
reports if yours differ.
"""

# --- fixed values -----------------------------------------------------------
REQUISITION_USAGE = "ORA_REQUISITION"
NAME_TYPE = "GLOBAL"
OPEN_PHASE = "OPEN"

ANSWER_SCOPE = {
    "subscriber_id": 4,
    "subject_code": "SUBMISSION",
    "status": "S",
    "participant_type": "CANDIDATE",
}

CONVICTION_CODES = {
    "sex_crime": "300000293743272",
    "felony": "300000293743263",
    "misdemeanor": "300000293743258",
    "regulation": "300000293743050",
}

PREFERENCE_CODES = {
    "uw_state": "300000293742814",
    "honorably": "300000293743041",
    "spouse": "300000293742939",
}

LOOKUP_SOURCE_MEDIUM = "ORA_IRC_SOURCE_TRACKING_MEDIUM"
LOOKUP_GENDER = "SEX"
LOOKUP_ETHNICITY = "ORA_PER_ETHNICITY"
LOOKUP_VETERAN = "ORA_HRX_US_VETS_SELFID_STATUS"
LOOKUP_DISABILITY = "ORA_PER_SELF_DISCLOSE_DISABILI"

# Person-level ethnicity codes.
ETHNICITY_CODES = {
    "white": "1",
    "unknown": "2",
    "black": "3",
    "hispanic": "4",
    "asian": "5",
    "hawaiian": "6",
    "indian": "7",
}

# In the single-code form on an application, this code means ethnicity and
# every other one means race.
ETHNICITY_NOT_RACE = 4

# The spelling of the "black" label is part of the expected output.
RACE_LABELS = {
    "many": "Two or more races",
    "none": "Did not provide",
    "white": "White",
    "black": "Black or Afican American",
    "asian": "Asian",
    "indian": "American Indian or Alaska Native",
    "hawaiian": "Native Hawaiian or other Pacific Islander",
}
RACE_LABELS_FIXED = {**RACE_LABELS, "black": "Black or African American"}
HISPANIC_LABEL = "I am Hispanic or Latino"

FEMALE = "F"
DISABILITY_YES = ["ORA_PER_YES_GB", "ORA_PER_YES_US"]
PROTECTED_VETERAN = "ORA_PROTECT_VETS_NO_SELFID"
NON_MINORITY = "1"

VETERAN_FLAGS = {
    "disabled_veteran": "per_information11",
    "active_duty_wartime": "per_information12",
    "armed_forces_medal": "per_information13",
    "recently_separated_veteran": "per_information15",
}

# --- limits -----------------------------------------------------------------
# Copies produced from one row by one explode.
COPIES_PER_ROW = 65_536
# Tables of labels and ids are only sent to every executor after a count has shown at most
# this many rows. Above it the same rows come from another kind of join.
BROADCAST_ROWS = 200_000
