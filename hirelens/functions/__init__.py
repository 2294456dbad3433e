from .dates import effective
from .labels import (
    blank_to_null,
    ethnicity_split,
    medium_and_name,
    preference_verdict,
    race_ethnicity,
    status_label,
    yes_no,
)

__all__ = [
    "blank_to_null",
    "effective",
    "ethnicity_split",
    "medium_and_name",
    "preference_verdict",
    "race_ethnicity",
    "status_label",
    "yes_no",
]
