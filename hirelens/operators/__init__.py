from .answers import answers_wide, scoped_answers
from .applications import (
    application_base,
    application_source,
    regulatory_profile,
    status_reason,
    submission_status,
)
from .copies import expand_copies, with_copies
from .dimensions import dimensions, guarded
from .filters import in_force, optional_filter, required_filter, sorted_report
from .flags import flags_by_code
from .headcount import headcount_by
from .lookups import lookup_decode, site_label, source_label, translated_names
from .people import current_names, person_profile, veteran_profile
from .requisitions import requisition_profile
from .scoping import for_requisitions, narrowed

__all__ = [
    "answers_wide",
    "application_base",
    "application_source",
    "current_names",
    "dimensions",
    "expand_copies",
    "flags_by_code",
    "for_requisitions",
    "guarded",
    "headcount_by",
    "in_force",
    "lookup_decode",
    "narrowed",
    "optional_filter",
    "person_profile",
    "regulatory_profile",
    "required_filter",
    "requisition_profile",
    "scoped_answers",
    "site_label",
    "sorted_report",
    "source_label",
    "status_reason",
    "submission_status",
    "translated_names",
    "veteran_profile",
    "with_copies",
]
