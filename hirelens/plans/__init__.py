from .disclosure import conviction_answers, disclosure_list, preference_answers
from .diversity import diversity_counts, diversity_counts_union, diversity_detail

__all__ = [
    "conviction_answers",
    "disclosure_list",
    "diversity_counts",
    "diversity_counts_union",
    "diversity_detail",
    "preference_answers",
]
