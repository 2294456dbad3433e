"""Recruiting and workforce reports on Spark DataFrames."""

from .plans import (
    conviction_answers,
    disclosure_list,
    diversity_counts,
    diversity_counts_union,
    diversity_detail,
    preference_answers,
)
from .sources import Tables, save_bucketed

__all__ = [
    "Tables",
    "conviction_answers",
    "disclosure_list",
    "diversity_counts",
    "diversity_counts_union",
    "diversity_detail",
    "preference_answers",
    "save_bucketed",
]
