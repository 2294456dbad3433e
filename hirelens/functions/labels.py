"""Column expressions: labels and classifiers."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """An empty string counts as missing."""
    return F.nullif(_col(c), F.lit(""))


def yes_no(c: Column | str) -> Column:
    """'Y' and 'N' spelled out; anything else passes through."""
    c = _col(c)
    return F.when(c == "Y", "Yes").when(c == "N", "No").otherwise(c)


def status_label(phase: Column | str, state: Column | str) -> Column:
    """'phase - state'; a missing part is empty, never null."""
    empty = F.lit("")
    return F.concat(F.coalesce(_col(phase), empty), F.lit(" - "), F.coalesce(_col(state), empty))


def medium_and_name(medium: Column | str, name: Column | str) -> Column:
    """'medium - name', or whichever of the two is known."""
    medium, name = _col(medium), _col(name)
    both = F.concat(medium, F.lit(" - "), name)
    return F.coalesce(both, medium, name)


def ethnicity_split(code: Column | str, meaning: Column | str) -> tuple[Column, Column]:
    """Split a decoded single code into (ethnicity, race).

    The code is compared as a number. A code that is not a number gives null for
    both instead of failing the query.
    """
    number = _col(code).try_cast("decimal(38,10)")
    meaning = _col(meaning)
    return (
        F.when(number == C.ETHNICITY_NOT_RACE, meaning),
        F.when(number != C.ETHNICITY_NOT_RACE, meaning),
    )


def race_ethnicity(
    flags: dict[str, Column | str], fix_labels: bool = False
) -> tuple[Column, Column]:
    """Classify Yes/No flags into (ethnicity, race).

    ``flags`` maps the names of ``config.ETHNICITY_CODES`` to columns holding
    'Yes' or 'No'; null counts as 'No'. Only five of them count towards the race
    label, and a Hispanic person has no race label.
    """
    labels = C.RACE_LABELS_FIXED if fix_labels else C.RACE_LABELS
    on = {name: F.coalesce(_col(c) == "Yes", F.lit(False)) for name, c in flags.items()}
    races = ["white", "black", "asian", "indian", "hawaiian"]
    marked = reduce(add, [on[r].cast("int") for r in races])

    race = F.when(on["hispanic"], F.lit(None).cast("string"))
    race = race.when(marked >= 2, labels["many"]).when(marked == 0, labels["none"])
    for name in races:
        race = race.when(on[name], labels[name])
    return F.when(on["hispanic"], C.HISPANIC_LABEL), race


def preference_verdict(uw_state: Column | str, honorably: Column | str, spouse: Column | str):
    """Null without any answer, 'No' after a refusal, else 'Yes' on either claim."""
    refused, honorable, married = _col(uw_state), _col(honorably), _col(spouse)
    return (
        F.when(refused.isNull() & honorable.isNull() & married.isNull(), None)
        .when(refused == "Yes", "No")
        .when((honorable == "Yes") | (married == "Yes"), "Yes")
        .otherwise("No")
    )
