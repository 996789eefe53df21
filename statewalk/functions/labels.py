"""Label columns: group aliases and the texts attached to result rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of the two groups (compared trimmed and in lower case).
TD_ALIASES = ("control", "controls", "ctrl", "td", "typically developing", "typically_developing")
DYSLEXIA_ALIASES = ("patient", "patients", "dyslexia", "dyslexic")

# Result texts.
HIGHER_IN_DYSLEXIA = "Higher in Dyslexia"
HIGHER_IN_TD = "Higher in TD"
NO_DIFFERENCE = "No difference"
NOT_ESTIMABLE = "Not estimable"
NOTE_ESTIMABLE = "Between-group duration distribution was estimable."
NOTE_NOT_ESTIMABLE = (
    "Not estimable: at least one group lacked sufficient complete internal runs for this state."
)


def standardize_group(label: Column) -> Column:
    """Map known spellings to ``TD`` / ``Dyslexia``; other labels are only trimmed."""
    trimmed = F.trim(label)
    folded = F.lower(trimmed)
    return (
        F.when(folded.isin(*TD_ALIASES), F.lit("TD"))
        .when(folded.isin(*DYSLEXIA_ALIASES), F.lit("Dyslexia"))
        .otherwise(trimmed)
    )


def direction(difference: Column) -> Column:
    return (
        F.when(difference.isNull(), F.lit(NOT_ESTIMABLE))
        .when(difference > 0, F.lit(HIGHER_IN_DYSLEXIA))
        .when(difference < 0, F.lit(HIGHER_IN_TD))
        .otherwise(F.lit(NO_DIFFERENCE))
    )


def interpretation_note(estimable: Column) -> Column:
    return F.when(estimable, F.lit(NOTE_ESTIMABLE)).otherwise(F.lit(NOTE_NOT_ESTIMABLE))


def integer_label(value: Column) -> Column:
    """Integer coercion of an id, time or state read as text: fractions are cut off, anything
    that is not a finite number becomes NULL."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number).try_cast("bigint")
