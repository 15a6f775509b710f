"""Severity expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severity words and the least numbers of each severity.
WORDS = {
    "critical": ("critical", "crit", "fatal", "emergency"),
    "high": ("high", "error", "err", "major"),
    "medium": ("medium", "med", "moderate", "warning", "warn"),
    "low": ("low", "minor", "notice"),
    "info": ("info", "informational", "debug", "trace"),
}
NUMBERS = ((90, "critical"), (70, "high"), (40, "medium"), (10, "low"))


def from_number(n: Column) -> Column:
    """Severity of a number on the scale to 100."""
    out = F.when(n >= NUMBERS[0][0], NUMBERS[0][1])
    for least, name in NUMBERS[1:]:
        out = out.when(n >= least, name)
    return out.when(n.isNotNull(), "info").otherwise("unknown")


def from_text_or_number(value: Column) -> Column:
    """Severity of a word or of a number in text; anything else is unknown."""
    text = F.lower(F.trim(value.cast("string")))
    number = text.try_cast("double")
    out = F.when(number.isNotNull() & ~F.isnan(number), from_number(number))
    for name, words in WORDS.items():
        out = out.when(text.isin(*words), name)
    return out.otherwise("unknown")


def whole(value: Column) -> Column:
    """Text of a number as a whole one (fractions dropped), else null."""
    text = F.trim(value.cast("string"))
    return F.coalesce(text.try_cast("bigint"), F.when(text.rlike(r"^[+-]?\d+\.\d*$"), text.try_cast("double").cast("bigint")))


def from_wazuh_level(value: Column) -> Column:
    """Severity of a rule level; text that is no number is read as a word."""
    n = whole(value)
    return F.when(n <= 2, "info").when(n <= 5, "low").when(n <= 8, "medium").when(n <= 11, "high").when(n.isNotNull(), "critical").otherwise(from_text_or_number(value))


def from_inverted(value: Column) -> Column:
    """Severity where 1 is the worst; text that is no number is read as a word."""
    n = whole(value)
    return F.when(n <= 1, "high").when(n == 2, "medium").when(n == 3, "low").when(n.isNotNull(), "info").otherwise(from_text_or_number(value))


def from_pf_action(action: Column) -> Column:
    """Low for a blocked packet, info for any other."""
    return F.when(F.lower(F.trim(action)) == "block", "low").otherwise("info")
