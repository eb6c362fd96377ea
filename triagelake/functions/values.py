"""Comparing extracted values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The units that carry no difference between two answers.
MERGE_UNITS = r"\s*(years?|yrs?|y\.?o\.?|months?|weeks?|days?|kg|kgs|lb|lbs|mg|ml)\b\.?"
SCORE_UNITS = r"\b(years?|yrs?|y\.?o\.?|months?|weeks?|days?|kg|lb|mg|ml)\b\.?"
#: Words that don't tell two renderings of a fact apart.
STOP_WORDS = ("a", "an", "the", "of", "with", "and", "or", "in", "on", "at", "to", "for", "patient", "reported", "stage", "no", "not", "was", "is", "has", "had")
OVERLAP = 0.67


def _folded(value: Column, units: str) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), units, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def merge_value(value: Column) -> Column:
    """The value as merging compares it; units go even inside words."""
    return _folded(value, MERGE_UNITS)


def score_value(value: Column) -> Column:
    """The value as scoring compares it; units go as whole words only."""
    return _folded(value, SCORE_UNITS)


def within(a: Column, b: Column) -> Column:
    """Whether the shorter value is a run of whole words of the longer."""
    padded = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return F.contains(padded(a), padded(b)) | F.contains(padded(b), padded(a))


def agree(left: Column, right: Column) -> Column:
    """Two folded values agree if either is empty or one is within the other."""
    return (left == "") | (right == "") | within(left, right)


def match(expected: Column, got: Column) -> Column:
    """Strict: an empty value matches an empty one only."""
    a, b = score_value(expected), score_value(got)
    return F.when((a == "") & (b == ""), True).when((a == "") | (b == ""), False).otherwise(within(a, b))


def match_loosely(expected: Column, got: Column) -> Column:
    """Two thirds of the content words of the side with fewer are shared, in any order."""

    def words(x: Column) -> Column:
        return F.array_except(F.array_distinct(F.split(score_value(x), " ")), F.array(F.lit(""), *map(F.lit, STOP_WORDS)))

    a, b = words(expected), words(got)
    least = F.least(F.size(a), F.size(b))
    return match(expected, got) | F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), least.cast("double")) >= OVERLAP, F.lit(False))
