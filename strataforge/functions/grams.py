"""Trigrams of names as native expressions. Lengths are in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE = 3


def gram_count(name: Column) -> Column:
    """How many grams a name gives: none if empty, one if shorter than a gram, else one a window."""
    n = F.length(name)
    return F.when(n == 0, 0).when(n < SIZE, 1).otherwise(n - (SIZE - 1))


def grams(name: Column) -> Column:
    """The grams of a name in order, repeats included, lower-cased; a null name has none."""
    low = F.lower(name)
    windows = F.transform(F.sequence(F.lit(1), F.length(low) - (SIZE - 1)), lambda i: F.substring(low, i, F.lit(SIZE)))
    return F.when(F.length(low) >= SIZE, windows).when(F.length(low) > 0, F.array(low)).otherwise(F.array().cast("array<string>"))
