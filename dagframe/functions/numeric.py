"""Numbers in text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number: no blanks around it, no type suffix, no hexadecimal form.
NUMBER = r"^[+-]?((?i:inf|infinity|nan)|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)$"


def as_number(text: Column) -> Column:
    """Double of a text that is wholly a number, else null."""
    plain = F.regexp_replace(F.lower(text), "^([+-]?)inf$", "$1infinity")
    return F.when(text.rlike(NUMBER), plain.try_cast("double"))


def ordered(x: Column) -> Column:
    """x, with NaN as null: comparisons with NaN are false and extremes skip it."""
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    """x, with NaN and infinities as null, as JSON has no such numbers."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
