"""The JSON transforms that flows use, as Columns over VARIANT; each is the transform in its comment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dagframe.functions import variants


def identity(v: Column) -> Column:
    """``.``"""
    return v


def path(v: Column, dotted: str) -> Column:
    """``.a.b``; missing is null."""
    return variants.field(v, dotted)


def items(v: Column, dotted: str = "") -> Column:
    """``.a[]`` as an array."""
    return variants.as_array(variants.field(v, dotted) if dotted else v)


def map_product(values: Column, first: str, second: str) -> Column:
    """``[.[] | .first * .second]`` as array<double>."""
    return F.transform(values, lambda x: variants.as_double(variants.field(x, first)) * variants.as_double(variants.field(x, second)))


def select(values: Column, dotted: str) -> Column:
    """``[.[] | select(.field)]``: what is neither null nor false passes (0 and "" do)."""

    def passes(x: Column) -> Column:
        v = variants.field(x, dotted)
        k = variants.kind(v)
        return F.when(k == "null", False).when(k == "bool", F.try_variant_get(v, "$", "boolean")).otherwise(True)

    return F.filter(values, passes)


def add(numbers: Column) -> Column:
    """``add`` of numbers; null for none."""
    return F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))))


def totals(numbers: Column) -> Column:
    """``{total: add, count: length}`` as a struct."""
    return F.struct(add(numbers).alias("total"), F.size(numbers).alias("count"))


def to_string(v: Column) -> Column:
    """``tostring``: strings stay, whole numbers have no point, all else is its JSON text."""
    n = variants.as_double(v)
    whole = F.when((n == F.floor(n)) & (F.abs(n) < 1e17), n.cast("decimal(20,0)").cast("string"))
    return F.coalesce(variants.as_string(v), whole, F.to_json(v), F.lit("null"))


def if_else(test: Column, then: Column, other: Column) -> Column:
    """``if test then a else b end`` on a boolean column; null is false."""
    return F.when(F.coalesce(test, F.lit(False)), then).otherwise(other)


def build(**fields: Column) -> Column:
    """``{a: .., b: ..}`` as JSON text with sorted names; nulls are kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
