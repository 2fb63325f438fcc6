"""Typed access to VARIANT values; a missing field and a JSON null are the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    """VARIANT of a JSON text; null where it isn't JSON."""
    return F.try_parse_json(text)


def path_of(dotted: str) -> str:
    """``a.b`` as a VARIANT path, names quoted."""
    return "$" + "".join(f"['{part}']" for part in dotted.split(".")) if dotted else "$"


def field(v: Column, dotted: str) -> Column:
    """The value at a dotted path as VARIANT, or null."""
    return F.try_variant_get(v, path_of(dotted), "variant")


def _base(v: Column) -> Column:
    """The type's name without parameters: STRING, DECIMAL, OBJECT and the like."""
    return F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)


def kind(v: Column) -> Column:
    """``null``, ``num``, ``str``, ``bool``, ``array`` or ``object``; never SQL null."""
    names = {"VOID": "null", "ARRAY": "array", "OBJECT": "object", "STRING": "str", "BOOLEAN": "bool"} | dict.fromkeys(NUMBERS, "num")
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.when(v.isNull(), "null").otherwise(F.coalesce(F.try_element_at(known, _base(v)), F.lit("num")))


def _is(v: Column, *types: str) -> Column:
    return F.coalesce(_base(v).isin(*types), F.lit(False))


NUMBERS = ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")


def as_string(v: Column) -> Column:
    """The string, or null for any other type."""
    return F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))


def as_double(v: Column) -> Column:
    return F.when(_is(v, *NUMBERS), F.try_variant_get(v, "$", "double"))


def as_count(v: Column) -> Column:
    """A whole number of 0 or more, or null."""
    n = F.when(_is(v, "BIGINT"), F.try_variant_get(v, "$", "bigint"))
    return F.when(n >= 0, n)


def as_array(v: Column) -> Column:
    """ARRAY<VARIANT>, or null for what is no array."""
    return F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def text_at(v: Column, dotted: str) -> Column:
    return as_string(field(v, dotted))


def json_at(v: Column, dotted: str, default: str = "null") -> Column:
    """JSON text of the value at a path."""
    return F.coalesce(F.to_json(field(v, dotted)), F.lit(default))


def truthy(v: Column) -> Column:
    """False for null, 0, "" and false; arrays and objects are true even when empty."""
    k = kind(v)
    return (
        F.when(k == "null", False)
        .when(k == "num", F.try_variant_get(v, "$", "double") != 0)
        .when(k == "str", F.try_variant_get(v, "$", "string") != "")
        .when(k == "bool", F.try_variant_get(v, "$", "boolean"))
        .otherwise(True)
    )
