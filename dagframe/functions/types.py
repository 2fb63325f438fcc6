"""Port types as Spark types."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import types as T

SIMPLE = {"string": T.StringType(), "number": T.DoubleType(), "bool": T.BooleanType(), "binary": T.BinaryType(), "json": T.VariantType(), "any": T.VariantType()}


def port_type(spec: object, custom: Mapping[str, Mapping[str, object]] | None = None) -> T.DataType:
    """The type of a port: a simple name, {"list": inner}, {"map": inner}, or {"custom": name} by its fields in custom."""
    if isinstance(spec, str) and spec in SIMPLE:
        return SIMPLE[spec]
    if isinstance(spec, Mapping) and len(spec) == 1:
        (kind, inner), known = next(iter(spec.items())), custom or {}
        if kind == "list":
            return T.ArrayType(port_type(inner, custom))
        if kind == "map":
            return T.MapType(T.StringType(), port_type(inner, custom))
        if kind == "custom" and inner in known:
            return T.StructType([T.StructField(name, port_type(field, custom)) for name, field in known[inner].items()])
    raise ValueError(f"no port type: {spec!r}")
