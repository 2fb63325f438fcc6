"""Questions to a table of texts: its columns, filtered rows, aggregates.

Fields are strings, whose numbers are what ``as_number`` takes, or typed columns: comparisons with
numeric ones are plain, so that filters reach the scan, and aggregates read no texts. Rows have a place in the table where
first rows are asked for, given as a column to order by.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dagframe.functions.numeric import NUMBER, as_number, finite, ordered

OPERATORS = ("eq", "contains", "gt", "lt", "gte", "lte")
OPERATIONS = ("sum", "avg", "min", "max", "count")
LIMIT = 20


def as_texts(df: DataFrame) -> DataFrame:
    """Every column as a string, nulls empty, as a text file has them."""
    return df.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def row_json(columns: list[str]) -> Column:
    """A row as JSON text with sorted names."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def list_columns(df: DataFrame, order: str, sample: int = 3) -> DataFrame:
    """One row: columns (array), sample_rows (JSON texts of the first rows) and row_count."""
    first = df.orderBy(order).limit(sample).select(F.col(order).alias("_at"), row_json(df.columns).alias("_row"))
    shown = first.agg(F.array_sort(F.collect_list(F.struct("_at", "_row"))).alias("r")).select(F.transform("r", lambda x: x["_row"]).alias("sample_rows"))
    names = F.array(*[F.lit(c) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("row_count")).crossJoin(shown).select(names.alias("columns"), "sample_rows", "row_count")  # one row each


def _typed(df: DataFrame | None, column: str) -> bool:
    return df is not None and isinstance(df.schema[column].dataType, T.NumericType)


def matches(column: str, operator: str, value, df: DataFrame | None = None) -> Column:
    """Whether a field answers to an operator; numbers as values are compared by their text for eq and contains. df tells a typed column from a text."""
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator: {operator}")
    text = value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)
    field = F.col(column)
    if _typed(df, column) and operator in ("gt", "lt", "gte", "lte"):
        limit = float(text) if re.fullmatch(NUMBER.strip("^$"), text) else float("nan")
        if limit != limit:
            return F.lit(False)
        test = {"gt": field > limit, "lt": field < limit, "gte": field >= limit, "lte": field <= limit}[operator]
        if operator in ("gt", "gte") and isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
            test = test & ~F.isnan(field)  # NaN is above all to Spark
        return test
    if _typed(df, column):
        field = F.coalesce(field.cast("string"), F.lit(""))
    if operator == "eq":
        return field == text
    if operator == "contains":
        return F.lower(field).contains(text.lower())
    a, b = ordered(as_number(field)), ordered(as_number(F.lit(text)))
    test = {"gt": a > b, "lt": a < b, "gte": a >= b, "lte": a <= b}[operator]
    return F.coalesce(test, F.lit(False))


def query(df: DataFrame, column: str, value, operator: str = "eq", limit: int | None = LIMIT, order: str | None = None) -> DataFrame:
    """Matching rows; with a limit the first ones by order, and one even if the limit is 0. Without a limit all of them."""
    if column not in df.columns:
        raise ValueError(f"column {column!r} not found")
    found = df.where(matches(column, operator, value, df))
    if limit is None:
        return found
    return (found.orderBy(order) if order else found).limit(max(limit, 1))


def query_report(df: DataFrame, column: str, value, operator: str = "eq", limit: int = LIMIT, order: str | None = None) -> DataFrame:
    """One row: count of the rows returned and matches, their JSON texts in order."""
    at = order or column
    rows = query(df, column, value, operator, limit, order).select(F.col(at).alias("_at"), row_json(df.columns).alias("_row"))
    return rows.agg(F.count(F.lit(1)).alias("count"), F.transform(F.array_sort(F.collect_list(F.struct("_at", "_row"))), lambda x: x["_row"]).alias("matches"))


def aggregate(df: DataFrame, column: str, operation: str, group_by: str | None = None) -> DataFrame:
    """sum, avg, min, max over the fields that are numbers, or count of the rows; result is null where there are none.

    An unknown operation fails when it is read, unless there is nothing to aggregate, which gives null.
    With group_by, groups without a number are absent (count has all). The order of addition is
    Spark's, so the last digits of a sum may differ from those of a sequential one.
    """
    for c in (column, group_by):
        if c is not None and c not in df.columns:
            raise ValueError(f"column {c!r} not found")
    n = F.col(column).cast("double") if _typed(df, column) else as_number(F.col(column))
    if operation not in OPERATIONS:
        wrong = F.when(F.count(n) > 0, F.raise_error(f"unknown aggregate operation: {operation}").cast("double"))
        return df.groupBy(*([group_by] if group_by else [])).agg(wrong.alias("result"))
    known = F.count(F.lit(1) if operation == "count" else n)
    result = {"sum": F.sum(n), "avg": F.avg(n), "min": F.coalesce(F.min(ordered(n)), F.lit(float("inf"))), "max": F.coalesce(F.max(ordered(n)), F.lit(float("-inf"))), "count": F.count(F.lit(1)).cast("double")}[operation]
    grouped = df.groupBy(*([group_by] if group_by else [])).agg(known.alias("_known"), result.alias("result"))
    value = F.when(F.col("_known") > 0, finite(F.col("result"))).alias("result")
    return grouped.where("_known > 0").select(group_by, value) if group_by else grouped.select(value)
