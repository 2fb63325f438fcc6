"""Edge conditions as Columns: ``status == 'ok' && score >= 3`` over a VARIANT.

Values are compared by type. Null equals null only; other types never mix, so that a comparison
of unlike types is false whatever the operator, ``!=`` included. Numbers are equal within one
machine epsilon. ``!`` applies to the comparison behind it, ``&&`` binds more than ``||``, and
both sides are plain booleans, so SQL's third truth value never shows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dagframe.functions import variants

EPSILON = 2.220446049250313e-16
TOKEN = re.compile(r"""\s*(?:(?P<op>==|!=|>=|<=|&&|\|\||[<>!])|(?P<num>-?(?:\d+\.?\d*|\.\d+)(?![\d.]))|(?P<str>'[^']*'|"[^"]*")|(?P<name>[A-Za-z_][A-Za-z0-9_.]*))""")
WORDS = {"true": True, "false": False, "null": None}


@dataclass(frozen=True)
class Operand:
    """One side of a comparison: its type name and its value as each type (null where it is another)."""

    kind: Column
    num: Column
    text: Column
    flag: Column
    truth: Column


def _literal(value) -> Operand:
    none = F.lit(None)
    name = "null" if value is None else "bool" if isinstance(value, bool) else "str" if isinstance(value, str) else "num"
    return Operand(
        F.lit(name),
        F.lit(float(value)) if name == "num" else none.cast("double"),
        F.lit(value) if name == "str" else none.cast("string"),
        F.lit(value) if name == "bool" else none.cast("boolean"),
        F.lit(bool(value)),
    )


def _operands(data: Column, needs: dict[str, set[str]]) -> Column:
    """What a condition asks of its paths, each looked up once: struct of the type name and of the values of the types asked for."""
    fields = []
    for i, (path, types) in enumerate(needs.items()):
        fields.append(variants.kind(variants.field(data, path)).alias(f"k{i}"))
        fields += [F.try_variant_get(data, variants.path_of(path), {"num": "double", "str": "string", "bool": "boolean"}[t]).alias(f"{t}{i}") for t in sorted(types)]
    return F.struct(*fields)


def _bound(row: Column, i: int, types: set[str]) -> Operand:
    kind = row[f"k{i}"]
    num, text, flag = (F.when(kind == t, row[f"{t}{i}"]) if t in types else F.lit(None).cast(c) for t, c in (("num", "double"), ("str", "string"), ("bool", "boolean")))
    truth = F.when(kind == "null", False).when(kind == "num", num != 0).when(kind == "str", text != "").when(kind == "bool", flag).otherwise(True)
    return Operand(kind, num, text, flag, truth)


def compare(a: Operand, op: str, b: Operand) -> Column:
    """Boolean, never null."""
    close = F.abs(a.num - b.num) < EPSILON
    numbers = {"==": close, "!=": ~close, ">": a.num > b.num, "<": a.num < b.num, ">=": (a.num > b.num) | close, "<=": (a.num < b.num) | close}[op]
    texts = {"==": a.text == b.text, "!=": a.text != b.text, ">": a.text > b.text, "<": a.text < b.text, ">=": a.text >= b.text, "<=": a.text <= b.text}[op]
    flags = {"==": a.flag == b.flag, "!=": a.flag != b.flag}.get(op, F.lit(False))
    nulls = {"==": (a.kind == "null") & (b.kind == "null"), "!=": (a.kind == "null") != (b.kind == "null")}.get(op, F.lit(False))
    same = a.kind == b.kind
    return F.coalesce(F.when((a.kind == "null") | (b.kind == "null"), nulls).when(same & (a.kind == "num"), numbers).when(same & (a.kind == "str"), texts).when(same & (a.kind == "bool"), flags), F.lit(False))


def condition(text: str, data: Column) -> Column:
    """A condition over the VARIANT column data; raises ValueError for what is no condition.

    The data and each of its paths are evaluated once a row, however often the condition names
    them, and only as the types that the other sides can have.
    """
    needs: dict[str, set[str]] = {}
    every = {"num", "str", "bool"}

    def note(a, op, b) -> Column:
        for one, other in ((a, b), (b, a)):
            if one[0] == "path":
                kind = every if other[0] == "path" else {"bool"} if isinstance(other[1], bool) else {"str"} if isinstance(other[1], str) else {"num"} if other[1] is not None else set()
                needs[one[1]] = needs.get(one[1], set()) | kind
        return F.lit(True)

    def note_truth(x) -> Column:
        if x[0] == "path":
            needs[x[1]] = every
        return F.lit(True)

    _build(text, lambda name: ("path", name), lambda x: ("value", x), note, note_truth)
    if not needs:
        return _build(text, lambda name: _literal(None), _literal, compare, lambda x: x.truth)
    place = {name: i for i, name in enumerate(needs)}
    rows = F.transform(F.array(data), lambda d: _operands(d, needs))
    return F.exists(rows, lambda row: _build(text, lambda name: _bound(row, place[name], needs[name]), _literal, compare, lambda x: x.truth))


def row_condition(text: str, df: DataFrame) -> Column:
    """The same over the typed columns of df: types are settled here, and plain comparisons reach the scan."""

    def named(name: str) -> Typed:
        at, kind = None, df.schema
        for part in name.split("."):
            hit = next((f for f in kind.fields if f.name == part), None) if isinstance(kind, T.StructType) else None
            if hit is None:
                return Typed("null", F.lit(None))
            at, kind = (F.col(f"`{part}`") if at is None else at[part]), hit.dataType
        group = "num" if isinstance(kind, T.NumericType) else {T.StringType: "str", T.BooleanType: "bool"}.get(type(kind), "other")
        return Typed(group, at, exact=isinstance(kind, T.IntegralType))

    def value(x) -> Typed:
        group = "null" if x is None else "bool" if isinstance(x, bool) else "str" if isinstance(x, str) else "num"
        return Typed(group, F.lit(x), exact=group == "num" and float(x).is_integer(), fixed=True)

    return _build(text, named, value, _compare_typed, _truth_typed)


@dataclass(frozen=True)
class Typed:
    """One side of a comparison whose type is known; null counts as missing."""

    kind: str
    column: Column
    exact: bool = False
    fixed: bool = False


def _compare_typed(a: Typed, op: str, b: Typed) -> Column:
    gone = lambda x: F.lit(x.kind == "null") if x.fixed or x.kind == "null" else x.column.isNull()
    there = lambda x: F.lit(x.kind != "null") if x.fixed or x.kind == "null" else x.column.isNotNull()
    both_gone, one_gone = gone(a) & gone(b), (gone(a) & there(b)) | (there(a) & gone(b))
    if a.kind == b.kind and a.kind in ("num", "str", "bool"):
        x, y = a.column, b.column
        close = x == y if a.kind != "num" or (a.exact and b.exact) else F.abs(x - y) < EPSILON
        test = {"==": close, "!=": ~close, ">": x > y, "<": x < y, ">=": (x > y) | close, "<=": (x < y) | close}[op]
        if a.exact and b.exact:
            test = {">=": x >= y, "<=": x <= y}.get(op, test)
        if a.kind == "bool" and op not in ("==", "!="):
            test = F.lit(False)
        test = there(a) & there(b) & test
    else:
        test = F.lit(False)
    return test | both_gone if op == "==" else test | one_gone if op == "!=" else test


def _truth_typed(x: Typed) -> Column:
    if x.kind == "null":
        return F.lit(False)
    return x.column.isNotNull() & {"num": x.column != 0, "str": x.column != "", "bool": x.column}.get(x.kind, F.lit(True))


def _build(text: str, named: Callable, value: Callable, compared: Callable, truth: Callable) -> Column:
    """One pass over the tokens, with what to make of names, values, comparisons and bare operands."""
    tokens, at = [], 0
    body = text.rstrip()
    while at < len(body):
        m = TOKEN.match(body, at)
        if not m:
            raise ValueError(f"unexpected text at {at} in condition {text!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    if not tokens:
        raise ValueError("empty condition")
    tokens.reverse()

    def next_op(*ops: str) -> str | None:
        return tokens.pop()[1] if tokens and tokens[-1][0] == "op" and tokens[-1][1] in ops else None

    def either() -> Column:
        left = both()
        while next_op("||"):
            left = left | both()
        return left

    def both() -> Column:
        left = negated()
        while next_op("&&"):
            left = left & negated()
        return left

    def negated() -> Column:
        return ~negated() if next_op("!") else comparison()

    def comparison() -> Column:
        left = operand()
        op = next_op("==", "!=", ">", "<", ">=", "<=")
        return compared(left, op, operand()) if op else truth(left)

    def operand():
        group, token = tokens.pop() if tokens else ("op", "the end")
        if group == "num":
            return value(float(token) if "." in token else int(token))
        if group == "str":
            return value(token[1:-1])
        if group == "name":
            return value(WORDS[token]) if token in WORDS else named(token)
        raise ValueError(f"unexpected {token} in condition {text!r}")

    out = either()
    if tokens:
        raise ValueError(f"unexpected {tokens[-1][1]} in condition {text!r}")
    return out


def edge_condition(text: str | None, data: Column) -> Column:
    """As an edge takes it: no condition passes, a faulty one never does."""
    if text is None:
        return F.lit(True)
    try:
        return condition(text, data)
    except ValueError:
        return F.lit(False)
