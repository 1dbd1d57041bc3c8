"""Filter trees compiled to two Columns: whether a row matches, and its score.

Operators, coercions and array handling are resolved from the schema when the plan
is built, so a filter on a typed column stays a plain predicate that reaches the
Parquet scan. Missing values fail every operator, also the negated ones (nulls count
as missing); the match of a row that fails may be null instead of false.
"""

from __future__ import annotations

import logging
from datetime import UTC
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.coerce import RFC3339, literal_number, literal_time, to_number, to_time

log = logging.getLogger(__name__)
OPERATORS = ("_exact", "_ne", "_gt", "_gte", "_lt", "_lte", "_contains", "_ncontains", "_contains_any_of")


def compile_filters(df: DataFrame, tree: dict[str, Any] | None, filterable: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """(matches, score) of a filter tree {operator, filters, groups}."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return _group(kinds, tree or {}, filterable)


def _group(kinds: dict[str, T.DataType], tree: dict[str, Any], filterable: tuple[str, ...]) -> tuple[Column, Column]:
    parts = [_condition(kinds, c, filterable) for c in tree.get("filters") or ()]
    parts += [_group(kinds, g, filterable) for g in tree.get("groups") or ()]
    if not parts:
        return F.lit(True), F.lit(0.0)
    operator = str(tree.get("operator") or "OR").upper()
    if operator == "AND":
        matches = reduce(lambda a, b: a & b, (m for m, _ in parts))
        total = reduce(lambda a, b: a + b, (s for _, s in parts))
        return matches, F.when(matches, total).otherwise(0.0)
    if operator != "OR":
        log.warning("unknown group operator %s, taken as OR", operator)
    matches = reduce(lambda a, b: a | b, (m for m, _ in parts))
    return matches, reduce(lambda a, b: a + b, (F.when(m, s).otherwise(0.0) for m, s in parts))


def _condition(kinds: dict[str, T.DataType], c: dict[str, Any], filterable: tuple[str, ...]) -> tuple[Column, Column]:
    name, operator, value = c["field"], c.get("operator") or "", c.get("value")
    if name not in filterable:
        log.warning("field %s is not declared filterable", name)
    score = F.lit(float(c.get("score") or 0.0))
    if name not in kinds:
        return F.lit(False), F.lit(0.0)
    kind, col = kinds[name], F.col(f"`{name}`")
    if operator == "":
        operator = "_contains" if isinstance(kind, T.ArrayType) else "_exact"
    if operator not in OPERATORS:
        log.warning("unknown operator %s, taken as equality", operator)
        operator = "_exact"
    negated = operator in ("_ne", "_ncontains")
    operator = {"_ne": "_exact", "_ncontains": "_contains"}.get(operator, operator)
    dated = "date" in name.lower() and isinstance(kind, T.StringType)
    if operator == "_contains":
        hit = _contains(col, kind, value, dated)
    elif operator == "_contains_any_of":
        hit = reduce(lambda a, b: a | b, (_any(col, kind, lambda x, k, v=v: _equal(x, k, v, dated)) for v in value), F.lit(False)) if isinstance(value, list | tuple) else F.lit(False)
    elif operator == "_exact":
        hit = _any(col, kind, lambda x, k: _equal(x, k, value, dated))
    else:
        hit = _any(col, kind, lambda x, k: _ordered(x, k, operator, value, dated))
    # a bare predicate reaches the scan; its null counts as false in AND, OR and WHERE
    matches = col.isNotNull() & (~F.coalesce(hit, F.lit(False)) if negated else hit)
    return matches, F.when(matches, score).otherwise(0.0)


def _any(col: Column, kind: T.DataType, test) -> Column:
    """A scalar, or any element of an array."""
    if isinstance(kind, T.ArrayType):
        return F.exists(col, lambda x: F.coalesce(test(x, kind.elementType), F.lit(False)))
    return test(col, kind)


def _contains(col: Column, kind: T.DataType, value: Any, dated: bool) -> Column:
    if not isinstance(value, str):
        return F.lit(False)
    element = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if not isinstance(element, T.StringType):
        return F.lit(False)
    found = _any(col, kind, lambda x, _: F.contains(F.lower(x), F.lit(value.lower())))
    # a date field that holds an instant is no text
    return found & ~col.rlike(RFC3339) if dated else found


def _equal(x: Column, kind: T.DataType, value: Any, dated: bool) -> Column:
    if value is None:
        return F.lit(False)
    if isinstance(kind, T.BooleanType) or isinstance(value, bool):
        return x == F.lit(value) if isinstance(kind, T.BooleanType) and isinstance(value, bool) else F.lit(False)
    if isinstance(kind, T.StringType) and isinstance(value, str):
        plain = x == F.lit(value)
        if dated:
            t = literal_time(value)
            instant = to_time(x, kind) == F.lit(t) if t else F.lit(False)
            return F.when(x.rlike(RFC3339), instant).otherwise(plain)
        return plain
    number, time = literal_number(value), literal_time(value)
    # a numeric column against a number: one comparison, which the scan can use
    if isinstance(kind, T.NumericType) and number is not None:
        return x == F.lit(int(number) if isinstance(kind, T.IntegralType) and number.is_integer() and abs(number) < 2**63 else number)
    tests = []
    if number is not None:
        n = to_number(x, kind)
        tests.append((n.isNotNull(), n == F.lit(number)))
    if time is not None and not isinstance(kind, T.IntegerType | T.ShortType | T.ByteType | T.FloatType):
        t = to_time(x, kind)
        tests.append((t.isNotNull(), t == F.lit(time)))
    return _first(tests)


def _first(tests: list[tuple[Column, Column]]) -> Column:
    """The outcome of the first test that applies; false if none does."""
    out = F.lit(False)
    for applies, outcome in reversed(tests):
        out = F.when(applies, outcome).otherwise(out)
    return out


def _ordered(x: Column, kind: T.DataType, operator: str, value: Any, dated: bool) -> Column:
    def compare(a: Column, b: Column) -> Column:
        return {"_gt": a > b, "_gte": a >= b, "_lt": a < b, "_lte": a <= b}[operator]

    if value is None or isinstance(value, bool):
        return F.lit(False)
    number, time = literal_number(value), literal_time(value)
    if isinstance(kind, T.NumericType) and number is not None:
        return compare(x, F.lit(number)) & ~F.isnan(x.cast("double")) if isinstance(kind, T.FractionalType) else compare(x, F.lit(int(number) if number.is_integer() and abs(number) < 2**63 else number))
    if isinstance(kind, T.TimestampNTZType) and time is not None:  # stored without a zone: UTC
        return compare(x, F.lit(time.astimezone(UTC).replace(tzinfo=None)).cast("timestamp_ntz"))
    if isinstance(kind, T.TimestampType | T.DateType) and time is not None:
        return compare(x.cast("timestamp"), F.lit(time))
    tests = []
    instant = x.rlike(RFC3339) if dated else F.lit(False)
    if number is not None:
        n = to_number(x, kind)
        tests.append((n.isNotNull() & ~instant, compare(n, F.lit(number))))
    if time is not None and not isinstance(kind, T.IntegerType | T.ShortType | T.ByteType | T.FloatType):
        t = to_time(x, kind)
        tests.append((t.isNotNull(), compare(t, F.lit(time))))
    if isinstance(kind, T.StringType) and isinstance(value, str):
        tests.append((~instant, compare(x, F.lit(value))))
    return _first(tests)
