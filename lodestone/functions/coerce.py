"""Coercions of dynamically typed values."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"
NAIVE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}([.,]\d+)?)?$"


def to_number(c: Column, kind: T.DataType) -> Column:
    """numbers of any width and strings that spell one; null otherwise. NaN is
    null, as it equals and orders with nothing."""
    if isinstance(kind, T.NumericType):
        x = c.cast("double")
    elif isinstance(kind, T.StringType):
        x = F.when(c.rlike(NUMBER), F.regexp_replace(c, "(?i)^([+-]?)inf$", "$1Infinity").try_cast("double"))
    else:
        return F.lit(None).cast("double")
    return F.when(~F.isnan(x), x)


def to_time(c: Column, kind: T.DataType) -> Column:
    """timestamps, the five accepted string formats (naive ones are UTC), and
    64-bit numbers as Unix seconds; null otherwise."""
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return c.cast("timestamp")
    if isinstance(kind, T.StringType):
        return F.when(c.rlike(RFC3339) | c.rlike(NAIVE), F.regexp_replace(c, ",", ".").try_cast("timestamp"))
    if isinstance(kind, T.LongType | T.DoubleType):
        return F.timestamp_seconds(F.when(F.abs(c) < 1e12, c.cast("long")))
    return F.lit(None).cast("timestamp")


def literal_number(v: object) -> float | None:
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, int | float):
        return float(v) if float(v) == float(v) else None
    if isinstance(v, str) and re.match(NUMBER, v):
        x = float(v)
        return x if x == x else None
    return None


def literal_time(v: object) -> datetime | None:
    if isinstance(v, datetime):
        return v if v.tzinfo else v.replace(tzinfo=UTC)
    if isinstance(v, str) and (re.match(RFC3339, v) or re.match(NAIVE, v)):
        try:
            t = datetime.fromisoformat(re.sub(r"([.,]\d{6})\d+", r"\1", v).replace(",", "."))
        except ValueError:
            return None
        return t if t.tzinfo else t.replace(tzinfo=UTC)
    if isinstance(v, float):
        return datetime.fromtimestamp(int(v), UTC) if abs(v) < 2e11 else None
    return None
