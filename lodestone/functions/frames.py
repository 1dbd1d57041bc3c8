"""Small frames and predicates made from values that the driver holds."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows as a local relation, whose size the planner knows."""
    fields = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow), fields)


def any_equal(column: str, values: list) -> Column:
    """``column`` is one of ``values``, as equalities: each of them is matched with the
    row groups' statistics, where a long IN list is matched by its bounds only. The
    tree is balanced, so that its depth stays small."""
    if not values:
        return F.lit(False)
    terms = [F.col(column) == v for v in values]
    while len(terms) > 1:
        terms = [reduce(lambda a, b: a | b, terms[i : i + 2]) for i in range(0, len(terms), 2)]
    return terms[0]
