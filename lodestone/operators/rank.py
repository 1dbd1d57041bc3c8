"""Ranking, distinct, paging and projection (Q19-Q22, M8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.index import ID
from lodestone.settings import FILTERS_FIELD, SCORE_FIELD, RankingCriterion
from lodestone.sources.files import scratch_folder


def ranking_keys(df: DataFrame, criteria: tuple[RankingCriterion, ...]) -> list[Column]:
    """Q20: sort keys, then score and identifier. Missing values come first
    ascending and last descending; booleans, arrays and objects do not rank."""
    out: list[Column] = []
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for c in criteria:
        if c.field in (SCORE_FIELD, FILTERS_FIELD):
            key = F.col("score" if c.field == SCORE_FIELD else "filter_score")
        elif isinstance(kinds.get(c.field), T.NumericType | T.StringType | T.TimestampType | T.TimestampNTZType | T.DateType):
            key = F.col(f"`{c.field}`")
        else:
            continue
        out.append(key.asc_nulls_first() if c.order == "asc" else key.desc_nulls_last())
    return [*out, F.col("score").desc(), F.col(ID).asc()]


def text_key(df: DataFrame, field: str) -> Column:
    """A value's text form: integral numbers without a fraction."""
    kind = df.schema[field].dataType
    c = F.col(f"`{field}`")
    if isinstance(kind, T.FractionalType):
        return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    if isinstance(kind, T.StringType):
        return c
    return F.to_json(c) if isinstance(kind, T.ArrayType | T.MapType | T.StructType) else c.cast("string")


def distinct_first(hits: DataFrame, field: str, keys: list[Column], by: tuple[str, ...] = ("qk",)) -> DataFrame:
    """Q21: the first hit of each value in ranking order; hits without it all stay.
    The rank limit runs before the shuffle too."""
    if field not in hits.columns:
        return hits
    missing = F.col(f"`{field}`").isNull()
    key = F.when(missing, F.concat(F.lit("id:"), F.col(ID).cast("string"))).otherwise(F.concat(F.lit("v:"), text_key(hits, field)))
    place = F.row_number().over(Window.partitionBy(*by, "_key").orderBy(*keys))
    return hits.withColumn("_key", key).withColumn("_place", place).where("_place = 1").drop("_key", "_place")


def page_of(hits: DataFrame, keys: list[Column], page: int, size: int, by: tuple[str, ...] = ("qk",)) -> DataFrame:
    """Q22: one page of every query, with ``rank`` from 1. Filtering on the rank lets
    each task keep its best page * size rows only."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*keys))
    return hits.withColumn("rank", rank).where((F.col("rank") <= page * size) & (F.col("rank") > (page - 1) * size))


def rank_all(hits: DataFrame, keys: list[Column], by: tuple[str, ...] = ("qk",)) -> DataFrame:
    """Every hit with ``rank`` from 1 and ``total``. Hits are dealt out in ranking order
    and written once, numbered within their part; what earlier parts hold comes on top. A
    part meets few queries besides its own, so there are at most as many offsets as parts
    and queries."""
    order = [F.col(c).asc() for c in by] + keys
    placed = hits.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    path = scratch_folder(hits.sparkSession, "ranks")
    placed.write.parquet(path)
    held = hits.sparkSession.read.schema(placed.schema).parquet(path).withColumn("_part", F.shiftright("_at", 33))
    parts = held.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    every = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select(*by, "_part", (before - F.col("_first") + 1).alias("_offset"), F.sum("_n").over(every).alias("total"))
    ranked = held.join(F.broadcast(offsets), [*by, "_part"])
    return ranked.withColumn("rank", F.col("_at") + F.col("_offset")).drop("_at", "_part", "_offset")


def project(df: DataFrame, fields: tuple[str, ...], always: tuple[str, ...] = (ID,)) -> DataFrame:
    """Q19: the listed fields that exist, and the identifier; all if none is listed."""
    if not fields:
        return df
    return df.select(*[c for c in df.columns if c in always or c in fields])
