"""Document and event sources, and the JSON sink."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import InvalidInput
from lodestone.operators.analytics import EVENT_SCHEMA


def parse_body(body: str | bytes) -> list[dict[str, Any]]:
    """A request body is one object or an array of objects."""
    try:
        data = json.loads(body)
    except ValueError as e:
        raise InvalidInput(f"invalid JSON: {e}") from e
    rows = data if isinstance(data, list) else [data]
    if not rows or not all(isinstance(r, dict) for r in rows):
        raise InvalidInput("the body must be an object or a non-empty array of objects")
    return rows


def from_records(spark: SparkSession, rows: list[dict[str, Any]]) -> DataFrame:
    """Records of any shape as a DataFrame; the schema is inferred over all of them."""
    lines = [json.dumps(r, ensure_ascii=False, default=str) for r in rows]
    texts = spark.createDataFrame([(x,) for x in lines], "value string")
    schema = texts.select(F.schema_of_json_agg("value")).first()[0] if hasattr(F, "schema_of_json_agg") else spark.read.json(spark.sparkContext.parallelize(lines, 1)).schema.simpleString()
    return texts.select(F.from_json("value", schema).alias("x")).select("x.*")


def read_json(spark: SparkSession, path: str, schema=None, multi_line: bool = True) -> DataFrame:
    """S1 from files: objects or arrays of objects; give a schema in production, as
    inference reads everything once more."""
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_events_json(spark: SparkSession, path: str) -> DataFrame:
    """S10 from a JSON array file."""
    return spark.read.schema(EVENT_SCHEMA).json(path, multiLine=True)


def to_json_lines(df: DataFrame) -> DataFrame:
    """K5: each row as a JSON object."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))
