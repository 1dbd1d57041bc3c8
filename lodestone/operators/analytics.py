"""Search analytics over an event table.

Events: index_name, query, search_type, response_time (ns), result_count, timestamp.
"Now" is always an argument. The dashboard needs two passes over the events (one
row of conditional aggregates, one small grouped table) whatever their number.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT_SCHEMA = "index_name string, query string, search_type string, response_time long, result_count int, timestamp timestamp"
SEARCH_TYPES = ("exact_match", "wildcard", "fuzzy_search", "filtered")
RETAINED_EVENTS = 10_000
# Upper bounds of the response-time classes, in milliseconds.
BUCKETS = ((25, "0-25ms"), (50, "25-50ms"), (100, "50-100ms"), (None, "100ms+"))


def after(events: DataFrame, start: datetime | Column) -> DataFrame:
    """A2: later than ``start``."""
    return events.where(F.col("timestamp") > (start if isinstance(start, Column) else F.lit(start)))


def between(events: DataFrame, start: datetime | Column, end: datetime | Column) -> DataFrame:
    """A3: between, both ends excluded."""
    return after(events, start).where(F.col("timestamp") < (end if isinstance(end, Column) else F.lit(end)))


def retained(events: DataFrame, most: int = RETAINED_EVENTS) -> DataFrame:
    """A1: the latest ``most`` events (a top-k, not a sort of the table)."""
    return events.orderBy(F.col("timestamp").desc(), "index_name", "query").limit(most)


def average_ms(when: Column | None = None) -> Column:
    """Integer mean of nanoseconds, truncated to milliseconds; 0 without events."""
    value = F.col("response_time") if when is None else F.when(when, F.col("response_time"))
    total, n = F.sum(value), F.count(value)
    return F.coalesce(F.call_function("div", F.call_function("div", total, F.nullif(n, F.lit(0))), F.lit(1_000_000)), F.lit(0)).cast("long")


def change_percent(current: Column, previous: Column) -> Column:
    """A5."""
    return F.when(previous == 0, F.when(current > 0, 100.0).otherwise(0.0)).otherwise((current - previous) / previous * 100.0)


def trend(current: Column, previous: Column) -> Column:
    """Relative change beyond a tenth."""
    change = F.when(previous != 0, (current - previous) / previous)
    return F.when(change > 0.1, "up").when(change < -0.1, "down").otherwise("stable")


def bucket(response_time: Column) -> Column:
    """Class of a response time."""
    ms = F.call_function("div", response_time, F.lit(1_000_000))
    out = F.lit(BUCKETS[-1][1])
    for most, name in reversed(BUCKETS[:-1]):
        out = F.when(ms <= most, name).otherwise(out)
    return out


def hourly(events: DataFrame) -> DataFrame:
    """24 rows (hour, searches, avg_ms), zero-filled."""
    hours = events.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    counts = events.groupBy(F.hour("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("n"), average_ms().alias("ms"))
    return hours.join(F.broadcast(counts), "hour", "left").select("hour", F.coalesce("n", F.lit(0)).cast("long").alias("searches"), F.coalesce("ms", F.lit(0)).cast("long").alias("avg_ms"))


def popular(events: DataFrame, most: int = 5) -> DataFrame:
    """A10: most frequent non-empty queries, ties by name."""
    counts = events.where("query != ''").groupBy("query").agg(F.count(F.lit(1)).alias("searches"))
    return counts.orderBy(F.desc("searches"), "query").limit(most).withColumn("trend", F.lit("stable"))


def index_usage(events: DataFrame, indexes: DataFrame) -> DataFrame:
    """Indexes (index_name, documents) with their searches and size."""
    counts = events.groupBy("index_name").agg(F.count(F.lit(1)).alias("n"))
    return indexes.join(counts, "index_name", "left").select("index_name", F.coalesce("n", F.lit(0)).cast("long").alias("searches"), "documents", (F.col("documents") * 0.001).alias("size_mb"))


def distribution(events: DataFrame) -> DataFrame:
    """Every class with its count and share; zeros without events."""
    spark = events.sparkSession
    names = spark.createDataFrame([(name,) for _, name in BUCKETS], "bucket string")
    counts = events.groupBy(bucket(F.col("response_time")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    total = events.agg(F.count(F.lit(1)).alias("total"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return names.join(F.broadcast(counts), "bucket", "left").crossJoin(F.broadcast(total)).select("bucket", n.alias("searches"), F.when(F.col("total") > 0, n * 100.0 / F.col("total")).otherwise(0.0).alias("percent"))


def type_counts(events: DataFrame) -> DataFrame:
    """One row, a column per search type; others are not counted."""
    return events.agg(*(F.count_if(F.col("search_type") == t).alias(t) for t in SEARCH_TYPES))


def summary(events: DataFrame, now: datetime) -> DataFrame:
    """The last 24 hours against the week from two weeks to one week ago, in
    one conditional aggregate."""
    day = F.col("timestamp") > F.lit(now - timedelta(days=1))
    old = (F.col("timestamp") > F.lit(now - timedelta(days=14))) & (F.col("timestamp") < F.lit(now - timedelta(days=7)))
    base = events.agg(F.count_if(day).alias("total_searches"), F.count_if(old).alias("before"), average_ms(day).alias("avg_response_ms"), average_ms(old).alias("before_ms"))
    return base.select("total_searches", change_percent(F.col("total_searches"), F.col("before")).alias("searches_change"), "avg_response_ms", trend(F.col("avg_response_ms"), F.col("before_ms")).alias("response_trend"))


def dashboard(events: DataFrame, indexes: DataFrame, now: datetime) -> dict:
    """All metrics. Metrics without a source (CPU, disk, growth of documents and
    indexes: A14, A15) are None."""
    recent = events.where(F.col("timestamp") > F.lit(now - timedelta(days=14)))
    recent.persist()
    try:
        day, week = after(recent, now - timedelta(days=1)), after(recent, now - timedelta(days=7))
        out = summary(recent, now).first().asDict()
        counts = indexes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents")).first()
        out |= {"active_indexes": counts["n"], "total_documents": counts["documents"], "documents_change": None, "indexes_change": None}
        out["hourly"] = [r.asDict() for r in hourly(day).orderBy("hour").collect()]
        out["popular_searches"] = [r.asDict() for r in popular(week).collect()]
        out["index_usage"] = [r.asDict() for r in index_usage(week, indexes).orderBy("index_name").collect()]
        out["response_times"] = [r.asDict() for r in distribution(day).collect()]
        out["search_types"] = type_counts(day).first().asDict()
        out["system_health"] = system_health(events.sparkSession)
        return out
    finally:
        recent.unpersist()


def system_health(spark) -> dict:
    """JVM memory in percent; what Spark does not know is None."""
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    used = runtime.totalMemory() - runtime.freeMemory()
    return {"memory": round(100.0 * used / runtime.maxMemory(), 1), "cpu": None, "disk": None, "index_health": None}
