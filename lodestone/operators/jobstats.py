"""Job history metrics as aggregates.

History: id, type, status, index_name, error, created_at, started_at, completed_at.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

JOB_SCHEMA = "id string, type string, status string, index_name string, error string, current long, total long, message string, created_at timestamp, started_at timestamp, completed_at timestamp"
FINISHED = ("completed", "failed", "cancelled")
KEPT_DURATIONS = 100


def select_jobs(jobs: DataFrame, index_name: str, status: str | None = None) -> DataFrame:
    """J3."""
    found = jobs.where(F.col("index_name") == index_name)
    return found.where(F.col("status") == status) if status else found


def retained(jobs: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    """Finished jobs older than ``hours`` go."""
    return jobs.where(~F.col("status").isin(*FINISHED) | F.col("completed_at").isNull() | (F.col("completed_at") >= F.lit(now - timedelta(hours=hours))))


def metrics(jobs: DataFrame) -> DataFrame:
    """One row of totals."""
    seconds = F.when(F.col("status") == "completed", (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1e6)
    done, failed = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "failed")
    return jobs.agg(
        F.count(F.lit(1)).alias("created"), done.alias("completed"), failed.alias("failed"), F.coalesce(F.sum(seconds), F.lit(0.0)).alias("total_seconds"), F.coalesce(F.avg(seconds), F.lit(0.0)).alias("average_seconds"),
        F.when(done + failed == 0, 1.0).otherwise(done / (done + failed)).alias("success_rate"), F.count_if(F.col("status").isin("pending", "running")).alias("workload"),
    )


def average_by_type(jobs: DataFrame, kept: int = KEPT_DURATIONS) -> DataFrame:
    """Mean duration of the last ``kept`` completed jobs of each type. The rank
    limit keeps each task's candidates to ``kept`` rows a type."""
    done = jobs.where("status = 'completed'")
    place = F.row_number().over(Window.partitionBy("type").orderBy(F.col("completed_at").desc(), "id"))
    seconds = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1e6
    return done.withColumn("place", place).where(F.col("place") <= kept).groupBy("type").agg(F.avg(seconds).alias("average_seconds"), F.count(F.lit(1)).alias("jobs"))


def counts(jobs: DataFrame, by: str) -> DataFrame:
    """Jobs by ``type`` or ``status``."""
    return jobs.groupBy(by).agg(F.count(F.lit(1)).alias("jobs"))
