"""Background jobs on a bounded thread pool."""

from __future__ import annotations

import os
import threading
import uuid
from collections import deque
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from lodestone.errors import JobCancelled, JobNotFound
from lodestone.operators.jobstats import FINISHED, JOB_SCHEMA, KEPT_DURATIONS


def _now() -> datetime:
    return datetime.now(UTC)


@dataclass
class Progress:
    current: int = 0
    total: int = 0
    message: str = ""

    @property
    def percent(self) -> float:
        """M17."""
        return 100.0 * self.current / self.total if self.total else 0.0


@dataclass
class Job:
    id: str
    type: str
    index_name: str
    status: str = "pending"
    progress: Progress = field(default_factory=Progress)
    error: str = ""
    created_at: datetime = field(default_factory=_now)
    started_at: datetime | None = None
    completed_at: datetime | None = None
    metadata: dict[str, str] = field(default_factory=dict)


class JobManager:
    """Each job runs its Spark actions in a thread and a FAIR pool of its own kind, so
    short jobs are not starved by long ones."""

    def __init__(self, workers: int | None = None, keep_hours: int = 24) -> None:
        self.workers = workers or min(16, max(4, 2 * (os.cpu_count() or 2)))
        self.keep = timedelta(hours=keep_hours)
        self._pool = ThreadPoolExecutor(self.workers)
        self._lock = threading.Lock()
        self._jobs: dict[str, Job] = {}
        self._futures: dict[str, Future] = {}
        self._durations: dict[str, deque] = {}
        self._stopped: set[str] = set()
        self._created = self._completed = self._failed = 0

    def create(self, kind: str, index_name: str, metadata: dict[str, str] | None = None) -> str:
        """J1."""
        job = Job(str(uuid.uuid4()), kind, index_name, metadata=metadata or {})
        with self._lock:
            self._sweep()
            self._jobs[job.id] = job
            self._created += 1
        return job.id

    def run(self, job_id: str, work: Callable[[Callable[[int, int, str], None]], None], spark: SparkSession | None = None) -> None:
        """``work`` gets a function that reports progress, and that ends the job
        where it was cancelled. Its Spark jobs form a group, which ``cancel`` stops."""

        def report(current: int, total: int, message: str = "") -> None:
            if job_id in self._stopped:
                raise JobCancelled(job_id)
            self.progress(job_id, current, total, message)

        def body() -> None:
            if spark is not None:
                spark.sparkContext.setLocalProperty("spark.scheduler.pool", self._jobs[job_id].type)
                spark.sparkContext.setJobGroup(job_id, self._jobs[job_id].type, True)
            self._set(job_id, "running")
            try:
                work(report)
            except Exception as e:  # noqa: BLE001
                self._set(job_id, "cancelled" if job_id in self._stopped else "failed", str(e))
            else:
                self._set(job_id, "completed")

        self._futures[job_id] = self._pool.submit(body)

    def cancel(self, job_id: str, spark: SparkSession | None = None) -> None:
        """A job that waits never starts; one that runs ends at its next step, or
        at once where Spark works for it. A write that is not committed leaves no trace."""
        self.get(job_id)
        self._stopped.add(job_id)
        future = self._futures.get(job_id)
        if future is not None and future.cancel():
            self._set(job_id, "cancelled")
        elif spark is not None:
            spark.sparkContext.cancelJobGroup(job_id)

    def _set(self, job_id: str, status: str, error: str = "") -> None:
        """J10."""
        with self._lock:
            job = self._jobs[job_id]
            job.status, job.error = status, error
            if status == "running":
                job.started_at = _now()
            elif status in FINISHED:
                job.completed_at = _now()
                if status == "completed":
                    self._completed += 1
                    started = job.started_at or job.created_at
                    self._durations.setdefault(job.type, deque(maxlen=KEPT_DURATIONS)).append((job.completed_at - started).total_seconds())
                elif status == "failed":
                    self._failed += 1

    def progress(self, job_id: str, current: int, total: int, message: str = "") -> None:
        """J4."""
        with self._lock:
            self._jobs[job_id].progress = Progress(current, total, message)

    def get(self, job_id: str) -> Job:
        """J3."""
        with self._lock:
            if job_id not in self._jobs:
                raise JobNotFound(job_id)
            return replace(self._jobs[job_id])

    def list(self, index_name: str | None = None, status: str | None = None) -> list[Job]:
        """J3."""
        with self._lock:
            return [replace(j) for j in self._jobs.values() if (index_name is None or j.index_name == index_name) and (status is None or j.status == status)]

    def wait(self, job_id: str, timeout: float | None = None) -> Job:
        future = self._futures.get(job_id)
        if future is not None and not future.cancelled():
            future.result(timeout)
        return self.get(job_id)

    def _sweep(self) -> None:
        """J5."""
        limit = _now() - self.keep
        for k in [k for k, j in self._jobs.items() if j.status in FINISHED and j.completed_at and j.completed_at < limit]:
            self._jobs.pop(k)
            self._futures.pop(k, None)
            self._stopped.discard(k)

    def metrics(self) -> dict:
        """J6-J9, J12."""
        with self._lock:
            every = [d for q in self._durations.values() for d in q]
            done = self._completed + self._failed
            return {
                "created": self._created,
                "completed": self._completed,
                "failed": self._failed,
                "by_type": _tally(j.type for j in self._jobs.values()),
                "by_status": _tally(j.status for j in self._jobs.values()),
                "average_seconds": sum(every) / len(every) if every else 0.0,
                "average_by_type": {k: sum(q) / len(q) for k, q in self._durations.items()},
                "success_rate": self._completed / done if done else 1.0,
                "workload": sum(j.status in ("pending", "running") for j in self._jobs.values()),
            }

    def history(self, spark: SparkSession) -> DataFrame:
        rows = [(j.id, j.type, j.status, j.index_name, j.error, j.progress.current, j.progress.total, j.progress.message, j.created_at, j.started_at, j.completed_at) for j in self.list()]
        return spark.createDataFrame(rows, JOB_SCHEMA)

    def stop(self) -> None:
        """Waits for running jobs; those that did not start are cancelled."""
        for k, f in self._futures.items():
            if f.cancel():
                self._set(k, "cancelled")
        self._pool.shutdown(wait=True)


def _tally(values) -> dict[str, int]:
    out: dict[str, int] = {}
    for v in values:
        out[v] = out.get(v, 0) + 1
    return out
