"""Ingest jobs: their states and results, and the log of queries. Driver-side records, no data."""

from __future__ import annotations

import secrets
import threading
import time
from collections import deque
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame

from lexspark.plans.index import Index
from lexspark.sources import store

PENDING, RUNNING, COMPLETED, FAILED = "pending", "running", "completed", "failed"


@dataclass(frozen=True)
class Job:
    job_id: str
    status: str
    source: str
    started_at: float
    result: dict[str, Any] | None = None
    error: str | None = None


@dataclass
class Jobs:
    """Runs ingests in the background, one thread each; Spark schedules their stages side by side."""

    jobs: dict[str, Job] = field(default_factory=dict)
    lock: threading.Lock = field(default_factory=threading.Lock)

    def start(self, corpus: DataFrame, path: str, source: str = "", output: str | None = None, on_complete=None) -> str:
        """Appends ``corpus`` to the index at ``path``; with ``output`` it is also written there as JSON lines."""
        job = Job(secrets.token_hex(8), PENDING, source, time.time())
        self._set(job)

        def run() -> None:
            began = time.time()
            self._set(replace(job, status=RUNNING))
            try:
                if output:
                    corpus.write.mode("overwrite").json(output)
                spark = corpus.sparkSession
                m, new = store.append_segment(spark, path, corpus)
                result = {"documents_written": new.docs, "version": m.version, "duration": round(time.time() - began, 3), "output_path": output}
                if on_complete:
                    on_complete(Index.load(spark, path))
                self._set(replace(job, status=COMPLETED, result=result))
            except Exception as e:  # noqa: BLE001 - whatever stops a job is its result
                self._set(replace(job, status=FAILED, error=str(e).split("\n")[0]))

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        return job.job_id

    def _set(self, job: Job) -> None:
        with self.lock:
            self.jobs[job.job_id] = job

    def get(self, job_id: str) -> Job | None:
        with self.lock:
            return self.jobs.get(job_id)

    def list(self) -> list[Job]:
        with self.lock:
            return list(self.jobs.values())

    def wait(self, job_id: str, seconds: float = 300) -> Job | None:
        end = time.time() + seconds
        while time.time() < end:
            job = self.get(job_id)
            if job is None or job.status in (COMPLETED, FAILED):
                return job
            time.sleep(0.05)
        return self.get(job_id)


class QueryLog:
    """Counts queries and keeps the last 100."""

    def __init__(self, keep: int = 100):
        self.lock, self.total, self.latency_ns, self.began = threading.Lock(), 0, 0, time.time()
        self.kept: deque[dict[str, Any]] = deque(maxlen=keep)

    def record(self, query: str, latency_ns: int, results: int) -> None:
        with self.lock:
            self.total += 1
            self.latency_ns += latency_ns
            self.kept.append({"query": query, "latency_ns": latency_ns, "results": results, "logged_at": time.time()})

    def stats(self) -> dict[str, Any]:
        with self.lock:
            up = time.time() - self.began
            avg = self.latency_ns // 1000 / self.total / 1000 if self.total else 0.0
            return {"total_queries": self.total, "avg_latency_ms": avg, "qps": self.total / up if up > 0 else 0.0, "uptime_seconds": up, "recent": list(self.kept)}
