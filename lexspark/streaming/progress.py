"""Progress of streams as rows: a listener that logs each query's states to a table, which ``jobs.job_states`` sums up."""

from __future__ import annotations

import datetime as dt
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

LOG = "job_id string, seq long, status string, level string, stage long, message string, rows long, at timestamp"


class JobLog(StreamingQueryListener):
    """Rows LOG of every stream of a session under ``path``: queued, running with each batch, then done or failed.

    A job is a query's name, or its id where it has none. Rows are held and written in small files by ``flush``, which the end of any
    query calls; a batch's row is a few bytes, so nothing grows but the table.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.lock = spark, path, threading.Lock()
        self.rows: list[tuple] = []
        self.names: dict[str, str] = {}
        self.seq: dict[str, int] = {}

    def add(self, run: str, status: str, message: str, stage: int = 0, rows: int = 0, level: str = "info") -> None:
        with self.lock:
            job = self.names.get(run, run)
            self.seq[job] = self.seq.get(job, -1) + 1
            self.rows.append((job, self.seq[job], status, level, stage, message[:2000], rows, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)))

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name or str(event.id)
        self.add(str(event.runId), "queued", f"started {event.timestamp}")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.names.setdefault(str(p.runId), p.name or str(p.id))
        self.add(str(p.runId), "running", f"batch {p.batchId}: {p.numInputRows} rows", p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        failed = event.exception is not None
        self.add(str(event.runId), "failed" if failed else "done", event.exception or "ended", level="error" if failed else "info")
        self.flush()

    def flush(self) -> None:
        with self.lock:
            rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        """The log so far, those rows included that are not written yet."""
        with self.lock:
            held = list(self.rows)
        kept = self.spark.createDataFrame(held, LOG)
        try:
            return self.spark.read.schema(LOG).parquet(self.path).unionByName(kept)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return kept
