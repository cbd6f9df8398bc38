"""The producer's side: enqueue tasks, with deduplication, and look at them."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ulid
from ..sources.store import JobStore, again
from .dedup import fold_submit
from .reads import HistoryFilter
from .tasks import Task
from .transitions import CleanupCriteria

ARRIVALS = "arrival long, id string, kind string, payload string, priority short, visible_at timestamp_ntz, carry string, dedup_key string"


class Queue:
    """A handle on a store. Every write is one batch and one new snapshot."""

    def __init__(self, store: JobStore):
        self.store = store

    def enqueue(self, task: Task, payload: Any, now: datetime) -> str:
        return self.enqueue_all(task, [payload], now)[0]

    def enqueue_at(self, task: Task, payload: Any, when: datetime, now: datetime) -> str:
        """Visible from ``when``, which may have passed."""
        return self.enqueue_all(task, [payload], now, when)[0]

    def enqueue_all(self, task: Task, payloads: list[Any], now: datetime, when: datetime | None = None) -> list[str]:
        """Ids of the jobs in which the payloads ended, their own or those they merged into."""
        millis = int(now.timestamp() * 1000)
        rows = [{"arrival": i, **task.row(p, ulid.new(millis), when)} for i, p in enumerate(payloads)]
        arrivals = self.store.spark.createDataFrame(rows, ARRIVALS)

        def submit() -> list[str]:
            base = self.store.version()
            done = fold_submit(self.store.active(base), self.store.journal(base), arrivals, task.merge, now)
            placed = {r.arrival: r for r in done.placed.collect()}  # one row a payload of this call
            # A new job notifies even if it becomes visible later; a merge does not.
            self.store.commit(base, done.jobs, done.added, notify=not all(r.merged for r in placed.values()))
            return [placed[i].id for i in range(len(payloads))]

        return again(submit)

    def jobs(self, which: HistoryFilter) -> DataFrame:
        return self.store.query(which)

    def job(self, job_id: str) -> DataFrame:
        return self.store.job(job_id)

    def job_journal(self, job_id: str) -> DataFrame:
        return self.store.timeline(job_id)

    def cleanup(self, which: CleanupCriteria) -> int:
        return self.store.cleanup(which)

    def stats(self, now: datetime) -> DataFrame:
        return self.store.stats(now)

    def pages(self, which: HistoryFilter, size: int):
        """Pages of a history, each continued after the last row of the one before."""
        before = which.before
        while True:
            page = self.store.query(HistoryFilter(which.kind, which.status, which.finished_since, which.finished_until, before, size)).orderBy(F.desc("created_at"), F.desc("id")).collect()
            if not page:
                return
            yield page
            before = (page[-1].created_at, page[-1].id)
