"""The worker: passes of recover, claim, run and settle over a store, each pass one batch."""

from __future__ import annotations

import logging
import os
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.backoff import Backoff
from ..sources.store import JobStore, again
from .claim import apply_claims, claim_batch, claim_capped, in_flight
from .reads import wait_duration, with_history
from .schema import CLAIMED, JOURNAL
from .tasks import RETRY, Registry, Task, run_handlers, task_leases
from .transitions import extend_lease, recover, settle, settlements_for

log = logging.getLogger("quayside.worker")


def default_concurrency() -> int:
    return min(max((os.cpu_count() or 1) // 2, 1), 8)


def worker_identity() -> str:
    return f"{os.environ.get('HOSTNAME', 'unknown')}:{os.getpid()}"


@dataclass
class Worker:
    """Options have the bounds that their setters of other queues have: a concurrency of one
    at least, a poll of a millisecond at least, a jitter fraction from 0 to 1."""

    store: JobStore
    registry: Registry = field(default_factory=Registry)
    state: Callable[[], Any] = lambda: None
    concurrency: int = field(default_factory=default_concurrency)
    poll_max: timedelta = timedelta(seconds=30)
    shutdown_timeout: timedelta = timedelta(seconds=30)
    lease: timedelta = timedelta(minutes=15)
    backoff: Backoff = Backoff()
    backstop: int | None = 20
    priority_ratio: int | None = 4
    jitter_fraction: float = 0.5
    panic_policy: str = RETRY
    identity: str = field(default_factory=worker_identity)
    counter: int = 0

    def __post_init__(self) -> None:
        self.concurrency = max(self.concurrency, 1)
        self.poll_max = max(self.poll_max, timedelta(milliseconds=1))
        self.jitter_fraction = min(max(self.jitter_fraction, 0.0), 1.0)

    def register(self, task: Task, cap: int | None = None) -> Worker:
        self.registry.register(task, cap)
        return self

    def recover_stale(self, now: datetime) -> int:
        return again(lambda: self._recover_stale(now))

    def _recover_stale(self, now: datetime) -> int:
        base = self.store.version()
        change = recover(self.store.active(base), now, self.backoff, self.jitter_fraction, worker=self.identity)
        n = change.count().first().applied
        if n:
            self.store.commit(base, change.jobs, change.added, notify=True)
            log.info("recovered %d stale claims", n)
        return n

    def claim(self, now: datetime) -> int:
        """Fill the free slots; the number of jobs claimed. Tasks that ask for a lease of their
        own have it from the start."""
        return again(lambda: self._claim(now))

    def _claim(self, now: datetime) -> int:
        counter = self.counter
        base = self.store.version()
        jobs = self.store.active(base)
        held = {r.kind: r.n for r in in_flight(jobs, self.identity).collect()}  # a row a kind
        slots = self.concurrency - sum(held.values())
        if slots <= 0 or not self.registry.kinds():
            return 0
        if any(cap is not None for cap in self.registry.caps.values()):
            claims = claim_capped(jobs, self.registry.caps, held, now, slots, counter, self.priority_ratio)
        else:
            claims = claim_batch(jobs, self.registry.kinds(), now, slots, counter, self.priority_ratio)
        n = claims.rows.count()
        if n:
            after = apply_claims(jobs, claims.rows, now, self.lease.total_seconds(), self.identity)
            commands = task_leases(after.join(claims.rows.select("id"), "id", "left_semi"), self.registry, self.lease)
            if commands.limit(1).count():
                after = extend_lease(after, commands, now).jobs
            self.store.commit(base, after)
        # Attempts of a pass that lost against another writer were none.
        self.counter = claims.counter
        return n

    def run_claimed(self, now: datetime, later: datetime | None = None, grace: timedelta | None = None) -> int:
        """Run what this worker holds and settle it as of ``later``; the number settled.

        With a ``grace``, runs that have not ended by then are given back instead."""
        mine, at = self._with_history(), later or now
        results = run_handlers(mine, self.registry, now, self.state, self.panic_policy, self.backoff, self.jitter_fraction, grace)
        # What handlers said is kept: reading it again must not run them again.
        results = self._kept(results)

        def commit() -> int:
            base = self.store.version()
            change = settle(self.store.active(base), settlements_for(results, at, self.backoff, self.jitter_fraction, self.backstop), at)
            done = change.count().first()
            if done.applied:
                self.store.commit(base, change.jobs, change.added, notify=done.notify)
            return done.applied

        n = again(commit)
        for df in (mine, results):
            self._discard(df)
        return n

    def _kept(self, df: DataFrame) -> DataFrame:
        path = self.store._at("drafts", uuid.uuid4().hex)
        df.write.parquet(path)
        return self.store.spark.read.schema(df.schema).parquet(path)

    def _discard(self, df: DataFrame) -> None:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            self.store._fs.delete(self.store._path(folder), True)

    def _with_history(self) -> DataFrame:
        """What this worker holds, with its history; without any where that cannot be read."""
        base = self.store.version()
        jobs = self.store.active(base)
        mine = jobs.where((F.col("status") == CLAIMED) & (F.col("claimed_by") == self.identity))
        try:
            return self._kept(with_history(mine, self.store.journal(base)))
        except Exception as e:  # noqa: BLE001 - whatever is wrong with the journal, the runs go on
            log.warning("could not load the history of claimed jobs, going on without: %s", e)
            return self._kept(with_history(mine, self.store.spark.createDataFrame([], JOURNAL)))

    def release(self, now: datetime) -> int:
        """Give back what this worker still holds; that is no failure."""
        return again(lambda: self._release(now))

    def _release(self, now: datetime) -> int:
        base = self.store.version()
        jobs = self.store.active(base)
        mine = jobs.where((F.col("status") == CLAIMED) & (F.col("claimed_by") == self.identity))
        commands = mine.select("id", "claimed_by", F.col("run_count").alias("run_no"), F.lit("release").alias("tag"), F.lit(now).cast("timestamp_ntz").alias("visible_at"), "failure_count", "carry", F.lit("released at shutdown").alias("note"), F.lit(None).cast("string").alias("attachment"))
        change = settle(jobs, commands, now)
        n = change.count().first().applied
        if n:
            self.store.commit(base, change.jobs, change.added, notify=True)
            log.info("released %d claims at shutdown", n)
        return n

    def step(self, now: datetime) -> int:
        """One pass: recover, claim, run, settle. The number of jobs settled."""
        if not self.registry.kinds():
            return 0
        self.recover_stale(now)
        return self.run_claimed(now) if self.claim(now) else 0

    def wait(self, now: datetime) -> timedelta:
        most = int(self.poll_max / timedelta(microseconds=1))
        row = wait_duration(self.store.pending(), self.registry.kinds(), now, most).first()
        return timedelta(microseconds=row.wait_us)

    def run(self, clock: Callable[[], datetime], sleep: Callable[[timedelta], None], stop: Callable[[], bool]) -> int:
        """Passes until ``stop``; then what is still claimed is given back. A pass that is under
        way at that time has ``shutdown_timeout`` to end, and is stopped after it."""
        settled = 0
        if not self.registry.kinds():
            return settled
        while not stop():
            n = self._stoppable(lambda: self.step(clock()), stop)
            settled += n
            if not n and not stop():
                sleep(self.wait(clock()))
        return settled + self.drain(clock())

    def _stoppable(self, action: Callable[[], int], stop: Callable[[], bool]) -> int:
        """The action's number, or 0 if its Spark jobs were cancelled after a stop."""
        context, tag = self.store.spark.sparkContext, f"quayside-{uuid.uuid4().hex}"
        ended, cancelled = threading.Event(), threading.Event()

        def watch() -> None:
            while not ended.wait(0.2):
                if stop():
                    if not ended.wait(self.shutdown_timeout.total_seconds()):
                        cancelled.set()
                        while not ended.wait(0.2):
                            context.cancelJobsWithTag(tag)
                    return

        watcher = threading.Thread(target=watch, daemon=True)
        context.addJobTag(tag)
        watcher.start()
        try:
            return action()
        except Exception:
            if not cancelled.is_set():
                raise
            log.warning("a pass was stopped at shutdown; what it had claimed is given back")
            return 0
        finally:
            ended.set()
            watcher.join()
            context.removeJobTag(tag)

    def drain(self, now: datetime) -> int:
        """Shut down: what is claimed still runs, with its token cancelled and within the time
        that is left for it; the rest is given back, which is no failure."""
        held = sum(r.n for r in in_flight(self.store.active(), self.identity).collect())
        log.info("shutdown: draining %d claimed jobs", held)
        settled = self.run_claimed(now, grace=self.shutdown_timeout)
        self.release(now)
        return settled
