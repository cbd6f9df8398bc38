"""Read operators over the jobs and journal relations; every one takes its clock as ``now``."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import all_of, before_row, micros_between, stamp
from .schema import CLAIMED, COMPLETED, DEAD, ENTRY_COLUMNS, JOB_COLUMNS, JOURNAL_COLUMNS, PENDING, ConfigError, is_failure


def eligible(kinds: Iterable[str], floor: int, now: datetime | str) -> Column:
    """Pending, of one of the kinds, at or above the floor, and visible by now."""
    return (F.col("status") == PENDING) & F.col("kind").isin(list(kinds)) & (F.col("priority") >= floor) & (F.col("visible_at") <= stamp(now))


def backlog(jobs: DataFrame, now: datetime | str) -> DataFrame:
    """Pending jobs and the age of the oldest by kind; jobs that are not yet visible count too."""
    grouped = jobs.where(F.col("status") == PENDING).groupBy("kind").agg(F.count(F.lit(1)).alias("pending"), F.min("created_at").alias("oldest_created_at"))
    return grouped.withColumn("oldest_age_us", micros_between(F.col("oldest_created_at"), stamp(now)))


def claimed_count(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("status") == CLAIMED).alias("claimed"))


def dead_by_kind(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status") == DEAD).groupBy("kind").agg(F.count(F.lit(1)).alias("dead"))


def snapshot(jobs: DataFrame, now: datetime | str) -> DataFrame:
    """All of the statistics in one pass: a row for each kind with a pending, claimed or dead job."""
    pending = F.col("status") == PENDING
    grouped = jobs.where(F.col("status") != COMPLETED).groupBy("kind").agg(F.count_if(pending).alias("pending"), F.min(F.when(pending, F.col("created_at"))).alias("oldest"), F.count_if(F.col("status") == CLAIMED).alias("claimed"), F.count_if(F.col("status") == DEAD).alias("dead"))
    return grouped.select("kind", "pending", micros_between(F.col("oldest"), stamp(now)).alias("oldest_age_us"), "claimed", "dead")


def next_visible_at(jobs: DataFrame, kinds: Iterable[str], now: datetime | str) -> DataFrame:
    """When the next pending job of the kinds becomes visible; null if none will."""
    future = (F.col("status") == PENDING) & F.col("kind").isin(list(kinds)) & (F.col("visible_at") > stamp(now))
    return jobs.where(future).agg(F.min("visible_at").alias("next_visible_at"))


def find_stale(jobs: DataFrame, now: datetime | str, limit: int = 100) -> DataFrame:
    """Claimed jobs of any kind whose lease has run out, those that ran out first first."""
    return jobs.where((F.col("status") == CLAIMED) & (F.col("claim_expires_at") < stamp(now))).orderBy("claim_expires_at", "id").limit(limit)


def dedup_candidates(jobs: DataFrame) -> DataFrame:
    """The oldest pending job of each (kind, dedup_key)."""
    oldest = F.row_number().over(Window.partitionBy("kind", "dedup_key").orderBy("created_at", "id"))
    return jobs.where((F.col("status") == PENDING) & F.col("dedup_key").isNotNull()).withColumn("_rank", oldest).where(F.col("_rank") == 1).drop("_rank")


def dedup_candidate(jobs: DataFrame, kind: str, key: str) -> DataFrame:
    return jobs.where((F.col("status") == PENDING) & (F.col("kind") == kind) & (F.col("dedup_key") == key)).orderBy("created_at", "id").limit(1)


@dataclass(frozen=True)
class HistoryFilter:
    """Conditions that hold together; a window of finished_at is half-open, and a cursor
    continues after the row that it names."""

    kind: str | None = None
    status: str | None = None
    finished_since: datetime | str | None = None
    finished_until: datetime | str | None = None
    before: tuple[datetime | str, str] | None = None
    limit: int | None = None

    def predicate(self) -> Column:
        found = []
        if self.kind is not None:
            found.append(F.col("kind") == self.kind)
        if self.status is not None:
            found.append(F.col("status") == self.status)
        if self.finished_since is not None:
            found.append(F.col("finished_at") >= stamp(self.finished_since))
        if self.finished_until is not None:
            found.append(F.col("finished_at") < stamp(self.finished_until))
        if self.before is not None:
            found.append(before_row(*self.before))
        return all_of(found)


def query_jobs(jobs: DataFrame, which: HistoryFilter) -> DataFrame:
    """Newest first."""
    if which.limit is not None and which.limit < 0:
        raise ConfigError("a limit is not negative")
    rows = jobs.where(which.predicate()).orderBy(F.desc("created_at"), F.desc("id"))
    return (rows if which.limit is None else rows.limit(which.limit)).select(*JOB_COLUMNS)


def job(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.where(F.col("id") == job_id).select(*JOB_COLUMNS)


def timeline(journal: DataFrame, job_id: str) -> DataFrame:
    return journal.where(F.col("job_id") == job_id).orderBy("id").select(*JOURNAL_COLUMNS)


def with_history(jobs: DataFrame, journal: DataFrame) -> DataFrame:
    """Each job with its journal entries in order, and the number of those that failed. Only
    entries of these jobs are gathered, so a few claims do not cost the whole journal."""
    own = journal.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    entries = own.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("id", *ENTRY_COLUMNS))).alias("_entries"), F.count_if(is_failure(F.col("outcome"))).alias("_failures"))
    joined = jobs.join(entries, jobs["id"] == entries["job_id"], "left")
    entry = "array<struct<" + ",".join(f"{c}:{t}" for c, t in zip(ENTRY_COLUMNS, ("int", "timestamp_ntz", "string", "string", "string"), strict=True)) + ">>"
    plain = F.transform("_entries", lambda e: F.struct(*[e[c].alias(c) for c in ENTRY_COLUMNS]))
    return joined.select(*[jobs[c] for c in jobs.columns], F.coalesce(plain, F.array().cast(entry)).alias("history"), F.coalesce("_failures", F.lit(0)).cast("bigint").alias("failures"))


def outcome_counts(journal: DataFrame) -> DataFrame:
    """Journal rows by kind and outcome."""
    return journal.groupBy("kind", "outcome").agg(F.count(F.lit(1)).alias("n"), F.max(is_failure(F.col("outcome"))).alias("failure"))


def wait_times(jobs: DataFrame, now: datetime | str, bounds_hours: tuple[int, ...] = (24, 24 * 30, 24 * 365)) -> DataFrame:
    """How long eligible jobs have waited since they were made, as a histogram by kind:
    the number of jobs up to each bound, and beyond (bound null). Sums of microseconds pass 64
    bits at some 100,000 jobs that have waited for years, so they are decimal(38,0)."""
    waited = micros_between(F.col("created_at"), stamp(now))
    bound = F.lit(None).cast("int")
    for hours in sorted(bounds_hours, reverse=True):
        bound = F.when(waited <= hours * 3_600_000_000, F.lit(hours)).otherwise(bound)
    visible = jobs.where((F.col("status") == PENDING) & (F.col("visible_at") <= stamp(now)))
    return visible.groupBy("kind", bound.alias("upto_hours")).agg(F.count(F.lit(1)).alias("n"), F.sum(waited.cast("decimal(28,0)")).alias("waited_us"))


def wait_duration(jobs: DataFrame, kinds: Iterable[str], now: datetime | str, poll_max_us: int = 30_000_000, least_us: int = 5_000) -> DataFrame:
    """How long a worker may sleep: until the next job is due, a little at least, a poll at most."""
    due = F.timestamp_diff("MICROSECOND", stamp(now), F.col("next_visible_at"))
    # greatest() passes over nulls, so nothing due is asked for by itself.
    wait = F.when(due.isNull(), F.lit(poll_max_us)).otherwise(F.least(F.greatest(due, F.lit(least_us)), F.lit(poll_max_us)))
    return next_visible_at(jobs, kinds, now).select(wait.cast("bigint").alias("wait_us"))
