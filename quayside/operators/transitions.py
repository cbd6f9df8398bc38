"""Guarded writes. A batch of commands meets the jobs by id; a command whose guard does not
hold changes nothing and leaves no trace in the journal.

Each function returns a :class:`Change`: the jobs after the batch, the journal rows that it
adds (without ids, which :mod:`quayside.sources.store` gives out on commit), and what came
of every command. A batch holds one command for a job at most; more are an error.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.backoff import Backoff, retry_delay_column
from ..functions.columns import all_of, plus_nanos, plus_seconds, stamp
from .reads import find_stale
from .schema import CLAIMED, COMPLETED, DEAD, JOB_COLUMNS, JOBS, JOURNAL, OUTCOME_OF, PENDING, ConfigError, checked_priority, notifies

#: Columns of the journal rows of a change.
ADDED_COLUMNS = JOURNAL.names[1:]
LEASE_LEAST, LEASE_MOST = 1.0, 365 * 86400.0


@dataclass(frozen=True)
class Change:
    jobs: DataFrame
    added: DataFrame
    outcome: DataFrame  # id, applied, notify

    def count(self) -> DataFrame:
        """The number of commands that applied, and whether any of them wakes workers."""
        return self.outcome.agg(F.count_if("applied").alias("applied"), F.coalesce(F.max("notify"), F.lit(False)).alias("notify"))


def _once(commands: DataFrame) -> DataFrame:
    """The commands, or an error where two of them name one job."""
    rest = [c for c in commands.columns if c != "id"]
    grouped = commands.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_c"))
    single = F.when(F.col("_n") == 1, F.col("_c")).otherwise(F.raise_error(F.concat(F.lit("two commands in one batch for job "), F.col("id"))))
    return grouped.select("id", single.alias("_c"))


def _met(jobs: DataFrame, commands: DataFrame, guard: Column) -> DataFrame:
    """Jobs with their command (c) and whether it applies. Commands are the small side as a
    rule; which side is sent around is left to the planner."""
    c = _once(commands).withColumnRenamed("id", "_id")
    rows = jobs.join(c, jobs["id"] == c["_id"], "left").drop("_id").withColumnRenamed("_c", "c")
    return rows.withColumn("applied", F.coalesce(F.col("c").isNotNull() & guard, F.lit(False)))


def _change(met: DataFrame, commands: DataFrame, new: dict[str, Column], entry: dict[str, Column] | None, now: datetime | str, notify: Column) -> Change:
    types = {f.name: f.dataType for f in JOBS.fields}
    columns = [F.when(F.col("applied"), new[c].cast(types[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in JOB_COLUMNS]
    jobs = met.select(*columns)
    hit = met.where("applied")
    if entry is None:
        added = hit.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in JOURNAL.fields[1:]]).where(F.lit(False))
    else:
        values = {"job_id": F.col("id"), "kind": F.col("kind"), "run_no": F.col("run_count"), "recorded_at": stamp(now), "note": F.lit(None), "attachment": F.lit(None)} | entry
        added = hit.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in JOURNAL.fields[1:]])
    done = hit.select("id", notify.alias("_notify"))
    outcome = commands.select("id").join(done, "id", "left").select("id", F.col("_notify").isNotNull().alias("applied"), F.coalesce("_notify", F.lit(False)).alias("notify"))
    return Change(jobs, added, outcome)


def enqueue(jobs: DataFrame, new: DataFrame, now: datetime | str) -> Change:
    """Append jobs. ``new``: id, kind, payload, priority and, if wanted, visible_at, carry
    and dedup_key. A priority outside of 0 to 2 is an error. All of them notify, even those
    that become visible later."""
    given = set(new.columns)
    opt = lambda name, default: F.coalesce(F.col(name), default) if name in given else default
    values = {
        "id": F.col("id"), "kind": F.col("kind"), "payload": F.col("payload"), "priority": checked_priority(F.col("priority")), "status": F.lit(PENDING), "created_at": stamp(now), "visible_at": opt("visible_at", stamp(now)),
        "run_count": F.lit(0), "failure_count": F.lit(0), "carry": opt("carry", F.lit("null")), "dedup_key": F.col("dedup_key") if "dedup_key" in given else F.lit(None),
    }
    rows = new.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in JOBS.fields])
    none = jobs.sparkSession.createDataFrame([], "job_id string, kind string, run_no int, recorded_at timestamp_ntz, outcome string, note string, attachment string")
    return Change(jobs.select(*JOB_COLUMNS).unionByName(rows), none, rows.select("id", F.lit(True).alias("applied"), F.lit(True).alias("notify")))


def _owned() -> Column:
    """The claim that a command speaks of is still the job's claim."""
    return (F.col("claimed_by") == F.col("c.claimed_by")) & (F.col("run_count") == F.col("c.run_no")) & (F.col("status") == CLAIMED)


def settle(jobs: DataFrame, commands: DataFrame, now: datetime | str) -> Change:
    """End runs. ``commands``: id, claimed_by, run_no, tag (complete, retry, pause, dead,
    release), visible_at, failure_count, carry, note, attachment.

    retry and dead set failure_count as given, retry and pause set carry; the others leave
    both alone. The tag of a command that applies must be known.
    """
    tag = F.col("c.tag")
    known = F.when(tag.isin(*OUTCOME_OF), tag).otherwise(F.raise_error(F.concat(F.lit("unknown settlement "), F.coalesce(tag, F.lit("null")))))
    back = tag.isin("retry", "pause", "release")
    status = F.when(known == "complete", COMPLETED).when(tag == "dead", DEAD).otherwise(PENDING)
    new = {
        "status": status,
        "finished_at": F.when(~back, stamp(now)).otherwise(F.col("finished_at")),
        "visible_at": F.when(back, F.col("c.visible_at")).otherwise(F.col("visible_at")),
        "failure_count": F.when(tag.isin("retry", "dead"), F.col("c.failure_count")).otherwise(F.col("failure_count")),
        "carry": F.when(tag.isin("retry", "pause"), F.col("c.carry")).otherwise(F.col("carry")),
        "claimed_by": F.lit(None),
        "claim_expires_at": F.lit(None),
    }
    outcomes = F.create_map(*[F.lit(x) for pair in OUTCOME_OF.items() for x in pair])
    entry = {"outcome": F.element_at(outcomes, tag), "run_no": F.col("c.run_no"), "note": F.col("c.note"), "attachment": F.col("c.attachment")}
    return _change(_met(jobs, commands, _owned()), commands, new, entry, now, notifies(tag))


def settlements_for(results: DataFrame, now: datetime | str, backoff: Backoff, fraction: float = 0.5, backstop: int | None = 20) -> DataFrame:
    """Commands for :func:`settle` from what handlers report.

    ``results``: id, claimed_by, run_no, failure_count (before this run), result (completed,
    paused, failed, fatal, released), pause_ns, carry, note, attachment and, optionally, base_ns and
    cap_ns of the task's own backoff. A failure that is not fatal is retried until the
    number of failures reaches the backstop; with a backstop of 0 or 1 the first one is fatal.
    """
    attempt = F.col("failure_count") + 1
    failed = F.col("result").isin("failed", "fatal")
    ends = F.lit(False) if backstop is None else attempt >= backstop
    tag = F.when(F.col("result") == "completed", "complete").when(F.col("result") == "paused", "pause").when(F.col("result") == "released", "release").when((F.col("result") == "fatal") | ends, "dead").otherwise("retry")
    delay = F.col("delay_ns") if "delay_ns" in results.columns else retry_delay_column(F.col("id"), attempt, backoff, fraction)
    wait = F.when(F.col("result") == "paused", F.coalesce("pause_ns", F.lit(0))).when(F.col("result") == "failed", delay).otherwise(F.lit(0))
    return results.select("id", "claimed_by", "run_no", tag.alias("tag"), plus_nanos(stamp(now), wait.cast("bigint")).alias("visible_at"), F.when(failed, attempt).otherwise(F.col("failure_count")).cast("int").alias("failure_count"), "carry", "note", "attachment")


def recover(jobs: DataFrame, now: datetime | str, backoff: Backoff = Backoff(), fraction: float = 0.5, limit: int = 100, worker: str | None = None) -> Change:
    """Put claimed jobs whose lease has run out back, up to ``limit`` of any kind.

    The failure counts, but the backstop is not asked: only a later failure ends the job.
    Who holds the claim does not matter; its run number does.
    """
    stale = find_stale(jobs, now, limit).select("id", F.col("run_count").alias("run_no"), F.col("claimed_by").alias("holder"), (F.col("failure_count") + 1).alias("failures"))
    delay = retry_delay_column(F.col("id"), F.col("failures"), backoff, fraction)
    commands = stale.select("id", "run_no", "failures", "holder", plus_nanos(stamp(now), delay).alias("visible_at"))
    return recover_with(jobs, commands, now, worker)


def recover_with(jobs: DataFrame, commands: DataFrame, now: datetime | str, worker: str | None = None) -> Change:
    """``commands``: id, run_no, visible_at, failures, holder."""
    guard = (F.col("status") == CLAIMED) & (F.col("claim_expires_at") < stamp(now)) & (F.col("run_count") == F.col("c.run_no"))
    new = {"status": F.lit(PENDING), "visible_at": F.col("c.visible_at"), "failure_count": F.col("c.failures"), "claimed_by": F.lit(None), "claim_expires_at": F.lit(None)}
    note = F.concat(F.lit("lease of "), F.coalesce("c.holder", F.lit("unknown")), F.lit(" ran out" + (f"; put back by {worker}" if worker else "")))
    return _change(_met(jobs, commands, guard), commands, new, {"outcome": F.lit("stale-recovered"), "run_no": F.col("c.run_no"), "note": note}, now, F.lit(True))


def clamp_lease(seconds: Column) -> Column:
    return F.least(F.greatest(seconds, F.lit(LEASE_LEAST)), F.lit(LEASE_MOST))


def extend_lease(jobs: DataFrame, commands: DataFrame, now: datetime | str) -> Change:
    """``commands``: id, claimed_by, run_no, lease_s. The lease then ends at now + lease,
    which may be sooner than before."""
    new = {"claim_expires_at": plus_seconds(stamp(now), clamp_lease(F.col("c.lease_s").cast("double")))}
    return _change(_met(jobs, commands, _owned()), commands, new, None, now, F.lit(False))


def merge_into(jobs: DataFrame, commands: DataFrame, now: datetime | str) -> Change:
    """Merge payloads into pending jobs. ``commands``: id, payload, carry, priority, note; a
    null payload keeps the job as it is. Both ways the journal says ``merged``; when the job
    becomes visible does not change, and nobody is notified."""
    keep = F.col("c.payload").isNull()
    new = {c: F.when(keep, F.col(c)).otherwise(F.col(f"c.{c}")) for c in ("payload", "carry")}
    new["priority"] = F.when(keep, F.col("priority")).otherwise(checked_priority(F.col("c.priority")))
    return _change(_met(jobs, commands, F.col("status") == PENDING), commands, new, {"outcome": F.lit("merged"), "note": F.col("c.note")}, now, F.lit(False))


@dataclass(frozen=True)
class CleanupCriteria:
    """Finished jobs that ended before an instant, of one kind or status if named."""

    finished_before: datetime | str
    kind: str | None = None
    status: str | None = None

    def __post_init__(self) -> None:
        if self.status is not None and self.status not in (COMPLETED, DEAD):
            raise ConfigError(f"only finished jobs can be cleaned up, not {self.status!r}")

    def predicate(self) -> Column:
        found = [F.col("finished_at").isNotNull(), F.col("finished_at") < stamp(self.finished_before), F.col("status").isin(COMPLETED, DEAD)]
        if self.kind is not None:
            found.append(F.col("kind") == self.kind)
        if self.status is not None:
            found.append(F.col("status") == self.status)
        return all_of(found)


def cleanup(jobs: DataFrame, journal: DataFrame, which: CleanupCriteria) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, journal, number of jobs deleted); the journal of a deleted job goes with it."""
    gone = F.coalesce(which.predicate(), F.lit(False))
    ids = jobs.where(gone).select(F.col("id").alias("job_id"))
    return jobs.where(~gone), journal.join(ids, "job_id", "left_anti").select(*JOURNAL.names), jobs.agg(F.count_if(gone).alias("deleted"))
