"""Claiming: an ordered, filtered top-k with a fairness rotation and caps by kind.

A worker claims one job at a time; each attempt has a priority floor that follows from a
counter. Here a whole batch of attempts is resolved at once and gives what they would have
given one by one:

* without caps only the number of eligible jobs of each priority matters, so the rotation
  runs over three numbers and picks (step, priority, rank), which are joined to ranked rows;
* with caps the kinds shrink as slots fill, so the first k rows of each kind and priority
  are fetched (kinds * 3 * k of them at most) and the rotation runs over those.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import plus_seconds, stamp
from .reads import eligible
from .schema import CLAIMED, HIGH, JOB_COLUMNS, LOW, NORMAL

DEFAULT_RATIO, DEFAULT_LEASE = 4, 900.0


def floor_for(counter: int, ratio: int | None) -> int:
    """Every ratio-th claim starts at normal, every ratio-squared-th at low, all others at high."""
    if ratio is None or ratio < 2:
        return HIGH
    if counter % (ratio * ratio) == 0:
        return LOW
    return NORMAL if counter % ratio == 0 else HIGH


def floor_column(counter: Column, ratio: int | None) -> Column:
    if ratio is None or ratio < 2:
        return F.lit(HIGH)
    return F.when(counter % (ratio * ratio) == 0, LOW).when(counter % ratio == 0, NORMAL).otherwise(HIGH)


def claimable_kinds(in_flight: dict[str, int], caps: dict[str, int | None]) -> list[str]:
    """Registered kinds (keys of ``caps``) that are below their cap; None is no cap."""
    return [k for k, cap in caps.items() if cap is None or in_flight.get(k, 0) < cap]


def in_flight(jobs: DataFrame, claimed_by: str) -> DataFrame:
    """Jobs that a worker holds, by kind."""
    return jobs.where((F.col("status") == CLAIMED) & (F.col("claimed_by") == claimed_by)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def next_jobs(jobs: DataFrame, kinds: Iterable[str], floor: int, now: datetime | str, k: int = 1) -> DataFrame:
    """The k jobs that would be claimed next at a floor: by priority, then age, then id."""
    return jobs.where(eligible(kinds, floor, now)).orderBy("priority", "created_at", "id").limit(k).select(*JOB_COLUMNS)


@dataclass(frozen=True)
class Claims:
    """The claimed rows (step, counter and id), and the counter after the batch."""

    rows: DataFrame
    counter: int


def rotate(counts: list[int], slots: int, counter: int, ratio: int | None) -> tuple[list[tuple[int, int, int, int]], int]:
    """(step, counter, priority, rank) of each claim, from the numbers of eligible jobs.

    The counter moves before each attempt, also before one that finds nothing. An attempt
    that finds nothing at its floor falls back to all priorities.
    """
    taken, picks = [0, 0, 0], []
    while len(picks) < slots:
        counter += 1
        floor = floor_for(counter, ratio)
        tier = next((p for p in [*range(floor, 3), *range(floor)] if taken[p] < counts[p]), None)
        if tier is None:
            break
        taken[tier] += 1
        picks.append((len(picks) + 1, counter, tier, taken[tier]))
    return picks, counter


def claim_batch(jobs: DataFrame, kinds: Iterable[str], now: datetime | str, slots: int, counter: int = 0, ratio: int | None = DEFAULT_RATIO) -> Claims:
    """Resolve ``slots`` claim attempts without caps."""
    spark, able = jobs.sparkSession, jobs.where(eligible(kinds, HIGH, now))
    # No tier gives more than the slots, so counting may stop there; it is one small aggregate.
    found = {r.priority: r.n for r in able.groupBy("priority").agg(F.count(F.lit(1)).alias("n")).collect()}
    picks, counter = rotate([min(found.get(p, 0), slots) for p in (HIGH, NORMAL, LOW)], slots, counter, ratio)
    rank = F.row_number().over(Window.partitionBy("priority").orderBy("created_at", "id"))
    columns = able.select("id", "kind", "priority", "created_at")
    # A top-k for each priority, whatever the number of slots; only their rows are ranked.
    tops = []
    for p in (HIGH, NORMAL, LOW):
        if most := max((rank for _, _, tier, rank in picks if tier == p), default=0):
            tops.append(columns.where(F.col("priority") == p).orderBy("created_at", "id").limit(most))
    ranked = functools.reduce(DataFrame.unionByName, tops or [columns.limit(0)]).withColumn("rank", rank)
    steps = spark.createDataFrame(picks, "step int, counter long, priority short, rank int")
    return Claims(ranked.join(F.broadcast(steps), ["priority", "rank"]).select("step", "counter", "id", "kind", "priority", "created_at"), counter)


def claim_capped(jobs: DataFrame, caps: dict[str, int | None], held: dict[str, int], now: datetime | str, slots: int, counter: int = 0, ratio: int | None = DEFAULT_RATIO) -> Claims:
    """Resolve ``slots`` claim attempts where each kind may have ``caps`` jobs in flight.

    A pass that ends because every kind is at its cap has not moved the counter for it.
    """
    spark = jobs.sparkSession
    rank = F.row_number().over(Window.partitionBy("kind", "priority").orderBy("created_at", "id"))
    # A kind gives no more jobs than its cap leaves room for.
    room = {k: slots if cap is None else min(slots, cap - held.get(k, 0)) for k, cap in caps.items()}
    open_kinds = [k for k in caps if room[k] > 0]
    most = max(room.values(), default=0)
    first = jobs.where(eligible(open_kinds, HIGH, now)).select("id", "kind", "priority", "created_at").withColumn("rank", rank).where(F.col("rank") <= max(most, 0))
    queues: dict[tuple[int, str], list[tuple]] = {}
    for r in first.collect():  # kinds * 3 * slots rows at most
        queues.setdefault((r.priority, r.kind), []).append((r.created_at, r.id))
    for q in queues.values():
        heapq.heapify(q)
    running, picks = dict(held), []
    while len(picks) < slots:
        kinds = claimable_kinds(running, caps)
        if not kinds:
            break
        counter += 1
        floor = floor_for(counter, ratio)
        heads = [(p, *queues[p, k][0], k) for p in range(3) for k in kinds if queues.get((p, k))]
        best = min((h for h in heads if h[0] >= floor), default=None) or min(heads, default=None)
        if best is None:
            break
        priority, created_at, job_id, kind = best
        heapq.heappop(queues[priority, kind])
        running[kind] = running.get(kind, 0) + 1
        picks.append((len(picks) + 1, counter, job_id, kind, priority, created_at))
    schema = "step int, counter long, id string, kind string, priority short, created_at timestamp_ntz"
    return Claims(spark.createDataFrame(picks, schema), counter)


def share_out(claims: DataFrame, workers: list[str]) -> DataFrame:
    """Give the rows of one batch to several workers in turn: no job goes to two of them."""
    who = F.element_at(F.array(*[F.lit(w) for w in workers]), ((F.col("step") - 1) % len(workers) + 1).cast("int"))
    return claims.withColumn("claimed_by", who)


def apply_claims(jobs: DataFrame, claims: DataFrame, now: datetime | str, lease_s: float | Column = DEFAULT_LEASE, claimed_by: str | None = None) -> DataFrame:
    """Jobs with the claims of a batch: claimed, leased, and one run further. A claim leaves
    no journal row. ``claims`` has id and, unless given, claimed_by."""
    who = claims.select(F.col("id").alias("_id"), (F.lit(claimed_by) if claimed_by else F.col("claimed_by")).alias("_who"))
    lease = F.lit(float(lease_s)) if isinstance(lease_s, (int, float)) else lease_s
    joined = jobs.join(who, jobs["id"] == who["_id"], "left")
    hit = F.col("_id").isNotNull()
    new = {"status": F.lit(CLAIMED), "claimed_by": F.col("_who"), "claim_expires_at": plus_seconds(stamp(now), lease), "run_count": (F.col("run_count") + 1).cast("int")}
    return joined.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in JOB_COLUMNS])
