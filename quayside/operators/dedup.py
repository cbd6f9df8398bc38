"""Keyed deduplication: a task that arrives meets the oldest pending job of its kind and key.

Within a batch, arrivals of one key act on each other in their order. Three of the four
decisions have a closed form and stay in the JVM; a merge by user code folds each key's
arrivals in a stream of rows in their order.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import stamp
from .reads import dedup_candidates
from .schema import JOB_COLUMNS, JOBS, JOURNAL, PENDING, checked_priority

KEEP, REPLACE, INDEPENDENT = "keep", "replace", "independent"


@dataclass(frozen=True)
class Submitted:
    """Jobs after the batch, the journal rows it adds (without ids), and the job each arrival ended in."""

    jobs: DataFrame
    added: DataFrame
    placed: DataFrame  # arrival, id, merged


def _new_rows(arrivals: DataFrame, now: datetime | str) -> DataFrame:
    values = {"id": F.col("id"), "kind": F.col("kind"), "payload": F.col("payload"), "priority": checked_priority(F.col("priority")), "status": F.lit(PENDING), "created_at": stamp(now), "visible_at": F.coalesce("visible_at", stamp(now)), "run_count": F.lit(0), "failure_count": F.lit(0), "carry": F.col("carry"), "dedup_key": F.col("dedup_key")}
    return arrivals.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in JOBS.fields])


def _entries(rows: DataFrame, now: datetime | str) -> DataFrame:
    """A ``merged`` row for each merge; its run number is the survivor's, 0 before a first run."""
    values = {"recorded_at": stamp(now), "outcome": F.lit("merged"), "attachment": F.lit(None)}
    return rows.select(*[values.get(f.name, F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in JOURNAL.fields[1:]])


def submit(jobs: DataFrame, arrivals: DataFrame, decision: str, now: datetime | str) -> Submitted:
    """Submit a batch under one decision.

    ``arrivals``: arrival (their order), id (of the job to be made), kind, payload, priority,
    visible_at, carry (the kind's empty carry) and dedup_key; without a key nothing merges.
    Keep leaves the survivor alone. Replace gives it the last arrival's payload and priority
    and an empty carry. Independent makes a job of each arrival, without a journal row.
    """
    keyed, free = arrivals.where(F.col("dedup_key").isNotNull()), arrivals.where(F.col("dedup_key").isNull())
    own = lambda rows: rows.select("arrival", "id", F.lit(False).alias("merged"))
    if decision == INDEPENDENT:
        none = _entries(arrivals.where(F.lit(False)).select(F.col("id").alias("job_id"), "kind", F.lit(0).alias("run_no")), now)
        return Submitted(jobs.select(*JOB_COLUMNS).unionByName(_new_rows(arrivals, now)), none, own(arrivals))
    if decision not in (KEEP, REPLACE):
        raise ValueError(f"unknown decision {decision!r}; user merges go through fold_submit")

    candidates = dedup_candidates(jobs).select("kind", "dedup_key", F.col("id").alias("c_id"), F.col("run_count").alias("c_runs"))
    order = Window.partitionBy("kind", "dedup_key")
    rows = keyed.join(candidates, ["kind", "dedup_key"], "left").withColumns({"nth": F.row_number().over(order.orderBy("arrival")), "first_id": F.first("id").over(order.orderBy("arrival"))})
    rows = rows.withColumns({"survivor": F.coalesce("c_id", "first_id"), "merged": F.col("c_id").isNotNull() | (F.col("nth") > 1)})
    made = _new_rows(rows.where(~F.col("merged")).select(*arrivals.columns), now).unionByName(_new_rows(free, now))
    everything = jobs.select(*JOB_COLUMNS).unionByName(made)
    if decision == REPLACE:
        last = rows.where("merged").groupBy("survivor").agg(F.max_by(F.struct("payload", "priority", "carry"), "arrival").alias("w"))
        met = everything.join(last, everything["id"] == last["survivor"], "left")
        new = {"payload": F.col("w.payload"), "carry": F.col("w.carry"), "priority": checked_priority(F.col("w.priority"))}
        everything = met.select(*[F.when(F.col("w").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in JOB_COLUMNS])
    entries = _entries(rows.where("merged").select(F.col("survivor").alias("job_id"), "kind", F.coalesce("c_runs", F.lit(0)).alias("run_no")), now)
    placed = rows.select("arrival", F.col("survivor").alias("id"), "merged").unionByName(own(free))
    return Submitted(everything, entries, placed)


@dataclass(frozen=True)
class Pending:
    """What a merge sees of the job that it may merge into."""

    payload: Any
    carry: Any
    run_count: int
    history: list[dict[str, Any]]


#: A merge takes the pending job and the arriving payload and says "keep", "replace",
#: "independent", or ("with", payload, carry, priority); priority None keeps the arrival's.
Merge = Callable[[Pending, Any], "str | tuple[str, Any, Any, int | None]"]

_FOLDED = "id string, kind string, payload string, priority short, carry string, dedup_key string, visible_at timestamp_ntz, run_no int, arrival long, merged boolean, target string, final boolean, fresh boolean"


def fold_submit(jobs: DataFrame, journal: DataFrame, arrivals: DataFrame, merge: Merge, now: datetime | str) -> Submitted:
    """Submit a batch under user code: arrivals of a key are folded one after another.

    After "independent" the oldest pending job still stands for the key. A payload or carry
    that is not JSON fails the batch. An arrival that is no merge is a job of its own.
    """
    first = dedup_candidates(jobs)
    history = journal.join(first.select(F.col("id").alias("job_id")), "job_id", "left_semi").groupBy("job_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "run_no", "outcome", "note", "attachment")))).alias("history"))
    candidates = first.join(history, first["id"] == history["job_id"], "left").select("kind", "dedup_key", F.col("id").alias("c_id"), F.col("payload").alias("c_payload"), F.col("carry").alias("c_carry"), F.col("priority").alias("c_priority"), F.col("run_count").alias("c_runs"), "history")
    keyed, free = arrivals.where(F.col("dedup_key").isNotNull()), arrivals.where(F.col("dedup_key").isNull())
    rows = keyed.join(candidates, ["kind", "dedup_key"], "left")

    types = {"id": pa.string(), "kind": pa.string(), "payload": pa.string(), "priority": pa.int16(), "carry": pa.string(), "dedup_key": pa.string(), "visible_at": pa.timestamp("us"), "run_no": pa.int32(), "arrival": pa.int64(), "merged": pa.bool_(), "target": pa.string(), "final": pa.bool_(), "fresh": pa.bool_()}
    blank = dict.fromkeys(types) | {"merged": False, "final": False, "fresh": False}

    def one(target: dict[str, Any] | None, a: dict[str, Any]) -> tuple[dict[str, Any], dict[str, Any]]:
        """(the key's standing job, the row to be said) after an arrival."""
        payload = json.loads(a["payload"])
        said = merge(Pending(target["payload"], target["carry"], target["run_no"], target["history"]), payload) if target else INDEPENDENT
        base = blank | {k: a[k] for k in ("kind", "dedup_key", "arrival")}
        if said == INDEPENDENT:
            own = {"id": a["id"], "kind": a["kind"], "payload": payload, "carry": json.loads(a["carry"]), "priority": a["priority"], "run_no": 0, "history": [], "touched": False}
            return target or own, base | {"id": a["id"], "payload": a["payload"], "priority": a["priority"], "carry": a["carry"], "visible_at": a["visible_at"], "run_no": 0, "target": a["id"], "fresh": True}
        if said == REPLACE:
            target |= {"payload": payload, "carry": json.loads(a["carry"]), "priority": a["priority"], "touched": True}
        elif said != KEEP:
            _, new_payload, new_carry, priority = said
            target |= {"payload": new_payload, "carry": new_carry, "priority": a["priority"] if priority is None else priority, "touched": True}
        target["history"].append({"id": None, "run_no": target["run_no"], "outcome": "merged", "note": None, "attachment": None})
        return target, base | {"run_no": target["run_no"], "merged": True, "target": target["id"]}

    def last(target: dict[str, Any] | None) -> list[dict[str, Any]]:
        if not target or not target["touched"]:
            return []
        return [blank | {"id": target["id"], "kind": target["kind"], "payload": json.dumps(target["payload"], separators=(",", ":")), "priority": target["priority"], "carry": json.dumps(target["carry"], separators=(",", ":")), "run_no": target["run_no"], "target": target["id"], "final": True}]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys come one after another, each in the order of arrival; one standing job is held at a time."""
        key, target = None, None
        for batch in batches:
            out = []
            for a in batch.to_pylist():
                if (a["kind"], a["dedup_key"]) != key:
                    out += last(target)
                    key, target = (a["kind"], a["dedup_key"]), None
                    if a["c_id"] is not None:
                        target = {"id": a["c_id"], "kind": a["kind"], "payload": json.loads(a["c_payload"]), "carry": json.loads(a["c_carry"]), "priority": a["c_priority"], "run_no": a["c_runs"], "history": json.loads(a["history"] or "[]"), "touched": False}
                target, said = one(target, a)
                out.append(said)
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in types.items()], names=list(types))
        if rest := last(target):
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rest], t) for c, t in types.items()], names=list(types))

    folded = rows.repartition("kind", "dedup_key").sortWithinPartitions("kind", "dedup_key", "arrival").mapInArrow(fold, _FOLDED)
    made = _new_rows(folded.where("fresh").select(*arrivals.columns), now).unionByName(_new_rows(free, now))
    final = folded.where("final").select(F.col("target").alias("_t"), F.struct("payload", "priority", "carry").alias("w"))
    everything = jobs.select(*JOB_COLUMNS).unionByName(made)
    met = everything.join(final, everything["id"] == final["_t"], "left")
    new = {"payload": F.col("w.payload"), "carry": F.col("w.carry"), "priority": checked_priority(F.col("w.priority"))}
    after = met.select(*[F.when(F.col("w").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in JOB_COLUMNS])
    entries = _entries(folded.where("merged").select(F.col("target").alias("job_id"), "kind", "run_no"), now)
    placed = folded.where(~F.col("final")).select("arrival", F.col("target").alias("id"), "merged").unionByName(free.select("arrival", "id", F.lit(False).alias("merged")))
    return Submitted(after, entries, placed)
