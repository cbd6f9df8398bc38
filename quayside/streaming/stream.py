"""Structured Streaming: commands as files that wake a store, and job state by key."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.schema import FAILURES
from ..operators.transitions import enqueue, settle
from ..sources.store import JobStore, again

COMMANDS = "action string, id string, kind string, payload string, priority short, visible_at timestamp_ntz, carry string, dedup_key string, claimed_by string, run_no int, tag string, failure_count int, note string, attachment string, issued_at timestamp_ntz"


def command_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Commands that producers and workers write as Parquet files."""
    return spark.readStream.schema(COMMANDS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def apply_commands(store: JobStore, batch: DataFrame, clock: datetime | None = None) -> int:
    """:func:`_apply`, again on the next version where another writer was faster."""
    return again(lambda: _apply(store, batch, clock))


def _apply(store: JobStore, batch: DataFrame, clock: datetime | None) -> int:
    """Enqueue and settle what a micro-batch holds, as one snapshot; the version after it.

    A batch that comes again after a failure finds its jobs already there or its guards
    failing, so it changes nothing: jobs that exist are not enqueued twice.
    """
    batch.persist()
    try:
        now = clock or batch.agg(F.max("issued_at")).first()[0]
        if now is None:
            return store.version()
        base = store.version()
        asked = batch.where("action = 'enqueue'").dropDuplicates(["id"])
        # Of all jobs ever only those that the batch names are gathered.
        known = store.jobs(base).select("id").join(asked.select("id"), "id", "left_semi")
        new = asked.join(known, "id", "left_anti")
        made = enqueue(store.active(base), new.select("id", "kind", "payload", "priority", "visible_at", F.coalesce("carry", F.lit("null")).alias("carry"), "dedup_key"), now)
        change = settle(made.jobs, batch.where("action = 'settle'").select("id", "claimed_by", "run_no", "tag", "visible_at", "failure_count", "carry", "note", "attachment"), now)
        wakes = new.limit(1).count() > 0 or change.count().first().notify
        return store.commit(base, change.jobs, change.added, notify=wakes)
    finally:
        batch.unpersist()


def start_commands(store: JobStore, commands: DataFrame, checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Feed a store from a stream; a micro-batch is what a notification is elsewhere."""
    trigger = trigger or {"processingTime": "30 seconds"}
    return commands.writeStream.foreachBatch(lambda batch, _: apply_commands(store, batch)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def start_worker(worker: Any, checkpoint: str, clock: Any, **trigger: Any) -> StreamingQuery:
    """Let a worker pass whenever its store notifies.

    The stream reads the folder of notifications; files that came since the last
    micro-batch are one wakeup, and a restart continues from the checkpoint. Work that
    becomes due by time alone is found by the worker's own polling (``Worker.run``)."""
    store = worker.store
    trigger = trigger or {"processingTime": "1 second"}

    def wake(batch: DataFrame, number: int) -> None:
        while worker.step(clock()):
            pass

    wakeups = store.spark.readStream.format("text").load(store.listen_path())
    return wakeups.writeStream.foreachBatch(wake).option("checkpointLocation", checkpoint).trigger(**trigger).start()


#: State by key lives on executors' disks rather than in their memory.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def job_states(journal: DataFrame) -> DataFrame:
    """State of each job as its journal (id, job_id, outcome) comes in, as a table or as a stream
    in update mode: entries, failures and latest outcome.

    Late rows count, and only a later id changes the latest outcome, so the state does not
    depend on how rows fall into batches. Streams should run with :data:`STATE_STORE`.
    """
    failed = F.count_if(F.col("outcome").isin(*FAILURES))
    return journal.groupBy("job_id").agg(F.count(F.lit(1)).alias("runs"), failed.alias("failures"), F.max("id").alias("last_event"), F.max_by("outcome", "id").alias("outcome"))
