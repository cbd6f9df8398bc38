"""What handlers may do to a pass, and what plans and writers do under load."""

import sys
import time
from datetime import datetime, timedelta

import pytest

from quayside.functions.backoff import MILLI, Backoff
from quayside.operators import claim, reads, tasks
from quayside.operators.queue import Queue
from quayside.operators.schema import JOBS, JOURNAL, MalformedManifest, SnapshotConflict
from quayside.operators.tasks import Completed, Paused, Registry, Task, TaskError
from quayside.operators.transitions import CleanupCriteria
from quayside.operators.worker import Worker
from quayside.sources.store import JobStore, again

T0 = datetime(2024, 1, 1)


@pytest.fixture
def store(spark, tmp_path):
    found = JobStore(spark, str(tmp_path), "q")
    found.migrate()
    return found


def row(payload="null", kind="k", **changes):
    return {"id": "0" * 26, "kind": kind, "payload": payload, "carry": "5", "run_count": 1, "failure_count": 0, "claimed_by": "w", "claim_expires_at": T0 + timedelta(minutes=15), "history": [], **changes}


def run(task, policy="retry", **options):
    return tasks.run_one(row(), Registry().register(task), None, T0, policy, Backoff(), 0.0, **options)


def exits(payload, context, state):
    context.carry, context.attachment = "lost", "lost"
    sys.exit(3)


def interrupts(payload, context, state):
    raise KeyboardInterrupt


def bad_hook(payload):
    raise SystemExit("no backoff")


def test_nothing_leaves_a_run():
    for handler in (exits, interrupts):
        for policy, result in (("retry", "failed"), ("dead", "fatal")):
            said = run(Task("k", handler), policy)
            assert (said["result"], said["carry"], said["attachment"]) == (result, "5", None) and "panicked" in said["note"]
    assert run(Task("k", lambda p, c, s: None, backoff=bad_hook))["result"] == "failed"
    assert run(Task("k", lambda p, c, s: None, backoff=lambda p: 1 / 0), "dead")["result"] == "fatal"
    assert run(Task("k", lambda p, c, s: None, decode=bad_hook))["result"] == "failed"
    assert run(Task("k", lambda p, c, s: None, decode=lambda p: 1 / 0))["result"] == "fatal"


def test_clock_and_token():
    seen = {}

    def look(payload, context, state):
        seen.update(cancelled=context.is_cancelled(), over=context.lease_over(), token=context.cancellation_token())

    run(Task("k", look))
    assert not seen["cancelled"] and not seen["over"]
    token = tasks.Token()
    token.cancel()
    run(Task("k", look), token=token)
    assert seen["cancelled"] and seen["token"].wait(0)
    tasks.run_one(row(claim_expires_at=T0 - timedelta(seconds=1)), Registry().register(Task("k", look)), None, T0, "retry", Backoff(), 0.0)
    assert seen["over"]


def test_a_straggler_is_aborted():
    marks = []

    def hangs(payload, context, state):
        try:
            while True:
                time.sleep(0.01)
        finally:
            marks.append("ended")

    began = time.monotonic()
    said = run(Task("k", hangs), seconds=0.3)
    assert said["result"] == "released" and said["carry"] == "5" and time.monotonic() - began < 5
    time.sleep(0.5)
    assert marks == ["ended"]
    assert run(Task("k", lambda p, c, s: Completed(1)), seconds=5)["result"] == "completed"
    assert run(Task("k", exits), seconds=5)["result"] == "failed"


def _winds_down(payload, context, state):
    if payload == "hang":
        while True:
            time.sleep(0.01)
    return Paused(timedelta(hours=1)) if context.is_cancelled() else None


def test_drain_cancels_and_aborts(store):
    queue, task = Queue(store), Task("k", _winds_down)
    a, b = queue.enqueue_all(task, ["polls", "hang"], T0)
    w = Worker(store, concurrency=2, identity="w:1", shutdown_timeout=timedelta(seconds=4)).register(task)
    assert w.claim(T0) == 2
    began = time.monotonic()
    assert w.drain(T0) == 2 and time.monotonic() - began < 60
    outcomes = {i: store.timeline(i).first().outcome for i in (a, b)}
    assert outcomes[b] == "released" and outcomes[a] in ("paused", "released")
    assert {(r.status, r.failure_count) for r in store.jobs().collect()} == {("pending", 0)}


def _exits_or_not(payload, context, state):
    if payload == "exit":
        sys.exit(1)


def test_a_poison_job_ends_at_the_backstop(store):
    queue, task = Queue(store), Task("k", _exits_or_not)
    bad, good = queue.enqueue_all(task, ["exit", "fine"], T0)
    w = Worker(store, concurrency=4, identity="w:1", backoff=Backoff(MILLI, MILLI), jitter_fraction=0, backstop=2).register(task)
    assert w.step(T0) == 2 and w.step(T0 + timedelta(days=1)) == 1
    assert {r.id: (r.status, r.failure_count) for r in store.jobs().collect()} == {bad: ("dead", 2), good: ("completed", 0)}


def test_a_stop_ends_a_pass(store):
    queue, task = Queue(store), Task("k", _winds_down)
    queue.enqueue(task, "hang", T0)
    w = Worker(store, concurrency=1, identity="w:1", shutdown_timeout=timedelta(seconds=1)).register(task)
    began = time.monotonic()
    assert w.run(lambda: T0, lambda d: None, lambda: time.monotonic() - began > 8) <= 1
    assert time.monotonic() - began < 90
    assert [(r.status, r.failure_count) for r in store.jobs().collect()] == [("pending", 0)]


def test_writers_try_again(store, monkeypatch):
    tries = []

    def second():
        tries.append(1)
        if len(tries) < 3:
            raise SnapshotConflict("late")
        return "done"

    assert again(second) == "done" and len(tries) == 3
    with pytest.raises(SnapshotConflict):
        again(lambda: (_ for _ in ()).throw(SnapshotConflict("always")), tries=2)
    # Another writer publishes between a worker's look and its commit.
    queue, task = Queue(store), Task("k", _exits_or_not)
    queue.enqueue(task, "fine", T0)
    w = Worker(store, concurrency=2, identity="w:1").register(task)
    plain, raced = store.commit, []

    def racing(base, *args, **options):
        if not raced:
            raced.append(1)
            plain(store.version(), store.active())
        return plain(base, *args, **options)

    monkeypatch.setattr(store, "commit", racing)
    assert w.claim(T0) == 1 and w.counter == 2  # the second attempt finds nothing


def test_history_that_cannot_be_read(store):
    queue, task = Queue(store), Task("k", _exits_or_not)
    queue.enqueue(task, "fine", T0)
    w = Worker(store, concurrency=2, identity="w:1").register(task)
    assert w.claim(T0) == 1
    base = store.version()
    manifest = store.manifest()
    store._publish(base, manifest | {"journal": ["gone"]})
    store._fs.mkdirs(store._path(store._at("journal")))
    assert w._with_history().first().history == []


def test_malformed_manifest(store):
    store._put("CURRENT", 2, '{"schema": 1}')
    with pytest.raises(MalformedManifest):
        store.active()


def test_cleanup_leaves_other_segments(store):
    queue, task = Queue(store), Task("k", _exits_or_not)
    w = Worker(store, concurrency=2, identity="w:1").register(task)
    for day in range(3):
        queue.enqueue(task, "fine", T0 + timedelta(days=day))
        assert w.step(T0 + timedelta(days=day)) == 1
    before = store.manifest()
    assert queue.cleanup(CleanupCriteria(T0 + timedelta(days=1))) == 1
    after = store.manifest()
    assert len(set(before["finished"]) & set(after["finished"])) == 2 and len(set(before["journal"]) & set(after["journal"])) == 2
    assert store.jobs().count() == store.journal().count() == 2
    assert queue.cleanup(CleanupCriteria(T0)) == 0


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_plans_gather_only_what_is_needed(spark, job_row):
    jobs = spark.createDataFrame([job_row(i) for i in range(3)], JOBS)
    journal = spark.createDataFrame([], JOURNAL)
    said = plan(reads.with_history(jobs, journal))
    assert "LeftSemi" in said and said.index("ObjectHashAggregate") < said.index("LeftSemi")
    claims = plan(claim.claim_batch(jobs, ["alpha"], T0, 5000).rows)
    assert "TakeOrderedAndProject" in claims
