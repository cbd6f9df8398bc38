"""Store, queue, worker and streams, end to end under an explicit clock."""

from datetime import datetime, timedelta

import pytest

from quayside.functions.backoff import MILLI, Backoff
from quayside.operators.queue import Queue
from quayside.operators.reads import HistoryFilter
from quayside.operators.schema import SnapshotConflict
from quayside.operators.tasks import Completed, HandlerPanic, Paused, Task, TaskError
from quayside.operators.transitions import CleanupCriteria
from quayside.operators.worker import Worker
from quayside.sources.store import JobStore

T0 = datetime(2024, 1, 1)
DAY = timedelta(days=1)


@pytest.fixture
def store(spark, tmp_path):
    found = JobStore(spark, str(tmp_path), "q")
    found.migrate()
    return found


def fails_twice(payload, context, state):
    context.carry = (context.carry or 0) + 1
    context.set_attachment({"run": context.run_count, "seen": len(context.history)})
    if context.carry < 3:
        raise TaskError(f"failure {context.carry}")
    return Completed()


def worker(store, **options):
    return Worker(store, concurrency=8, identity="w:1", backoff=Backoff(MILLI, MILLI), jitter_fraction=0, **options)


def test_migrate_is_idempotent(store, spark, tmp_path):
    store.migrate()
    assert store.version() == 1 and store.jobs().count() == 0
    other = JobStore(spark, str(tmp_path), "other")
    other.migrate()
    assert other.version() == store.version() == 1


def test_conflict(store):
    jobs = store.active()
    store.commit(1, jobs)
    with pytest.raises(SnapshotConflict):
        store.commit(1, jobs)
    # A writer that looked before the other published is refused by the file system.
    assert store._put("CURRENT", 3, "{}") and not store._put("CURRENT", 3, "{}")


def test_segments(store, spark, job_row):
    from quayside.operators.schema import JOBS

    queue, task = Queue(store), Task("mode", _by_mode)
    w = worker(store).register(task)
    for _ in range(3):
        queue.enqueue(task, "fine", T0)
        w.step(T0)
    before = store.manifest()
    assert len(before["finished"]) == 3 and len(before["journal"]) == 3 and before["active"] == []
    rows, log = sorted(store.jobs().collect()), sorted(store.journal().collect())
    store.compact()
    store.vacuum(1)
    after = store.manifest()
    assert len(after["finished"]) == 1 and len(after["journal"]) == 1
    assert sorted(store.jobs().collect()) == rows and sorted(store.journal().collect()) == log
    odd = spark.createDataFrame([job_row(1, status="lost")], JOBS)
    odd.write.partitionBy("status").parquet(store._at("jobs", "segment=odd"))
    with pytest.raises(Exception, match="unknown status"):
        store._jobs(["segment=odd/status=lost"]).collect()


def test_retries_then_completes(store):
    queue, task = Queue(store), Task("work", fails_twice, default=0)
    job_id = queue.enqueue(task, None, T0)
    w = worker(store).register(task)
    for i in range(3):
        assert w.step(T0 + i * DAY) == 1
    row = store.job(job_id).first()
    assert (row.status, row.run_count, row.failure_count, row.carry) == ("completed", 3, 2, "2")  # the carry of the last retry
    log = store.timeline(job_id).collect()
    assert [(r.id, r.run_no, r.outcome) for r in log] == [(1, 1, "retried"), (2, 2, "retried"), (3, 3, "completed")]
    assert log[-1].attachment == '{"run":3,"seen":2}' and log[0].note == "failure 1"
    assert queue.cleanup(CleanupCriteria(T0 + 9 * DAY)) == 1
    assert store.jobs().count() == store.journal().count() == 0


def _by_mode(payload, context, state):
    if payload == "permanent":
        raise TaskError.fatal("no")
    if payload == "pause" and context.run_count == 1:
        context.carry = 1
        return Paused(timedelta(hours=1), "later")
    if payload == "panic":
        context.carry, context.attachment = "lost", "lost"
        raise HandlerPanic("broken")
    if payload == "odd":
        context.carry = {(1, 2): 3}
    if payload == "retry":
        raise ValueError("plain")
    return None


def test_outcomes(store):
    queue, task = Queue(store), Task("mode", _by_mode)
    modes = ["permanent", "pause", "panic", "odd", "retry", "fine"]
    ids = dict(zip(modes, queue.enqueue_all(task, modes, T0)))
    w = worker(store, backstop=2).register(task)
    assert w.step(T0) == 6
    got = {m: store.job(i).first() for m, i in ids.items()}
    assert {m: r.status for m, r in got.items()} == {"permanent": "dead", "pause": "pending", "panic": "pending", "odd": "dead", "retry": "pending", "fine": "completed"}
    assert (got["pause"].failure_count, got["pause"].carry, got["pause"].visible_at) == (0, "1", T0 + timedelta(hours=1))
    assert got["panic"].carry == "null"
    assert w.step(T0 + DAY) == 3
    got = {m: store.job(i).first() for m, i in ids.items()}
    assert (got["pause"].status, got["pause"].run_count) == ("completed", 2)
    assert got["retry"].status == got["panic"].status == "dead" and got["retry"].failure_count == 2
    assert "carry is not JSON" in store.timeline(ids["odd"]).first().note


def test_unknown_kind_and_bad_payload(store, spark):
    queue = Queue(store)

    def refuse(payload):
        raise ValueError("cannot read it")

    a = queue.enqueue(Task("gone"), 1, T0)
    b = queue.enqueue(Task("bad"), 1, T0)
    w = worker(store).register(Task("gone")).register(Task("bad", _by_mode, decode=refuse))
    w.step(T0)
    assert [store.job(i).first().status for i in (a, b)] == ["dead", "dead"]
    assert "no handler" in store.timeline(a).first().note


def test_stale_claims_and_release(store):
    queue, task = Queue(store), Task("mode", _by_mode)
    queue.enqueue_all(task, ["fine", "fine"], T0)
    lost = worker(store).register(task)
    assert lost.claim(T0) == 2
    w = Worker(store, concurrency=4, identity="w:2", backoff=Backoff(MILLI, MILLI)).register(task)
    assert w.step(T0 + timedelta(minutes=14)) == 0
    assert w.step(T0 + timedelta(minutes=16)) == 2
    assert lost.run_claimed(T0 + timedelta(minutes=17)) == 0  # its claims are gone
    assert [r.failure_count for r in store.jobs().collect()] == [1, 1]
    queue.enqueue(task, "fine", T0)
    assert w.claim(T0 + DAY) == 1 and w.release(T0 + DAY) == 1
    assert store.query(HistoryFilter(status="pending")).first().run_count == 1


def test_leases_and_caps(store):
    queue = Queue(store)
    long, short = Task("long", _by_mode, lease=lambda p: timedelta(hours=5)), Task("short", _by_mode)
    queue.enqueue_all(long, ["fine"] * 3, T0)
    queue.enqueue_all(short, ["fine"] * 3, T0)
    w = worker(store).register(long, cap=0).register(short)
    assert w.claim(T0) == 4
    got = store.query(HistoryFilter(status="claimed")).collect()
    assert sorted((r.kind, (r.claim_expires_at - T0).total_seconds()) for r in got) == [("long", 18000.0), *[("short", 900.0)] * 3]


def test_run_loop(store):
    queue, task = Queue(store), Task("work", fails_twice, default=0)
    queue.enqueue_all(task, [None] * 5, T0)
    time = [T0]
    w = worker(store).register(task)
    n = w.run(lambda: time[0], lambda d: time.__setitem__(0, time[0] + d), lambda: store.query(HistoryFilter(status="completed")).count() == 5)
    assert n == 15 and time[0] < T0 + timedelta(minutes=5)
    assert Worker(store).run(lambda: T0, lambda d: None, lambda: False) == 0  # no kinds


def test_dedup_through_the_queue(store):
    queue = Queue(store)
    task = Task("sum", _by_mode, default=0, dedup_key=lambda p: "k", merge=lambda old, new: ("with", {"v": old.payload["v"] + new["v"]}, old.carry + 1, None))
    ids = queue.enqueue_all(task, [{"v": 1}, {"v": 2}], T0) + [queue.enqueue(task, {"v": 12}, T0)]
    assert len(set(ids)) == 1
    row = store.jobs().first()
    assert (row.payload, row.carry) == ('{"v":15}', "2")
    assert [r.outcome for r in store.timeline(ids[0]).collect()] == ["merged", "merged"]
    assert [len(p) for p in queue.pages(HistoryFilter(), 1)] == [1]


def test_command_stream(store, spark, tmp_path):
    from quayside.streaming.stream import COMMANDS, command_stream, start_commands

    blank = dict.fromkeys([c.split()[0] for c in COMMANDS.split(", ")])
    rows = [{**blank, "action": "enqueue", "id": f"{i:026d}", "kind": "k", "payload": "1", "priority": 1, "issued_at": T0} for i in range(5)]
    spark.createDataFrame(rows, COMMANDS).write.mode("append").parquet(str(tmp_path / "in"))
    stream = command_stream(spark, str(tmp_path / "in"))
    start_commands(store, stream, str(tmp_path / "cp"), availableNow=True).awaitTermination()
    assert store.jobs().count() == 5
    settle = {**blank, "action": "settle", "id": f"{1:026d}", "claimed_by": "x", "run_no": 1, "tag": "complete", "issued_at": T0}
    spark.createDataFrame([settle, rows[0]], COMMANDS).write.mode("append").parquet(str(tmp_path / "in"))
    start_commands(store, stream, str(tmp_path / "cp"), availableNow=True).awaitTermination()
    assert store.jobs().count() == 5 and store.stats(T0).first().pending == 5


def test_stream_equals_batch(spark):
    from quayside.plans.queries import stream_job_state
    from quayside.sources.derive import event_outcomes, table
    from quayside.streaming.stream import job_states

    d = "/root/testdata/sf0.001"
    assert sorted(stream_job_state(spark, d).collect()) == sorted(job_states(event_outcomes(table(spark, d, "events"))).collect())


def test_notifications(store):
    queue, task = Queue(store), Task("mode", _by_mode)
    merging = Task("merge", _by_mode, dedup_key=lambda p: "k")
    told = lambda: len(store.notifications())
    queue.enqueue_at(task, "fine", T0 + DAY, T0)
    assert told() == 1  # even if it is not visible yet
    queue.enqueue(merging, 1, T0)
    queue.enqueue(merging, 2, T0)
    assert told() == 2  # the merge is silent
    w = worker(store, backstop=None).register(task)
    for payload, wakes in (("fine", 0), ("permanent", 0), ("retry", 1), ("pause", 1)):
        queue.enqueue(task, payload, T0)
        before = told()
        assert w.claim(T0) >= 1 and told() == before
        w.run_claimed(T0)
        assert told() == before + wakes
    queue.enqueue(task, "fine", T0)
    before = told()
    assert w.claim(T0 + timedelta(minutes=30)) >= 1 and w.release(T0 + timedelta(minutes=30)) >= 1 and told() == before + 1
    assert w.claim(T0 + timedelta(minutes=30)) >= 1 and w.recover_stale(T0 + DAY) >= 1 and told() == before + 2


def test_worker_wakes_on_notifications(store, tmp_path):
    from quayside.streaming.stream import start_worker

    queue, task = Queue(store), Task("mode", _by_mode)
    queue.enqueue_all(task, ["fine"] * 3, T0)
    w = worker(store).register(task)
    start_worker(w, str(tmp_path / "cp"), lambda: T0, availableNow=True).awaitTermination()
    assert store.query(HistoryFilter(status="completed")).count() == 3
    queue.enqueue(task, "fine", T0)
    start_worker(w, str(tmp_path / "cp"), lambda: T0, availableNow=True).awaitTermination()
    assert store.query(HistoryFilter(status="completed")).count() == 4


def test_drain_releases_what_has_not_begun(store):
    queue, task = Queue(store), Task("mode", _by_mode)
    queue.enqueue_all(task, ["fine"] * 3, T0)
    w = worker(store, shutdown_timeout=timedelta(0)).register(task)
    assert w.claim(T0) == 3
    assert w.run(lambda: T0, lambda d: None, lambda: True) == 3
    rows = store.jobs().collect()
    assert {(r.status, r.run_count, r.failure_count) for r in rows} == {("pending", 1, 0)}
    assert {r.outcome for r in store.journal().collect()} == {"released"}
    assert Worker(store, identity="w:2", concurrency=3).register(task).step(T0) == 3


def test_stress(store):
    def flaky(payload, context, state):
        context.carry += 1
        if context.carry <= payload["fail_times"]:
            raise TaskError("again")

    queue, task = Queue(store), Task("stress", flaky, default=0)
    queue.enqueue_all(task, [{"index": i, "fail_times": i % 3} for i in range(60)], T0)
    workers = [Worker(store, concurrency=8, identity=f"w:{i}", backoff=Backoff(MILLI, MILLI), jitter_fraction=0).register(task) for i in range(3)]
    now = T0
    for _ in range(20):
        now += timedelta(seconds=1)
        if not sum(w.step(now) for w in workers):
            break
    rows = store.jobs().collect()
    assert all(r.status == "completed" and r.run_count == int(r.payload.rsplit(":", 1)[1][:-1]) + 1 for r in rows)
    assert store.journal().count() == sum(r.run_count for r in rows)


def test_metrics(spark, store):
    from quayside.operators.observability import claim_latency, counters, handler_durations, observed
    from quayside.operators.reads import with_history
    from quayside.operators.tasks import Registry, run_handlers

    queue, task = Queue(store), Task("mode", _by_mode)
    queue.enqueue_all(task, ["fine", "retry"], T0)
    w = worker(store).register(task)
    w.claim(T0 + timedelta(seconds=5))
    held = store.query(HistoryFilter(status="claimed"))
    assert [(r.le, r.value) for r in claim_latency(held, T0 + timedelta(seconds=5)).collect()] == [(10.0, 2)]
    results = run_handlers(with_history(held, store.journal()), Registry().register(task), T0)
    assert sum(r.value for r in handler_durations(results).collect()) == 2
    w.run_claimed(T0 + timedelta(seconds=6))
    assert {(r.series, r.outcome, r.value) for r in counters(store.journal()).collect()} == {("settled_total", "completed", 1), ("settled_total", "retried", 1)}
    rows, seen = observed(store.journal())
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 2, "failures": 1}
