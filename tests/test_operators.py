import random
from datetime import datetime, timedelta

import pytest

from quayside.functions.backoff import Backoff
from quayside.operators import claim, dedup, reads, transitions
from quayside.operators.schema import JOBS, JOURNAL, ConfigError

T0 = datetime(2024, 1, 1)
KINDS = ["alpha", "beta", "gamma"]


def jobs_of(spark, rows):
    return spark.createDataFrame(rows, JOBS)


def command(row, tag, **changes):
    base = {"id": row["id"], "claimed_by": row["claimed_by"], "run_no": row["run_count"], "tag": tag, "visible_at": T0 + timedelta(hours=1), "failure_count": 7, "carry": "5", "note": "n", "attachment": None}
    return {**base, **changes}


SETTLE = "id string, claimed_by string, run_no int, tag string, visible_at timestamp_ntz, failure_count int, carry string, note string, attachment string"


def test_settle_arms(spark, claimed_row):
    rows = [claimed_row(i, failure_count=2, carry="1") for i in range(5)]
    tags = ["complete", "retry", "pause", "dead", "release"]
    change = transitions.settle(jobs_of(spark, rows), spark.createDataFrame([command(r, t) for r, t in zip(rows, tags)], SETTLE), T0)
    got = {r.id: r for r in change.jobs.collect()}
    after = [got[r["id"]] for r in rows]
    assert [r.status for r in after] == ["completed", "pending", "pending", "dead", "pending"]
    assert [r.failure_count for r in after] == [2, 7, 2, 7, 2]
    assert [r.carry for r in after] == ["1", "5", "5", "1", "1"]
    assert [r.finished_at is not None for r in after] == [True, False, False, True, False]
    assert all(r.claimed_by is None and r.claim_expires_at is None and r.run_count == 1 for r in after)
    assert {r.outcome for r in change.added.collect()} == {"completed", "retried", "paused", "dead", "released"}
    assert {r.id: r.notify for r in change.outcome.collect()} == {r["id"]: t in ("retry", "pause", "release") for r, t in zip(rows, tags)}


@pytest.mark.parametrize("changes", [{"claimed_by": "w:2"}, {"run_no": 2}, {"id": "x" * 26}])
def test_settle_guard(spark, claimed_row, changes):
    row = claimed_row(1)
    change = transitions.settle(jobs_of(spark, [row]), spark.createDataFrame([command(row, "complete", **changes)], SETTLE), T0)
    assert change.jobs.first().status == "claimed" and change.added.count() == 0
    assert [r.applied for r in change.outcome.collect()] == [False]


def test_two_commands_for_a_job_fail(spark, claimed_row):
    row = claimed_row(1)
    change = transitions.settle(jobs_of(spark, [row]), spark.createDataFrame([command(row, "complete"), command(row, "dead")], SETTLE), T0)
    with pytest.raises(Exception, match="two commands"):
        change.jobs.collect()


def test_recover(spark, claimed_row, job_row):
    now = T0 + timedelta(hours=1)
    rows = [claimed_row(1, failure_count=40), claimed_row(2, claim_expires_at=now), job_row(3)]
    change = transitions.recover(jobs_of(spark, rows), now, Backoff(), 0)
    got = {int(r.id): r for r in change.jobs.collect()}
    assert (got[1].status, got[1].failure_count, got[1].visible_at) == ("pending", 41, now + timedelta(seconds=120))  # no backstop here
    assert got[2].status == "claimed"  # a lease that ends just now still holds
    assert [(r.outcome, r.run_no) for r in change.added.collect()] == [("stale-recovered", 1)]


def test_stale_scan_is_bounded(spark, claimed_row):
    rows = [claimed_row(i, claim_expires_at=T0 + timedelta(seconds=i // 3)) for i in range(130)]
    got = reads.find_stale(jobs_of(spark, rows), T0 + timedelta(days=1)).collect()
    assert [int(r.id) for r in got] == list(range(100))


def test_extend_lease(spark, claimed_row):
    row = claimed_row(1)
    for seconds, expected in ((60.0, 60), (0.0, 1), (1e12, 365 * 86400)):
        cmd = spark.createDataFrame([(row["id"], "w:1", 1, seconds)], "id string, claimed_by string, run_no int, lease_s double")
        change = transitions.extend_lease(jobs_of(spark, [row]), cmd, T0)
        assert change.jobs.first().claim_expires_at == T0 + timedelta(seconds=expected)  # shorter than before is fine
        assert change.added.count() == 0


def test_merge_into(spark, job_row, claimed_row):
    rows = [job_row(1, run_count=1), job_row(2), claimed_row(3)]
    schema = "id string, payload string, carry string, priority short, note string"
    cmds = spark.createDataFrame([(rows[0]["id"], '{"v":2}', "0", 0, None), (rows[1]["id"], None, None, None, None), (rows[2]["id"], "1", "0", 0, None)], schema)
    change = transitions.merge_into(jobs_of(spark, rows), cmds, T0)
    got = {int(r.id): r for r in change.jobs.collect()}
    assert (got[1].payload, got[1].priority, got[2].payload, got[3].payload) == ('{"v":2}', 0, "null", "null")
    assert sorted((r.job_id, r.run_no) for r in change.added.collect()) == [(rows[0]["id"], 1), (rows[1]["id"], 0)]


def test_enqueue_rejects_priorities(spark):
    new = spark.createDataFrame([("1" * 26, "alpha", "null", 3)], "id string, kind string, payload string, priority short")
    with pytest.raises(Exception, match="invalid priority"):
        transitions.enqueue(jobs_of(spark, []), new, T0).jobs.collect()


def test_cleanup_cascades(spark, job_row):
    rows = [job_row(1, status="completed", finished_at=T0), job_row(2, status="dead", finished_at=T0 + timedelta(days=2)), job_row(3)]
    journal = spark.createDataFrame([(1, rows[0]["id"], "alpha", 1, T0, "completed", None, None), (2, rows[1]["id"], "alpha", 1, T0, "dead", None, None)], JOURNAL)
    left, entries, deleted = transitions.cleanup(jobs_of(spark, rows), journal, transitions.CleanupCriteria(T0 + timedelta(days=1)))
    assert deleted.first()[0] == 1 and left.count() == 2 and [r.id for r in entries.collect()] == [2]
    with pytest.raises(ConfigError):
        transitions.CleanupCriteria(T0, status="pending")


def test_stats(spark, job_row, claimed_row):
    rows = [job_row(1), job_row(2, visible_at=T0 + timedelta(days=9)), job_row(3, kind="beta"), claimed_row(4), job_row(5, status="dead")]
    got = {r.kind: r for r in reads.snapshot(jobs_of(spark, rows), T0 + timedelta(seconds=2)).collect()}
    assert (got["alpha"].pending, got["alpha"].oldest_age_us, got["alpha"].claimed, got["alpha"].dead) == (2, 2_000_000, 1, 1)
    assert (got["beta"].pending, got["beta"].claimed) == (1, 0)
    before = reads.backlog(jobs_of(spark, rows), T0 - timedelta(days=1)).collect()
    assert all(r.oldest_age_us == 0 for r in before)


def test_pages(spark, job_row):
    rows = [job_row(i, created_at=T0 + timedelta(seconds=i // 3), kind=KINDS[i % 2]) for i in range(10)]
    jobs, seen, before = jobs_of(spark, rows), [], None
    while page := reads.query_jobs(jobs, reads.HistoryFilter(before=before, limit=3)).collect():
        seen += [int(r.id) for r in page]
        before = (page[-1].created_at, page[-1].id)
    assert seen == list(range(9, -1, -1))
    assert reads.query_jobs(jobs, reads.HistoryFilter("beta", before=(T0, "0" * 26))).count() == 0
    with pytest.raises(ConfigError):
        reads.query_jobs(jobs, reads.HistoryFilter(limit=-1))


def test_cursor_is_pushed_down(spark, tmp_path, job_row):
    jobs_of(spark, [job_row(1)]).write.parquet(str(tmp_path / "j"))
    plan = spark.read.parquet(str(tmp_path / "j")).where(reads.HistoryFilter(before=(T0, "5")).predicate())._jdf.queryExecution().toString()
    assert "Or(LessThan(created_at" in plan.replace("PushedFilters: [", "")


def test_sum_of_waits_is_exact(spark, job_row):
    now, old = datetime(9999, 12, 31), datetime(1, 1, 1)
    rows = [job_row(i, created_at=old, visible_at=T0) for i in range(40)] + [job_row(40, created_at=now - timedelta(hours=24))]
    got = {r.upto_hours: (r.n, r.waited_us) for r in reads.wait_times(jobs_of(spark, rows), now).collect()}
    assert got == {None: (40, 40 * ((now - old) // timedelta(microseconds=1))), 24: (1, 86_400_000_000)}
    assert got[None][1] > 2**63 - 1


def test_wait(spark, job_row):
    jobs = jobs_of(spark, [job_row(1, visible_at=T0 + timedelta(seconds=10))])
    wait = lambda now, **k: reads.wait_duration(jobs, KINDS, now, **k).first().wait_us
    assert wait(T0) == 10_000_000
    assert wait(T0 + timedelta(seconds=10, microseconds=-1)) == 5_000
    assert wait(T0 + timedelta(hours=1)) == 30_000_000
    assert wait(T0, poll_max_us=7) == 7


def _one_by_one(rows, caps, held, now, slots, counter, ratio):
    """Claims one at a time, as a worker would make them."""
    left, running, out = list(rows), dict(held), []
    while len(out) < slots:
        kinds = claim.claimable_kinds(running, caps)
        if not kinds:
            break
        counter += 1
        floor = claim.floor_for(counter, ratio)
        able = [r for r in left if r["kind"] in kinds and r["visible_at"] <= now and r["status"] == "pending"]
        order = lambda r: (r["priority"], r["created_at"], r["id"])
        best = min((r for r in able if r["priority"] >= floor), key=order, default=None) or min(able, key=order, default=None)
        if best is None:
            break
        left.remove(best)
        running[best["kind"]] = running.get(best["kind"], 0) + 1
        out.append(best["id"])
    return out, counter


@pytest.mark.parametrize("seed", range(6))
def test_batches_equal_single_claims(spark, job_row, seed):
    rng = random.Random(seed)
    rows = [job_row(i, kind=rng.choice(KINDS), priority=rng.randrange(3), created_at=T0 + timedelta(seconds=rng.randrange(5)), visible_at=T0 + timedelta(seconds=rng.randrange(3)), status=rng.choice(["pending"] * 4 + ["dead"])) for i in range(40)]
    jobs, now, slots, counter, ratio = jobs_of(spark, rows), T0 + timedelta(seconds=1), rng.randrange(1, 16), rng.randrange(20), rng.choice([None, 2, 3, 4])
    plain = claim.claim_batch(jobs, KINDS, now, slots, counter, ratio)
    assert ([r.id for r in plain.rows.orderBy("step").collect()], plain.counter) == _one_by_one(rows, dict.fromkeys(KINDS), {}, now, slots, counter, ratio)
    caps, held = {k: rng.choice([None, 1, 2, 3]) for k in KINDS}, {rng.choice(KINDS): 1}
    capped = claim.claim_capped(jobs, caps, held, now, slots, counter, ratio)
    assert ([r.id for r in capped.rows.orderBy("step").collect()], capped.counter) == _one_by_one(rows, caps, held, now, slots, counter, ratio)


def test_claims_are_applied_once(spark, job_row):
    jobs = jobs_of(spark, [job_row(i) for i in range(6)])
    batch = claim.claim_batch(jobs, KINDS, T0, 4)
    after = claim.apply_claims(jobs, claim.share_out(batch.rows, ["a", "b"]), T0, 60)
    got = after.where("status = 'claimed'").collect()
    assert len(got) == 4 and {r.claimed_by for r in got} == {"a", "b"} and all(r.run_count == 1 and r.claim_expires_at == T0 + timedelta(minutes=1) for r in got)


ARRIVALS = "arrival long, id string, kind string, payload string, priority short, visible_at timestamp_ntz, carry string, dedup_key string"


def arrivals_of(spark, *rows):
    return spark.createDataFrame([(i, f"{900 + i:026d}", "alpha", f'{{"v":{v}}}', p, None, "0", k) for i, (v, p, k) in enumerate(rows)], ARRIVALS)


def test_decisions(spark, job_row):
    old = job_row(1, payload='{"v":10}', carry="3", dedup_key="k", run_count=1, visible_at=T0 + timedelta(hours=1))
    jobs, new = jobs_of(spark, [old]), arrivals_of(spark, (1, 1, "k"), (2, 0, "k"), (3, 2, None), (4, 1, "other"), (5, 1, "other"))
    replaced = dedup.submit(jobs, new, dedup.REPLACE, T0)
    got = {int(r.id): r for r in replaced.jobs.collect()}
    assert sorted(got) == [1, 902, 903]
    assert (got[1].payload, got[1].priority, got[1].carry, got[1].run_count, got[1].visible_at) == ('{"v":2}', 0, "0", 1, old["visible_at"])
    assert got[903].payload == '{"v":5}'
    assert sorted((int(r.job_id), r.run_no) for r in replaced.added.collect()) == [(1, 1), (1, 1), (903, 0)]
    kept = dedup.submit(jobs, new, dedup.KEEP, T0)
    assert {int(r.id): r.payload for r in kept.jobs.collect()} == {1: '{"v":10}', 902: '{"v":3}', 903: '{"v":4}'}
    free = dedup.submit(jobs, new, dedup.INDEPENDENT, T0)
    assert free.jobs.count() == 6 and free.added.count() == 0


@pytest.mark.parametrize("decision", [dedup.KEEP, dedup.REPLACE, dedup.INDEPENDENT])
def test_fold_equals_closed_forms(spark, job_row, decision):
    jobs = jobs_of(spark, [job_row(1, payload='{"v":10}', dedup_key="k"), job_row(2, payload='{"v":11}', dedup_key="k", created_at=T0 - timedelta(1))])
    journal = spark.createDataFrame([], JOURNAL)
    new = arrivals_of(spark, (1, 1, "k"), (2, 0, "k"), (3, 2, None), (4, 1, "o"), (5, 0, "o"))
    a, b = dedup.submit(jobs, new, decision, T0), dedup.fold_submit(jobs, journal, new, lambda pending, payload: decision, T0)
    assert sorted(a.jobs.collect()) == sorted(b.jobs.collect())
    assert sorted(map(str, a.added.collect())) == sorted(map(str, b.added.collect()))
    assert sorted(a.placed.collect()) == sorted(b.placed.collect())


def test_fold_with_user_merge(spark, job_row):
    jobs = jobs_of(spark, [job_row(1, payload='{"v":10}', carry="0", dedup_key="k")])
    done = dedup.fold_submit(jobs, spark.createDataFrame([], JOURNAL), arrivals_of(spark, (5, 1, "k")), lambda p, v: ("with", {"v": p.payload["v"] + v["v"]}, p.carry + 1, None), T0)
    row = done.jobs.first()
    assert (row.payload, row.carry, row.priority) == ('{"v":15}', "1", 1)


def test_ties_and_nulls(spark, job_row):
    rows = [job_row(3, dedup_key="k"), job_row(2, dedup_key="k"), job_row(4)]
    assert [int(r.id) for r in reads.dedup_candidates(jobs_of(spark, rows)).collect()] == [2]
    assert [int(r.id) for r in claim.next_jobs(jobs_of(spark, rows), KINDS, 0, T0, 3).collect()] == [2, 3, 4]
    assert reads.next_visible_at(jobs_of(spark, []), KINDS, T0).first()[0] is None
