"""Random command sequences against a model of the store in plain Python."""

import random
from datetime import datetime, timedelta

import pytest

from quayside.functions.backoff import Backoff, retry_delay
from quayside.operators import claim, transitions
from quayside.operators.schema import JOBS

T0 = datetime(2024, 1, 1)
KINDS = ["alpha", "beta"]
SETTLE = "id string, claimed_by string, run_no int, tag string, visible_at timestamp_ntz, failure_count int, carry string, note string, attachment string"
OUTCOME = {"complete": "completed", "retry": "retried", "pause": "paused", "dead": "dead", "release": "released"}


class Model:
    """Jobs by id, and the journal; each command sees what the one before it left."""

    def __init__(self):
        self.jobs, self.journal = {}, []

    def note(self, job, outcome, run_no):
        self.journal.append((job["id"], run_no, outcome))

    def settle(self, c, now):
        job = self.jobs.get(c["id"])
        if not job or (job["status"], job["claimed_by"], job["run_count"]) != ("claimed", c["claimed_by"], c["run_no"]):
            return
        tag = c["tag"]
        self.note(job, OUTCOME[tag], c["run_no"])
        job |= {"claimed_by": None, "claim_expires_at": None}
        if tag in ("complete", "dead"):
            job |= {"status": OUTCOME[tag], "finished_at": now}
        else:
            job |= {"status": "pending", "visible_at": c["visible_at"]}
        if tag in ("retry", "dead"):
            job["failure_count"] = c["failure_count"]
        if tag in ("retry", "pause"):
            job["carry"] = c["carry"]

    def recover(self, now):
        stale = sorted((j for j in self.jobs.values() if j["status"] == "claimed" and j["claim_expires_at"] < now), key=lambda j: (j["claim_expires_at"], j["id"]))
        for job in stale[:100]:
            self.note(job, "stale-recovered", job["run_count"])
            delay = retry_delay(Backoff(), 0.5, job["failure_count"] + 1, job["id"])
            job |= {"status": "pending", "claimed_by": None, "claim_expires_at": None, "failure_count": job["failure_count"] + 1, "visible_at": now + timedelta(microseconds=delay // 1000)}

    def claim(self, now, slots, counter, ratio, who):
        taken = 0
        while taken < slots:
            counter += 1
            floor = claim.floor_for(counter, ratio)
            able = [j for j in self.jobs.values() if j["status"] == "pending" and j["visible_at"] <= now]
            best = min(able, key=lambda j: (j["priority"] < floor, j["priority"], j["created_at"], j["id"]), default=None)
            if best is None:
                break
            best |= {"status": "claimed", "claimed_by": who, "claim_expires_at": now + timedelta(seconds=90), "run_count": best["run_count"] + 1}
            taken += 1
        return counter


@pytest.mark.parametrize("seed", range(3))
def test_sequences(spark, job_row, seed):
    rng, model, counter, now, number = random.Random(seed), Model(), 0, T0, 0
    jobs, log = spark.createDataFrame([], JOBS), []
    for _ in range(14):
        now += timedelta(seconds=rng.choice([0, 1, 30, 120]))
        step = rng.choice(["enqueue", "enqueue", "claim", "claim", "settle", "settle", "recover", "extend", "merge"])
        if step == "enqueue":
            new = []
            for _ in range(rng.randint(1, 6)):
                number += 1
                row = job_row(number, kind=rng.choice(KINDS), priority=rng.randrange(3), created_at=now, visible_at=now + timedelta(seconds=rng.choice([0, 0, 60])))
                model.jobs[row["id"]] = row
                new.append(row)
            change = transitions.enqueue(jobs, spark.createDataFrame(new, JOBS).select("id", "kind", "payload", "priority", "visible_at"), now)
        elif step == "claim":
            slots, ratio, who = rng.randint(1, 5), rng.choice([None, 2, 4]), rng.choice(["w:1", "w:2"])
            batch = claim.claim_batch(jobs, KINDS, now, slots, counter, ratio)
            counter = model.claim(now, slots, counter, ratio, who)
            assert batch.counter == counter
            jobs = claim.apply_claims(jobs, batch.rows, now, 90, who)
            change = None
        elif step == "recover":
            model.recover(now)
            change = transitions.recover(jobs, now)
        else:
            picked = rng.sample(sorted(model.jobs), min(len(model.jobs), rng.randint(1, 8)))
            right = lambda j: (j["claimed_by"] if rng.random() < 0.8 else "w:9", j["run_count"] - (rng.random() < 0.1))
            cmds = [(i, *right(model.jobs[i])) for i in picked]
            if step == "settle":
                made = [{"id": i, "claimed_by": w, "run_no": n, "tag": rng.choice(list(OUTCOME)), "visible_at": now + timedelta(seconds=rng.randrange(99)), "failure_count": rng.randrange(5), "carry": str(n), "note": None, "attachment": None} for i, w, n in cmds]
                change = transitions.settle(jobs, spark.createDataFrame(made, SETTLE), now)
                for c in made:
                    model.settle(c, now)
            elif step == "extend":
                change = transitions.extend_lease(jobs, spark.createDataFrame([(*c, 600.0) for c in cmds], "id string, claimed_by string, run_no int, lease_s double"), now)
                for i, w, n in cmds:
                    job = model.jobs[i]
                    if (job["status"], job["claimed_by"], job["run_count"]) == ("claimed", w, n):
                        job["claim_expires_at"] = now + timedelta(seconds=600)
            else:
                change = transitions.merge_into(jobs, spark.createDataFrame([(i, '"m"', "9", 2, None) for i, *_ in cmds], "id string, payload string, carry string, priority short, note string"), now)
                for i, *_ in cmds:
                    job = model.jobs[i]
                    if job["status"] == "pending":
                        job |= {"payload": '"m"', "carry": "9", "priority": 2}
                        model.note(job, "merged", job["run_count"])
        if change is not None:
            jobs = change.jobs
            log += [(r.job_id, r.run_no, r.outcome) for r in change.added.collect()]
        rows = jobs.collect()
        assert sorted(tuple(r) for r in rows) == sorted(tuple(j[c] for c in JOBS.names) for j in model.jobs.values()) or {r.id: r.asDict() for r in rows} == model.jobs
        jobs = spark.createDataFrame(rows, JOBS)
    assert sorted(log) == sorted(model.journal)
