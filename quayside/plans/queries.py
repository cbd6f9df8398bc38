"""Every operator as a query over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.backoff import Backoff, base_delay_column, jitter_unit, retry_delay_column
from ..operators import claim, dedup, observability, reads, tasks, transitions
from ..sources import derive
from ..sources.derive import NOW, jobs, journal
from ..streaming.stream import STATE_STORE, job_states

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
KINDS = ["BUILDING", "MACHINERY", "FURNITURE"]
IN_KINDS = "kind IN ('BUILDING', 'MACHINERY', 'FURNITURE')"
NOW_SQL = f"TIMESTAMP '{NOW}'"
SLOTS, RATIO, LEASE = 40, 4, 900.0
LONG_MAX = 2**63 - 1
STATE = ["id", "status", "priority", "visible_at", "claim_expires_at", "claimed_by", "finished_at", "run_count", "failure_count", "carry"]
STATE_SQL = ", ".join(STATE)


def query(name: str, sql: str | None = None, *, recursive: bool = False, plain: bool = False) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            head = "" if plain else f"WITH {'RECURSIVE ' if recursive else ''}{derive.SQL}"
            SQL[name] = head + sql
        return f

    return add


def numbered(df: DataFrame) -> DataFrame:
    """The number that a derived id spells."""
    return df.withColumn("n", F.col("id").cast("bigint"))


# Statistics


@query("backlog_stats", f"SELECT kind, count(*) AS pending, min(created_at) AS oldest_created_at, greatest(date_diff('microsecond', min(created_at), {NOW_SQL}), 0)::BIGINT AS oldest_age_us FROM jobs WHERE status = 'pending' GROUP BY kind")
def backlog_stats(spark, d):
    return reads.backlog(jobs(spark, d), NOW)


@query("claimed_count", "SELECT count(*) AS claimed FROM jobs WHERE status = 'claimed'")
def claimed_count(spark, d):
    return reads.claimed_count(jobs(spark, d))


@query("dead_by_kind", "SELECT kind, count(*) AS dead FROM jobs WHERE status = 'dead' GROUP BY kind")
def dead_by_kind(spark, d):
    return reads.dead_by_kind(jobs(spark, d))


@query(
    "snapshot_stats",
    f"""SELECT kind, count(*) FILTER (status = 'pending') AS pending, greatest(date_diff('microsecond', min(created_at) FILTER (status = 'pending'), {NOW_SQL}), 0)::BIGINT AS oldest_age_us,
    count(*) FILTER (status = 'claimed') AS claimed, count(*) FILTER (status = 'dead') AS dead FROM jobs WHERE status <> 'completed' GROUP BY kind""",
)
def snapshot_stats(spark, d):
    return reads.snapshot(jobs(spark, d), NOW)


@query("outcome_counts", "SELECT kind, outcome, count(*) AS n, outcome IN ('retried', 'dead', 'stale-recovered') AS failure FROM journal GROUP BY kind, outcome")
def outcome_counts(spark, d):
    return reads.outcome_counts(journal(spark, d))


@query(
    "metric_counters",
    "SELECT CASE outcome WHEN 'merged' THEN 'merged_total' WHEN 'stale-recovered' THEN 'recovered_total' ELSE 'settled_total' END AS series, kind, outcome, count(*) AS value FROM journal GROUP BY kind, outcome",
)
def metric_counters(spark, d):
    return observability.counters(journal(spark, d))


@query(
    "claim_wait_times",
    f"""SELECT kind, (CASE WHEN w <= 86400000000 THEN 24 WHEN w <= 2592000000000 THEN 720 WHEN w <= 31536000000000 THEN 8760 END)::INTEGER AS upto_hours, count(*) AS n, sum(w)::BIGINT AS waited_us
    FROM (SELECT kind, greatest(date_diff('microsecond', created_at, {NOW_SQL}), 0) AS w FROM jobs WHERE status = 'pending' AND visible_at <= {NOW_SQL}) GROUP BY 1, 2""",
)
def claim_wait_times(spark, d):
    rows = reads.wait_times(jobs(spark, d), NOW)
    # BIGINT as in the SQL, whose cast fails where a sum passes 64 bits; there all of them keep the type that holds them.
    most = rows.agg(F.max("waited_us")).first()[0]
    return rows if most is not None and most > LONG_MAX else rows.withColumn("waited_us", F.col("waited_us").cast("bigint"))


# Claiming

_TOP = "SELECT id, kind, priority, created_at, visible_at FROM jobs WHERE status = 'pending' AND {kinds} AND priority >= {floor} AND visible_at <= {now} ORDER BY priority, created_at, id LIMIT {k}"
for _name, _floor in (("claim_strict_topk", 0), ("claim_floor1_topk", 1), ("claim_floor2_topk", 2)):
    query(_name, _TOP.format(kinds=IN_KINDS, floor=_floor, now=NOW_SQL, k=50))(lambda spark, d, floor=_floor: claim.next_jobs(jobs(spark, d), KINDS, floor, NOW, 50).select("id", "kind", "priority", "created_at", "visible_at"))

_ROTATION = f"""
, able AS (SELECT * FROM jobs WHERE status = 'pending' AND {IN_KINDS} AND visible_at <= {NOW_SQL}),
c AS (SELECT count(*) FILTER (priority = 0) AS h, count(*) FILTER (priority = 1) AS m, count(*) FILTER (priority = 2) AS l FROM able),
r AS (
    SELECT 0 AS step, 0::BIGINT AS counter, -1 AS tier, 0 AS th, 0 AS tm, 0 AS tl
    UNION ALL
    SELECT step + 1, counter + 1, tier2, th + (tier2 = 0)::INTEGER, tm + (tier2 = 1)::INTEGER, tl + (tier2 = 2)::INTEGER FROM (
        SELECT r.*, CASE floor WHEN 0 THEN CASE WHEN th < h THEN 0 WHEN tm < m THEN 1 WHEN tl < l THEN 2 END
            WHEN 1 THEN CASE WHEN tm < m THEN 1 WHEN tl < l THEN 2 WHEN th < h THEN 0 END
            ELSE CASE WHEN tl < l THEN 2 WHEN th < h THEN 0 WHEN tm < m THEN 1 END END AS tier2
        FROM (SELECT r.*, c.*, CASE WHEN (counter + 1) % {RATIO * RATIO} = 0 THEN 2 WHEN (counter + 1) % {RATIO} = 0 THEN 1 ELSE 0 END AS floor FROM r, c) AS r
    ) WHERE step < {SLOTS} AND tier2 IS NOT NULL
), picks AS (SELECT step, counter, tier, CASE tier WHEN 0 THEN th WHEN 1 THEN tm ELSE tl END AS rank FROM r WHERE step > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY created_at, id) AS rank FROM able)
"""


@query("claim_rotation_batch", _ROTATION + "SELECT step::INTEGER AS step, counter, id, kind, priority, created_at FROM picks JOIN ranked ON tier = priority AND picks.rank = ranked.rank", recursive=True)
def claim_rotation_batch(spark, d):
    return claim.claim_batch(jobs(spark, d), KINDS, NOW, SLOTS, 0, RATIO).rows


@query(
    "claim_post_state",
    _ROTATION
    + f""", claims AS (SELECT id FROM picks JOIN ranked ON tier = priority AND picks.rank = ranked.rank)
    SELECT id, CASE WHEN hit THEN 'claimed' ELSE status END AS status, priority, visible_at, CASE WHEN hit THEN {NOW_SQL} + INTERVAL 900 SECOND ELSE claim_expires_at END AS claim_expires_at,
    CASE WHEN hit THEN 'worker:1' ELSE claimed_by END AS claimed_by, finished_at, (run_count + hit::INTEGER)::INTEGER AS run_count, failure_count, carry
    FROM (SELECT *, id IN (SELECT id FROM claims) AS hit FROM jobs)""",
    recursive=True,
)
def claim_post_state(spark, d):
    rows = jobs(spark, d)
    claims = claim.claim_batch(rows, KINDS, NOW, SLOTS, 0, RATIO).rows
    return claim.apply_claims(rows, claims, NOW, LEASE, "worker:1").select(*STATE)


_CAPPED = f"""
, able AS (
    SELECT id, kind, priority, created_at FROM (SELECT *, row_number() OVER (PARTITION BY kind, priority ORDER BY created_at, id) AS n FROM jobs WHERE status = 'pending' AND {IN_KINDS} AND visible_at <= {NOW_SQL}) WHERE n <= {SLOTS}
), r AS (
    SELECT 0 AS step, 0::BIGINT AS counter, []::VARCHAR[] AS ids, NULL::VARCHAR AS id, 2 AS building, 0 AS furniture
    UNION ALL
    SELECT step + 1, counter + 1, list_append(ids, best), best, building + (kind = 'BUILDING')::INTEGER, furniture + (kind = 'FURNITURE')::INTEGER FROM (
        SELECT r.step, r.counter, r.ids, r.building, r.furniture,
            arg_min(a.id, (a.priority < CASE WHEN (r.counter + 1) % {RATIO * RATIO} = 0 THEN 2 WHEN (r.counter + 1) % {RATIO} = 0 THEN 1 ELSE 0 END, a.priority, a.created_at, a.id)) AS best,
            arg_min(a.kind, (a.priority < CASE WHEN (r.counter + 1) % {RATIO * RATIO} = 0 THEN 2 WHEN (r.counter + 1) % {RATIO} = 0 THEN 1 ELSE 0 END, a.priority, a.created_at, a.id)) AS kind
        FROM r JOIN able a ON NOT list_contains(r.ids, a.id) AND (a.kind <> 'BUILDING' OR r.building < 5) AND (a.kind <> 'FURNITURE' OR r.furniture < 3)
        WHERE r.step < {SLOTS} GROUP BY ALL
    )
)
SELECT r.step::INTEGER AS step, r.counter, r.id, able.kind, able.priority, able.created_at FROM r JOIN able USING (id)
"""


@query("claim_capped_batch", _CAPPED, recursive=True)
def claim_capped_batch(spark, d):
    return claim.claim_capped(jobs(spark, d), {"BUILDING": 5, "MACHINERY": None, "FURNITURE": 3}, {"BUILDING": 2}, NOW, SLOTS, 0, RATIO).rows


# Where no kind reaches its cap, the cap changes nothing.
@query("claim_loosely_capped_batch", _ROTATION + "SELECT step::INTEGER AS step, counter, id, kind, priority, created_at FROM picks JOIN ranked ON tier = priority AND picks.rank = ranked.rank", recursive=True)
def claim_loosely_capped_batch(spark, d):
    return claim.claim_capped(jobs(spark, d), dict.fromkeys(KINDS, SLOTS + 1), {}, NOW, SLOTS, 0, RATIO).rows


@query(
    "claim_shared_out",
    _ROTATION + "SELECT step::INTEGER AS step, id, 'worker:' || ((step - 1) % 3)::VARCHAR AS claimed_by FROM picks JOIN ranked ON tier = priority AND picks.rank = ranked.rank",
    recursive=True,
)
def claim_shared_out(spark, d):
    rows = claim.claim_batch(jobs(spark, d), KINDS, NOW, SLOTS, 0, RATIO).rows
    return claim.share_out(rows, ["worker:0", "worker:1", "worker:2"]).select("step", "id", "claimed_by")


def _histogram_sql(source: str, seconds: str) -> str:
    le = " ".join(f"WHEN s <= {b} THEN {b}" for b in observability.BOUNDS)
    return f"SELECT kind, (CASE {le} END)::DOUBLE AS le, count(*) AS value, sum(s)::DOUBLE AS sum FROM (SELECT kind, {seconds} AS s FROM {source}) GROUP BY 1, 2"


@query(
    "claim_latency",
    _ROTATION + ", claims AS (SELECT ranked.kind, ranked.created_at FROM picks JOIN ranked ON tier = priority AND picks.rank = ranked.rank) " + _histogram_sql("claims", f"greatest(date_diff('microsecond', created_at, {NOW_SQL}), 0) / 1000000.0::DOUBLE"),
    recursive=True,
)
def claim_latency(spark, d):
    return observability.claim_latency(claim.claim_batch(jobs(spark, d), KINDS, NOW, SLOTS, 0, RATIO).rows, NOW)


@query("metric_claimed", _ROTATION + "SELECT 'claimed_total' AS series, ranked.kind, count(*) AS value FROM picks JOIN ranked ON tier = priority AND picks.rank = ranked.rank GROUP BY 2", recursive=True)
def metric_claimed(spark, d):
    return observability.claim_counters(claim.claim_batch(jobs(spark, d), KINDS, NOW, SLOTS, 0, RATIO).rows)


@query("handler_durations", ", took AS (SELECT kind, id::BIGINT * 100000 AS us FROM jobs WHERE status = 'claimed') " + _histogram_sql("took", "us / 1000000.0::DOUBLE"))
def handler_durations(spark, d):
    """Of made-up reports: a claimed job's number in tenths of a second."""
    return observability.handler_durations(numbered(jobs(spark, d).where("status = 'claimed'")).select("kind", (F.col("n") * 100_000).alias("took_us")))


@query("in_flight_by_kind", "SELECT kind, count(*) AS n FROM jobs WHERE status = 'claimed' AND claimed_by = 'host:3' GROUP BY kind")
def in_flight_by_kind(spark, d):
    return claim.in_flight(jobs(spark, d), "host:3")


@query("floor_schedule", "SELECT c AS counter, (CASE WHEN c % 16 = 0 THEN 2 WHEN c % 4 = 0 THEN 1 ELSE 0 END)::INTEGER AS floor FROM range(1, 257) t(c)", plain=True)
def floor_schedule(spark, d):
    return spark.range(1, 257).select(F.col("id").alias("counter"), claim.floor_column(F.col("id"), 4).alias("floor"))


@query("next_visible", f"SELECT min(visible_at) AS next_visible_at FROM jobs WHERE status = 'pending' AND {IN_KINDS} AND visible_at > {NOW_SQL}")
def next_visible(spark, d):
    return reads.next_visible_at(jobs(spark, d), KINDS, NOW)


@query("wait_duration", f"SELECT (CASE WHEN count(*) = 0 THEN 30000000 ELSE least(greatest(date_diff('microsecond', {NOW_SQL}, min(visible_at)), 5000), 30000000) END)::BIGINT AS wait_us FROM jobs WHERE status = 'pending' AND {IN_KINDS} AND visible_at > {NOW_SQL}")
def wait_duration(spark, d):
    return reads.wait_duration(jobs(spark, d), KINDS, NOW)


# Reads


@query("history_filter", "SELECT id, kind, status, created_at, finished_at FROM jobs WHERE kind = 'BUILDING' AND status = 'completed' AND finished_at >= TIMESTAMP '1996-01-01' AND finished_at < TIMESTAMP '1997-01-01'")
def history_filter(spark, d):
    which = reads.HistoryFilter("BUILDING", "completed", "1996-01-01 00:00:00", "1997-01-01 00:00:00")
    return reads.query_jobs(jobs(spark, d), which).select("id", "kind", "status", "created_at", "finished_at")


_PAGE = "SELECT id, created_at FROM (SELECT id, created_at, row_number() OVER (ORDER BY created_at DESC, id DESC) AS n FROM jobs WHERE kind = 'MACHINERY') WHERE n > {} AND n <= {}"


@query("history_page1", _PAGE.format(0, 50))
def history_page1(spark, d):
    return reads.query_jobs(jobs(spark, d), reads.HistoryFilter("MACHINERY", limit=50)).select("id", "created_at")


@query("history_page2", _PAGE.format(50, 100))
def history_page2(spark, d):
    last = history_page1(spark, d).orderBy("created_at", "id").first()
    before = (last.created_at, last.id) if last else None
    return reads.query_jobs(jobs(spark, d), reads.HistoryFilter("MACHINERY", before=before, limit=50)).select("id", "created_at")


@query("job_lookup", "SELECT id, kind, payload, priority, status, created_at FROM jobs WHERE id = lpad('77', 26, '0')")
def job_lookup(spark, d):
    return reads.job(jobs(spark, d), "77".rjust(26, "0")).select("id", "kind", "payload", "priority", "status", "created_at")


@query("job_timeline", "SELECT id, run_no, recorded_at, outcome, note, attachment FROM journal WHERE job_id = lpad('7', 26, '0')")
def job_timeline(spark, d):
    return reads.timeline(journal(spark, d), "7".rjust(26, "0")).select("id", "run_no", "recorded_at", "outcome", "note", "attachment")


@query(
    "history_context",
    """SELECT jobs.id, coalesce(string_agg(journal.run_no::VARCHAR || ':' || outcome, ',' ORDER BY journal.id), '') AS history, count(*) FILTER (outcome IN ('retried', 'dead', 'stale-recovered')) AS failures
    FROM jobs LEFT JOIN journal ON job_id = jobs.id GROUP BY jobs.id""",
)
def history_context(spark, d):
    rows = reads.with_history(jobs(spark, d), journal(spark, d))
    return rows.select("id", F.concat_ws(",", F.transform("history", lambda e: F.concat_ws(":", e["run_no"].cast("string"), e["outcome"]))).alias("history"), "failures")


@query("stale_scan", f"SELECT id, claim_expires_at, claimed_by FROM jobs WHERE status = 'claimed' AND claim_expires_at < {NOW_SQL} ORDER BY claim_expires_at, id LIMIT 100")
def stale_scan(spark, d):
    return reads.find_stale(jobs(spark, d), NOW).select("id", "claim_expires_at", "claimed_by")


@query("dedup_candidates", "SELECT kind, dedup_key, id FROM (SELECT *, row_number() OVER (PARTITION BY kind, dedup_key ORDER BY created_at, id) AS n FROM jobs WHERE status = 'pending' AND dedup_key IS NOT NULL) WHERE n = 1")
def dedup_candidates(spark, d):
    return reads.dedup_candidates(jobs(spark, d)).select("kind", "dedup_key", "id")


# Backoff

_DELAYS = ", ".join(map(str, Backoff().table()))


@query("backoff_curve", f"SELECT a AS attempt, ([{_DELAYS}])[least(a, {len(Backoff().table())})]::BIGINT AS delay_ns FROM range(1, 41) t(a)", plain=True)
def backoff_curve(spark, d):
    return spark.range(1, 41).select(F.col("id").alias("attempt"), base_delay_column(F.col("id"), Backoff()).alias("delay_ns"))


def _mixed(source: str, column: str, tag: str) -> str:
    """SQL for a CTE ``<tag>`` that adds the mixed column ``<tag>_z`` to ``source``."""
    wrap = "18446744073709551616::UHUGEINT"
    return f"""
    {tag}0 AS (SELECT *, (({column}::UHUGEINT + 11400714819323198485) % {wrap})::UBIGINT AS {tag}_a FROM {source}),
    {tag}1 AS (SELECT *, ((xor({tag}_a, {tag}_a >> 30)::UHUGEINT * 13787848793156543929) % {wrap})::UBIGINT AS {tag}_b FROM {tag}0),
    {tag}2 AS (SELECT *, ((xor({tag}_b, {tag}_b >> 27)::UHUGEINT * 10723151780598845931) % {wrap})::UBIGINT AS {tag}_c FROM {tag}1),
    {tag} AS (SELECT *, xor({tag}_c, {tag}_c >> 31) AS {tag}_z FROM {tag}2)"""


def _jittered(source: str, attempt: str) -> str:
    """CTEs that end in ``delayed``: ``source`` (with id) and unit, base_ns and delay_ns.

    Derived ids are decimal digits, five bits each, in the low half of the identifier."""
    low = f"list_sum(list_transform(range(0, 12), lambda k: (substr(id, 26 - k::INTEGER, 1)::UBIGINT) << (5 * k)::UBIGINT))::UBIGINT"
    return f"""
    , seeded AS (SELECT *, {attempt} AS attempt, xor({low}, ({attempt})::UBIGINT) AS x FROM {source}),
    {_mixed("seeded", "x", "p")}, {_mixed("p", "p_z", "q")},
    unit AS (SELECT *, (q_z >> 11)::DOUBLE / 9007199254740992 AS unit, ([{_DELAYS}])[least(attempt, {len(Backoff().table())})]::BIGINT AS base_ns FROM q),
    delayed AS (SELECT *, trunc(base_ns * (1 - 0.5::DOUBLE * (1 - unit)))::BIGINT AS delay_ns FROM unit)"""


@query("backoff_jitter", _jittered("(SELECT id, failure_count FROM jobs)", "failure_count + 1") + " SELECT id, attempt::INTEGER AS attempt, unit, delay_ns FROM delayed")
def backoff_jitter(spark, d):
    attempt = (F.col("failure_count") + 1).cast("int")
    return jobs(spark, d).select("id", attempt.alias("attempt"), jitter_unit(F.col("id"), attempt).alias("unit"), retry_delay_column(F.col("id"), attempt, Backoff(), 0.5).alias("delay_ns"))


# Writes

_STALE = _jittered(f"(SELECT * FROM jobs WHERE status = 'claimed' AND claim_expires_at < {NOW_SQL} ORDER BY claim_expires_at, id LIMIT 100)", "failure_count + 1")
_LATER = f"{NOW_SQL} + to_microseconds(delay_ns // 1000)"


@query(
    "recover_post_state",
    _STALE
    + f""" SELECT jobs.id, CASE WHEN s.id IS NULL THEN jobs.status ELSE 'pending' END AS status, jobs.priority, CASE WHEN s.id IS NULL THEN jobs.visible_at ELSE {_LATER} END AS visible_at,
    CASE WHEN s.id IS NULL THEN jobs.claim_expires_at END AS claim_expires_at, CASE WHEN s.id IS NULL THEN jobs.claimed_by END AS claimed_by, jobs.finished_at, jobs.run_count,
    (jobs.failure_count + (s.id IS NOT NULL)::INTEGER)::INTEGER AS failure_count, jobs.carry FROM jobs LEFT JOIN delayed s ON s.id = jobs.id""",
)
def recover_post_state(spark, d):
    return transitions.recover(jobs(spark, d), NOW).jobs.select(*STATE)


@query("recover_journal", _STALE + f" SELECT id AS job_id, kind, run_count AS run_no, {NOW_SQL} AS recorded_at, 'stale-recovered' AS outcome, 'lease of ' || claimed_by || ' ran out' AS note, NULL::VARCHAR AS attachment FROM delayed")
def recover_journal(spark, d):
    return transitions.recover(jobs(spark, d), NOW).added


def commands(spark: SparkSession, d: str, tag: str | None = None) -> DataFrame:
    """A settlement for every second job: some of a claim that is gone, of another worker or of another run."""
    rows = numbered(jobs(spark, d)).where("n % 2 = 0")
    return rows.select(
        "id",
        F.when(F.col("n") % 6 == 0, "other:1").otherwise(F.coalesce("claimed_by", F.lit("none:0"))).alias("claimed_by"),
        (F.col("run_count") - F.when(F.col("n") % 10 == 0, 1).otherwise(0)).alias("run_no"),
        (F.lit(tag) if tag else F.element_at(F.array(*[F.lit(t) for t in ("complete", "retry", "pause", "dead", "release")]), ((F.col("n") / 2).cast("bigint") % 5 + 1).cast("int"))).alias("tag"),
        F.expr(f"timestamp_ntz'{NOW}' + make_dt_interval(0, 0, cast(n % 100 as int))").alias("visible_at"),
        (F.col("failure_count") + 1).alias("failure_count"),
        F.concat(F.lit('{"n":'), F.col("n").cast("string"), F.lit("}")).alias("carry"),
        F.concat(F.lit("note "), F.col("n").cast("string")).alias("note"),
        F.lit('{"a":1}').alias("attachment"),
    )


_COMMANDS = f""", cmds AS (
    SELECT id, CASE WHEN id::BIGINT % 6 = 0 THEN 'other:1' ELSE coalesce(claimed_by, 'none:0') END AS claimed_by, run_count - (id::BIGINT % 10 = 0)::INTEGER AS run_no,
        ['complete', 'retry', 'pause', 'dead', 'release'][(id::BIGINT // 2) % 5 + 1] AS mixed, {NOW_SQL} + (id::BIGINT % 100) * INTERVAL 1 MINUTE AS visible_at,
        failure_count + 1 AS failure_count, '{{"n":' || id::BIGINT || '}}' AS carry, 'note ' || id::BIGINT AS note FROM jobs WHERE id::BIGINT % 2 = 0
), met AS (
    SELECT jobs.*, c.visible_at AS c_visible, c.failure_count AS c_failures, c.carry AS c_carry, c.note AS c_note, c.run_no AS c_run, c.mixed,
        c.id IS NOT NULL AS asked, coalesce(jobs.status = 'claimed' AND jobs.claimed_by = c.claimed_by AND jobs.run_count = c.run_no, FALSE) AS hit
    FROM jobs LEFT JOIN cmds c ON c.id = jobs.id
)
"""


def _settled_sql(tag: str) -> str:
    status = {"complete": "completed", "dead": "dead"}.get(tag, "pending")
    back = tag in ("retry", "pause", "release")
    pick = lambda new, old: f"CASE WHEN hit THEN {new} ELSE {old} END AS {old}"
    return (
        _COMMANDS
        + f"SELECT id, {pick(f"'{status}'", 'status')}, priority, {pick('c_visible', 'visible_at') if back else 'visible_at'}, {pick('NULL', 'claim_expires_at')}, {pick('NULL', 'claimed_by')}, "
        + f"{'finished_at' if back else pick(NOW_SQL, 'finished_at')}, run_count, {pick('c_failures', 'failure_count') if tag in ('retry', 'dead') else 'failure_count'}, {pick('c_carry', 'carry') if tag in ('retry', 'pause') else 'carry'} FROM met"
    )


for _tag in ("complete", "retry", "pause", "dead", "release"):
    query(f"settle_{_tag}", _settled_sql(_tag))(lambda spark, d, tag=_tag: transitions.settle(jobs(spark, d), commands(spark, d, tag), NOW).jobs.select(*STATE))


@query(
    "settle_journal",
    _COMMANDS
    + f"""SELECT id AS job_id, kind, c_run AS run_no, {NOW_SQL} AS recorded_at, CASE mixed WHEN 'complete' THEN 'completed' WHEN 'retry' THEN 'retried' WHEN 'pause' THEN 'paused' WHEN 'dead' THEN 'dead' ELSE 'released' END AS outcome,
    c_note AS note, '{{"a":1}}' AS attachment FROM met WHERE hit""",
)
def settle_journal(spark, d):
    return transitions.settle(jobs(spark, d), commands(spark, d), NOW).added


@query("settle_guard_misses", _COMMANDS + "SELECT id, hit AS applied, hit AND mixed IN ('retry', 'pause', 'release') AS notify FROM met WHERE asked")
def settle_guard_misses(spark, d):
    return transitions.settle(jobs(spark, d), commands(spark, d), NOW).outcome


@query(
    "metric_settled",
    _COMMANDS
    + """SELECT 'settled_total' AS series, kind, CASE mixed WHEN 'complete' THEN 'completed' WHEN 'retry' THEN 'retried' WHEN 'pause' THEN 'paused' WHEN 'dead' THEN 'dead' ELSE 'released' END AS outcome,
    count(*) FILTER (hit) AS value, count(*) FILTER (NOT hit) AS missed FROM met WHERE asked GROUP BY 2, 3""",
)
def metric_settled(spark, d):
    rows, said = jobs(spark, d), commands(spark, d)
    return observability.settle_counters(rows, said, transitions.settle(rows, said, NOW).outcome)


@query(
    "settlement_routing",
    _jittered("(SELECT * FROM jobs WHERE status = 'claimed')", "failure_count + 1")
    + f""", said AS (SELECT *, ['completed', 'paused', 'failed', 'fatal'][id::BIGINT % 4 + 1] AS result FROM delayed)
    SELECT id, CASE WHEN result = 'completed' THEN 'complete' WHEN result = 'paused' THEN 'pause' WHEN result = 'fatal' OR failure_count + 1 >= 3 THEN 'dead' ELSE 'retry' END AS tag,
    {NOW_SQL} + to_microseconds((CASE result WHEN 'paused' THEN 60000000000 WHEN 'failed' THEN delay_ns ELSE 0 END) // 1000) AS visible_at,
    (failure_count + (result IN ('failed', 'fatal'))::INTEGER)::INTEGER AS failure_count FROM said""",
)
def settlement_routing(spark, d):
    rows = numbered(jobs(spark, d).where("status = 'claimed'"))
    said = F.element_at(F.array(*[F.lit(t) for t in ("completed", "paused", "failed", "fatal")]), (F.col("n") % 4 + 1).cast("int"))
    results = rows.select("id", "claimed_by", F.col("run_count").alias("run_no"), "failure_count", said.alias("result"), F.lit(60_000_000_000).alias("pause_ns"), "carry", F.lit(None).cast("string").alias("note"), F.lit(None).cast("string").alias("attachment"))
    return transitions.settlements_for(results, NOW, Backoff(), 0.5, 3).select("id", "tag", "visible_at", "failure_count")


@query(
    "extend_lease_post_state",
    _COMMANDS
    + f"""SELECT id, CASE WHEN hit THEN {NOW_SQL} + to_microseconds(least(greatest((id::BIGINT % 3000) / 2.0 - 10, 1.0), 31536000.0)::DECIMAL(18, 1)::DOUBLE::BIGINT * 1000000 + ((id::BIGINT % 2 = 1 AND (id::BIGINT % 3000) / 2.0 - 10 > 1)::INTEGER * 500000)) ELSE claim_expires_at END AS claim_expires_at,
    status, run_count FROM met""",
)
def extend_lease_post_state(spark, d):
    leases = numbered(commands(spark, d)).select("id", "claimed_by", "run_no", ((F.col("n") % 3000) / 2.0 - 10).alias("lease_s"))
    return transitions.extend_lease(jobs(spark, d), leases, NOW).jobs.select("id", "claim_expires_at", "status", "run_count")


@query(
    "merge_into_post_state",
    """, c AS (SELECT id, id::BIGINT % 4 = 0 AS keep FROM jobs WHERE id::BIGINT % 2 = 0)
    SELECT jobs.id, CASE WHEN status = 'pending' AND NOT keep THEN '{"merged":1}' ELSE payload END AS payload, CASE WHEN status = 'pending' AND NOT keep THEN '7' ELSE carry END AS carry,
    (CASE WHEN status = 'pending' AND NOT keep THEN 0 ELSE priority END)::SMALLINT AS priority, visible_at, status FROM jobs LEFT JOIN c ON c.id = jobs.id""",
)
def merge_into_post_state(spark, d):
    rows = jobs(spark, d)
    keep = F.col("n") % 4 == 0
    cmds = numbered(rows).where("n % 2 = 0").select("id", F.when(~keep, '{"merged":1}').alias("payload"), F.lit("7").alias("carry"), F.lit(0).alias("priority"), F.lit("by hand").alias("note"))
    return transitions.merge_into(rows, cmds, NOW).jobs.select("id", "payload", "carry", "priority", "visible_at", "status")


_NEW = """, arrivals AS (
    SELECT o_orderkey AS arrival, lpad((o_orderkey + 1000000000)::VARCHAR, 26, '0') AS id, c_mktsegment AS kind, o_orderkey AS v,
        (CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 WHEN o_orderpriority = '5-LOW' THEN 2 ELSE 1 END)::SMALLINT AS priority, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey::VARCHAR END AS dedup_key
    FROM orders JOIN customer ON o_custkey = c_custkey
)
"""


def arrivals(spark: SparkSession, d: str) -> DataFrame:
    rows = derive.table(spark, d, "orders").join(derive.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.col("o_orderkey").alias("arrival"),
        F.lpad((F.col("o_orderkey") + 1_000_000_000).cast("string"), 26, "0").alias("id"),
        F.col("c_mktsegment").alias("kind"),
        F.concat(F.lit('{"v":'), F.col("o_orderkey").cast("string"), F.lit("}")).alias("payload"),
        F.expr("CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 WHEN o_orderpriority = '5-LOW' THEN 2 ELSE 1 END").cast("smallint").alias("priority"),
        F.lit(None).cast("timestamp_ntz").alias("visible_at"),
        F.lit("0").alias("carry"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey").cast("string")).alias("dedup_key"),
    )


@query(
    "enqueue",
    _NEW + f"SELECT id, kind, payload, priority, status, created_at, visible_at, dedup_key FROM jobs UNION ALL SELECT id, kind, '{{\"v\":' || v || '}}', priority, 'pending', {NOW_SQL}, {NOW_SQL}, dedup_key FROM arrivals",
)
def enqueue(spark, d):
    return transitions.enqueue(jobs(spark, d), arrivals(spark, d).drop("arrival"), NOW).jobs.select("id", "kind", "payload", "priority", "status", "created_at", "visible_at", "dedup_key")


_MERGED = (
    _NEW
    + """, cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, dedup_key ORDER BY created_at, id) AS n FROM jobs WHERE status = 'pending' AND dedup_key IS NOT NULL) WHERE n = 1),
x AS (
    SELECT a.*, c.id AS c_id, c.run_count AS c_runs, row_number() OVER (PARTITION BY a.kind, a.dedup_key ORDER BY arrival) AS nth,
        coalesce(c.id, first_value(a.id) OVER (PARTITION BY a.kind, a.dedup_key ORDER BY arrival)) AS survivor
    FROM arrivals a LEFT JOIN cand c ON c.kind = a.kind AND c.dedup_key = a.dedup_key WHERE a.dedup_key IS NOT NULL
), y AS (SELECT *, c_id IS NOT NULL OR nth > 1 AS merged FROM x),
made AS (SELECT id, kind, v, priority FROM y WHERE NOT merged UNION ALL SELECT id, kind, v, priority FROM arrivals WHERE dedup_key IS NULL),
before AS (SELECT id, kind, payload, priority, carry FROM jobs UNION ALL SELECT id, kind, '{"v":' || v || '}', priority, '0' FROM made)
"""
)
_JOB_PART = ["id", "kind", "payload", "priority", "carry"]


@query("dedup_keep", _MERGED + "SELECT * FROM before")
def dedup_keep(spark, d):
    return dedup.submit(jobs(spark, d), arrivals(spark, d), dedup.KEEP, NOW).jobs.select(*_JOB_PART)


@query(
    "dedup_replace",
    _MERGED
    + """, last AS (SELECT survivor, arg_max(v, arrival) AS v, arg_max(priority, arrival) AS p FROM y WHERE merged GROUP BY survivor)
    SELECT id, kind, CASE WHEN survivor IS NULL THEN payload ELSE '{"v":' || last.v || '}' END AS payload, coalesce(last.p, priority)::SMALLINT AS priority, CASE WHEN survivor IS NULL THEN carry ELSE '0' END AS carry
    FROM before LEFT JOIN last ON survivor = id""",
)
def dedup_replace(spark, d):
    return dedup.submit(jobs(spark, d), arrivals(spark, d), dedup.REPLACE, NOW).jobs.select(*_JOB_PART)


@query("dedup_independent", _NEW + "SELECT id, kind, payload, priority, carry FROM jobs UNION ALL SELECT id, kind, '{\"v\":' || v || '}', priority, '0' FROM arrivals")
def dedup_independent(spark, d):
    return dedup.submit(jobs(spark, d), arrivals(spark, d), dedup.INDEPENDENT, NOW).jobs.select(*_JOB_PART)


@query("dedup_placed", _MERGED + "SELECT arrival, survivor AS id, merged FROM y UNION ALL SELECT arrival, id, FALSE FROM arrivals WHERE dedup_key IS NULL")
def dedup_placed(spark, d):
    return dedup.submit(jobs(spark, d), arrivals(spark, d), dedup.REPLACE, NOW).placed


@query("dedup_journal", _MERGED + f"SELECT survivor AS job_id, kind, coalesce(c_runs, 0)::INTEGER AS run_no, {NOW_SQL} AS recorded_at, 'merged' AS outcome FROM y WHERE merged")
def dedup_journal(spark, d):
    return dedup.submit(jobs(spark, d), arrivals(spark, d), dedup.KEEP, NOW).added.select("job_id", "kind", "run_no", "recorded_at", "outcome")


@query("metric_enqueued", _MERGED + "SELECT CASE WHEN merged THEN 'merged_total' ELSE 'enqueued_total' END AS series, kind, count(*) AS value FROM (SELECT kind, merged FROM y UNION ALL SELECT kind, FALSE FROM arrivals WHERE dedup_key IS NULL) GROUP BY 1, 2")
def metric_enqueued(spark, d):
    new = arrivals(spark, d)
    return observability.enqueue_counters(new, dedup.submit(jobs(spark, d), new, dedup.KEEP, NOW).placed)


def _sum_up(pending: dedup.Pending, payload):
    before = pending.payload.get("v", pending.payload.get("custkey"))
    return "with", {"v": before + payload["v"]}, (pending.carry or 0) + 1, None


@query(
    "dedup_with_fold",
    _MERGED
    + """, sums AS (SELECT survivor, sum(v) AS s, count(*) AS n, arg_max(priority, arrival) AS p FROM y WHERE merged GROUP BY survivor)
    SELECT id, kind, CASE WHEN survivor IS NULL THEN payload ELSE '{"v":' || (s + regexp_extract(payload, '[0-9]+')::BIGINT)::VARCHAR || '}' END AS payload, coalesce(p, priority)::SMALLINT AS priority,
    CASE WHEN survivor IS NULL THEN carry ELSE n::VARCHAR END AS carry FROM before LEFT JOIN sums ON survivor = id""",
)
def dedup_with_fold(spark, d):
    return dedup.fold_submit(jobs(spark, d), journal(spark, d), arrivals(spark, d), _sum_up, NOW).jobs.select(*_JOB_PART)


_OLD = "status IN ('completed', 'dead') AND finished_at < TIMESTAMP '1995-01-01'"
_CRITERIA = transitions.CleanupCriteria("1995-01-01 00:00:00")


@query("cleanup_survivors", f"SELECT id, kind, status, finished_at FROM jobs WHERE NOT coalesce({_OLD}, FALSE)")
def cleanup_survivors(spark, d):
    return transitions.cleanup(jobs(spark, d), journal(spark, d), _CRITERIA)[0].select("id", "kind", "status", "finished_at")


@query("cleanup_journal_survivors", f"SELECT id, job_id, outcome FROM journal WHERE job_id NOT IN (SELECT id FROM jobs WHERE {_OLD})")
def cleanup_journal_survivors(spark, d):
    return transitions.cleanup(jobs(spark, d), journal(spark, d), _CRITERIA)[1].select("id", "job_id", "outcome")


@query("cleanup_count", f"SELECT count(*) AS deleted FROM jobs WHERE {_OLD} AND kind = 'BUILDING' AND status = 'dead'")
def cleanup_count(spark, d):
    return transitions.cleanup(jobs(spark, d), journal(spark, d), transitions.CleanupCriteria("1995-01-01 00:00:00", "BUILDING", "dead"))[2]


# User code


def _by_number(payload, context: tasks.Context, state):
    n = payload["custkey"]
    context.carry = n
    if n % 4 == 0:
        raise tasks.TaskError(f"customer {n} is out")
    if n % 4 == 1:
        raise tasks.TaskError.fatal("never again")
    if n % 4 == 2:
        return tasks.Paused(timedelta(minutes=1), {"failures": context.failures()})
    return tasks.Completed({"runs": len(context.history)})


def registry() -> tasks.Registry:
    found = tasks.Registry()
    for kind in KINDS:
        found.register(tasks.Task(kind, _by_number))
    return found


@query(
    "handler_run",
    f""", h AS (SELECT jobs.id, count(journal.id) AS runs, count(*) FILTER (outcome IN ('retried', 'dead', 'stale-recovered')) AS failures FROM jobs LEFT JOIN journal ON job_id = jobs.id GROUP BY jobs.id),
    r AS (SELECT jobs.*, regexp_extract(payload, '[0-9]+')::BIGINT AS n, h.runs, h.failures AS fs, {IN_KINDS} AS known FROM jobs JOIN h USING (id) WHERE status = 'claimed')
    SELECT id, CASE WHEN NOT known THEN 'fatal' ELSE ['failed', 'fatal', 'paused', 'completed'][n % 4 + 1] END AS result, CASE WHEN known THEN n::VARCHAR ELSE carry END AS carry,
    CASE WHEN NOT known THEN 'no handler is registered for kind ''' || kind || '''' WHEN n % 4 = 0 THEN 'customer ' || n || ' is out' WHEN n % 4 = 1 THEN 'never again' END AS note,
    CASE WHEN NOT known THEN NULL WHEN n % 4 = 2 THEN '{{"failures":' || fs || '}}' WHEN n % 4 = 3 THEN '{{"runs":' || runs || '}}' END AS attachment FROM r""",
)
def handler_run(spark, d):
    claimed = reads.with_history(jobs(spark, d).where("status = 'claimed'"), journal(spark, d))
    return tasks.run_handlers(claimed, registry(), datetime.fromisoformat(NOW)).select("id", "result", "carry", "note", "attachment")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir``; in tests, where that is unset, under a temporary one."""
    named, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(named or tempfile.gettempdir()).rstrip('/')}/quayside-{uuid.uuid4().hex}"


@query(
    "stream_job_state",
    """SELECT job_id, count(*) AS runs, count(*) FILTER (outcome IN ('retried', 'dead', 'stale-recovered')) AS failures, max(id) AS last_event, arg_max(outcome, id) AS outcome FROM journal GROUP BY job_id""",
)
def stream_job_state(spark, d):
    """The events table as a stream, taken to its end; each key's last row is its state."""
    # A pattern, as the source wants a folder or a pattern where the table is one file.
    path, schema = f"{d}/events.parque?", derive.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(path)
    rows = derive.event_outcomes(events)
    folder = shared_folder(spark)
    out = f"{folder}/states"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    spark.conf.set(*STATE_STORE)
    job_states(rows).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    states = spark.read.parquet(out)
    return states.groupBy("job_id").agg(F.max_by(F.struct("runs", "failures", "last_event", "outcome"), "runs").alias("s")).select("job_id", "s.*")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backlog by kind: what is pending, and how old the oldest is."""
    return backlog_stats(spark, sf_dir)

