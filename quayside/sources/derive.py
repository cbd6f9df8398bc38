"""Jobs and journal as views over orders, customers and events, at any scale.

Only integers and whole days and hours take part, so that SQL gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The clock of everything that is derived.
NOW = "1998-06-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    days = lambda n: F.expr(f"o_orderdate + make_dt_interval(cast({n} as int))")
    hours = lambda n: F.expr(f"o_orderdate + make_dt_interval(0, cast({n} as int))")
    status = F.expr("CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'claimed' ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'dead' ELSE 'completed' END END")
    runs = (key % 6).cast("int") + F.when(F.col("o_orderstatus") == "O", 0).otherwise(1)
    return rows.select(
        F.lpad(key.cast("string"), 26, "0").alias("id"),
        F.col("c_mktsegment").alias("kind"),
        F.concat(F.lit('{"custkey":'), F.col("o_custkey").cast("string"), F.lit("}")).alias("payload"),
        F.expr("CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 WHEN o_orderpriority = '5-LOW' THEN 2 ELSE 1 END").cast("smallint").alias("priority"),
        status.alias("status"),
        F.col("o_orderdate").alias("created_at"),
        days("o_orderkey % 30").alias("visible_at"),
        F.when(F.col("o_orderstatus") == "P", hours("o_orderkey % 48")).alias("claim_expires_at"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("host:"), (F.col("o_custkey") % 8).cast("string"))).alias("claimed_by"),
        F.when(F.col("o_orderstatus") == "F", hours("o_orderkey % 90")).alias("finished_at"),
        runs.alias("run_count"),
        F.least((key % 4).cast("int"), runs).alias("failure_count"),
        F.lit("null").alias("carry"),
        F.when(key % 3 != 0, F.col("o_custkey").cast("string")).alias("dedup_key"),
    )


def event_outcomes(events: DataFrame) -> DataFrame:
    """(id, job_id, outcome) of events; of a stream as well as of a table."""
    outcome = F.expr(
        """CASE WHEN event_id % 11 = 0 THEN 'stale-recovered' WHEN event_id % 13 = 0 THEN 'released'
        ELSE CASE event_type WHEN 'view' THEN 'paused' WHEN 'click' THEN 'retried' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'dead' ELSE 'merged' END END"""
    )
    return events.select(F.col("event_id").alias("id"), F.lpad(F.col("user_id").cast("string"), 26, "0").alias("job_id"), outcome.alias("outcome"), *[c for c in events.columns if c not in ("id", "job_id", "outcome")])


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_outcomes(table(spark, sf_dir, "events"))
    kinds = jobs(spark, sf_dir).select(F.col("id").alias("job_id"), "kind")
    run_no = F.row_number().over(Window.partitionBy("job_id").orderBy("id"))
    rows = rows.select("id", "job_id", run_no.alias("run_no"), F.col("ts").alias("recorded_at"), "outcome", F.lit(None).cast("string").alias("note"), F.col("props").alias("attachment"))
    return rows.join(kinds, "job_id").select("id", "job_id", "kind", "run_no", "recorded_at", "outcome", "note", "attachment")


#: The same in DuckDB's SQL, for the head of a WITH.
SQL = """
jobs AS (
    SELECT lpad(o_orderkey::VARCHAR, 26, '0') AS id, c_mktsegment AS kind, '{"custkey":' || o_custkey::VARCHAR || '}' AS payload,
        (CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 WHEN o_orderpriority = '5-LOW' THEN 2 ELSE 1 END)::SMALLINT AS priority,
        CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'claimed' ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'dead' ELSE 'completed' END END AS status,
        o_orderdate AS created_at, o_orderdate + (o_orderkey % 30) * INTERVAL 1 DAY AS visible_at,
        CASE WHEN o_orderstatus = 'P' THEN o_orderdate + (o_orderkey % 48) * INTERVAL 1 HOUR END AS claim_expires_at,
        CASE WHEN o_orderstatus = 'P' THEN 'host:' || (o_custkey % 8)::VARCHAR END AS claimed_by,
        CASE WHEN o_orderstatus = 'F' THEN o_orderdate + (o_orderkey % 90) * INTERVAL 1 HOUR END AS finished_at,
        ((o_orderkey % 6) + CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END)::INTEGER AS run_count,
        least(o_orderkey % 4, (o_orderkey % 6) + CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END)::INTEGER AS failure_count,
        'null' AS carry, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey::VARCHAR END AS dedup_key
    FROM orders JOIN customer ON o_custkey = c_custkey
), journal AS (
    SELECT event_id AS id, lpad(user_id::VARCHAR, 26, '0') AS job_id, jobs.kind, (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INTEGER AS run_no, ts AS recorded_at,
        CASE WHEN event_id % 11 = 0 THEN 'stale-recovered' WHEN event_id % 13 = 0 THEN 'released'
            ELSE CASE event_type WHEN 'view' THEN 'paused' WHEN 'click' THEN 'retried' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'dead' ELSE 'merged' END END AS outcome,
        NULL::VARCHAR AS note, props AS attachment
    FROM events JOIN jobs ON jobs.id = lpad(user_id::VARCHAR, 26, '0')
)
"""
