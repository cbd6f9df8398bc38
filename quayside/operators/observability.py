"""Metrics as queries over the relations, and as observations of a running batch."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .schema import OUTCOME_OF, is_failure

#: Upper bounds of histogram buckets, in seconds.
BOUNDS = (0.01, 0.1, 1.0, 10.0, 60.0, 600.0, 3600.0, 86400.0)


def counters(journal: DataFrame) -> DataFrame:
    """Series of counters: settled by outcome, merged and recovered, for each kind."""
    series = F.when(F.col("outcome") == "merged", "merged_total").when(F.col("outcome") == "stale-recovered", "recovered_total").otherwise("settled_total")
    return journal.groupBy(series.alias("series"), "kind", "outcome").agg(F.count(F.lit(1)).alias("value"))


def enqueue_counters(arrivals: DataFrame, placed: DataFrame) -> DataFrame:
    """Of a submitted batch: jobs made and arrivals merged, by kind."""
    rows = arrivals.select("arrival", "kind").join(placed.select("arrival", "merged"), "arrival")
    series = F.when(F.col("merged"), "merged_total").otherwise("enqueued_total")
    return rows.groupBy(series.alias("series"), "kind").agg(F.count(F.lit(1)).alias("value"))


def claim_counters(claims: DataFrame) -> DataFrame:
    """Of a batch of claims: jobs claimed, by kind."""
    return claims.groupBy(F.lit("claimed_total").alias("series"), "kind").agg(F.count(F.lit(1)).alias("value"))


def settle_counters(jobs: DataFrame, commands: DataFrame, outcome: DataFrame) -> DataFrame:
    """Of a batch of settlements: runs settled by kind and outcome, and those among them whose
    guard did not hold."""
    said = commands.select("id", F.element_at(F.create_map(*[F.lit(x) for pair in OUTCOME_OF.items() for x in pair]), F.col("tag")).alias("outcome"))
    rows = said.join(outcome.select("id", "applied"), "id").join(jobs.select("id", "kind"), "id")
    return rows.groupBy(F.lit("settled_total").alias("series"), "kind", "outcome").agg(F.count_if("applied").alias("value"), F.count_if(~F.col("applied")).alias("missed"))


def claim_latency(claims: DataFrame, now: datetime | str) -> DataFrame:
    """A histogram, by kind, of the seconds from a job's creation to its claim."""
    seconds = F.greatest(F.timestamp_diff("MICROSECOND", F.col("created_at"), F.lit(str(now)).cast("timestamp_ntz")), F.lit(0)) / 1e6
    bound = F.lit(None).cast("double")
    for b in reversed(BOUNDS):
        bound = F.when(seconds <= b, F.lit(b)).otherwise(bound)
    return claims.groupBy("kind", bound.alias("le")).agg(F.count(F.lit(1)).alias("value"), F.sum(seconds).alias("sum"))


def handler_durations(results: DataFrame) -> DataFrame:
    """A histogram, by kind, of how long handlers ran, from their reports."""
    seconds = F.col("took_us") / 1e6
    bound = F.lit(None).cast("double")
    for b in reversed(BOUNDS):
        bound = F.when(seconds <= b, F.lit(b)).otherwise(bound)
    return results.where(F.col("took_us").isNotNull()).groupBy("kind", bound.alias("le")).agg(F.count(F.lit(1)).alias("value"), F.sum(seconds).alias("sum"))


def observed(added: DataFrame, name: str = "journal") -> tuple[DataFrame, Observation]:
    """The rows, and the counts that will be known once they have been written."""
    seen = Observation(name)
    return added.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(is_failure(F.col("outcome"))).alias("failures")), seen
