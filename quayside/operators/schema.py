"""The two relations, their value domains, validation and errors."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIGH, NORMAL, LOW = 0, 1, 2
PENDING, CLAIMED, COMPLETED, DEAD = "pending", "claimed", "completed", "dead"
STATUSES = (PENDING, CLAIMED, COMPLETED, DEAD)
OUTCOMES = ("completed", "paused", "retried", "dead", "stale-recovered", "released", "merged")
#: Outcomes that count as a failed execution.
FAILURES = ("retried", "dead", "stale-recovered")
#: What each settlement writes to the journal.
OUTCOME_OF = {"complete": "completed", "retry": "retried", "pause": "paused", "dead": "dead", "release": "released"}
#: Settlements that put a job back and so wake workers.
NOTIFYING = ("retry", "pause", "release")
#: Later than any real instant: where adding a duration would overflow.
FAR_FUTURE = "9999-12-31 23:59:59.999999"
MAX_RUN_NO = 2**31 - 1

_STAMP = T.TimestampNTZType()


def _fields(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


JOBS = _fields(
    ("id", T.StringType(), False),
    ("kind", T.StringType(), False),
    ("payload", T.StringType(), False),
    ("priority", T.ShortType(), False),
    ("status", T.StringType(), False),
    ("created_at", _STAMP, False),
    ("visible_at", _STAMP, False),
    ("claim_expires_at", _STAMP, True),
    ("claimed_by", T.StringType(), True),
    ("finished_at", _STAMP, True),
    ("run_count", T.IntegerType(), False),
    ("failure_count", T.IntegerType(), False),
    ("carry", T.StringType(), False),
    ("dedup_key", T.StringType(), True),
)
JOURNAL = _fields(
    ("id", T.LongType(), False),
    ("job_id", T.StringType(), False),
    ("kind", T.StringType(), False),
    ("run_no", T.IntegerType(), False),
    ("recorded_at", _STAMP, False),
    ("outcome", T.StringType(), False),
    ("note", T.StringType(), True),
    ("attachment", T.StringType(), True),
)
JOB_COLUMNS, JOURNAL_COLUMNS = JOBS.names, JOURNAL.names
#: What a handler sees of a journal row.
ENTRY_COLUMNS = ("run_no", "recorded_at", "outcome", "note", "attachment")


class QueueError(Exception):
    """Base of all errors of this package."""


class SerializationError(QueueError):
    pass


class UnknownKind(QueueError):
    def __init__(self, kind: str):
        super().__init__(f"no handler is registered for kind {kind!r}")


class ConfigError(QueueError):
    pass


class InvalidPriority(QueueError):
    def __init__(self, priority: int):
        super().__init__(f"priority {priority} is not 0 (high), 1 (normal) or 2 (low)")


class RunNumberOutOfRange(QueueError):
    def __init__(self, run_no: int):
        super().__init__(f"run number {run_no} does not fit into 31 bits")


class MalformedManifest(QueueError):
    """A published version's manifest cannot be read."""

    def __init__(self, path: str):
        super().__init__(f"manifest {path} is malformed")


class SnapshotConflict(QueueError):
    """Another writer has published a snapshot meanwhile."""


def check_priority(priority: int) -> int:
    if priority not in (HIGH, NORMAL, LOW):
        raise InvalidPriority(priority)
    return priority


def check_run_no(run_no: int) -> int:
    if not 0 <= run_no <= MAX_RUN_NO:
        raise RunNumberOutOfRange(run_no)
    return run_no


def validate_prefix(prefix: str) -> str:
    """A table prefix: a lower-case letter, then lower-case letters, digits and underscores; 39 at most."""
    if len(prefix) > 39 or not re.fullmatch(r"[a-z][a-z0-9_]*", prefix):
        raise ConfigError(f"prefix {prefix!r} must match [a-z][a-z0-9_]* and have 39 characters at most")
    return prefix


def checked_priority(column: Column) -> Column:
    """The column, or an error of the query where it is no priority."""
    valid = column.isin(HIGH, NORMAL, LOW)
    return F.when(valid, column).otherwise(F.raise_error(F.concat(F.lit("invalid priority "), column.cast("string")))).cast("smallint")


def checked_domain(column: Column, values: tuple[str, ...], name: str) -> Column:
    """Stored text outside of its domain is an error, not null."""
    return F.when(column.isin(*values), column).otherwise(F.raise_error(F.concat(F.lit(f"unknown {name} "), F.coalesce(column, F.lit("null")))))


def is_failure(outcome: Column) -> Column:
    return outcome.isin(*FAILURES)


def notifies(tag: Column) -> Column:
    return tag.isin(*NOTIFYING)
