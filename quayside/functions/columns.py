"""Column expressions that several operators share. Time never comes from a clock here."""

from __future__ import annotations

import functools
import operator
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.schema import FAR_FUTURE


def stamp(value: datetime | str) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def plus_nanos(at: Column, nanos: Column) -> Column:
    """at + nanos, to whole microseconds; what would pass the far future is the far future."""
    micros = F.floor(nanos / 1000).cast("bigint")
    room = F.timestamp_diff("MICROSECOND", at, stamp(FAR_FUTURE))
    return F.when(micros >= room, stamp(FAR_FUTURE)).otherwise(F.timestamp_add("MICROSECOND", micros, at))


def plus_seconds(at: Column, seconds: Column) -> Column:
    return plus_nanos(at, (seconds * 1_000_000_000).cast("decimal(38,0)").cast("bigint"))


def micros_between(start: Column, end: Column) -> Column:
    """end - start in microseconds, 0 if that is negative."""
    return F.greatest(F.timestamp_diff("MICROSECOND", start, end), F.lit(0)).cast("bigint")


def all_of(predicates: list[Column]) -> Column:
    """Their conjunction; true if there are none."""
    return functools.reduce(operator.and_, predicates, F.lit(True))


def before_row(created_at: datetime, job_id: str) -> Column:
    """(created_at, id) < (given pair), in the form that Parquet readers can push down."""
    at = stamp(created_at)
    return (F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < job_id))
