"""Delays before a retry: a Fibonacci curve, capped, with jitter that follows from id and attempt."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ulid

MILLI, SECOND = 1_000_000, 1_000_000_000
SATURATED = 2**64 - 1


@cache
def fib_minus_one(n: int) -> int:
    """0, 0, 1, 2, 4, 7, 12, 20 ... for n from 1; 0 below; saturates at 64 bits."""
    a, b = 1, 1
    for _ in range(n - 1):
        a, b = b, a + b
        if a - 1 >= SATURATED:
            return SATURATED
    return a - 1


@dataclass(frozen=True)
class Backoff:
    """base and cap in nanoseconds; base is a millisecond at least, cap no less than base."""

    base: int = 500 * MILLI
    cap: int = 120 * SECOND

    def __post_init__(self) -> None:
        object.__setattr__(self, "base", max(self.base, MILLI))
        object.__setattr__(self, "cap", max(self.cap, self.base))

    def base_delay(self, attempt: int) -> int:
        return min(self.base * fib_minus_one(attempt), self.cap)

    def table(self) -> list[int]:
        """Delays of attempts 1, 2 ... up to the first that is the cap."""
        delays = [self.base_delay(1)]
        while delays[-1] < self.cap:
            delays.append(self.base_delay(len(delays) + 1))
        return delays


def splitmix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit mixer of the SplitMix generator, wrapping."""
    z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def jitter_units(ids: list[str], attempts: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each id and attempt."""
    high, low = ulid.halves(ids)
    mix = splitmix64(high ^ splitmix64(low ^ attempts.astype(np.uint64)))
    return (mix >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def retry_delay(backoff: Backoff, fraction: float, attempt: int, job_id: str) -> int:
    """Nanoseconds to wait before the retry that follows failure number ``attempt``."""
    base = backoff.base_delay(attempt)
    if not base:
        return 0
    unit = float(jitter_units([job_id], np.array([attempt]))[0])
    return int(base * (1 - fraction * (1 - unit)))


@F.pandas_udf(T.DoubleType())
def jitter_unit(ids, attempts):
    import pandas as pd

    return pd.Series(jitter_units(ids.tolist(), attempts.to_numpy()))


def base_delay_column(attempt: Column, backoff: Backoff) -> Column:
    """The curve as an array index; beyond the array the delay is the cap."""
    table = backoff.table()
    delays = F.array(*[F.lit(d).cast("bigint") for d in table])
    return F.when(attempt < 1, F.lit(0).cast("bigint")).otherwise(F.element_at(delays, F.least(attempt, F.lit(len(table))).cast("int")))


def retry_delay_column(job_id: Column, attempt: Column, backoff: Backoff, fraction: float) -> Column:
    """:func:`retry_delay` by column. Without jitter no Python runs."""
    base = base_delay_column(attempt, backoff)
    if fraction == 0:
        return base
    return F.when(base == 0, base).otherwise((base * (1 - fraction * (1 - jitter_unit(job_id, attempt)))).cast("bigint"))
