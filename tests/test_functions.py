import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from quayside.functions import ulid
from quayside.functions.backoff import MILLI, SATURATED, SECOND, Backoff, base_delay_column, fib_minus_one, jitter_units, retry_delay, retry_delay_column, splitmix64
from quayside.operators.claim import floor_for, rotate
from quayside.operators.schema import ConfigError, InvalidPriority, RunNumberOutOfRange, check_priority, check_run_no, validate_prefix

ID = "01ARZ3NDEKTSV4RRFFQ69G5FAV"


def test_curve():
    assert [fib_minus_one(n) for n in range(0, 9)] == [0, 0, 0, 1, 2, 4, 7, 12, 20]
    assert fib_minus_one(500) == SATURATED


def test_clamps():
    assert Backoff(0, 0) == Backoff(MILLI, MILLI)
    assert Backoff(5 * SECOND, SECOND).cap == 5 * SECOND
    assert Backoff().base_delay(10**6) == 120 * SECOND


def test_known_mixes():
    assert splitmix64(np.arange(3)).tolist() == [16294208416658607535, 10451216379200822465, 10905525725756348110]
    assert ulid.decode(ID) == 0x1563E3AB5D3D6764C61EFB99302BD5B


@pytest.mark.parametrize(("attempt", "unit", "delay"), [(1, 0.07920833189837817, 0), (3, 0.754061940463762, 438515485), (8, 0.8005706795270565, 9002853397), (14, 0.46901901700221826, 88141141020)])
def test_jitter(attempt, unit, delay):
    assert jitter_units([ID], np.array([attempt]))[0] == unit
    assert retry_delay(Backoff(), 0.5, attempt, ID) == delay


def test_no_jitter_is_exact():
    assert retry_delay(Backoff(100 * SECOND, 10**6 * SECOND), 0, 3, ID) == 100 * SECOND


@given(st.integers(0, 2**128 - 1), st.integers(1, 60), st.floats(0, 1))
def test_delay_bounds(value, attempt, fraction):
    job_id = ulid.encode(value)
    assert ulid.decode(job_id) == value
    high, low = ulid.halves([job_id])
    assert int(high[0]) << 64 | int(low[0]) == value
    base = Backoff().base_delay(attempt)
    delay = retry_delay(Backoff(), fraction, attempt, job_id)
    assert int(base * (1 - fraction)) <= delay <= base
    assert delay == retry_delay(Backoff(), fraction, attempt, job_id)


@pytest.mark.parametrize("bad", ["", ID.lower(), ID[:-1], "8" + ID[1:], ID[:-1] + "U"])
def test_bad_ids(bad):
    with pytest.raises(ValueError):
        ulid.decode(bad)


@given(st.integers(0, 2**128 - 1), st.integers(0, 2**128 - 1))
def test_text_order_is_number_order(a, b):
    assert (a < b) == (ulid.encode(a) < ulid.encode(b))


def test_columns(spark):
    from pyspark.sql import functions as F

    rows = spark.range(1, 20).select(F.lit(ID).alias("job"), F.col("id").cast("int").alias("a"))
    got = rows.select("a", base_delay_column(F.col("a"), Backoff()).alias("b"), retry_delay_column(F.col("job"), F.col("a"), Backoff(), 0.5).alias("d")).collect()
    assert all(r.b == Backoff().base_delay(r.a) and r.d == retry_delay(Backoff(), 0.5, r.a, ID) for r in got)


def test_rotation_table():
    assert [floor_for(c, 2) for c in (1, 2, 3, 4)] == [0, 1, 0, 2]
    assert {floor_for(c, r) for c in range(50) for r in (None, 0, 1)} == {0}
    for ratio, shares in ((2, [2, 1, 1]), (3, [6, 2, 1]), (4, [12, 3, 1])):
        floors = [floor_for(c, ratio) for c in range(1, ratio**2 + 1)]
        assert [floors.count(f) for f in range(3)] == shares


@given(st.lists(st.integers(0, 12), min_size=3, max_size=3), st.integers(0, 20), st.integers(0, 30), st.sampled_from([None, 1, 2, 3, 4]))
def test_rotation_equals_single_claims(counts, slots, counter, ratio):
    left, expected, c = list(counts), [], counter
    while len(expected) < slots:
        c += 1
        floor = floor_for(c, ratio)
        tier = next((p for p in range(floor, 3) if left[p]), next((p for p in range(3) if left[p]), None))
        if tier is None:
            break
        left[tier] -= 1
        expected.append((tier, counts[tier] - left[tier]))
    picks, after = rotate(counts, slots, counter, ratio)
    assert [p[2:] for p in picks] == expected and after == c


def test_validation():
    assert validate_prefix("a_1") == "a_1"
    for bad in ("", "A", "1a", "a-b", "a" * 40):
        with pytest.raises(ConfigError):
            validate_prefix(bad)
    with pytest.raises(InvalidPriority):
        check_priority(3)
    with pytest.raises(RunNumberOutOfRange):
        check_run_no(2**31)
