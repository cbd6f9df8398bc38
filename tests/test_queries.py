"""Every query against its SQL on the smallest tables."""

import os
from datetime import datetime, timedelta

import duckdb
import pytest

import __spark_entry__ as driver
from quayside.plans.queries import NOW, QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    want = duck.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("n, kind", [(0, "bigint"), (140, "bigint"), (150, "decimal(38,0)")])
def test_sums_of_waits_beyond_64_bits(spark, tmp_path, n, kind):
    old, new, now = datetime(1, 1, 1), datetime(1998, 5, 31), datetime.fromisoformat(NOW)
    orders = [(30 * i, 1, "O", old, "5-LOW") for i in range(n)] + [(30, 2, "O", new, "5-LOW")] * bool(n)
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1, "A"), (2, "B")], "c_custkey long, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    got = QUERIES["claim_wait_times"](spark, str(tmp_path))
    assert dict(got.dtypes)["waited_us"] == kind
    waits = (now - old) // timedelta(microseconds=1)
    assert (n * waits > 2**63 - 1) == (kind != "bigint")
    assert sorted(got.collect(), key=lambda r: r.kind) == [("A", None, n, n * waits), ("B", 24, 1, 86_400_000_000)][: 2 * bool(n)]


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_capped_claims_keep_their_caps(spark):
    rows = QUERIES["claim_capped_batch"](spark, SMALL).collect()
    kinds = [r.kind for r in rows]
    assert kinds.count("BUILDING") <= 3 and kinds.count("FURNITURE") <= 3 and len({r.id for r in rows}) == len(rows)


@pytest.mark.skipif(os.environ.get("QUAYSIDE_PLANS") == "0", reason="plans are not wanted")
def test_plans_prune_and_push(spark):
    plan = QUERIES["claim_strict_topk"](spark, SMALL)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    assert "c_acctbal" not in plan.split("== Physical Plan ==")[1]
    assert "WindowGroupLimit" in QUERIES["dedup_candidates"](spark, SMALL)._jdf.queryExecution().toString()
