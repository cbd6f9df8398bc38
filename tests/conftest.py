import os
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
# Python workers import the package and what tests hand to them.
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), str(ROOT / "tests"), str(ROOT / "tests" / "llm"), os.environ.get("PYTHONPATH", "")])
SMALL = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def job_row():
    """A pending job, with changes."""

    def make(number, **changes):
        row = {
            "id": str(number).rjust(26, "0"), "kind": "alpha", "payload": "null", "priority": 1, "status": "pending", "created_at": T0, "visible_at": T0, "claim_expires_at": None, "claimed_by": None,
            "finished_at": None, "run_count": 0, "failure_count": 0, "carry": "null", "dedup_key": None,
        }
        return {**row, **changes}

    return make


@pytest.fixture
def claimed_row(job_row):
    def make(number, **changes):
        return job_row(number, **{"status": "claimed", "claimed_by": "w:1", "run_count": 1, "claim_expires_at": T0 + timedelta(minutes=15), **changes})

    return make
