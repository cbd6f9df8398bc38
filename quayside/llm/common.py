"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The same mapping for bytes; UTF-8 continuation bytes are never in A-Z.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())

#: Shuffle files of a finished write are of no use; Spark can delete them at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset, as in
    local tests, a temporary folder of this machine takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quayside-"))
    return context.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder, which goes when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(_located(spark, path))
    return path


#: Tables that this process has written, as (file system, path) of the JVM.
_written: list[tuple[Any, Any]] = []


def _located(spark: SparkSession, path: str) -> tuple[Any, Any]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


@atexit.register
def _sweep() -> None:
    """Results are lazy and may read these tables until the driver ends; then they go."""
    with contextlib.suppress(Exception):  # the JVM may have ended before
        for fs, where in _written:
            fs.delete(where, True)


_writers: dict[str, Any] = {"lock": threading.Lock(), "n": 0, "before": None}


@contextlib.contextmanager
def _clean_shuffles(spark: SparkSession) -> Iterator[None]:
    """CLEANUP holds while at least one thread writes."""
    with _writers["lock"]:
        if not _writers["n"]:
            _writers["before"] = spark.conf.get(CLEANUP)
            spark.conf.set(CLEANUP, "true")
        _writers["n"] += 1
    try:
        yield
    finally:
        with _writers["lock"]:
            _writers["n"] -= 1
            if not _writers["n"]:
                spark.conf.set(CLEANUP, _writers["before"])


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage,
    survives lost executors and gives the planner true sizes."""
    path = shared_path(df.sparkSession, label)
    with _clean_shuffles(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`stored` wrote, once nothing will read it again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        fs, where = _located(df.sparkSession, folder)
        fs.delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_slices(texts: Any, rows: int = 1000) -> Iterator[list[str | None]]:
    """The texts of an Arrow array as Python strings, some at a time, so that a worker does
    not hold a whole batch a second time."""
    for at in range(0, len(texts), rows):
        yield texts.slice(at, rows).to_pylist()


def one_thread() -> None:
    """Keep numeric libraries of a Python worker to its one core."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(name, "1")


def _murmur3(value: int, seed: int = 42) -> int:
    """Spark's hash of an INT column."""
    mask = 0xFFFFFFFF
    k = value * 0xCC9E2D51 & mask
    k = (k << 15 | k >> 17) & mask
    k = k * 0x1B873593 & mask
    h = seed ^ k
    h = (h << 13 | h >> 19) & mask
    h = (h * 5 + 0xE6546B64) & mask
    h ^= 4
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & mask
    h ^= h >> 16
    return h - (1 << 32) if h >= 1 << 31 else h


def partition_keys(n: int) -> list[int]:
    """For each of n partitions an INT key that ``repartition(n, key)`` sends there."""
    found: dict[int, int] = {}
    key = 0
    while len(found) < n:
        found.setdefault(_murmur3(key) % n, key)
        key += 1
    return [found[i] for i in range(n)]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_few_files(df: DataFrame, rows: int, per_task: int) -> DataFrame:
    """``df`` in fewer tasks where it has few rows, so that a small table isn't written as
    one file a shuffle partition. Tables of many rows keep their partitions."""
    least = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(least, -(-rows // per_task)))
