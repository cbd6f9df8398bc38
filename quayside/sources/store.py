"""Versioned snapshots of the two relations on any file system that Spark can write.

A version is a small manifest that lists folders of Parquet files:

* ``active``: pending and claimed jobs, written anew by every commit;
* ``finished``: completed and dead jobs, in segments; they never change again, so a commit
  only adds a segment of what has finished in it;
* ``journal``: segments too, one a commit.

So a commit costs what is active and what is new, not the history. Folders have names of
their own and manifests are published by a rename that does not overwrite: of two writers
that started from one version, the second fails with a conflict and has touched nothing of
the first. Readers take the manifest of the highest number and are never disturbed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.reads import HistoryFilter, dedup_candidate, find_stale, job, next_visible_at, query_jobs, snapshot, timeline
from ..operators.schema import CLAIMED, COMPLETED, DEAD, JOB_COLUMNS, JOBS, JOURNAL, JOURNAL_COLUMNS, OUTCOMES, PENDING, STATUSES, MalformedManifest, SnapshotConflict, checked_domain, validate_prefix
from ..operators.transitions import CleanupCriteria, cleanup

#: Layouts so far; a store of an older one is brought up by the steps that follow it, each
#: of which takes a manifest and gives the next one.
SCHEMA_VERSION = 1
MIGRATIONS: dict[int, Callable[[JobStore, dict], dict]] = {}
LIVE, OVER = (PENDING, CLAIMED), (COMPLETED, DEAD)


def again(action: Callable[[], Any], tries: int = 10) -> Any:
    """What an action that ends in a commit returns. Where another writer has published first it
    is done anew, from the version that is then current; nothing of the first try remains."""
    for left in reversed(range(tries)):
        try:
            return action()
        except SnapshotConflict:
            if not left:
                raise


class JobStore:
    """A pair of relations under a validated prefix."""

    def __init__(self, spark: SparkSession, root: str, prefix: str = "quayside"):
        self.spark, self.prefix = spark, validate_prefix(prefix)
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path, conf = hadoop.Path, spark._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(conf)
        self.root = str(self._fs.makeQualified(self._path(root.rstrip("/"))))
        # Renames of a file context fail where the target exists.
        self._context = hadoop.FileContext.getFileContext(self._path(self.root).toUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)

    def _at(self, what: str, *rest: object) -> str:
        return "/".join([f"{self.root}/{self.prefix}_{what}", *map(str, rest)])

    def _numbers(self, what: str) -> list[int]:
        path = self._path(self._at(what))
        if not self._fs.exists(path):
            return []
        return sorted(int(n) for n in (s.getPath().getName() for s in self._fs.listStatus(path)) if n.isdigit())

    def _put(self, what: str, number: int, text: str) -> bool:
        """Write a small file as a whole, unless there is one of this number."""
        draft = self._path(self._at("drafts", uuid.uuid4().hex))
        self._fs.mkdirs(self._path(self._at(what)))
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            self._context.rename(draft, self._path(self._at(what, number)), self._no_options)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def version(self) -> int:
        """The published version; 0 before ``migrate``."""
        return max(self._numbers("CURRENT"), default=0)

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        path = self._at("CURRENT", self.version() if version is None else version)
        text = self.spark.read.text(path, wholetext=True).first()[0]
        try:
            found = json.loads(text)
            sound = isinstance(found["schema"], int) and isinstance(found["last_id"], int) and all(isinstance(f, str) for k in ("active", "finished", "journal") for f in found[k])
        except (ValueError, KeyError, TypeError):
            sound = False
        if not sound:
            raise MalformedManifest(path)
        return found

    def _publish(self, base: int, manifest: dict[str, Any]) -> int:
        if self.version() != base or not self._put("CURRENT", base + 1, json.dumps(manifest)):
            raise SnapshotConflict(f"version {base} is no longer current")
        return base + 1

    def migrate(self) -> None:
        """Lay the relations out, or bring them to the present layout; harmless if repeated."""
        if not self.version():
            try:
                self._publish(0, {"schema": SCHEMA_VERSION, "active": [], "finished": [], "journal": [], "last_id": 0})
            except SnapshotConflict:
                pass  # another process has laid them out
        manifest = self.manifest()
        for step in range(manifest["schema"] + 1, SCHEMA_VERSION + 1):
            manifest = MIGRATIONS[step](self, manifest) | {"schema": step}
            self._publish(self.version(), manifest)

    def _read(self, folders: list[str], what: str, schema) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        base = self._at(what)
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{f}" for f in folders])

    def _jobs(self, folders: list[str]) -> DataFrame:
        rows = self._read(folders, "jobs", JOBS)
        return rows.select(*[checked_domain(F.col(c), STATUSES, "status").alias(c) if c == "status" else F.col(c) for c in JOB_COLUMNS])

    def active(self, version: int | None = None) -> DataFrame:
        """Jobs that may still change: what claims, settlements and merges are about."""
        return self._jobs(self.manifest(version)["active"])

    def jobs(self, version: int | None = None) -> DataFrame:
        manifest = self.manifest(version)
        return self._jobs(manifest["active"] + manifest["finished"])

    def pending(self, version: int | None = None) -> DataFrame:
        return self._jobs([f for f in self.manifest(version)["active"] if f.endswith(f"status={PENDING}")])

    def journal(self, version: int | None = None) -> DataFrame:
        rows = self._read(self.manifest(version)["journal"], "journal", JOURNAL)
        return rows.select(*[checked_domain(F.col(c), OUTCOMES, "outcome").alias(c) if c == "outcome" else F.col(c) for c in JOURNAL_COLUMNS])

    def _write_jobs(self, jobs: DataFrame) -> dict[str, list[str]]:
        """Write jobs into a folder of their own, by status; the folders by kind of status."""
        name = uuid.uuid4().hex
        jobs.select(*JOB_COLUMNS).sortWithinPartitions("status", "priority", "created_at", "id").write.partitionBy("status").parquet(self._at("jobs", f"segment={name}"))
        made = [s.getPath().getName() for s in self._fs.listStatus(self._path(self._at("jobs", f"segment={name}")))]
        return {what: [f"segment={name}/status={s}" for s in kinds if f"status={s}" in made] for what, kinds in (("active", LIVE), ("finished", OVER))}

    def _write_journal(self, rows: DataFrame) -> list[str]:
        name = uuid.uuid4().hex
        rows.select(*JOURNAL_COLUMNS).sortWithinPartitions("job_id", "id").write.parquet(self._at("journal", name))
        return [name]

    def notify(self, version: int) -> None:
        """Tell listeners that jobs may have become available. A notification has no content,
        and several that come before a listener looks count as one."""
        self._put("NOTIFY", version, "")

    def notifications(self) -> list[int]:
        """Versions that have notified."""
        return self._numbers("NOTIFY")

    def listen_path(self) -> str:
        """The folder that a stream of notifications reads."""
        path = self._at("NOTIFY")
        self._fs.mkdirs(self._path(path))
        return path

    def _numbered(self, added: DataFrame, last: int) -> tuple[list[str], int]:
        """Write new journal rows, numbered after ``last`` in the order of (recorded_at, job_id,
        run_no). Ranges of that order are numbered side by side: their sizes, a number for
        each partition, give the offsets."""
        order = ["recorded_at", "job_id", "run_no", "outcome"]
        # Ranges are drawn from a sample, so they are fixed before their sizes are taken.
        draft = self._at("drafts", uuid.uuid4().hex)
        added.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).write.parquet(draft)
        ranged = self.spark.read.parquet(draft)
        offsets, at = [], last
        for p, n in sorted((r["_p"], r.n) for r in ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()):
            offsets.append((p, at))
            at += n
        folders = []
        if at > last:
            starts = F.broadcast(self.spark.createDataFrame(offsets, "_p int, _start long"))  # a row a partition
            folders = self._write_journal(ranged.join(starts, "_p").withColumn("id", F.col("_start") + F.row_number().over(Window.partitionBy("_p").orderBy(*order))))
        self._fs.delete(self._path(draft), True)
        return folders, at

    def commit(self, base: int, active: DataFrame, added: DataFrame | None = None, notify: bool = False) -> int:
        """Publish what has become of the active jobs of version ``base``, with new ones, and
        append journal rows. What is completed or dead by now becomes a finished segment."""
        before = self.manifest(base)
        jobs = self._write_jobs(active)
        journal, last = ([], before["last_id"]) if added is None else self._numbered(added, before["last_id"])
        version = self._publish(base, before | {"active": jobs["active"], "finished": before["finished"] + jobs["finished"], "journal": before["journal"] + journal, "last_id": last})
        if notify:
            self.notify(version)
        return version

    def compact(self) -> int:
        """Write finished and journal segments into one each; contents stay the same."""
        base = self.version()
        before = self.manifest(base)
        finished = self._write_jobs(self._jobs(before["finished"]))["finished"] if len(before["finished"]) > 2 else before["finished"]
        journal = self._write_journal(self.journal(base)) if len(before["journal"]) > 1 else before["journal"]
        return self._publish(base, before | {"finished": finished, "journal": journal})

    def vacuum(self, keep: int = 2) -> None:
        """Delete the folders that none of the latest versions names, and older manifests."""
        versions = self._numbers("CURRENT")
        named: dict[str, set[str]] = {"jobs": set(), "journal": set()}
        for v in versions[-keep:]:
            manifest = self.manifest(v)
            named["jobs"] |= {f.split("/")[0] for f in manifest["active"] + manifest["finished"]}
            named["journal"] |= set(manifest["journal"])
        for what, used in named.items():
            path = self._path(self._at(what))
            for status in self._fs.listStatus(path) if self._fs.exists(path) else []:
                if status.getPath().getName() not in used:
                    self._fs.delete(status.getPath(), True)
        for v in versions[:-keep]:
            self._fs.delete(self._path(self._at("CURRENT", v)), False)

    # Reads
    def query(self, which: HistoryFilter) -> DataFrame:
        return query_jobs(self.jobs(), which)

    def job(self, job_id: str) -> DataFrame:
        return job(self.jobs(), job_id)

    def timeline(self, job_id: str) -> DataFrame:
        return timeline(self.journal(), job_id)

    def stats(self, now: datetime | str) -> DataFrame:
        return snapshot(self.jobs(), now)

    def next_visible_at(self, kinds: list[str], now: datetime | str) -> DataFrame:
        return next_visible_at(self.pending(), kinds, now)

    def find_stale(self, now: datetime | str, limit: int = 100) -> DataFrame:
        return find_stale(self.jobs(), now, limit)

    def dedup_candidate(self, kind: str, key: str) -> DataFrame:
        return dedup_candidate(self.pending(), kind, key)

    def cleanup(self, which: CleanupCriteria) -> int:
        """Delete finished jobs and their journal; the number of jobs. Only segments that hold
        some of them are written anew, or dropped where nothing is left."""
        return again(lambda: self._cleanup(which))

    def _cleanup(self, which: CleanupCriteria) -> int:
        base = self.version()
        before = self.manifest(base)
        finished = self._read(before["finished"], "jobs", JOBS).withColumn("_file", F.input_file_name())
        gone = finished.where(F.coalesce(which.predicate(), F.lit(False)))
        # A row a segment comes to the driver, as in the manifest.
        met = [(r["_s"], r.n) for r in gone.groupBy(F.regexp_extract("_file", r"/(segment=[^/]+/status=[^/]+)/[^/]*$", 1).alias("_s")).agg(F.count(F.lit(1)).alias("n")).collect()]
        n = sum(k for _, k in met)
        if not n:
            return 0
        hit = [f for f in before["finished"] if f in {s for s, _ in met}]
        ids = gone.select(F.col("id").alias("job_id"))
        journal = self._read(before["journal"], "journal", JOURNAL).withColumn("_file", F.input_file_name())
        told = {r["_s"] for r in journal.join(ids, "job_id", "left_semi").groupBy(F.regexp_extract("_file", r"/([^/]+)/[^/]*$", 1).alias("_s")).agg(F.count(F.lit(1)).alias("n")).collect()}
        entries = [f for f in before["journal"] if f in told]
        left, kept, _ = cleanup(self._jobs(hit), self._read(entries, "journal", JOURNAL), which)
        finished = [f for f in before["finished"] if f not in hit] + self._write_jobs(left)["finished"]
        journal = [f for f in before["journal"] if f not in told] + (self._write_journal(kept) if entries else [])
        self._publish(base, before | {"finished": finished, "journal": journal})
        return n
