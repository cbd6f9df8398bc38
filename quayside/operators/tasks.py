"""User code per job: task kinds, handlers with carried state, and what they may say.

Handlers run on executors, in Python workers, once for each claimed row; what they report
becomes a settlement. Effects are at least once, as tasks may be retried; the guard of the
settlement keeps the jobs right.
"""

from __future__ import annotations

import ctypes
import json
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame

from ..functions.backoff import Backoff, retry_delay
from .dedup import REPLACE, Merge
from .schema import NORMAL, SerializationError, UnknownKind, check_priority

RETRY, TO_DEAD = "retry", "dead"


@dataclass(frozen=True)
class Completed:
    attachment: Any = None


@dataclass(frozen=True)
class Paused:
    """Run again after a while; not a failure. A pause of nothing is due at once."""

    delay: timedelta
    attachment: Any = None


class TaskError(Exception):
    """A failure of a run, retried unless it is permanent."""

    def __init__(self, message: str, *, permanent: bool = False, cause: BaseException | None = None):
        super().__init__(message)
        self.permanent = permanent
        self.cause = cause

    @classmethod
    def fatal(cls, message: str, cause: BaseException | None = None) -> TaskError:
        return cls(message, permanent=True, cause=cause)

    def note(self) -> str:
        return str(self) if self.cause is None else f"{self}: {self.cause}"


class HandlerPanic(Exception):
    """A broken handler rather than a failed run; the panic policy says what follows."""


class Token:
    """Shared by a run and whoever may cancel it: the worker, when it shuts down."""

    def __init__(self) -> None:
        self._event = threading.Event()

    @property
    def cancelled(self) -> bool:
        return self._event.is_set()

    def cancel(self) -> None:
        self._event.set()

    def wait(self, timeout: float | None = None) -> bool:
        """Wait for the cancellation; was there one?"""
        return self._event.wait(timeout)


@dataclass
class Context:
    """What a run knows of its job, and what it leaves."""

    id: str
    run_count: int
    history: list[dict[str, Any]]
    carry: Any = None
    attachment: Any = None
    lease_ends: datetime | None = None
    clock: Callable[[], datetime] = field(default=datetime.now)
    token: Token = field(default_factory=Token)

    def set_attachment(self, value: Any) -> None:
        self.attachment = value

    def is_cancelled(self) -> bool:
        """Is the worker shutting down? A long run may then stop early, by a pause as a rule."""
        return self.token.cancelled

    def lease_over(self) -> bool:
        """Has the claim's lease run out, on the clock of the pass? The job may then run elsewhere."""
        return self.lease_ends is not None and self.clock() >= self.lease_ends

    def cancellation_token(self) -> Token:
        """What to hand to code that the handler calls."""
        return self.token

    def failures(self) -> int:
        return sum(e["outcome"] in ("retried", "dead", "stale-recovered") for e in self.history)


Handler = Callable[[Any, Context, Any], "Completed | Paused | None"]


@dataclass(frozen=True)
class Task:
    """A kind of job: how it is queued, and what runs it. ``default`` is its empty carry."""

    kind: str
    handler: Handler | None = None
    default: Any = None
    priority: Callable[[Any], int] = lambda payload: NORMAL
    dedup_key: Callable[[Any], str | int | None] = lambda payload: None
    merge: Merge = lambda pending, payload: REPLACE
    backoff: Callable[[Any], Backoff | None] = lambda payload: None
    lease: Callable[[Any], timedelta | None] = lambda payload: None
    decode: Callable[[Any], Any] = lambda payload: payload

    def row(self, payload: Any, job_id: str, visible_at: datetime | None = None) -> dict[str, Any]:
        """An arrival for :mod:`quayside.operators.dedup`."""
        key = self.dedup_key(payload)
        return {"id": job_id, "kind": self.kind, "payload": to_json(payload), "priority": check_priority(self.priority(payload)), "visible_at": visible_at, "carry": to_json(self.default), "dedup_key": None if key is None else str(key)}


def to_json(value: Any) -> str:
    try:
        return json.dumps(value, separators=(",", ":"))
    except (TypeError, ValueError) as e:
        raise SerializationError(str(e)) from e


@dataclass
class Registry:
    """Kinds with their tasks and caps; registering again replaces."""

    tasks: dict[str, Task] = field(default_factory=dict)
    caps: dict[str, int | None] = field(default_factory=dict)

    def register(self, task: Task, cap: int | None = None) -> Registry:
        self.tasks[task.kind] = task
        self.caps[task.kind] = None if cap is None else max(cap, 1)
        return self

    def kinds(self) -> list[str]:
        return list(self.tasks)

    def task(self, kind: str) -> Task:
        if kind not in self.tasks:
            raise UnknownKind(kind)
        return self.tasks[kind]


RESULTS = "id string, claimed_by string, run_no int, failure_count int, result string, pause_ns long, carry string, note string, attachment string, delay_ns long, kind string, took_us long"


def is_panic(error: BaseException) -> bool:
    """Is this a broken handler (or one that tries to end the process) rather than a failed run?"""
    return not isinstance(error, Exception) or isinstance(error, (HandlerPanic, RecursionError, MemoryError))


class Aborted(BaseException):
    """Raised inside a run that has not ended by the end of the grace."""


def within(seconds: float, run: Callable[[], Any]) -> Any:
    """What ``run`` returns or raises; or, after so many seconds, :class:`Aborted`, which is also
    raised inside it. Code that never comes back to Python is left behind."""
    done: dict[str, Any] = {}

    def body() -> None:
        try:
            done["value"] = run()
        except BaseException as e:  # noqa: BLE001 - handed to the caller
            done["error"] = e

    thread = threading.Thread(target=body, daemon=True)
    thread.start()
    thread.join(max(seconds, 0.0))
    if not done:  # what has ended meanwhile counts as ended
        ctypes.pythonapi.PyThreadState_SetAsyncExc(ctypes.c_ulong(thread.ident), ctypes.py_object(Aborted))
        raise Aborted
    if "error" in done:
        raise done["error"]
    return done["value"]


def run_one(row: dict[str, Any], registry: Registry, state: Any, now: datetime, panic_policy: str, default_backoff: Backoff, fraction: float, token: Token | None = None, seconds: float | None = None) -> dict[str, Any]:
    """One run: decode, handle, encode. Nothing that user code raises leaves it.

    An unknown kind or a payload that cannot be decoded is fatal. An error keeps the carry
    as the handler left it; a panic, of the handler or of a hook, keeps the one from before
    the run, and no attachment, and the policy says what follows. A carry that is not JSON
    after a run that ended well is fatal, with carry null. A run that takes longer than
    ``seconds``, if given, is aborted and reported as released.
    """
    began = time.monotonic()
    out = {"id": row["id"], "claimed_by": row["claimed_by"], "run_no": row["run_count"], "failure_count": row["failure_count"], "pause_ns": None, "carry": row["carry"], "note": None, "attachment": None, "delay_ns": None}
    panicked = "failed" if panic_policy == RETRY else "fatal"
    try:
        task = registry.task(row["kind"])
        if task.handler is None:
            raise UnknownKind(row["kind"])
        payload = task.decode(json.loads(row["payload"]))
        carry = json.loads(row["carry"])
    except BaseException as e:  # noqa: BLE001 - whatever a decoder raises ends the job, a panic by its policy
        return out | {"result": panicked if is_panic(e) else "fatal", "note": str(e)}
    try:
        backoff = task.backoff(payload) or default_backoff
        out["delay_ns"] = retry_delay(backoff, fraction, row["failure_count"] + 1, row["id"])
    except BaseException as e:  # noqa: BLE001 - a broken hook
        return out | {"result": panicked, "note": f"backoff panicked: {type(e).__name__}: {e}"}
    clock = lambda: now + timedelta(seconds=time.monotonic() - began)
    context = Context(row["id"], row["run_count"], [dict(e) for e in row["history"] or []], task.default if carry is None else carry, None, row.get("claim_expires_at"), clock, token or Token())
    handle = lambda: task.handler(payload, context, state)
    try:
        said = handle() if seconds is None else within(seconds, handle)
        said = Completed() if said is None else said
        result, note = ("paused" if isinstance(said, Paused) else "completed"), None
        if said.attachment is not None:
            context.attachment = said.attachment
        if isinstance(said, Paused):
            out["pause_ns"] = int(said.delay / timedelta(microseconds=1)) * 1000
    except Aborted:
        return out | {"result": "released", "note": "aborted at shutdown"}
    except TaskError as e:
        result, note = ("fatal" if e.permanent else "failed"), e.note()
    except BaseException as e:  # noqa: BLE001 - nothing that a handler raises may end the pass
        if is_panic(e):
            return out | {"result": panicked, "note": f"handler panicked: {type(e).__name__}: {e}"}
        result, note = "failed", f"{type(e).__name__}: {e}"
    try:
        attachment = None if context.attachment is None else to_json(context.attachment)
    except SerializationError as e:
        attachment, result, note = None, "fatal", f"attachment is not JSON: {e}"
    try:
        kept = to_json(context.carry)
    except SerializationError as e:
        kept = "null"
        result, note = ("fatal", f"carry is not JSON: {e}") if result in ("completed", "paused") else (result, note)
    return out | {"result": result, "note": note, "carry": kept, "attachment": attachment}


def run_handlers(claimed: DataFrame, registry: Registry, now: datetime, state: Callable[[], Any] = lambda: None, panic_policy: str = RETRY, backoff: Backoff = Backoff(), fraction: float = 0.5, grace: timedelta | None = None) -> DataFrame:
    """Run the handler of each row of ``claimed`` (jobs with their history) and report.

    ``state`` makes what handlers share, once for each partition. A ``grace`` is that of a
    worker that shuts down: the runs' token is cancelled, no run starts after that time and
    one that has not ended by then is aborted; those are reported as ``released``, all
    others as they ended.
    """

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [c.split(" ")[0] for c in RESULTS.split(", ")]
        shared, began, token = state(), time.monotonic(), Token()
        if grace is not None:
            token.cancel()

        def timed(row: dict[str, Any]) -> dict[str, Any]:
            start = time.monotonic()
            left = None if grace is None else grace.total_seconds() - (start - began)
            if left is not None and left <= 0:
                kept = {c: row[c] for c in ("id", "claimed_by", "failure_count", "carry", "kind")}
                return dict.fromkeys(names) | kept | {"run_no": row["run_count"], "result": "released", "note": "released at shutdown"}
            said = run_one(row, registry, shared, now, panic_policy, backoff, fraction, token, left)
            return said | {"kind": row["kind"], "took_us": int((time.monotonic() - start) * 1e6)}

        for batch in batches:
            rows = [timed(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types, strict=True)], names=names)

    return claimed.select("id", "kind", "payload", "carry", "run_count", "failure_count", "claimed_by", "claim_expires_at", "history").mapInArrow(run, RESULTS)


def task_leases(claimed: DataFrame, registry: Registry, default: timedelta) -> DataFrame:
    """Commands for ``extend_lease`` for the claims whose task asks for a lease of its own."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    task = registry.task(r["kind"])
                    lease = task.lease(task.decode(json.loads(r["payload"])))
                except BaseException:  # noqa: BLE001, S112 - dispatch will say what is wrong with the job
                    continue
                if lease is not None and lease != default:
                    rows.append((r["id"], r["claimed_by"], r["run_count"], lease.total_seconds()))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.float64()), strict=True)], names=["id", "claimed_by", "run_no", "lease_s"])

    return claimed.select("id", "kind", "payload", "run_count", "claimed_by").mapInArrow(run, "id string, claimed_by string, run_no int, lease_s double")
