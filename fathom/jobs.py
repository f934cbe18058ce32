"""A queue of background jobs in a collection, and a loop on the driver that works it off."""

from __future__ import annotations

import datetime as dt
import json
import threading
import uuid
from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import ValidationError

if TYPE_CHECKING:
    from .engine import Engine

COLLECTION = "_jobs"
FIELDS = {"id": "ID", "job_type": "String", "payload": "Object", "priority": "Int", "status": "String", "retries": "Int", "max_retries": "Int", "created_at": "DateTime", "run_at": "DateTime", "error": "String"}
PRIORITIES = {"LOW": 0, "NORMAL": 1, "HIGH": 2, "CRITICAL": 3}
#: Seconds before the first retry; each further one takes twice as long.
BACKOFF = 5
#: Jobs that are claimed and finished at once.
BATCH = 100


def _now() -> str:
    return dt.datetime.now(dt.UTC).isoformat(timespec="microseconds")


def row(args: dict[str, Any]) -> dict[str, Any]:
    """A new job's row."""
    if not args.get("jobType"):
        raise ValidationError("a job needs jobType")
    priority = str(args.get("priority", "NORMAL")).upper()
    if priority not in PRIORITIES:
        raise ValidationError(f"unknown priority {priority}")
    at = _now()
    return {"id": uuid.uuid4().hex, "job_type": args["jobType"], "payload": args.get("payload") or {}, "priority": PRIORITIES[priority], "status": "PENDING", "retries": 0, "max_retries": int(args.get("maxRetries", 3)), "created_at": at, "run_at": args.get("scheduledAt") or at}


def _call(f: Callable[[dict[str, Any]], Any], payload: dict[str, Any], timeout: float | None) -> None:
    """Runs a handler; after the timeout it is given up, though its thread may go on."""
    if timeout is None:
        f(payload)
        return
    raised: list[BaseException] = []

    def run() -> None:
        try:
            f(payload)
        except BaseException as e:  # the handler's own, raised again below
            raised.append(e)

    t = threading.Thread(target=run, daemon=True)
    t.start()
    t.join(timeout)
    if t.is_alive():
        raise TimeoutError(f"took more than {timeout:g} seconds")
    if raised:
        raise raised[0]


class Queue:
    """Jobs by priority, then age.  A job that fails or takes too long waits longer each time, and in the end is dead.

    Jobs are claimed and finished in batches, each of which is one commit.
    """

    def __init__(self, engine: Engine, *, timeout: float | None = None):
        self.engine = engine
        self.timeout = timeout
        self.handlers: dict[str, Callable[[dict[str, Any]], Any]] = {}

    def on(self, job_type: str, f: Callable[[dict[str, Any]], Any]) -> None:
        self.handlers[job_type] = f

    def _jobs(self) -> DataFrame:
        return self.engine.catalog.get(COLLECTION).load()

    def due(self) -> DataFrame:
        return self._jobs().filter((F.col("status") == "PENDING") & (F.col("run_at") <= F.current_timestamp())).orderBy(F.col("priority").desc(), "created_at", "id")

    def reap(self, seconds: int) -> int:
        """Puts jobs back that have been running for longer: who ran them is gone."""
        n = 0
        lost = (F.col("status") == "RUNNING") & (F.col("run_at") < F.current_timestamp() - F.make_interval(secs=F.lit(seconds)))
        while got := self._jobs().filter(lost).select("_sid").limit(BATCH).collect():
            self.engine.assign(COLLECTION, [{"_sid": r[0], "status": "PENDING"} for r in got])
            n += len(got)
        return n

    def cleanup(self, seconds: int) -> int:
        """Deletes jobs that were completed or given up longer ago."""
        return self.engine.delete_where(COLLECTION, F.col("status").isin("COMPLETED", "DEAD") & (F.col("run_at") < F.current_timestamp() - F.make_interval(secs=F.lit(seconds))))

    def stats(self) -> DataFrame:
        return self._jobs().groupBy("status").agg(F.count(F.lit(1)).alias("n"))

    def run_batch(self, size: int) -> list[str]:
        """Runs the first jobs that are due and have a handler, so many at most; their statuses after that."""
        got = self.due().filter(F.col("job_type").isin(list(self.handlers))).limit(size).collect()
        if not got:
            return []
        self.engine.assign(COLLECTION, [{"_sid": j["_sid"], "status": "RUNNING", "run_at": _now()} for j in got])
        done = [self._run(j.asDict()) for j in got]
        self.engine.assign(COLLECTION, done)
        return [d["status"] for d in done]

    def _run(self, job: dict[str, Any]) -> dict[str, Any]:
        try:
            _call(self.handlers[job["job_type"]], json.loads(job["payload"] or "{}"), self.timeout)
        except Exception as e:  # the handler's own
            retries = job["retries"] + 1
            at = dt.datetime.now(dt.UTC) + dt.timedelta(seconds=BACKOFF * 2 ** (retries - 1))
            status = "DEAD" if retries >= job["max_retries"] else "PENDING"
            return {"_sid": job["_sid"], "status": status, "retries": retries, "error": str(e), "run_at": at.isoformat()}
        return {"_sid": job["_sid"], "status": "COMPLETED", "retries": job["retries"], "error": job["error"], "run_at": _now()}

    def run_one(self) -> str | None:
        """Runs the first job; its status after that, None if there was none."""
        got = self.run_batch(1)
        return got[0] if got else None

    def run(self) -> int:
        """Runs what is due; how many runs that took."""
        n = 0
        while got := self.run_batch(BATCH):
            n += len(got)
        return n
