"""The life of analysis jobs as keyed state, and stores that are read once.

Events of a job: ``submit``, ``start``, ``progress``, ``finish``, ``fail``,
``cancel``. A terminal state stays as it is; whatever comes after it is
ignored, and the page that was submitted is dropped from the state with it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RETENTION_SECONDS, CAPACITY = 3600, 32
TERMINAL = ("completed", "failed", "cancelled")
_NEXT = {"start": "running", "finish": "completed", "fail": "failed", "cancel": "cancelled"}
SNAPSHOT = "job_id string, status string, current long, total long, message string, result string, error string, updated_at double"
STATE = "snapshot string"


def advance(job: dict | None, event: dict) -> dict:
    """The job after an event."""
    job = job or {"status": "queued", "current": 0, "total": 0, "message": "", "result": None, "error": None, "payload": None}
    if job["status"] in TERMINAL:
        return job
    kind = event["event"]
    if kind == "submit":
        return job | {"payload": event.get("payload"), "updated_at": event["at"]}
    if kind == "progress":
        if job["status"] != "running":
            return job
        return job | {"current": event.get("current") or 0, "total": event.get("total") or 0, "message": event.get("message") or "", "updated_at": event["at"]}
    if kind not in _NEXT or kind == "finish" and job["status"] != "running":
        return job
    job = job | {"status": _NEXT[kind], "updated_at": event["at"]}
    if kind == "finish":
        job |= {"result": event.get("message")}
    if kind == "fail":
        job |= {"error": event.get("message")}
    return job | {"payload": None} if job["status"] in TERMINAL else job


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    job = json.loads(state.get[0]) if state.exists else None
    events = [e for f in frames for e in f.astype(object).where(f.notna(), None).to_dict("records")]
    for e in sorted(events, key=lambda e: e["at"]):
        job = advance(job, e)
    state.update((json.dumps(job),))
    if job["status"] in TERMINAL:
        state.setTimeoutDuration(RETENTION_SECONDS * 1000)
    yield pd.DataFrame([{"job_id": key[0], **{k: job.get(k) for k in ("status", "current", "total", "message", "result", "error", "updated_at")}}])


def job_snapshots(events: DataFrame) -> DataFrame:
    """Streaming: a snapshot of each job that a micro-batch touches. ``events``: ``job_id, event, at, current, total, message, payload``."""
    return events.groupBy("job_id").applyInPandasWithState(_step, SNAPSHOT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def retained(log: DataFrame, now, retention: int = RETENTION_SECONDS, capacity: int = CAPACITY) -> DataFrame:
    """Batch form of retention: ``job_id, finished_at, inserted, terminal`` with the jobs that stay.

    Terminal jobs older than ``retention`` seconds go; of the others the oldest
    terminal ones go until fewer than ``capacity`` jobs are left.
    """
    young = log.filter(~F.col("terminal") | (F.col("finished_at") > now - retention))
    counts = dict(young.groupBy("terminal").count().collect())  # two rows at most
    waiting, ended = counts.get(False, 0), counts.get(True, 0)
    keep = ended if waiting + ended < capacity else max(0, capacity - 1 - waiting)  # fewer than the capacity, so a top-k does
    return young.filter(~F.col("terminal")).unionAll(young.filter("terminal").orderBy(F.col("inserted").desc()).limit(keep))


def reply(lines: DataFrame, key: str = "reply_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """Streamed JSON replies put together: the contents in order up to the line that is done; an error ends a reply."""
    got = lines.select(key, order, F.from_json(line, "message struct<content:string>, done boolean, error string").alias("j"))
    listed = got.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("j").alias("j")))).alias("all"))
    stop = F.array_min(F.transform(F.filter("all", lambda s: F.coalesce(s["j"]["done"], F.lit(False)) | s["j"]["error"].isNotNull()), lambda s: s["o"]))
    upto = F.filter("all", lambda s: stop.isNull() | (s["o"] <= stop))
    text = F.array_join(F.transform(upto, lambda s: F.coalesce(s["j"]["message"]["content"], F.lit(""))), "")
    failed = F.get(F.filter(F.transform(upto, lambda s: s["j"]["error"]), lambda e: e.isNotNull()), 0)
    return listed.select(key, text.alias("text"), failed.alias("error"), stop.isNotNull().alias("ended"))


def read_once(puts: DataFrame, reads: DataFrame, ttl: int = RETENTION_SECONDS) -> DataFrame:
    """Batch form of a store that forgets on read: each put (``key, value, at``) goes to the first read (``key, read_id, at``) after it and before it expires."""
    window = Window.partitionBy("key").orderBy("at", "kind", "n")
    both = puts.select("key", F.lit(0).alias("kind"), "value", F.lit(None).cast("long").alias("n"), "at").unionByName(reads.select("key", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("value"), F.col("read_id").alias("n"), "at"))
    before = both.withColumn("last_kind", F.lag("kind").over(window)).withColumn("last_value", F.lag("value").over(window)).withColumn("last_at", F.lag("at").over(window))
    hit = (F.col("last_kind") == 0) & (F.col("at") - F.col("last_at") <= ttl)
    return before.filter("kind = 1").select("key", F.col("n").alias("read_id"), F.when(hit, F.col("last_value")).alias("value"))


def current_answers(log: DataFrame, key: str = "key", order: str = "at") -> DataFrame:
    """Answers of a log that belong to the generation that is running when they come; stale ones go.

    ``log``: ``key, at, kind, generation``; a row of kind ``start`` begins the
    next generation of its key (the first is 1), an ``answer`` names the one it was asked by.
    """
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.count(F.when(F.col("kind") == "start", 1)).over(before)
    return log.withColumn("_running", running).filter((F.col("kind") == "answer") & (F.col("generation") == F.col("_running"))).drop("_running")


READ = "key string, read_id long, value string"


def _store(ttl: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else None
        given = []
        for e in sorted((e for f in frames for e in f.astype(object).where(f.notna(), None).to_dict("records")), key=lambda e: (e["at"], e["kind"] != "put", e["read_id"] or 0)):
            if e["kind"] == "put":
                held = {"value": e["value"], "at": e["at"]}
            else:
                fresh = held is not None and e["at"] - held["at"] <= ttl
                given.append({"key": key[0], "read_id": e["read_id"], "value": held["value"] if fresh else None})
                held = None
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(held),))
            state.setTimeoutDuration(ttl * 1000)
        yield pd.DataFrame(given, columns=["key", "read_id", "value"])

    return step


def read_once_stream(events: DataFrame, ttl: int = RETENTION_SECONDS) -> DataFrame:
    """Streaming: the store of :func:`read_once` as keyed state that is cleared when it is read or expires.

    ``events``: ``key, kind`` (``put`` or ``read``), ``value, read_id, at``; a row for each read.
    """
    return events.groupBy("key").applyInPandasWithState(_store(ttl), READ, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
