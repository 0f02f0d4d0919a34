"""Saved jobs as a stream of actions: event time, timers, and state that goes when a job does.

Events of a key wait until the watermark has passed them and are then judged in the order of their time, so what comes late
or out of order (within the delay) is judged as if it had come in order. A timer at the end of a job's life reports it and
empties its state. The rules are a plain fold over one key's events; the batch form runs the same fold.

Actions on a job: save (name, password, module, payload), update (password, payload), unlock and delete (password). Any
that is accepted but a deletion starts the job's life anew. The admin's password opens every job.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "job_id string, seq long, ts timestamp, action string, name string, password string, module string, payload string"
RESULTS = "job_id string, seq long, ts timestamp, action string, status string, payload string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000


def hashed(password: str) -> str:
    salt = os.urandom(8).hex()
    return f"{salt}:{hashlib.sha256((salt + password).encode()).hexdigest()}"


def opens(password: str | None, stored: str, admin: str | None) -> bool:
    salt, digest = stored.split(":", 1)
    given = password or ""
    return hmac.compare_digest(hashlib.sha256((salt + given).encode()).hexdigest(), digest) or bool(admin) and hmac.compare_digest(given, admin)


@dataclass
class Jobs:
    """The rules. held is a job's state, None before it is saved and after it has gone; times are milliseconds."""

    days: float = 60
    admin: str | None = None

    def end(self, held: dict) -> int:
        """When a job has expired: the first millisecond beyond its life."""
        return held["updated"] + int(self.days * DAY) + 1

    def judge(self, held: dict | None, e: dict) -> tuple[dict | None, str, str | None]:
        """(state, status, payload to give back) after an event."""
        if e["action"] == "save":
            if len(e["password"] or "") < 4:
                return held, "short password", None
            if not (e["name"] or "").strip():
                return held, "no name", None
            if held:
                return held, "exists", None
            return {"name": e["name"].strip(), "module": e["module"], "hash": hashed(e["password"]), "payload": e["payload"], "created": e["at"], "updated": e["at"]}, "saved", None
        if not held:
            return None, "not found", None
        if not opens(e["password"], held["hash"], self.admin):
            return held, "wrong password", None
        if e["action"] == "delete":
            return None, "deleted", None
        if e["action"] == "update":
            return {**held, "payload": e["payload"], "updated": e["at"]}, "updated", None
        if e["action"] == "unlock":
            return {**held, "updated": e["at"]}, "unlocked", held["payload"]
        return held, "unknown action", None

    def run(self, key: str, held: dict | None, events: list[dict], now: int | None) -> tuple[dict | None, list[tuple]]:
        """Events in the order of time, then of seq, with what expires between them and, if now is given, up to then."""
        out: list[tuple] = []

        def expire(until: int) -> None:
            nonlocal held
            if held and self.end(held) <= until:
                out.append((key, None, self.end(held), "expire", "expired", None))
                held = None

        for e in sorted(events, key=lambda x: (x["at"], x["seq"])):
            expire(e["at"])
            held, status, payload = self.judge(held, e)
            out.append((key, e["seq"], e["at"], e["action"], status, payload))
        if now is not None:
            expire(now)
        return held, out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["job_id", "seq", "ts", "action", "status", "payload"])
    return df.assign(seq=df["seq"].astype("Int64"), ts=pd.to_datetime(df["ts"], unit="ms"))


def _events(frame: pd.DataFrame) -> list[dict[str, Any]]:
    """Rows as plain values, times as whole milliseconds."""
    at = (pd.to_datetime(frame["ts"]).astype("datetime64[us]").astype("int64") // 1000).tolist()
    plain = frame[["seq", "action", "name", "password", "module", "payload"]].astype(object).where(frame[["seq", "action", "name", "password", "module", "payload"]].notna(), None)
    return [{**r, "seq": int(r["seq"]), "at": t} for r, t in zip(plain.to_dict("records"), at)]


class SavedJobs(StatefulProcessor):
    """Per job: events that wait for the watermark, the job, and one timer for each time at which something is due."""

    def __init__(self, rules: Jobs):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "json string")
        self.waiting = handle.getListState("waiting", "json string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for e in _events(frame):
                self.waiting.appendValue((json.dumps(e),))
                self.handle.registerTimer(e["at"])
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all up to the watermark is final: what ends before it is reported now, as a timer set here would wait for the next batch
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        events = [json.loads(x[0]) for x in self.waiting.get()]
        due, left = [e for e in events if e["at"] <= now], [e for e in events if e["at"] > now]
        held = json.loads(self.job.get()[0]) if self.job.exists() else None
        held, out = self.rules.run(key[0], held, due, now)
        self.waiting.clear()
        if left:
            self.waiting.put([(json.dumps(e),) for e in left])
        if held:
            self.job.update((json.dumps(held),))
            self.handle.registerTimer(self.rules.end(held))
        else:
            self.job.clear()
        if out:
            yield _frame(out)

    def close(self) -> None:
        pass


def saved_jobs(stream: DataFrame, delay: str = "1 day", days: float = 60, admin: str | None = None) -> DataFrame:
    """A stream of EVENTS to one of RESULTS, in the order of time within a job; needs the state store of STORE."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    plain = stream.select(*[x.split()[0] for x in EVENTS.split(", ")]).withWatermark("ts", delay)
    return plain.groupBy("job_id").transformWithStateInPandas(SavedJobs(Jobs(days, admin)), outputStructType=RESULTS, outputMode="append", timeMode="eventTime")


def saved_jobs_of(events: DataFrame, until: str | None = None, days: float = 60, admin: str | None = None) -> DataFrame:
    """The batch form: all events of each job, and what has expired by `until`. A job's events are its users' actions; they are judged together."""
    rules = Jobs(days, admin)
    now = None if until is None else int(pd.Timestamp(until).timestamp() * 1000)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return _frame(rules.run(key[0], None, _events(frame), now)[1])

    return events.select(*[F.col(x.split()[0]) for x in EVENTS.split(", ")]).groupBy("job_id").applyInPandas(run, RESULTS)
