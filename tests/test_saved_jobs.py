"""Saved jobs: the rules by cases; the stream against the batch form with late and unordered events; state that goes."""

import random
from datetime import datetime, timedelta

import pytest

from shelfwise.streaming import saved

T0 = datetime(2024, 1, 1)


def event(job, seq, day, action, password="pass", name="n", payload=None):
    return (job, seq, T0 + timedelta(days=day), action, name, password, "m", payload)


def plain(rows):
    return sorted((x.job_id, x.seq if x.seq is not None else -1, x.ts, x.action, x.status, x.payload or "") for x in rows)


def test_rules(spark):
    rows = [
        event("a", 1, 0, "save", "abc"), event("a", 2, 1, "save", name=" "), event("a", 3, 2, "update"), event("a", 4, 3, "save", payload="p1"), event("a", 5, 4, "save"), event("a", 6, 5, "update", "nope", payload="p2"),
        event("a", 7, 6, "update", payload="p3"), event("a", 8, 66, "unlock"), event("a", 9, 127, "unlock"), event("a", 10, 128, "save", payload="p4"), event("a", 11, 129, "unlock", "root"), event("a", 12, 130, "delete", None), event("a", 13, 130, "delete"),
        event("a", 14, 131, "unlock"), event("b", 1, 0, "save"), event("c", 1, 9, "what"),
    ]
    done = saved.saved_jobs_of(spark.createDataFrame(rows, saved.EVENTS).repartition(3), until="2024-03-01", admin="root")
    got = [(x.job_id, x.seq, x.status, x.payload) for x in sorted(done.collect(), key=lambda x: (x.job_id, x.ts, x.seq or 0))]
    assert [x[2] for x in got if x[0] == "a"] == [
        "short password", "no name", "not found", "saved", "exists", "wrong password", "updated", "unlocked", "expired", "not found", "saved", "unlocked", "wrong password", "deleted", "not found",
    ]
    assert [x for x in got if x[0] != "a"] == [("b", 1, "saved", None), ("c", 1, "not found", None)]
    assert [x[3] for x in got if x[2] == "unlocked"] == ["p3", "p4"]
    late = saved.saved_jobs_of(spark.createDataFrame([event("b", 1, 0, "save")], saved.EVENTS), until="2024-03-02")
    assert [x.status for x in late.collect()] == ["saved", "expired"]


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [event(f"j{r.randrange(6)}", k, r.randrange(400) / 4, r.choice(["save", "update", "unlock", "delete", "unlock"]), r.choice(["pass", "pass", "pass", "wrong"]), payload=f"p{k}") for k in range(240)]
    # files in the order of time, but for what is up to five days late
    rows.sort(key=lambda x: x[2] + timedelta(days=r.random() * 5))
    source = tmp_path / "in"
    for k in range(0, 240, 60):
        spark.createDataFrame(rows[k : k + 60], saved.EVENTS).coalesce(1).write.mode("append").parquet(str(source))
    # a last event far ahead drives the watermark past all others, and past the end of every job
    spark.createDataFrame([event("clock", 0, 400, "noop")], saved.EVENTS).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(saved.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(source))
    name = f"jobs{seed}"
    query = saved.saved_jobs(stream, delay="6 days", days=20).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    got = plain(x for x in spark.table(name).collect() if x.job_id != "clock")
    want = plain(saved.saved_jobs_of(spark.createDataFrame(rows, saved.EVENTS), until="2024-12-31", days=20).collect())
    assert got == want and {"expired", "unlocked", "wrong password"} <= {x[4] for x in want}
    # every job has gone, and so has its state
    left = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "job").load(str(tmp_path / "c"))
    assert left.count() == 0
