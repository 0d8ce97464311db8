"""Messages taken in once, and states that a stream keeps, against the fold of everything."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from compare import rows
from millrace import schemas
from millrace.operators import registry
from millrace.session import scratch
from millrace.sources import messages
from millrace.streaming import distinct, results, state
from millrace.suite import history
from millrace.suite import messages as suite

START = datetime(2024, 5, 1, tzinfo=timezone.utc)


def body(number, hours, status="success", step=None, time=True):
    message = {"status": status, "correlation_id": f"c-{number}", "step_id": step, "duration_ms": number}
    if time:
        message["timestamp"] = (START + timedelta(hours=hours)).isoformat()
    return json.dumps(message)


def deliver(spark, place, name, bodies):
    spark.createDataFrame([(b,) for b in bodies], "body string").coalesce(1).write.text(f"{place}/{name}")


def test_results_are_taken_in_once(spark):
    place, stored, once = (scratch(spark, n) for n in ("again", "stored", "once"))
    checks = scratch(spark, "check-a"), scratch(spark, "check-b")

    def run():
        stream = lambda: messages.message_stream(spark, place, files_per_batch=1)
        results.consume_results(stream(), stored, checks[0]).awaitTermination()
        distinct.store_distinct(stream(), once, checks[1]).awaitTermination()

    pending = body(3, 5, "pending", "s3")
    deliver(spark, place, "1", [body(1, 0), body(1, 0), body(2, 1), pending, pending, body(3, 6, step="s3"), "not json"])
    run()
    deliver(spark, place, "2", [body(2, 1), body(4, 30), body(3, 6, step="s3"), body(5, 0, time=False), body(6, 10**6)])
    run()  # goes on from the checkpoint, with what it remembers
    deliver(spark, place, "3", [body(4, 30), body(7, 90)])
    deliver(spark, place, "4", [body(8, 2), body(8, 2), body(1, 0), body(9, 89)])
    run()
    first, kept = spark.read.parquet(once), spark.read.parquet(stored)
    assert rows(first.select("correlation_id", "status"), "correlation_id", "status") == [
        ("c-1", "success"), ("c-2", "success"), ("c-3", "pending"), ("c-3", "success"), ("c-4", "success"),
        ("c-7", "success"), ("c-9", "success"),
    ]
    late = distinct.late_results(kept, first)
    assert rows(late.select("correlation_id")) == [("c-5",), ("c-6",), ("c-8",)]
    both = distinct.all_results(kept, first)
    assert both.count() == 10 and both.filter("late").count() == 3


def test_each_arrival_is_written_by_all_tasks(spark, tmp_path, monkeypatch):
    """Four files of events make four files of each arrival's messages, and still one micro-batch each."""
    source, places = "/root/testdata/sf0.001/events.parquet", {}
    spark.read.parquet(source).repartition(4, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(suite, "scratch", lambda spark, label: places.setdefault(label, f"{tmp_path}/{label}"))
    for size in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.set(f"spark.sql.files.{size}", "4k")
    try:
        found = suite.e5_distinct_results(spark, str(tmp_path))
    finally:
        for size in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{size}")
    assert [len(list(Path(places["again_queue"], str(n)).glob("part-*"))) for n in range(2)] == [4, 4]
    assert len(list(Path(places["again_stored"]).glob("stream=*/batch_id=*"))) == 3
    events = [r for r in spark.read.parquet(source).collect() if r.event_id % 97]
    late = {f"c-{r.event_id}" for r in events if r.event_id % 7 == 0 and r.ts < datetime(2024, 1, 6)}
    assert rows(found.select("correlation_id")) == sorted((f"c-{r.event_id}",) for r in events)
    assert {r.correlation_id for r in found.filter("late").collect()} == late


def patches(seed, count):
    rng = random.Random(seed)
    out = []
    for n in range(count):
        job = f"job-{rng.choice([0, 0, 0, *range(12)])}"
        new = rng.random() < 0.3
        fields = {"status": rng.choice(["running", "success", "failed", None]), "error": rng.choice([None, None, f"e{n}"])}
        meta = rng.choice([None, {}, {rng.choice("abc"): str(n)}, {"a": str(n), "d": None}])
        at = START + timedelta(seconds=rng.randrange(200))
        out.append((job, fields["status"], fields["error"], meta, "create" if new else "update", at, n))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_state_is_the_fold(spark, database, seed):
    some = spark.createDataFrame(
        patches(seed, 240), "job_id string, status string, error string, metadata map<string,string>, op string, patched_at timestamp, seq long"
    )
    log = registry._conform(some, schemas.JOB, "op", "patched_at", "seq")
    place, checks = scratch(spark, "patches"), [scratch(spark, "check") for _ in range(2)]
    fields, entries = f"{database}.fields", f"{database}.entries"

    def run():
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(place)
        a = state.keep(state.field_states(stream, "job_id", registry.JOB_FIELDS), fields, checks[0])
        b = state.keep(state.entry_states(stream, "job_id"), entries, checks[1])
        a.awaitTermination()
        b.awaitTermination()

    def same(upto):
        view = lambda jobs: rows(
            jobs.select("job_id", "status", "error", "started_at", F.sort_array(F.map_entries("metadata")).alias("m"), *registry.JOB_FIELDS[:3])
        )
        got = view(state.current(spark, fields, entries, "job_id"))
        assert got == view(registry.current_jobs(log.filter(F.col("seq") < upto))) and got

    for n in range(3):
        log.filter(F.col("seq").between(60 * n, 60 * n + 59)).repartition(2, "job_id").write.parquet(f"{place}/{n}")
    run()
    same(180)
    # Batches hold the records that they touched, and a batch written again changes nothing.
    before = spark.table(fields).groupBy("batch").count().collect()
    assert len(before) >= 3 and all(r["count"] <= 12 for r in before)
    again = spark.table(fields).filter("batch = 1").drop("batch").collect()
    state._overwrite(spark.createDataFrame(again, spark.table(fields).drop("batch").schema), fields, 1)
    assert sorted(map(tuple, before)) == sorted(map(tuple, spark.table(fields).groupBy("batch").count().collect()))
    same(180)
    state.settle(spark, fields, ["job_id"], scratch(spark, "settle"))
    state.settle(spark, entries, ["job_id", "entry_key"], scratch(spark, "settle"))
    assert [r["batch"] for r in spark.table(fields).select("batch").distinct().collect()] == [state.SETTLED]
    same(180)
    log.filter("seq >= 180").write.parquet(f"{place}/3")
    run()
    same(240)


def test_a_batch_reads_its_own_rows(spark, database):
    """No log and no state table in the plan of a stored batch."""
    place = scratch(spark, "patches")
    some = spark.createDataFrame(patches(5, 40), "job_id string, status string, error string, metadata map<string,string>, op string, patched_at timestamp, seq long")
    some.coalesce(1).write.parquet(place)
    stream = spark.readStream.schema(some.schema).parquet(place)
    query = state.keep(state.field_states(stream, "job_id", ["status", "error"]), f"{database}.f", scratch(spark, "check"))
    query.awaitTermination()
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in progress] == [40]


def test_batches_of_the_stream_are_bounded(spark, database, monkeypatch):
    """A longer log makes more batches, not larger ones."""
    monkeypatch.setattr(history, "BATCH_ROWS", 100, raising=False)
    monkeypatch.setattr(history, "fresh_database", lambda spark, label: database)
    folder = "/root/testdata/sf0.001"
    found = rows(history.r3_streamed_state(spark, folder))
    assert found == rows(history.r3_update_job(spark, folder)) and found
    batches = spark.table(f"{database}.job_fields").groupBy("batch").count().collect()
    assert len(batches) > 3 and all(r["count"] <= 100 for r in batches)
