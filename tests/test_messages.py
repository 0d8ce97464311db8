from __future__ import annotations

import json
import shutil
from pathlib import Path

import pytest
from compare import rows
from pyspark.sql import functions as F

from millrace.operators import registry
from millrace.operators.runs import Context, data_ref, tracked, tracked_write
from millrace.operators.sql import execution_record
from millrace.session import scratch
from millrace.sources import messages
from millrace.streaming import envelope, events, results

TABLE = {"ref_type": "table", "location": "main.stg_data", "format": None, "metadata": {}}
FILE = {"ref_type": "file", "location": "s3://bucket/input.csv", "format": "csv", "metadata": {"bytes": 12}}


def result(**fields):
    base = {"status": "success", "correlation_id": "c", "step_id": "s1", "timestamp": "2024-01-01T00:00:01.000005+00:00"}
    return {k: v for k, v in {**base, **fields}.items() if v is not ...}


def bodies(spark, *given):
    texts = [(g if isinstance(g, str) else json.dumps(g),) for g in given]
    return spark.createDataFrame(texts, "body string")


def wrapped(message):
    return {"Type": "Notification", "Message": json.dumps(message)}


def test_unwrap(spark):
    inner = {"type": "query", "action": "execute", "payload": {"note": 'the "Message" word'}}
    raw = bodies(spark, inner, wrapped(inner), "not json", '{"Message": null}', "")
    opened = [r[0] for r in raw.select(envelope.unwrap(F.col("body"))).collect()]
    assert [json.loads(t) for t in opened[:2]] == [inner, inner]
    assert opened[2:] == ["not json", '{"Message": null}', ""]


def test_decode_result(spark):
    good = result(inputs=[FILE], outputs=[TABLE], executions=[{"execution_type": "sql", "details": {"statements": ["INSERT"], "n": 1}}], data={"n": 1, "deep": {"x": [1]}}, duration_ms=7)
    decoded = envelope.decode(bodies(spark, wrapped(good)), "result").first()
    assert decoded.valid and decoded.duration_ms == 7
    assert decoded.data == {"n": "1", "deep": '{"x":[1]}'}
    assert decoded.inputs[0].metadata == {"bytes": "12"}
    assert decoded.executions[0].details == {"statements": '["INSERT"]', "n": "1"}
    assert decoded.timestamp.microsecond == 5


@pytest.mark.parametrize(
    "bad",
    [
        "not json",
        "[]",
        "",
        result(correlation_id=...),
        result(status=...),
        result(status="done"),
        result(timestamp="yesterday"),
        result(duration_ms="soon"),
        result(errors="not a list"),
    ],
)
def test_decode_refuses(spark, bad):
    assert envelope.decode(bodies(spark, bad), "result").first().valid is False


def test_decode_defaults(spark):
    raw = bodies(spark, {"type": "query", "action": "execute"}, {"type": "query", "action": "execute"}, {"action": "execute"})
    commands = envelope.decode(raw, "command").collect()
    assert [c.valid for c in commands] == [True, True, False]
    assert commands[0].correlation_id == commands[1].correlation_id != commands[2].correlation_id
    assert commands[0].timestamp is not None
    event = envelope.decode(bodies(spark, {"type": "storage.created", "payload": {"k": "v"}}), "event").first()
    assert event.valid and event.payload == {"k": "v"}
    plain = envelope.decode(bodies(spark, result(timestamp=...)), "result").first()
    assert plain.valid and plain.duration_ms == 0 and plain.errors == []


def test_route(spark):
    raw = bodies(spark, *[{"type": t, "action": "x"} for t in ("storage", "query", "transform", "catalog")])
    routed = envelope.route(envelope.decode(raw, "command")).select("type", "topic", "route_error")
    assert rows(routed) == [
        ("catalog", None, "Unknown service type: catalog"),
        ("query", "query-commands", None),
        ("storage", "storage-commands", None),
        ("transform", "transform-commands", None),
    ]


def test_patches(spark):
    raw = bodies(
        spark,
        result(step_id="ok", inputs=[FILE], outputs=[TABLE], duration_ms=5),
        result(step_id="bad", status="error", errors=["no answer", "gave up"]),
        result(step_id="wait", status="pending"),
        result(step_id=...),
        result(step_id=""),
    )
    found = {r.step_id: r for r in results.step_patches(envelope.decode(raw, "result")).collect()}
    assert set(found) == {"ok", "bad", "wait"}
    assert (found["ok"].status, found["ok"].error, found["ok"].executions) == ("success", None, None)
    assert found["ok"].outputs[0].location == "main.stg_data"
    assert (found["bad"].status, found["bad"].error) == ("failed", "no answer; gave up")
    assert found["wait"].status == "failed"


def consume(spark, folder, stored, checkpoint, **options):
    stream = messages.message_stream(spark, folder, files_per_batch=1)
    results.consume_results(stream, stored, checkpoint, **options).awaitTermination()
    return spark.read.parquet(stored)


@pytest.fixture
def queue(tmp_path):
    def put(name, *given):
        lines = [g if isinstance(g, str) else json.dumps(g) for g in given]
        Path(tmp_path, name).write_text("\n".join(lines) + "\n")
        return str(tmp_path)

    return put


def test_consumer_keeps_every_message_and_its_outcome(spark, queue):
    first = result(step_id="s1", correlation_id="c1", status="pending")
    folder = queue("a.txt", first, "not json", result(step_id=..., correlation_id="c2"))
    queue("b.txt", wrapped(result(step_id="s1", correlation_id="c1", timestamp="2024-01-01T00:00:09+00:00", outputs=[TABLE])), first)
    stored, checkpoint = scratch(spark, "stored"), scratch(spark, "checkpoint")
    seen = consume(spark, folder, stored, checkpoint)
    assert rows(seen.select("outcome", "reason", "correlation_id")) == [
        ("error", "unreadable message", None),
        ("skipped", "no_step_id", "c2"),
        ("updated", None, "c1"),
        ("updated", None, "c1"),
        ("updated", None, "c1"),
    ]
    assert seen.filter("outcome = 'error'").first().body == "not json"
    assert seen.select("stream", "batch_id").distinct().count() == 2
    summary = results.batch_summary(seen)
    assert rows(summary.groupBy("outcome").agg(F.sum("processed"))) == [("error", 1), ("skipped", 1), ("updated", 3)]

    request = spark.createDataFrame([("j1", "s1", "load", "query", "execute", -1)], "job_id string, step_id string, step_name string, handler_type string, action string, seq bigint")
    added = registry.add_steps(request.withColumn("patched_at", F.timestamp_seconds(F.lit(0))), ["step_id"])
    state = lambda: registry.current_steps(
        added.unionByName(registry.step_updates(results.stored_patches(spark.read.parquet(stored))))
    ).first()
    assert (state().status, state().outputs[0].location) == ("success", "main.stg_data")

    queue("c.txt", result(step_id="s2", correlation_id="c9"))
    consume(spark, folder, stored, checkpoint)
    assert spark.read.parquet(stored).count() == 6


def test_a_replayed_batch_changes_nothing(spark, queue):
    """A batch whose completion was not recorded is run again and leaves the same rows."""
    folder = queue("a.txt", result(step_id="s1"), "not json")
    stored, checkpoint = scratch(spark, "stored"), scratch(spark, "checkpoint")
    once = rows(consume(spark, folder, stored, checkpoint).drop("timestamp"))
    for mark in Path(checkpoint, "commits").glob("*0*"):
        mark.unlink()
    again = rows(consume(spark, folder, stored, checkpoint).drop("timestamp"))
    assert Path(checkpoint, "commits", "0").exists()
    assert len(once) == 2 and once == again


def test_a_new_checkpoint_overwrites_nothing(spark, queue):
    """Reading a queue from the start again stores its messages again; the folded steps are the same."""
    folder, stored = queue("a.txt", result(step_id="s1")), scratch(spark, "stored")
    consume(spark, folder, stored, scratch(spark, "checkpoint"))
    seen = consume(spark, folder, stored, scratch(spark, "checkpoint"))
    assert seen.count() == 2
    assert rows(results.stored_patches(seen).drop("inputs", "outputs", "executions").distinct())[0][0] == "s1"
    assert results.stored_patches(seen).select("step_id", "patched_at", "seq").distinct().count() == 1


def test_unknown_steps_are_errors(spark, queue):
    folder = queue("a.txt", result(step_id="s1"), result(step_id="lost"), result(step_id=...), "{")
    known = spark.createDataFrame([("s1",), ("s1",), ("s7",)], "step_id string")
    seen = consume(spark, folder, scratch(spark, "stored"), scratch(spark, "checkpoint"), known_steps=known)
    assert rows(seen.select("outcome", "reason")) == [
        ("error", "Step not found: lost"),
        ("error", "unreadable message"),
        ("skipped", "no_step_id"),
        ("updated", None),
    ]


def test_known_steps_are_narrowed_before_the_shuffle(spark, tmp_path):
    known = spark.range(100_000).select(F.concat(F.lit("s"), "id").alias("step_id"))
    raw = bodies(spark, result(step_id="s1"), result(step_id="s1"), result(step_id="lost"), result(step_id=...), "{")
    assert rows(results.asked_steps(raw)) == [("lost",), ("s1",)]
    results.asked_steps(raw).write.parquet(str(tmp_path / "ids"))
    near = results.narrowed(known, spark.read.schema("step_id string").parquet(str(tmp_path / "ids")))
    assert rows(near) == [("s1",)]
    text = near._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_batches_are_gathered(spark, tmp_path):
    """The newest batch stays, a call that died before it deleted costs nothing, and rows come once."""
    queue, stored, gathered = (str(tmp_path / n) for n in ("queue", "stored", "gathered"))
    Path(queue).mkdir()
    checkpoint = str(tmp_path / "checkpoint")

    def arrive(*steps):
        for step in steps:
            Path(queue, f"{step}.txt").write_text(json.dumps(result(step_id=step)) + "\n{\n")
        stream = messages.message_stream(spark, queue, files_per_batch=1)
        results.consume_results(stream, stored, checkpoint).awaitTermination()

    def seen():
        return rows(results.read_results(spark, stored, gathered).select("batch_id", "outcome", "step_id").orderBy("batch_id"))

    arrive("a", "b", "c")
    whole = seen()
    assert len(whole) == 6
    kept = tmp_path / "copy"
    shutil.copytree(stored, kept)
    results.gather_results(spark, stored, gathered)
    assert seen() == whole
    assert [len(b) for b in results._batches(spark, stored).values()] == [1]
    shutil.copytree(kept, stored, dirs_exist_ok=True)
    assert seen() == whole
    results.gather_results(spark, stored, gathered)
    assert seen() == whole and len(results._parts(spark, gathered)) == 1
    arrive("d", "e")
    results.gather_results(spark, stored, gathered)
    assert len(seen()) == 10 and len(results._parts(spark, gathered)) == 2
    assert [len(b) for b in results._batches(spark, stored).values()] == [1]


def test_published_messages_come_back(spark):
    decoded = envelope.decode(bodies(spark, result(handler="query", job_id="j", data={"n": 1})), "result").filter("valid")
    folder = scratch(spark, "published")
    made = events.domain_events(decoded)
    messages.publish(made, "event", folder)
    raw = spark.read.schema("body string, type string").text(folder)
    assert raw.first().type == "query.success"
    back = envelope.decode(raw.select("body"), "event").first()
    assert back.payload == {"job_id": "j", "step_id": "s1", "duration_ms": "0", "n": "1"}
    assert (back.correlation_id, back.source, back.timestamp.microsecond) == ("c", "query", 5)
    kafka = messages.kafka_rows(made, "event").first()
    assert kafka.key == "c" and {h.key: bytes(h.value).decode() for h in kafka.headers} == {
        "type": "query.success",
        "correlation_id": "c",
    }
    assert json.loads(kafka.value)["source"] == "query"


def test_tracked_runs(spark, database):
    context = Context("table", "corr", "job", "step")
    reads, writes = [data_ref("table", "a")], [data_ref("table", "b", metadata={"rows": 3})]
    ran = [execution_record("INSERT", {"x": 1})]
    good = tracked_write(
        spark.range(3), context, lambda f: f.write.saveAsTable(f"{database}.b"), reads, writes, ran
    ).first()
    assert (good.status, good.data, good.handler, good.job_id) == ("success", {"row_count": "3"}, "table", "job")
    assert good.outputs[0].metadata == {"rows": "3"} and good.duration_ms >= 0
    assert good.executions[0].details["dialect"] == "spark"

    def fail():
        raise RuntimeError("no such thing")

    bad = tracked(spark, context, fail, reads, writes, ran)
    row = bad.first()
    assert (row.status, row.errors, row.inputs, row.outputs, row.executions) == ("error", ["no such thing"], [], [], [])
    texts = bad.select(F.to_json(F.struct("*")).alias("body"))
    patch = results.step_patches(envelope.decode(texts, "result").filter("valid")).first()
    assert (patch.step_id, patch.status, patch.error) == ("step", "failed", "no such thing")


def test_later_positions_win_at_one_time(spark):
    texts = [json.dumps(result(status=status)) for status in ("pending", "success", "error")]
    for order in ([0, 1, 2], [2, 1, 0], [1, 2, 0]):
        raw = spark.createDataFrame([(texts[k], at) for at, k in enumerate(order)], "body string, position bigint")
        patches = results.step_patches(envelope.decode(raw, "result"))
        newest = patches.orderBy(F.desc("seq")).first()
        assert patches.count() == 3 and patches.select("seq").distinct().count() == 3
        assert newest.status == ("success" if order[-1] == 1 else "failed")
