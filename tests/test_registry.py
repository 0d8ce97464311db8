from __future__ import annotations

import pytest
from compare import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions.folding import compact, fold
from millrace.functions.skew import salted_join
from millrace.operators import lineage, registry
from millrace.operators.registry import JobQuery
from millrace.schemas import DATA_REF

REQUEST = "pipeline string, environment string, namespace string, job_id string, seq bigint"


def created(spark, *requests):
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(requests)], REQUEST)
    return registry.create_jobs(frame.withColumn("patched_at", F.timestamp_seconds("seq")), ["pipeline", "seq"])


def patches(spark, key, ddl, *entries):
    """Patch rows from (id, second, seq, fields…)."""
    frame = spark.createDataFrame(list(entries), f"{key} string, second bigint, seq bigint, {ddl}")
    return frame.withColumn("patched_at", F.timestamp_seconds("second")).drop("second")


def test_create_fills_defaults_and_keeps_given_ids(spark):
    jobs = created(spark, ("monthly", None, None, None), ("monthly", "prod", None, "job-mine"), ("m", "dev", "dev_alice", None), ("", "dev", None, None))
    shown = rows(jobs.select("pipeline", "environment", "namespace", "status", "logic_version"))
    assert shown == [
        ("m", "dev", "dev_alice", "pending", "unknown"),
        ("monthly", "dev", "dev", "pending", "unknown"),
        ("monthly", "prod", "prod", "pending", "unknown"),
    ]
    ids = [r.job_id for r in jobs.collect()]
    assert "job-mine" in ids and len(set(ids)) == 3
    assert all(len(i) == 68 and i.startswith("job-") for i in ids if i != "job-mine")


def test_status_sets_times_and_metadata_merges(spark):
    log = created(spark, ("p", "dev", None, "j1"), ("p", "dev", None, "j2")).unionByName(
        registry.job_updates(
            patches(
                spark, "job_id", "status string, error string, metadata map<string,string>",
                ("j1", 10, 1, "running", None, {"a": "1", "b": "1"}),
                ("j1", 20, 2, "success", None, {"b": "2", "duration_sec": "300"}),
                ("j1", 15, 3, None, "a note", None),
                ("nobody", 15, 4, "failed", "lost", None),
            )
        )
    )
    jobs = registry.current_jobs(log)
    shown = jobs.select("job_id", "status", F.unix_seconds("started_at"), F.unix_seconds("completed_at"), "error")
    assert rows(shown) == [("j1", "success", 10, 20, "a note"), ("j2", "pending", None, None, None)]
    assert jobs.filter("job_id = 'j1'").first().metadata == {"a": "1", "b": "2", "duration_sec": "300"}
    assert jobs.filter("job_id = 'j2'").first().metadata == {}
    assert rows(registry.unknown_patches(log, "job_id").select("job_id", "error")) == [("nobody", "lost")]


def test_log_is_stored_by_day_and_compacted(spark):
    from millrace.schemas import JOB
    from millrace.session import scratch

    place = scratch(spark, "log")
    registry.append_log(created(spark, ("p", "dev", None, "j1")), place)
    day = 86_400
    updates = [("j1", day * i, i, "running" if i < 9 else "success", None) for i in range(1, 10)]
    updates += [("j1", day * 5, 50, None, {"k": "v"}), ("j1", day * 4, 40, None, {"k": "old"})]
    registry.append_log(registry.job_updates(patches(spark, "job_id", "status string, metadata map<string,string>", *updates)), place)
    log = registry.read_log(spark, place, JOB)
    kept = registry.compact_jobs(log)
    assert sorted(r.seq for r in kept.collect()) == [0, 8, 9, 50]
    assert rows(registry.current_jobs(kept)) == rows(registry.current_jobs(log))
    assert log.count() == 12


def test_log_is_renewed(spark):
    """Questions fold the patches that matter and what came later, late ones among them."""
    from millrace.schemas import JOB
    from millrace.session import scratch
    from millrace.sources import storage

    place = scratch(spark, "log")
    registry.renew_log(spark, place, JOB)
    assert registry.read_log(spark, place, JOB).count() == 0
    day, update = 86_400, "status string, error string"
    registry.append_log(created(spark, ("p", "dev", None, "j1"), ("p", "dev", None, "j2")), place)
    updates = [("j1", day * i, i, "running", None) for i in range(1, 30)]
    registry.append_log(registry.job_updates(patches(spark, "job_id", update, *updates)), place)
    before = rows(registry.current_jobs(registry.read_log(spark, place, JOB)))
    registry.renew_log(spark, place, JOB)
    log = registry.read_log(spark, place, JOB)
    assert rows(registry.current_jobs(log)) == before and log.count() < 10
    late = patches(spark, "job_id", update, ("j1", day * 3, 99, "failed", "late note"), ("j2", day, 5, "success", None))
    registry.append_log(registry.job_updates(late), place)
    shown = registry.current_jobs(registry.read_log(spark, place, JOB)).select("job_id", "status", "error")
    assert rows(shown) == [("j1", "running", "late note"), ("j2", "success", None)]
    spark.range(1).write.parquet(f"{place}/generation-00000009")
    (done,) = [c for c in storage.children(spark, f"{place}/generation-00000009") if c.endswith("/_SUCCESS")]
    storage.delete(spark, done)
    assert rows(registry.current_jobs(registry.read_log(spark, place, JOB)).select("job_id", "status", "error")) == rows(shown)
    assert len(registry.prune_log(spark, place)) == 1 and registry.prune_log(spark, place) == []


def test_given_times_are_kept(spark):
    given = patches(spark, "job_id", "status string, started_at timestamp, completed_at timestamp", ("j1", 10, 1, "running", None, None))
    given = given.withColumn("started_at", F.timestamp_seconds(F.lit(5)))
    log = created(spark, ("p", "dev", None, "j1")).unionByName(registry.job_updates(given))
    assert registry.current_jobs(log).select(F.unix_seconds("started_at")).first()[0] == 5


ENTRIES = st.lists(
    st.tuples(
        st.sampled_from(["a", "b"]),
        st.one_of(st.none(), st.sampled_from(["pending", "running", "success"])),
        st.one_of(st.none(), st.dictionaries(st.sampled_from("xyz"), st.sampled_from("123"), max_size=2)),
    ),
    max_size=10,
)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(entries=ENTRIES, shuffled=st.randoms(use_true_random=False))
def test_fold_equals_updating_a_dictionary(spark, entries, shuffled):
    """Shuffled and replayed patches fold to what applying them in order gives."""
    state = {}
    for key, status, metadata in entries:
        old = state.get(key, (None, {}))
        state[key] = (status or old[0], {**old[1], **(metadata or {})})
    numbered = [(k, i // 2, i, s, m) for i, (k, s, m) in enumerate(entries)]
    arrived = numbered + numbered[:3]
    shuffled.shuffle(arrived)
    log = spark.createDataFrame(arrived, "k string, patched_at int, seq int, status string, metadata map<string,string>")
    as_dict = lambda frame: {r.k: (r.status, r.metadata) for r in fold(frame, "k", ["status"], ["metadata"]).collect()}
    assert as_dict(log) == state
    always = F.col("seq") == 0
    early, late = log.filter("seq % 3 <> 0"), log.filter("seq % 3 = 0")
    kept = compact(early, "k", ["status"], ["metadata"], always=always)
    assert as_dict(kept.unionByName(late)) == {k: v for k, v in state.items()}
    assert kept.count() <= early.count()


def test_query_jobs_filters_pages_and_orders(spark):
    jobs = registry.current_jobs(
        created(spark, *[(f"p{i % 2}", "prod" if i % 3 == 0 else "dev", None, f"j{i}") for i in range(8)])
    )
    names = lambda **criteria: [r.job_id for r in registry.query_jobs(jobs, JobQuery(**criteria)).collect()]
    assert names() == [f"j{i}" for i in reversed(range(8))]
    assert names(pipeline="p0") == ["j6", "j4", "j2", "j0"]
    assert names(pipeline="p0", environment="prod") == ["j6", "j0"]
    assert names(limit=2, offset=1) == ["j6", "j5"]
    bounds = {"created_after": "1970-01-01T00:00:02+00:00", "created_before": "1970-01-01T00:00:04+00:00"}
    assert names(**bounds) == ["j4", "j3", "j2"]
    assert names(namespace="dev", status="pending", logic_version="unknown", limit=1) == ["j7"]
    assert names(status="failed") == []


def refs(*locations):
    return [("table", location, None, None) for location in locations]


@pytest.fixture
def jobs(spark):
    return registry.current_jobs(
        created(spark, ("p", "dev", None, "j1"), ("p", "prod", None, "j2"))
    ).withColumn("logic_version", F.concat(F.lit("v-"), "job_id"))


@pytest.fixture
def steps(spark):
    data = [
        ("s1", "j1", refs("raw.a", "raw.b"), refs("main_a"), 5, 9),
        ("s2", "j2", refs("raw.a", "raw.a"), refs("main_a", "main_a"), 6, 8),
        ("s3", "j2", refs("main_a"), refs("mainXa"), None, None),
        ("s4", "j2", refs("main_a"), refs("main_a"), 7, None),
        ("s5", "gone", refs("raw.a"), refs("main_a"), 1, 1),
    ]
    ddl = f"step_id string, job_id string, inputs array<{DATA_REF}>, outputs array<{DATA_REF}>, started bigint, completed bigint"
    return spark.createDataFrame(data, ddl).select(
        "step_id", "job_id", "inputs", "outputs",
        F.lit("n").alias("step_name"), F.lit("h").alias("handler_type"), F.lit("a").alias("action"),
        F.lit("success").alias("status"), F.lit(3).alias("duration_ms"),
        F.array().cast("array<struct<execution_type:string,details:map<string,string>>>").alias("executions"),
        F.timestamp_seconds("started").alias("started_at"), F.timestamp_seconds("completed").alias("completed_at"),
    )


def test_producers_match_exactly_once_per_step(steps, jobs):
    found = lineage.producers(steps, jobs, "main_a").collect()
    assert [(r.step_id, r.logic_version) for r in found] == [("s1", "v-j1"), ("s2", "v-j2"), ("s4", "v-j2")]
    assert [r.step_id for r in lineage.producers(steps, jobs, "main_a", "dev").collect()] == ["s1"]
    assert lineage.producers(steps, jobs, "main%").count() == 0


def test_consumers_latest_start_first(steps, jobs):
    assert [r.step_id for r in lineage.consumers(steps, jobs, "main_a").collect()] == ["s4", "s3"]
    assert [r.step_id for r in lineage.consumers(steps, jobs, "raw.a").collect()] == ["s2", "s1"]


def test_bulk_lineage_agrees_with_single_questions(spark, steps, jobs):
    wanted = spark.createDataFrame([("main_a",), ("raw.a",), ("raw.a",)], "location string")
    for environment in (None, "prod"):
        bulk = rows(lineage.lineage(steps, jobs, wanted, environment=environment).select("location", "role", "step_id"))
        single = []
        for place in ("main_a", "raw.a"):
            single += [(place, "producer", r.step_id) for r in lineage.producers(steps, jobs, place, environment).collect()]
            single += [(place, "consumer", r.step_id) for r in lineage.consumers(steps, jobs, place, environment).collect()]
        assert bulk == sorted(single, key=repr)
    assert {r.role for r in lineage.lineage(steps, jobs, direction="producers").collect()} == {"producer"}
    with pytest.raises(ValueError, match="Invalid direction"):
        lineage.edges(steps, "up")


def test_job_steps_summary_and_orphans(spark, steps, jobs):
    listed = registry.job_steps(steps, "j2").collect()
    assert [(r.step_id, r.input_count, r.output_count) for r in listed] == [("s2", 2, 2), ("s4", 1, 1), ("s3", 1, 1)]
    assert rows(registry.job_summary(steps).select("job_id", "steps", "success_steps", "total_duration_ms")) == [
        ("gone", 1, 1, 3), ("j1", 1, 1, 3), ("j2", 3, 3, 9),
    ]
    assert rows(registry.orphan_steps(steps, jobs).select("step_id")) == [("s5",)]
    wanted = spark.createDataFrame([("s1",), ("none",)], "step_id string")
    assert rows(registry.get_by_id(steps, wanted, "step_id").select("step_id", "found")) == [("none", False), ("s1", True)]


def test_step_lists_are_replaced_not_merged(spark):
    request = spark.createDataFrame([("j1", "load", "transform", "run", 0), ("j1", "", "transform", "run", 0)], "job_id string, step_name string, handler_type string, action string, seq bigint")
    added = registry.add_steps(request.withColumn("patched_at", F.timestamp_seconds("seq")).withColumn("step_id", F.lit("s1")), ["seq"])
    assert added.count() == 1
    ddl = f"status string, inputs array<{DATA_REF}>, outputs array<{DATA_REF}>, duration_ms int"
    updates = patches(
        spark, "step_id", ddl,
        ("s1", 1, 1, "running", refs("raw.departments", "raw.employees"), None, None),
        ("s1", 2, 2, "success", None, refs("main.stg_departments"), 1500),
        ("s1", 3, 3, None, refs("raw.other"), None, None),
    )
    step = registry.current_steps(added.unionByName(registry.step_updates(updates))).first()
    assert [i.location for i in step.inputs] == ["raw.other"]
    assert [o.location for o in step.outputs] == ["main.stg_departments"]
    assert (step.status, step.duration_ms, step.executions) == ("success", 1500, [])
    assert step.started_at < step.completed_at


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_a_join(spark, how):
    big = spark.range(300).select(F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 7).alias("k"), "id")
    small = spark.createDataFrame([(0, "zero"), (3, "three"), (99, "none")], "k bigint, label string")
    assert rows(salted_join(big, small, ["k"], ["id"], how)) == rows(big.join(small, ["k"], how))
