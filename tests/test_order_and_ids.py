"""Ids, positions, refused requests, null places in a log, converted numbers, both merge plans."""

from __future__ import annotations

import json

import pytest
from compare import rows
from pyspark.sql import functions as F

from millrace.functions.folding import compact, fold
from millrace.functions.ids import stable_id
from millrace.functions.positions import positions
from millrace.operators import manifest, registry, sql, tables
from millrace.operators.tables import ColumnSpec
from millrace.streaming import envelope


def test_ids_differ_where_parts_do(spark):
    parts = [("a|b", "c"), ("a", "b|c"), ("a", None), (None, "a"), ("a", ""), ("1:a", None), ("a1:", "b"), ("a", "1:b")]
    found = spark.createDataFrame([*parts, parts[0]], "x string, y string").select(stable_id("job", F.col("x"), F.col("y")))
    ids = [r[0] for r in found.collect()]
    assert len(set(ids)) == len(parts) and ids[0] == ids[-1] and all(len(i) == 68 for i in ids)


def test_positions(spark):
    frame = spark.createDataFrame([(i % 7, str(i)) for i in range(500)] + [(None, "n")], "a int, b string")
    found = positions(frame, F.desc_nulls_last("a"), F.asc("b"))
    assert "SinglePartition" not in found._jdf.queryExecution().logical().toString()
    expected = sorted(frame.collect(), key=lambda r: (-r.a if r.a is not None else 1, r.b))
    assert [tuple(r) for r in found.orderBy("position").collect()] == [(*r, i) for i, r in enumerate(expected, 1)]
    assert positions(frame.limit(0), F.asc("a")).count() == 0


def test_compaction_keeps_patches_without_a_place(spark):
    log = spark.createDataFrame([("a", "x", None, None), ("a", None, 3, 1), ("b", "y", 2, None)], "id string, f string, patched_at int, seq int")
    assert rows(fold(compact(log, "id", ["f"]), "id", ["f"])) == rows(fold(log, "id", ["f"])) == [("a", "x"), ("b", "y")]


def test_refused_requests(spark):
    made = [("p", 1), ("", 2), (None, 3)]
    requests = spark.createDataFrame(made, "pipeline string, seq int").withColumn("patched_at", F.lit("2025-01-01").cast("timestamp"))
    assert registry.create_jobs(requests, ["seq"]).count() == 1
    assert rows(registry.rejected_jobs(requests).select("seq", "reason")) == [(2, "pipeline is missing"), (3, "pipeline is missing")]
    steps = [("j1", "s", "h", "a", 1), ("j2", "s", "h", "a", 2), ("j1", "", "h", "a", 3), (None, "s", "h", "a", 4)]
    requests = spark.createDataFrame(steps, "job_id string, step_name string, handler_type string, action string, seq int").withColumn(
        "patched_at", F.lit("2025-01-01").cast("timestamp"))
    jobs = spark.createDataFrame([("j1",), ("j1",)], "job_id string")
    assert rows(registry.add_steps(requests, ["seq"], jobs).select("seq")) == [(1,)]
    assert rows(registry.rejected_steps(requests, jobs).select("seq", "reason")) == [
        (2, "job does not exist"), (3, "step_name is missing"), (4, "job_id is missing")]
    assert registry.add_steps(requests, ["seq"]).count() + registry.rejected_steps(requests).count() == 4


def test_script_text(spark, database):
    sql.execute_script(spark, f"CREATE TABLE {database}.t (id INT, name STRING) USING parquet;\nINSERT INTO {database}.t VALUES (4, 'x;y'), (5, 'z');\n")
    assert rows(spark.table(f"{database}.t")) == [(4, "x;y"), (5, "z")]
    assert sql.execute_script(spark, " ; ")


def test_projects_of_one_folder_name(spark, tmp_path):
    for side, good in (("a", True), ("b", False)):
        target = tmp_path / side / "proj" / "target"
        target.mkdir(parents=True)
        node = {"resource_type": "model", "relation_name": f"main.{side}", "depends_on": {"nodes": []}}
        (target / "manifest.json").write_text(json.dumps({"nodes": {f"model.{side}": node}}))
        if good:
            (target / "run_results.json").write_text(json.dumps({"results": [{"unique_id": f"model.{side}", "status": "success"}]}))
    documents = [manifest.read_documents(spark, str(tmp_path), n) for n in ("manifest.json", "run_results.json")]
    found = manifest.manifest_lineage(*documents)
    assert rows(found.select("project", "role", "location")) == [("a/proj", "output", "main.a"), ("b/proj", "output", "main.b")]


def test_durations_are_converted(spark):
    given = [12, "12", 12.0, "12.0", None, 12.5, "x", 2**40]
    bodies = [(json.dumps({"status": "success", "correlation_id": str(i), "duration_ms": d}),) for i, d in enumerate(given)]
    found = envelope.decode(spark.createDataFrame(bodies, "body string"), "result")
    got = {int(r.correlation_id): (r.valid, r.duration_ms) for r in found.collect()}
    assert [got[i] for i in range(5)] == [(True, 12)] * 4 + [(True, 0)]
    assert [got[i][0] for i in range(5, 8)] == [False] * 3


@pytest.mark.parametrize("limit", ["-1", "10485760"])
def test_upsert_by_either_plan(spark, database, limit):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        name = f"{database}.merged"
        tables.create_table(spark, name, [ColumnSpec("id", "INTEGER", primary_key=True), ColumnSpec("value", "VARCHAR")])
        tables.insert(spark, name, [{"id": i, "value": "old"} for i in range(20)])
        tables.upsert(spark, name, [{"id": i, "value": "new"} for i in range(15, 25)], ["id"])
        assert rows(spark.table(name)) == sorted(((i, "new" if i >= 15 else "old") for i in range(25)), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
