"""Keyed reads give what scans give, and read less."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from compare import rows
from millrace.operators import catalog, indexes, lineage

STEP = (
    "step_id string, job_id string, step_name string, handler_type string, started_at timestamp, completed_at timestamp, "
    "inputs array<struct<location:string>>, outputs array<struct<location:string>>"
)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_ids_read_their_buckets(spark, database):
    name = f"{database}.log"
    for n in range(3):
        frame = spark.range(300).select((F.col("id") % 40).cast("string").alias("k"), (F.col("id") + 1000 * n).alias("v"))
        indexes.keep_bucketed(frame, name, "k", 8)
    found = indexes.of_ids(spark, name, "k", ["7", "7", None, "missing"])
    plan = plan_of(found.groupBy("k").agg(F.max("v")))
    assert re.search("SelectedBucketsCount: [12] out of 8", plan) and "Exchange" not in plan
    assert rows(found) == sorted([("7", i + 1000 * n) for n in range(3) for i in range(300) if i % 40 == 7], key=repr)
    assert indexes.of_ids(spark, name, "k", []).count() == 0
    folded = spark.table(name).groupBy("k").agg(F.max_by("v", "v").alias("v"))
    assert "Exchange" not in plan_of(folded) and folded.count() == 40


@pytest.mark.parametrize("direction", ["both", "producers", "consumers"])
def test_indexed_lineage(spark, database, direction):
    rng = random.Random(8)
    place = lambda: [(rng.choice(["hot", "hot", None, *(f"p{n}" for n in range(200))]),) for _ in range(rng.randrange(4))]
    steps = [(f"s{i}", f"j{i % 7}", "n", "h", None, None, None if i % 50 == 0 else place(), place()) for i in range(400)]
    frame = spark.createDataFrame(steps, STEP)
    jobs = spark.createDataFrame([(f"j{n}", "dev", "v") for n in range(6)], "job_id string, environment string, logic_version string")
    for half in (0, 1):
        indexes.index_locations(frame.filter(f"cast(substring(step_id, 2) as int) % 2 = {half}"), f"{database}.places")
    # An entry that is out of date: the step names the location no more.
    indexes.index_locations(spark.createDataFrame([("s1", "j1", "n", "h", None, None, [("p5",)], [("p5",)])], STEP), f"{database}.places")
    for wanted in (["p3", "p4", "none"], ["hot"], ["p5", None], []):
        asked = spark.createDataFrame([(w,) for w in wanted], "location string")
        ids = indexes.steps_naming(spark, f"{database}.places", asked, direction)
        if wanted:
            assert "PartitionFilters: [isnotnull(part" in plan_of(ids) or "PartitionFilters: [part" in plan_of(ids)
        some = frame.join(ids, "step_id", "left_semi")
        whole = lineage.lineage(frame, jobs, asked.where("location is not null"), direction)
        assert rows(lineage.lineage(some, jobs, asked.where("location is not null"), direction)) == rows(whole)
        assert ids.count() < 400 or "hot" in wanted


def test_indexed_search(spark, database):
    words = ["Orders", "orders_daily", "İstanbul", "50%_off", "a_b", "ab", "", "ABC abc", "straße", "DÉPÔT", "aaaa"]
    rng = random.Random(2)
    assets = [(f"{rng.choice(words)} {i}", rng.choice([None, *words, "some Text " + rng.choice(words)]), "table", ["t"]) for i in range(200)]
    frame = spark.createDataFrame(assets, "name string, description string, asset_type string, tags array<string>")
    indexes.index_text(frame, f"{database}.pieces", 8)
    for query in ("orders", "ORDERS_D", "50%_", "a_b", "xt a", "straße", "dépôt", "istanbul", "İst", "aaa", "aaaa", "none at all", "ab", "c", " 12"):
        want = rows(catalog.search(frame, query))
        assert rows(indexes.search_indexed(frame, f"{database}.pieces", query)) == want, query
    assert indexes.names_with(spark, f"{database}.pieces", "ab") is None
    names = indexes.names_with(spark, f"{database}.pieces", "orders_daily")
    assert "SelectedBucketsCount" in plan_of(names) and "SelectedBucketsCount: 8 out" not in plan_of(names) and 0 < names.count() < 200
    assert indexes.search_indexed(frame, f"{database}.pieces", "orders", "view").count() == 0
