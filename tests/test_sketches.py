"""Stored sketches against exact figures of the rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from compare import rows
from millrace.operators import sketches
from millrace.session import scratch

START = datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def given():
    rng = random.Random(3)
    out = []
    for i in range(20_000):
        group = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        value = None if rng.random() < 0.02 else rng.gauss(0, 1) ** 3
        out.append((START + timedelta(minutes=rng.randrange(10 * 24 * 60)), group, f"u{rng.randrange(5000)}", value))
    return out


@pytest.fixture(scope="module")
def place(spark, given):
    path = scratch(spark, "sketches")
    frame = spark.createDataFrame(given, "ts timestamp, g string, u string, v double")
    for day in (0, 5):  # two appends of different days
        some = frame.where((F.col("ts") >= START + timedelta(days=day)) & (F.col("ts") < START + timedelta(days=day + 5)))
        sketches.store(sketches.daily(some, "ts", ["g"], ["u"], ["v"]), path)
    return path


@pytest.mark.parametrize(("first", "last"), [(None, None), ("2024-03-02", "2024-03-04"), ("2024-03-06", "2024-03-06")])
def test_ranges_of_days(spark, given, place, first, last):
    kept = [r for r in given if (first is None or str(r[0].date()) >= first) and (last is None or str(r[0].date()) <= last)]
    quantiles = [0.1, 0.5, 0.99]
    found = sketches.merged(sketches.stored(spark, place, first, last), ["g"], ["u"], {"v": quantiles}).collect()
    assert {r.g for r in found} == {"hot", "a", "b", None}
    for r in found:
        mine = [x for x in kept if x[1] == r.g]
        values = sorted(x[3] for x in mine if x[3] is not None)
        users = len({x[2] for x in mine})
        assert r.n == len(mine) and abs(r.u_distinct - users) <= 1 + sketches.distinct_bound() * users
        for q, value in zip(quantiles, r.v_quantiles, strict=True):
            rank = sum(v <= value for v in values) / len(values)
            assert abs(rank - q) <= sketches.rank_bound() + 2 / len(values)
    whole = sketches.merged(sketches.stored(spark, place, first, last), [], ["u"]).first()
    users = len({x[2] for x in kept})
    assert whole.n == len(kept) and abs(whole.u_distinct - users) <= 1 + sketches.distinct_bound() * users


def test_only_the_wanted_days_are_read(spark, place):
    frame = sketches.stored(spark, place, "2024-03-02", "2024-03-03")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert len(frame.inputFiles()) >= 2 and frame.select("day").distinct().count() == 2


def test_days_written_anew(spark):
    path, kinds = scratch(spark, "sketches"), "ts timestamp, g string, u string, v double"
    one = spark.createDataFrame([(START, "a", "x", 1.0), (START + timedelta(days=1), "a", "y", 2.0)], kinds)
    sketches.store(sketches.daily(one, "ts", ["g"], ["u"], ["v"]), path)
    two = spark.createDataFrame([(START, "a", u, None) for u in "pqr"], kinds)
    sketches.store(sketches.daily(two, "ts", ["g"], ["u"], ["v"]), path, replace=True)
    days = sketches.merged(sketches.stored(spark, path), ["day"], ["u"], {"v": [0.5]})
    assert rows(days.select(F.col("day").cast("string"), "n", "u_distinct", "v_quantiles")) == [
        ("2024-03-01", 3, 3, None), ("2024-03-02", 1, 1, [2.0]),
    ]


def test_nothing(spark):
    none = spark.createDataFrame([], "ts timestamp, g string, u string, v double")
    assert sketches.merged(sketches.daily(none, "ts", ["g"], ["u"], ["v"]), ["g"], ["u"], {"v": [0.5]}).count() == 0
