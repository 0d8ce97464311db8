"""As-of joins, running counts and overlapping intervals against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from compare import rows
from millrace.operators import time_joins
from millrace.session import scratch

LEFT = "id long, k string, t long, u long, note string"
RIGHT = "k string, s long, e long, seq long, state string"


def tables(spark, seed, hot=0.5):
    rng = random.Random(seed)
    key = lambda: "hot" if rng.random() < hot else rng.choice(["a", "b", "ü", None])
    time = lambda: None if rng.random() < 0.05 else rng.randrange(-300, 300)
    left = []
    for i in range(150):
        t = time()
        left.append((i, key(), t, None if t is None else t + rng.choice([-5, 0, 1, 3, 40, 900]), None if i % 9 else "n"))
    right = []
    for i in range(200):
        s = time()
        right.append((key(), s, None if s is None else s + rng.choice([0, 1, 2, 30, 700]), i % 50, None if i % 11 == 0 else f"s{i}"))
    right += right[:5]
    return left, right, spark.createDataFrame(left, LEFT).repartition(3), spark.createDataFrame(right, RIGHT)


@pytest.mark.parametrize("slab", [1, 7, 10_000])
@pytest.mark.parametrize("inclusive", [True, False])
def test_asof(spark, slab, inclusive):
    left, right, a, b = tables(spark, slab)
    right = [(*r[:3], n, *r[4:]) for n, r in enumerate(right)]  # ties decided by a distinct number
    b = spark.createDataFrame(right, RIGHT)
    found = time_joins.asof_join(a, b, ["k"], "t", "s", {"state": "state", "at": "s"}, slab, ["seq"], inclusive)
    want = []
    for row in left:
        near = [r for r in right if None not in (row[1], row[2], r[0], r[1]) and r[0] == row[1] and (r[1] <= row[2] if inclusive else r[1] < row[2])]
        best = max(near, key=lambda r: (r[1], r[3]), default=None)
        want.append((*row, best[4] if best else None, best[1] if best else None))
    assert rows(found) == sorted(want, key=repr)


def test_asof_of_nothing(spark):
    _, _, a, b = tables(spark, 1)
    found = time_joins.asof_join(a, b.limit(0), ["k"], "t", "s", {"state": "state"}, 5)
    assert found.count() == a.count() and found.where("state is not null").count() == 0
    assert time_joins.asof_join(a.limit(0), b, ["k"], "t", "s", {"state": "state"}, 5).count() == 0
    with pytest.raises(ValueError, match="note"):
        time_joins.asof_join(a, b, ["k"], "t", "s", {"note": "state"}, 5)
    with pytest.raises(ValueError, match="slab"):
        time_joins.asof_join(a, b, ["k"], "t", "s", {"state": "state"}, 0)


def test_asof_without_ties_columns_and_without_keys(spark):
    a = spark.createDataFrame([(1, 5), (2, 9)], "id long, t long")
    b = spark.createDataFrame([(4, {"x": 1}), (9, {"x": 2})], "s long, m map<string,int>")
    found = time_joins.asof_join(a, b, [], "t", "s", {"m": "m"}, 3)
    assert rows(found.select("id", F.col("m")["x"])) == [(1, 1), (2, 2)]


@pytest.mark.parametrize("slab", [1, 13, 5000])
def test_counts(spark, slab):
    left, right, a, b = tables(spark, 30 + slab)
    found = time_joins.count_before(a, b, ["k"], "t", "s", "n", slab)
    want = [(*x, None if None in (x[1], x[2]) else sum(r[0] == x[1] and r[1] is not None and r[1] <= x[2] for r in right)) for x in left]
    assert rows(found) == sorted(want, key=repr)


def meet(x, r):
    if None in (x[1], x[2], x[3], r[0], r[1], r[2]) or x[1] != r[0]:
        return False
    return x[2] < x[3] and r[1] < r[2] and x[2] < r[2] and r[1] < x[3]


@pytest.mark.parametrize("width", [1, 4, 100, 100_000])
def test_overlaps(spark, width):
    left, right, a, b = tables(spark, 60 + width)
    pairs = time_joins.overlap_join(a, b, ["k"], ("t", "u"), ("s", "e"), width).select("l.id", "r.s", "r.e", "r.seq", "r.state")
    want = [(x[0], *r[1:]) for x in left for r in right if meet(x, r)]
    assert rows(pairs) == sorted(want, key=repr) and len(want) > 500
    counted = time_joins.overlap_counts(a, b, ["k"], ("t", "u"), ("s", "e"), "n", width)
    assert rows(counted) == sorted([(*x, sum(meet(x, r) for r in right)) for x in left], key=repr)


def test_overlap_of_intervals_beyond_the_coarsest_bins(spark):
    top = time_joins.FACTOR**time_joins.LEVELS
    a = spark.createDataFrame([(1, 0, 20 * top), (2, 3, 4)], "id long, t long, u long")
    found = time_joins.overlap_join(a, a, [], ("t", "u"), ("t", "u"), 1).select("l.id", F.col("r.id").alias("other"))
    assert rows(found) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_plans_compare_no_other_keys(spark):
    _, _, a, b = tables(spark, 2)
    frames = [
        time_joins.asof_join(a, b, ["k"], "t", "s", {"state": "state"}, 50),
        time_joins.overlap_counts(a, b, ["k"], ("t", "u"), ("s", "e"), "n", 50),
        time_joins.overlap_join(a, b, ["k"], ("t", "u"), ("s", "e"), 4),
    ]
    for frame in frames:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlap_shuffles_what_is_asked_at_the_levels_that_are_used(spark):
    left, right, a, b = tables(spark, 3)
    places = scratch(spark, "spans"), scratch(spark, "spans")
    a.write.parquet(places[0])
    b.write.parquet(places[1])
    a, b = (spark.read.parquet(p) for p in places)
    pairs = time_joins.overlap_join(a, b, ["k"], ("t", "u"), ("s", "e"), 4).select("l.id", "r.seq")
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "note" not in plan and "state" not in plan
    assert plan.count("SortMergeJoin") == 2  # however small its tables are, the rows in bins are not broadcast
    assert rows(pairs) == sorted([(x[0], r[3]) for x in left for r in right if meet(x, r)], key=repr)
    # Lengths of 3 and 900 fit levels 0 and 3 of 4: each row stands there at most, not at all eight.
    c = a.where("u - t in (3, 900)")
    d = time_joins._levelled(c, ["k"], ("t", "u"), 4, "_l")
    assert {r[0] for r in d.select("_l_own").distinct().collect()} == {0, 3}
    e = time_joins._levelled(c, ["k"], ("t", "u"), 4, "_r")
    found = time_joins._lifted(d, "_l", e, "_r", 0)
    assert found.count() == 2 * d.where("_l_own = 0").count() + d.where("_l_own = 3").count()
