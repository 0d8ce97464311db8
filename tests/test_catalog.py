from __future__ import annotations

import random

import pytest
from compare import rows
from pyspark.sql import functions as F

from millrace.operators import catalog

LOG = "op string, name string, asset_type string, description string, tags array<string>, seq bigint"


def log(spark, *entries):
    """Log rows from (op, name, type, description, tags); the position gives time and sequence."""
    data = [(*entry, i) for i, entry in enumerate(entries)]
    frame = spark.createDataFrame(data, LOG).withColumn("logged_at", F.timestamp_seconds("seq"))
    ops = frame.select("name", "op", "seq").withColumnRenamed("op", "given")
    filled = catalog.registrations(frame.drop("op")).join(ops, ["name", "seq"])
    return filled.withColumn("op", F.col("given")).drop("given")


def reg(name, kind="table", description="", tags=()):
    return ("register", name, kind, description, list(tags))


def unreg(name):
    return ("unregister", name, "-", "", [])


def seconds(assets):
    return rows(
        assets.select("name", "asset_type", F.unix_seconds("created_at"), F.unix_seconds("updated_at"))
    )


def test_register_replaces_and_keeps_created_at(spark):
    entries = [reg("a"), reg("b"), reg("a", "model", "again", ["t"])]
    assets = catalog.current_assets(log(spark, *entries))
    assert seconds(assets) == [("a", "model", 0, 2), ("b", "table", 1, 1)]
    assert rows(assets.filter("name = 'a'").select("description", "tags", "location")) == [("again", ["t"], "")]


def test_removal_ends_a_life(spark):
    entries = [reg("a"), reg("b"), unreg("a"), reg("c"), reg("a", "view"), reg("a", "model"), unreg("b"), unreg("ghost")]
    assert seconds(catalog.current_assets(log(spark, *entries))) == [("a", "model", 4, 5), ("c", "table", 3, 3)]


def test_fold_ignores_arrival_order(spark):
    shuffler = random.Random(7)
    entries = [
        unreg(f"n{shuffler.randrange(4)}") if shuffler.random() < 0.25 else reg(f"n{shuffler.randrange(4)}", f"k{i}")
        for i in range(40)
    ]
    full = log(spark, *entries)
    expected = {}
    for i, (op, name, kind, *_) in enumerate(entries):
        if op == "unregister":
            expected.pop(name, None)
        else:
            expected[name] = (kind, expected.get(name, (None, i))[1], i)
    for seed in (1, 2):
        mixed = full.orderBy(F.rand(seed)).union(full.limit(5))
        assert seconds(catalog.current_assets(mixed)) == [(n, *expected[n]) for n in sorted(expected)]


def test_registrations_need_name_and_type(spark):
    frame = spark.createDataFrame([("a", "table"), ("", "table"), ("b", None)], "name string, asset_type string")
    assert rows(catalog.registrations(frame).select("name", "tags", "metadata")) == [("a", [], {})]
    assert catalog.rejected(frame).count() == 2


@pytest.fixture
def assets(spark):
    return catalog.current_assets(
        log(
            spark,
            reg("raw_orders", "table", "Order data", ["raw", "orders"]),
            reg("raw_products", "table", "Product catalog", ["raw"]),
            reg("stg_orders", "model", "Staged orders", ["staging", "orders"]),
            reg("fact_sales", "model", "100% of ORDER lines", ["mart", "fact", "fact"]),
        )
    )


@pytest.mark.parametrize(
    ("criteria", "names"),
    [
        ({"asset_type": "model"}, ["fact_sales", "stg_orders"]),
        ({"tags": ["orders"]}, ["raw_orders", "stg_orders"]),
        ({"tags": ["orders", "raw"]}, ["raw_orders"]),
        ({"query": "order"}, ["fact_sales", "raw_orders", "stg_orders"]),
        ({"query": "ORDER", "asset_type": "table"}, ["raw_orders"]),
        ({"query": "100%"}, ["fact_sales"]),
        ({"query": "raw_"}, ["raw_orders", "raw_products"]),
        ({"query": "rawxorders"}, []),
        ({"query": "", "asset_type": "", "tags": []}, ["fact_sales", "raw_orders", "raw_products", "stg_orders"]),
    ],
)
def test_search(assets, criteria, names):
    assert [r.name for r in catalog.search(assets, **criteria).collect()] == names


def test_get_and_unregister(spark, assets):
    wanted = spark.createDataFrame([("raw_orders",), ("nope",), ("nope",)], "name string")
    assert rows(catalog.get_assets(assets, wanted).select("name", "found", "asset_type")) == [
        ("nope", False, None),
        ("raw_orders", True, "table"),
    ]
    assert rows(catalog.unregister_report(assets, wanted)) == [("nope", False), ("raw_orders", True)]
    assert catalog.unregister(assets, wanted).count() == 3
    assert catalog.list_assets(assets).first().name == "fact_sales"


def test_stats_count_repeated_tags(assets):
    assert rows(catalog.stats(assets)) == sorted(
        [
            ("total", "", 4), ("type", "table", 2), ("type", "model", 2), ("tag", "raw", 2), ("tag", "orders", 2),
            ("tag", "staging", 1), ("tag", "mart", 1), ("tag", "fact", 2),
        ],
        key=repr,
    )


def test_lineage_is_one_hop_as_registered(spark):
    assets = spark.createDataFrame(
        [("stg", ["raw"], ["fact", "dim"]), ("raw", [], [])], "name string, upstream array<string>, downstream array<string>"
    )
    names = spark.createDataFrame([("stg",), ("unknown",)], "name string")
    both = [("stg", "downstream", "dim"), ("stg", "downstream", "fact"), ("stg", "upstream", "raw")]
    assert rows(catalog.asset_lineage(assets, names)) == both
    assert rows(catalog.asset_lineage(assets, names, "upstream")) == both[2:]
    assert rows(catalog.asset_lineage(assets, names, "downstream")) == both[:2]
    assert rows(catalog.asset_lineage(assets, names.filter("name = 'unknown'"))) == []
    assert rows(catalog.asset_lineage(assets, spark.createDataFrame([("raw",)], "name string"))) == []
    with pytest.raises(ValueError, match="no such direction"):
        catalog.asset_lineage(assets, names, "sideways")


def test_persists_as_a_table(spark, database, assets):
    from millrace.operators import tables

    tables.store(spark, f"{database}.assets", assets)
    again = spark.table(f"{database}.assets")
    assert rows(again.filter("name = 'raw_orders'").select("description", "tags")) == [
        ("Order data", ["raw", "orders"])
    ]
