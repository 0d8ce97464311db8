from __future__ import annotations

import base64
import json
from pathlib import Path

import pytest
from compare import rows

from millrace.operators.manifest import manifest_lineage, read_documents
from millrace.sources import objects


@pytest.fixture
def store(tmp_path):
    for i in range(3):
        path = Path(tmp_path, "list-test", f"file{i}.txt")
        path.parent.mkdir(exist_ok=True)
        path.write_text("x" * (i + 1))
    Path(tmp_path, "head").mkdir()
    Path(tmp_path, "head", "with space.txt").write_text("head test content")
    return str(tmp_path)


def test_listing_and_pages(spark, store):
    listed = objects.list_objects(spark, store, "list-test/")
    assert rows(listed.select("path", "size"), "path") == [(f"list-test/file{i}.txt", i + 1) for i in range(3)]
    assert listed.select("etag").distinct().count() == 3
    page = objects.list_page(spark, store, "list-test/", max_keys=2)
    assert (page.count, page.is_truncated, page.next_start) == (2, True, "list-test/file1.txt")
    rest = objects.list_page(spark, store, "list-test/", max_keys=2, start_after=page.next_start)
    assert ([o.path for o in rest.objects], rest.is_truncated) == (["list-test/file2.txt"], False)
    assert objects.list_page(spark, store).count == 4
    assert objects.list_page(spark, store, "nothing/").count == 0


def test_scan_and_stat(spark, store):
    body = objects.scan_objects(spark, store, "head/").first()
    assert (body.path, bytes(body.body), body.size) == ("head/with space.txt", b"head test content", 17)
    assert base64.b64decode(body.body_base64) == b"head test content"
    wanted = spark.createDataFrame([("head/with space.txt",), ("missing",)], "path string")
    assert rows(objects.stat_objects(spark, store, wanted).select("path", "found", "size")) == [
        ("head/with space.txt", True, 17),
        ("missing", False, None),
    ]


def test_keys_are_exact(spark, tmp_path):
    """Names with pattern and escape characters, and a root name that occurs again below it."""
    root = Path(tmp_path, "data")
    names = ["a+b.txt", "c%20d.txt", "x/data/y.txt", "x/[1]{2}.txt", "x/star*.txt"]
    for name in names:
        path = Path(root, name)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("1")
    listed = lambda prefix=None: [r.path for r in objects.list_objects(spark, str(root), prefix).orderBy("path").collect()]
    assert listed() == sorted(names)
    assert listed("x/") == ["x/[1]{2}.txt", "x/data/y.txt", "x/star*.txt"]
    assert listed("x/d") == ["x/data/y.txt"]
    assert listed("x/[1]{") == ["x/[1]{2}.txt"]
    assert listed("x/star*") == ["x/star*.txt"]
    assert listed("c%") == ["c%20d.txt"]
    assert listed("*") == []


def test_empty_and_hidden_objects(spark, tmp_path):
    """Names that begin with _ or ., and empty bodies, in listing, scan and stat; folders are no objects."""
    root = Path(tmp_path, "data")
    bodies = {"empty.txt": b"", "_x": b"1", ".x": b"22", "p/_y/.z": b"", "p/_y/w.bin": bytes(range(256)), ".h/a": b"7", "p/q/r/s/t": b"t"}
    for name, body in bodies.items():
        path = Path(root, name)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    Path(root, "nothing", "here").mkdir(parents=True)
    for spread in (1, 3, 64):  # however many folders the driver walks itself
        listed = objects.list_objects(spark, str(root), spread=spread)
        assert rows(listed.select("path", "size"), "path") == sorted((n, len(b)) for n, b in bodies.items())
        some = objects.list_objects(spark, str(root), "p/_", spread)
        assert [r.path for r in some.orderBy("path").collect()] == ["p/_y/.z", "p/_y/w.bin"]
    assert {r.path: bytes(r.body) for r in objects.scan_objects(spark, str(root)).collect()} == bodies
    assert [r.path for r in objects.scan_objects(spark, str(root), ".").orderBy("path").collect()] == [".h/a", ".x"]
    asked = [*bodies, "p", "", None, "p/_y/", "p//_y/.z", "../data/_x", "/_x", "no", "_x"]
    wanted = spark.createDataFrame([(p, n) for n, p in enumerate(asked)], "path string, n long")
    stats = objects.stat_objects(spark, str(root), wanted)
    assert stats.columns == ["path", "n", "size", "etag", "last_modified", "found"]
    found = {r.n: r for r in stats.collect()}
    times = {r.path: (r.etag, r.last_modified) for r in objects.list_objects(spark, str(root)).collect()}
    for n, path in enumerate(asked):
        real = path in bodies
        assert (found[n].found, found[n].size) == (real, len(bodies[path]) if real else None)
        assert (found[n].etag, found[n].last_modified) == (times[path] if real else (None, None))
    assert objects.list_objects(spark, str(Path(tmp_path, "missing"))).count() == 0


def test_stat_lists_nothing(spark, store):
    wanted = spark.createDataFrame([("head/with space.txt",)], "path string")
    plan = objects.stat_objects(spark, store, wanted)._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" not in plan and "binaryFile" not in plan and "Join" not in plan
    with pytest.raises(ValueError, match="size"):
        objects.stat_objects(spark, store, wanted.selectExpr("path", "1 as size"))


def test_many_objects_of_one_folder_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(objects, "CHUNK", 100)
    for i in range(60):
        Path(tmp_path, f"o{i:02d}").write_bytes(b"x" * i)
    bodies = objects.scan_objects(spark, str(tmp_path))
    assert sorted((r.path, r.size) for r in bodies.collect()) == [(f"o{i:02d}", i) for i in range(60)]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert bodies.rdd.getNumPartitions() == tasks > 1


def test_roots():
    assert objects.open_store("file:/a b/c%20d/")[1] == "/a b/c%20d"
    assert objects.open_store("/x/y")[1] == "/x/y" and objects.open_store("file:///x")[1] == "/x"


def node(kind, relation, *needs):
    return {"resource_type": kind, "relation_name": relation, "depends_on": {"nodes": list(needs)}}


NODES = {
    "seed.raw": node("seed", '"db"."main"."raw"'),
    "model.stg": node("model", '"db"."main"."stg"', "seed.raw", "source.ext"),
    "model.copy": node("model", '"db"."main"."stg"', "seed.raw"),
    "model.mart": node("model", '"db"."main"."mart"', "model.stg", "model.eph"),
    "model.eph": node("model", None, "model.stg"),
    "test.t": node("test", None, "model.mart"),
}
RAW, STG, MART = "db.main.raw", "db.main.stg", "db.main.mart"
EVERYTHING = [
    ("input", RAW, "seed.raw"),
    ("input", STG, "model.stg"),
    ("output", MART, "model.mart"),
    ("output", STG, "model.copy"),
]


@pytest.mark.parametrize(
    ("results", "wanted"),
    [
        ({"model.stg": "success"}, [("input", RAW, "seed.raw"), ("output", STG, "model.stg")]),
        ({"seed.raw": "success"}, [("output", RAW, "seed.raw")]),
        ({"model.mart": "success", "model.stg": "error", "test.t": "pass"}, [("input", STG, "model.stg"), ("output", MART, "model.mart")]),
        ({"model.eph": "success"}, [("input", STG, "model.stg")]),
        ({"test.t": "success", "unknown.x": "success"}, []),
        ({"model.stg": "error", "model.mart": "error"}, EVERYTHING),
        ({}, EVERYTHING),
        (None, EVERYTHING),
    ],
)
def test_manifest_lineage(spark, tmp_path, results, wanted):
    target = Path(tmp_path, "proj", "target")
    target.mkdir(parents=True)
    (target / "manifest.json").write_text(json.dumps({"metadata": {}, "nodes": NODES}, indent=1))
    other = Path(tmp_path, "other", "target")
    other.mkdir(parents=True)
    (other / "run_results.json").write_text(json.dumps({"results": [{"unique_id": "model.x", "status": "success"}]}))
    if results is not None:
        body = {"results": [{"unique_id": k, "status": v} for k, v in results.items()]}
        (target / "run_results.json").write_text(json.dumps(body))
    found = manifest_lineage(
        read_documents(spark, str(tmp_path), "manifest.json"), read_documents(spark, str(tmp_path), "run_results.json")
    )
    assert rows(found) == [("proj", *w) for w in wanted]


def test_manifests_stay_in_all_partitions(spark):
    """Small documents grow to many rows, so they are not put into few tasks, nor laid in order as they are."""
    manifests = spark.createDataFrame([(f"p{i}", json.dumps({"nodes": NODES})) for i in range(40)], "project string, document string")
    runs = spark.createDataFrame([("p1", json.dumps({"results": [{"unique_id": "model.stg", "status": "success"}]}))], manifests.schema)
    found = manifest_lineage(manifests, runs)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found) == sorted([(f"p{i}", *w) for i in range(40) if i != 1 for w in EVERYTHING] + [("p1", "input", RAW, "seed.raw"), ("p1", "output", STG, "model.stg")])
