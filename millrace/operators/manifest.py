"""Lineage of finished model runs, read from their manifest and run-result documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = """nodes map<string,struct<resource_type:string,relation_name:string,
    depends_on:struct<nodes:array<string>>>>"""
#: What a run can build.
BUILT = ("model", "seed")
RUN_RESULTS = "results array<struct<unique_id:string,status:string>>"


def read_documents(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows `(project, document)` for `<root>/<project>/target/<name>` files; a project is the path
    from the root to its folder."""
    path = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/")
    file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return (
        spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name)
        .select(
            F.regexp_extract(file, f"\\Q{path}\\E/+(?:(.*)/)?target/[^/]+$", 1).alias("project"),
            F.col("value").alias("document"),
        )
    )


def manifest_lineage(manifests: DataFrame, run_results: DataFrame) -> DataFrame:
    """Rows `(project, role, location, node)`: what each project's run wrote and read.

    The nodes that ran are those with status `success`, or all models when there are none.
    Only models and seeds are outputs, one per relation; inputs are the relations of what they
    depend on, one per node. Both documents of a project are parsed once, before they are shuffled, and meet
    in one row. What is left of them is small and packs well, so Spark would judge by their bytes that a few
    tasks will do; they stay in all of the session's shuffle partitions, since each row becomes many.
    """
    spark = manifests.sparkSession
    parsed = manifests.select("project", F.explode(F.array(F.from_json("document", MANIFEST))).alias("m"))
    said = parsed.select("project", _said("m.nodes").alias("said"))
    spread = said.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "project")
    # One row per project on the right: a table of them takes less room than both sides in order.
    met = spread.join(_succeeded(run_results).hint("shuffle_hash"), "project", "left")
    nodes = met.select("project", "done", F.explode("said").alias("n")).select("project", "done", "n.*")
    ran = F.when(F.size("done") > 0, F.array_contains("done", F.col("node"))).otherwise(F.col("kind") == "model")
    flagged = nodes.withColumn("built", ran & F.col("kind").isin(*BUILT)).drop("done")
    facts = flagged.select("project", F.inline(_facts()))
    output = F.col("role") == "output"
    found = facts.groupBy("project", "role", "key").agg(
        F.when(output, F.min("other")).otherwise(F.max("other")).alias("other"), F.max("counts").alias("counts")
    )
    return found.filter(F.col("counts") & F.col("other").isNotNull()).select(
        "project", "role",
        F.when(output, F.col("key")).otherwise(F.col("other")).alias("location"),
        F.when(output, F.col("other")).otherwise(F.col("key")).alias("node"),
    )


def _said(nodes: str) -> Column:
    """The nodes that can say something, with that alone: a place, or what a node that is built needs."""

    def node(entry: Column) -> Column:
        value = entry["value"]
        return F.struct(
            entry["key"].alias("node"),
            value["resource_type"].alias("kind"),
            F.translate(F.nullif(value["relation_name"], F.lit("")), '"', "").alias("location"),
            F.when(value["resource_type"].isin(*BUILT), value["depends_on"]["nodes"]).alias("needs"),
        )

    listed = F.transform(F.map_entries(nodes), node)
    return F.filter(listed, lambda n: n["location"].isNotNull() | F.coalesce(n["kind"].isin(*BUILT), F.lit(False)))


def _succeeded(run_results: DataFrame) -> DataFrame:
    """Rows `(project, done)`: the nodes that ran well, from all of a project's run results."""
    results = F.from_json("document", RUN_RESULTS)["results"]
    done = F.transform(F.filter(results, lambda r: r["status"] == "success"), lambda r: r["unique_id"])
    return run_results.groupBy("project").agg(F.array_distinct(F.flatten(F.collect_list(done))).alias("done"))


def _facts() -> Column:
    """What one node says: where it is, what it wrote if it was built, and what it then needed.

    An input's key is the node and `other` its location, an output's the other way round. Facts with one role
    and key add up to a result row if any of them counts.
    """

    def fact(role: str, key: Column, other: Column, counts: Column) -> Column:
        return F.struct(
            F.lit(role).alias("role"), key.alias("key"), other.alias("other"), counts.alias("counts")
        )

    node, location, built = F.col("node"), F.col("location"), F.col("built")
    nowhere = F.lit(None).cast("string")
    needs = F.transform(F.when(built, F.col("needs")), lambda need: fact("input", need, nowhere, F.lit(True)))
    nothing = F.array().cast("array<struct<role:string,key:string,other:string,counts:boolean>>")
    said = F.concat(
        F.array(fact("input", node, location, F.lit(False)), fact("output", location, node, built)),
        F.coalesce(needs, nothing),
    )
    return F.filter(
        said,
        lambda f: F.when(f["role"] == "output", f["counts"] & f["key"].isNotNull()).otherwise(
            f["counts"] | f["other"].isNotNull()
        ),
    )
