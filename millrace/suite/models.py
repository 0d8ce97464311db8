"""Models, data tests, builds and run lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import checks, manifest
from millrace.operators.runs import Context
from millrace.plans import budget
from millrace.plans.models import (
    DataTest,
    Model,
    Project,
    transform_result,
    version_stamp,
    versions,
)
from millrace.session import scratch
from millrace.sources.seeds import load_seed
from millrace.suite import standins as s
from millrace.suite.base import fresh_database, query, table


@query("m1_stg_departments", s.DEPARTMENTS_SQL)
def m1_stg_departments(spark: SparkSession, folder: str) -> DataFrame:
    return budget.stg_departments(s.raw_departments(spark, folder))


@query("m2_stg_expenditures", s.EXPENDITURES_SQL)
def m2_stg_expenditures(spark: SparkSession, folder: str) -> DataFrame:
    return budget.stg_expenditures(s.raw_expenditures(spark, folder))


@query("m3_budget_summary", s.SUMMARY_SQL)
def m3_budget_summary(spark: SparkSession, folder: str) -> DataFrame:
    return budget.budget_summary(
        budget.stg_departments(s.raw_departments(spark, folder)),
        budget.stg_expenditures(s.raw_expenditures(spark, folder)),
    )


@query(
    "m4_version_stamp",
    f"""select *, 'git:abc123' as _logic_version, 'corr-1' as _execution_id, true as stamped
        from ({s.SUMMARY_SQL})""",
)
def m4_version_stamp(spark: SparkSession, folder: str) -> DataFrame:
    """The version comes from the command, the execution id falls back to the correlation id."""
    stamp = versions({"logic_version": "git:abc123"}, "git:default", "corr-1")
    stamped = version_stamp(m3_budget_summary(spark, folder), *stamp)
    return stamped.withColumn("stamped", F.col("_processed_at").isNotNull()).drop("_processed_at")


@query(
    "m5_test_unique",
    """select l_orderkey, l_linenumber, count(*) as n from lineitem
        group by l_orderkey, l_linenumber having count(*) > 1""",
)
def m5_test_unique(spark: SparkSession, folder: str) -> DataFrame:
    return checks.not_unique(table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber")


@query(
    "m6_test_not_null",
    """select d.doc_id, d.lang from documents d left join labels l on d.doc_id = l.doc_id
       where l.quality is null""",
)
def m6_test_not_null(spark: SparkSession, folder: str) -> DataFrame:
    labelled = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return checks.nulls(labelled, "quality").select("doc_id", "lang")


@query(
    "m7_test_relationships",
    """select d.doc_id, count(*) as n from documents d
       where not exists (select 1 from labels l where l.doc_id = d.doc_id) and d.doc_id is not null
       group by d.doc_id""",
)
def m7_test_relationships(spark: SparkSession, folder: str) -> DataFrame:
    return checks.orphans(table(spark, folder, "documents"), "doc_id", table(spark, folder, "labels"), "doc_id")


def _raw(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        "raw_departments": s.raw_departments(spark, folder),
        "raw_expenditures": s.raw_expenditures(spark, folder),
    }


@query(
    "m8_run",
    f"select *, 'v2.0.0' as _logic_version, 'run-002' as _execution_id from ({s.SUMMARY_SQL})",
)
def m8_run(spark: SparkSession, folder: str) -> DataFrame:
    """The mart with all it needs, run twice: the second version replaces the first."""
    database = fresh_database(spark, "run")
    for logic, run in (("v1.0.0", "run-001"), ("v2.0.0", "run-002")):
        project = budget.budget_project(spark, database, None, _raw(spark, folder), logic, run)
        project.run("+dept_budget_summary no_such_model", logic_version=logic, execution_id=run)
    return spark.table(f"{database}.dept_budget_summary").drop("_processed_at")


@query(
    "m9_test",
    """with x as (select * from orders where o_orderpriority = '1-URGENT'),
        u as (select o_custkey from x group by o_custkey having count(*) > 1)
       select 'unique_stg_departments_department_id' as node, 0 as failures
       union all select 'not_null_stg_departments_department_id', 0
       union all select 'unique_stg_expenditures_expenditure_id', 0
       union all select 'not_null_stg_expenditures_expenditure_id', 0
       union all select 'relationships_stg_expenditures_department_id', count(*) from x
            where o_custkey not in (select c_custkey from customer)
       union all select 'unique_dept_budget_summary_department_id', 0
       union all select 'not_null_dept_budget_summary_department_id', 0
       union all select 'unique_spenders_department_id', count(*) from u
       union all select 'not_null_spenders_department_id', 0""",
)
def m9_test(spark: SparkSession, folder: str) -> DataFrame:
    """All tests of the project as one report, with one that fails."""
    project = _with_failing_model(spark, folder, "test")
    return project.test_counts(project.selected())


def _with_failing_model(spark: SparkSession, folder: str, label: str) -> Project:
    """The sample project, a model whose unique test fails, and one that needs it."""
    spenders = Model(
        "spenders",
        lambda x: x.select("department_id", "amount"),
        ("stg_expenditures",),
        tests=(DataTest("unique", "department_id"), DataTest("not_null", "department_id")),
    )
    above = Model("spender_totals", lambda x: x.groupBy("department_id").agg(F.sum("amount")), ("spenders",))
    return budget.budget_project(
        spark, fresh_database(spark, label), None, _raw(spark, folder), extra=(spenders, above)
    )


@query(
    "m10_build",
    """with u as (select o_custkey from orders where o_orderpriority = '1-URGENT'
                  group by o_custkey having count(*) > 1)
       select * from (values ('raw_departments', 'model', 'success', null),
        ('raw_expenditures', 'model', 'success', null), ('stg_departments', 'model', 'success', null),
        ('stg_expenditures', 'model', 'success', null), ('dept_budget_summary', 'model', 'success', null),
        ('spenders', 'model', 'success', null), ('spender_totals', 'model', 'skipped', null),
        ('unique_stg_departments_department_id', 'test', 'pass', 0),
        ('not_null_stg_departments_department_id', 'test', 'pass', 0),
        ('unique_stg_expenditures_expenditure_id', 'test', 'pass', 0),
        ('not_null_stg_expenditures_expenditure_id', 'test', 'pass', 0),
        ('relationships_stg_expenditures_department_id', 'test', 'pass', 0),
        ('unique_dept_budget_summary_department_id', 'test', 'pass', 0),
        ('not_null_dept_budget_summary_department_id', 'test', 'pass', 0),
        ('not_null_spenders_department_id', 'test', 'pass', 0)) t(node, kind, status, failures)
       union all select 'unique_spenders_department_id', 'test', 'fail', count(*) from u""",
)
def m10_build(spark: SparkSession, folder: str) -> DataFrame:
    """A failed test skips what needs its model and nothing else."""
    project = _with_failing_model(spark, folder, "build")
    return project.build().frame(spark).drop("error")


def _documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Every order as a project: a customer seed, an order model on it, a status mart and a test.

    The seed and the model ran well unless the order is open, in which case all failed; orders with
    key % 7 = 0 have no run results at all.
    """
    orders = table(spark, folder, "orders")
    key = F.col("o_orderkey").cast("string")
    project = F.concat(F.lit("p"), key).alias("project")

    def node(kind: str, relation, *needs) -> F.Column:
        need = F.array(*needs) if needs else F.array().cast("array<string>")
        return F.struct(
            F.lit(kind).alias("resource_type"),
            relation.alias("relation_name"),
            F.struct(need.alias("nodes")).alias("depends_on"),
        )

    def quoted(prefix: str, column: str):
        return F.concat(F.lit(f'"db"."main"."{prefix}'), F.col(column).cast("string"), F.lit('"'))

    seed = F.concat(F.lit("seed.c"), F.col("o_custkey").cast("string"))
    model = F.concat(F.lit("model.o"), key)
    mart = F.concat(F.lit("model.s"), "o_orderstatus")
    nodes = F.create_map(
        seed, node("seed", quoted("customer_", "o_custkey")),
        model, node("model", quoted("order_", "o_orderkey"), seed, F.lit("source.elsewhere")),
        mart, node("model", quoted("status_", "o_orderstatus"), model, seed),
        F.lit("test.unique"), node("test", F.lit(None).cast("string"), model),
    )
    manifests = orders.select(project, F.to_json(F.struct(nodes.alias("nodes"))).alias("document"))
    status = F.when(F.col("o_orderstatus") == "O", "error").otherwise("success")
    result = lambda node, state: F.struct(node.alias("unique_id"), state.alias("status"))
    results = F.array(
        result(seed, status), result(model, status), result(mart, F.lit("error")),
        result(F.lit("test.unique"), F.lit("pass")),
    )
    runs = orders.filter("o_orderkey % 7 <> 0").select(
        project, F.to_json(F.struct(results.alias("results"))).alias("document")
    )
    return manifests, runs


@query(
    "m11_manifest_lineage",
    """with o as (select 'p' || o_orderkey as project, 'seed.c' || o_custkey as seed,
            'db.main.customer_' || o_custkey as seed_at, 'model.o' || o_orderkey as model,
            'db.main.order_' || o_orderkey as model_at, 'model.s' || o_orderstatus as mart,
            'db.main.status_' || o_orderstatus as mart_at,
            (o_orderkey % 7 <> 0 and o_orderstatus <> 'O') as ran from orders)
       select project, 'output' as role, model_at as location, model as node from o
       union all select project, 'output', seed_at, seed from o where ran
       union all select project, 'output', mart_at, mart from o where not ran
       union all select project, 'input', seed_at, seed from o
       union all select project, 'input', model_at, model from o where not ran""",
)
def m11_manifest_lineage(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.manifest_lineage(*_documents(spark, folder))


@query(
    "m12_transform_result",
    """select 'build' as command, 'v1' as logic_version, 'run-1' as execution_id, 'success' as status,
        null as error, 5 as outputs, 4 as inputs, 1 as executions, (select count(*) from customer) as mart_rows
       union all select null, null, null, 'error', 'build failed', 0, 0, 0, (select count(*) from customer)""",
)
def m12_transform_result(spark: SparkSession, folder: str) -> DataFrame:
    """The results of a build that goes well and of one in which a test fails."""
    database = fresh_database(spark, "result")
    good = budget.budget_project(spark, database, None, _raw(spark, folder), "v1", "run-1")
    bad = _with_failing_model(spark, folder, "failing")
    context = Context("transform", "corr-1")
    rows = transform_result(
        spark, context, lambda: good.build(logic_version="v1", execution_id="run-1")
    ).unionByName(transform_result(spark, context, bad.build))
    built = spark.table(f"{database}.dept_budget_summary").agg(F.count("*").alias("mart_rows"))
    text = lambda key: F.try_element_at("data", F.lit(key)).alias(key)
    return rows.select(
        text("command"), text("logic_version"), text("execution_id"), "status",
        F.try_element_at("errors", F.lit(1)).alias("error"),
        F.size("outputs").alias("outputs"), F.size("inputs").alias("inputs"),
        F.size("executions").alias("executions"),
        F.lit(built.first()[0]).cast("bigint").alias("mart_rows"),
    )


@query(
    "s1_seed_load",
    """select o_orderkey, o_custkey, o_orderpriority, cast(o_totalprice as decimal(15,2)) o_totalprice,
        cast(o_orderdate as date) o_orderdate from orders""",
)
def s1_seed_load(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files written from the orders, loaded twice; the second load replaces the first."""
    database, place = fresh_database(spark, "seeded"), scratch(spark, "seed_csv")
    table(spark, folder, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderpriority",
        F.col("o_totalprice").cast("decimal(15,2)"),
        F.col("o_orderdate").cast("date"),
    ).write.option("header", True).csv(place)
    schema = (
        "o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_totalprice decimal(15,2), o_orderdate date"
    )
    load_seed(spark, place, schema, f"{database}.orders")
    return load_seed(spark, place, schema, f"{database}.orders")


@query("s5_model_sink", s.SUMMARY_SQL)
def s5_model_sink(spark: SparkSession, folder: str) -> DataFrame:
    """A stored model built on views, then rebuilt over its own table."""
    project = budget.budget_project(spark, fresh_database(spark, "sink"), None, _raw(spark, folder))
    project.run()
    project.run("dept_budget_summary")
    return project.frame("dept_budget_summary").drop("_logic_version", "_execution_id", "_processed_at")
