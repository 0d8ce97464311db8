from __future__ import annotations

from decimal import Decimal
from pathlib import Path

import pytest
from compare import rows
from pyspark.sql import functions as F

from millrace.operators import checks
from millrace.operators.runs import Context
from millrace.plans import budget
from millrace.plans.models import DataTest, Model, Project, transform_result, version_stamp, versions

DEPARTMENTS = """department_id,department_name,budget_amount,fiscal_year
1,Harbour,4000000,2025
2,Libraries,800000,2025
3,Forestry,1600000,2025
4,Trams,6400000,2025
5,Museums,2000000,2025
6,Idle,100,2025
7,Unfunded,0,2025
"""
EXPENDITURES = """expenditure_id,department_id,amount,category,expenditure_date
1,2,12000,Shelves,2025-03-04
2,1,90000,Cranes,2025-03-11
3,1,10000,Paint,2025-04-02
4,3,64000,Saplings,2025-05-20
5,4,800000,Rails,2025-06-01
6,4,160000,Wires,2025-06-09
7,5,77000,Lighting,2025-07-15
8,5,3000,Tickets,2025-07-30
"""


@pytest.fixture
def seeds(tmp_path):
    Path(tmp_path, "raw_departments.csv").write_text(DEPARTMENTS)
    Path(tmp_path, "raw_expenditures.csv").write_text(EXPENDITURES)
    return tmp_path


def outcomes(report):
    return {row[0]: row[2] for row in report.rows}


def test_build_gives_the_budget_summary(spark, database, seeds):
    report = budget.budget_project(spark, database, str(seeds), None, "v1", "run-1").build(
        logic_version="v1", execution_id="run-1"
    )
    assert report.success and report.errors == []
    mart = spark.table(f"{database}.dept_budget_summary")
    money = lambda text: Decimal(text)
    picked = mart.select("department_id", "total_spent", "transaction_count", "budget_remaining", "percent_spent")
    assert rows(picked, "department_id") == [
        (1, money("100000.00"), 2, money("3900000.00"), 2.5),
        (2, money("12000.00"), 1, money("788000.00"), 1.5),
        (3, money("64000.00"), 1, money("1536000.00"), 4.0),
        (4, money("960000.00"), 2, money("5440000.00"), 15.0),
        (5, money("80000.00"), 2, money("1920000.00"), 4.0),
        (6, money("0.00"), 0, money("100.00"), 0.0),
        (7, money("0.00"), 0, money("0.00"), None),
    ]
    assert rows(mart.select("_logic_version", "_execution_id").distinct()) == [("v1", "run-1")]
    assert mart.filter("_processed_at is null").count() == 0
    assert {t: s for t, s in outcomes(report).items() if "_id" in t} == {
        "unique_stg_departments_department_id": "pass",
        "not_null_stg_departments_department_id": "pass",
        "unique_stg_expenditures_expenditure_id": "pass",
        "not_null_stg_expenditures_expenditure_id": "pass",
        "relationships_stg_expenditures_department_id": "pass",
        "unique_dept_budget_summary_department_id": "pass",
        "not_null_dept_budget_summary_department_id": "pass",
    }


def test_second_build_replaces_the_versions(spark, database, seeds):
    for logic, run in (("v1.0.0", "run-001"), ("v2.0.0", "run-002")):
        budget.budget_project(spark, database, str(seeds), None, logic, run).build()
    mart = spark.table(f"{database}.dept_budget_summary")
    assert rows(mart.select("_logic_version", "_execution_id").distinct()) == [("v2.0.0", "run-002")]
    assert mart.count() == 7


def test_run_needs_seeds_then_names_its_lineage(spark, database, seeds):
    project = budget.budget_project(spark, database, str(seeds))
    assert outcomes(project.seed("raw_departments")) == {"raw_departments": "success"}
    assert outcomes(project.seed()) == {"raw_departments": "success", "raw_expenditures": "success"}
    report = project.run("stg_departments")
    assert [o["location"] for o in report.outputs] == [f"{database}.stg_departments"]
    assert [i["metadata"]["node"] for i in report.inputs] == ["raw_departments"]
    report = project.run("dept_budget_summary no_such_model")
    assert outcomes(report) == {"dept_budget_summary": "success"}
    assert spark.table("stg_departments").count() == 7


def test_seed_replaces_rows_and_full_refresh_the_schema(spark, database, tmp_path):
    from millrace.sources.seeds import load_seed

    path = Path(tmp_path, "s.csv")
    path.write_text("a,b\n1,x\n2,y\n")
    table = f"{database}.s"
    load_seed(spark, str(path), "a int, b string", table)
    path.write_text("a,b\n3,z\n")
    assert rows(load_seed(spark, str(path), "a int, b string", table)) == [(3, "z")]
    path.write_text("a,b,c\n3,z,2024-01-31\n")
    with pytest.raises(ValueError, match="full_refresh"):
        load_seed(spark, str(path), "a int, b string, c date", table)
    refreshed = load_seed(spark, str(path), "a int, b string, c date", table, full_refresh=True)
    assert refreshed.columns == ["a", "b", "c"]
    path.write_text("a,b,c\nthree,z,2024-01-31\n")
    with pytest.raises(Exception):  # noqa: B017
        load_seed(spark, str(path), "a int, b string, c date", table).count()


SELECTIONS = [
    (None, None, "raw_departments raw_expenditures stg_departments stg_expenditures dept_budget_summary"),
    ("stg_departments", None, "stg_departments"),
    ("+stg_departments", None, "raw_departments stg_departments"),
    ("stg_departments+", None, "stg_departments dept_budget_summary"),
    ("tag:daily", None, "dept_budget_summary"),
    ("tag:staging unknown", None, "stg_departments stg_expenditures"),
    ("+dept_budget_summary", "tag:raw stg_departments", "stg_expenditures dept_budget_summary"),
    ("unknown", None, ""),
    ("tag:staging,+dept_budget_summary", "stg_e*", "stg_departments"),
    ("1+dept_budget_summary", None, "stg_departments stg_expenditures dept_budget_summary"),
    ("raw_departments+1", None, "raw_departments stg_departments"),
    ("@raw_departments", None, "raw_departments raw_expenditures stg_departments stg_expenditures dept_budget_summary"),
    ("stg_*", None, "stg_departments stg_expenditures"),
    ("resource_type:seed", None, "raw_departments raw_expenditures"),
]


@pytest.mark.parametrize(("select", "exclude", "wanted"), SELECTIONS)
def test_selection(spark, database, select, exclude, wanted):
    project = budget.budget_project(spark, database, "/nowhere")
    chosen = project.selected(select, exclude)
    assert sorted(chosen) == sorted(wanted.split())
    place = {n: i for i, n in enumerate(chosen)}
    for name in chosen:
        assert all(place[r] < place[name] for r in project.models[name].refs if r in place)


def test_failures_block_only_what_needs_them(spark, database):
    def broken(_):
        raise RuntimeError("cannot derive")

    project = Project(
        spark,
        database,
        [
            Model("base", lambda: spark.createDataFrame([(1,), (1,), (None,)], "k int"), tests=(DataTest("unique", "k"), DataTest("not_null", "k"))),
            Model("child", lambda b: b, ("base",)),
            Model("other", lambda: spark.range(2)),
            Model("bad", broken, ("other",)),
            Model("after_bad", lambda b: b, ("bad",)),
            Model("fine", lambda o: o, ("other",)),
        ],
    )
    report = project.build()
    assert outcomes(report) == {
        "base": "success",
        "unique_base_k": "fail",
        "not_null_base_k": "fail",
        "child": "skipped",
        "other": "success",
        "bad": "error",
        "after_bad": "skipped",
        "fine": "success",
    }
    assert not report.success
    assert report.errors[0] == "build failed" and "bad: cannot derive" in report.errors
    assert {r[0]: r[3] for r in report.rows if r[1] == "test"} == {"unique_base_k": 1, "not_null_base_k": 1}
    assert report.frame(spark).count() == 8
    ran = project.run()
    assert outcomes(ran)["child"] == "success"


def test_unknown_selections_are_told(spark, database):
    project = budget.budget_project(spark, database, "/nowhere")
    with pytest.warns(UserWarning, match="nobody"):
        assert project.selected("nobody stg_departments") == ["stg_departments"]
    with pytest.raises(ValueError, match="color"):
        project.selected("color:red")


def test_relationships_meet_the_parent_of_this_build(spark, database):
    known = [1]
    child = DataTest("relationships", "k", "parents", "id")
    models = [
        Model("children", lambda: spark.createDataFrame([(1,), (2,)], "k int"), tests=(child,), stored=True),
        Model("parents", lambda: spark.createDataFrame([(k,) for k in known], "id int"), stored=True),
    ]
    assert outcomes(Project(spark, database, models).build())["relationships_children_k"] == "fail"
    known.append(2)
    project = Project(spark, database, models)
    assert project.order == ["parents", "children"] and project.build().success
    late = Project(spark, database, [
        Model("first", lambda: spark.createDataFrame([(1,), (7,)], "k int"), tests=(DataTest("relationships", "k", "second", "k"),)),
        Model("second", lambda f: f.where("k < 7"), ("first",)),
        Model("third", lambda s: s, ("second",)),
    ])
    report = late.build()
    assert [r[0] for r in report.rows] == ["first", "second", "relationships_first_k", "third"]
    assert outcomes(report)["relationships_first_k"] == "fail"

    def broken():
        raise RuntimeError("no parent today")

    report = Project(spark, database, [models[0], Model("parents", broken)]).build()
    assert outcomes(report) == {"parents": "error", "children": "success", "relationships_children_k": "skipped"}


def test_data_tests_ignore_or_find_nulls(spark):
    frame = spark.createDataFrame([(1, 1), (1, 2), (None, 2), (None, 9), (3, 9)], "k int, parent int")
    assert rows(checks.not_unique(frame, "k")) == [(1, 2)]
    assert checks.nulls(frame, "k").count() == 2
    parents = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id int")
    assert rows(checks.orphans(frame, "parent", parents, "id")) == [(9, 2)]
    assert rows(checks.orphans(frame, "k", parents, "id")) == [(3, 1)]
    report = checks.constraint_report(frame, ["k", "parent"], ["parent"])
    assert rows(report) == [("not_null", "k", 2), ("not_null", "parent", 0), ("unique", "parent", 2)]


def test_versions_fall_back():
    assert versions({"logic_version": "a", "execution_id": "b"}, "repo", "corr") == ("a", "b")
    assert versions({}, "repo", "corr") == ("repo", "corr")
    assert versions(None) == ("unknown", "unknown")


def test_stamp_defaults(spark):
    stamped = version_stamp(spark.range(1), None, "")
    assert rows(stamped.select("_logic_version", "_execution_id", F.col("_processed_at").isNotNull())) == [
        ("unknown", "unknown", True)
    ]


def test_transform_result(spark, database, seeds):
    context = Context("transform", "corr", "job", "step")
    project = budget.budget_project(spark, database, str(seeds), None, "v1", "run-1")
    good = transform_result(spark, context, lambda: project.build("+stg_departments"), "+stg_departments").first()
    assert (good.status, good.step_id, good.data["command"], good.data["nodes"]) == ("success", "step", "build", "4")
    assert [o.location for o in good.outputs] == [f"{database}.raw_departments", f"{database}.stg_departments"]
    assert good.executions[0].details == {"command": "build", "select": "+stg_departments"}

    def broken():
        raise RuntimeError("bad model")

    failing = Project(spark, database, [Model(f"m{i}", broken) for i in range(12)])
    bad = transform_result(spark, context, failing.run).first()
    assert (bad.status, bad.data, bad.executions, bad.outputs) == ("error", None, [], [])
    assert bad.errors[0] == "run failed" and len(bad.errors) == 13 and bad.errors[-1] == "m11: bad model"
