"""The sample project: budgets and spending per department."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.models import DataTest, Model, Project, version_stamp

DEPARTMENTS = "department_id int, department_name string, budget_amount int, fiscal_year int"
EXPENDITURES = (
    "expenditure_id int, department_id int, amount int, category string, expenditure_date date"
)


def stg_departments(raw: DataFrame) -> DataFrame:
    return raw.select(
        "department_id",
        "department_name",
        F.col("budget_amount").cast("decimal(15,2)").alias("budget_amount"),
        F.col("fiscal_year").cast("int").alias("fiscal_year"),
    )


def stg_expenditures(raw: DataFrame) -> DataFrame:
    return raw.select(
        "expenditure_id",
        "department_id",
        F.col("amount").cast("decimal(15,2)").alias("amount"),
        "category",
        F.col("expenditure_date").cast("date").alias("expenditure_date"),
    )


def budget_summary(departments: DataFrame, expenditures: DataFrame) -> DataFrame:
    """Spending per department against its budget; a budget of zero has no percentage.

    Spending is summed per department before the join, so the join sees one row per department
    however many expenditures a department has.
    """
    totals = expenditures.groupBy("department_id").agg(
        F.sum("amount").alias("spent"), F.count("*").alias("transactions")
    )
    spent = F.coalesce(F.col("spent"), F.lit(0).cast("decimal(15,2)"))
    budget = F.col("budget_amount")
    percent = spent.cast("double") / F.nullif(budget.cast("double"), F.lit(0.0)) * 100
    return departments.join(totals, "department_id", "left").select(
        *departments.columns,
        spent.cast("decimal(18,2)").alias("total_spent"),
        F.coalesce("transactions", F.lit(0)).alias("transaction_count"),
        (budget - spent).cast("decimal(18,2)").alias("budget_remaining"),
        F.round(percent, 2).alias("percent_spent"),
    )


def budget_project(
    spark: SparkSession,
    database: str,
    seed_folder: str | None = None,
    raw: dict[str, DataFrame] | None = None,
    logic_version: str = "unknown",
    execution_id: str = "unknown",
    extra: tuple[Model, ...] = (),
) -> Project:
    """The project over CSV seeds in a folder, or over raw frames that are already there."""

    def source(name: str, schema: str) -> Model:
        if raw is not None:
            return Model(name, build=lambda: raw[name], tags=("raw",))
        return Model(name, seed_path=f"{seed_folder}/{name}.csv", seed_schema=schema, tags=("raw",))

    key = lambda column: (DataTest("unique", column), DataTest("not_null", column))
    return Project(
        spark,
        database,
        [
            source("raw_departments", DEPARTMENTS),
            source("raw_expenditures", EXPENDITURES),
            Model(
                "stg_departments", stg_departments, ("raw_departments",), ("staging",), key("department_id")
            ),
            Model(
                "stg_expenditures",
                stg_expenditures,
                ("raw_expenditures",),
                ("staging",),
                (
                    *key("expenditure_id"),
                    DataTest("relationships", "department_id", "stg_departments", "department_id"),
                ),
            ),
            Model(
                "dept_budget_summary",
                lambda d, e: version_stamp(budget_summary(d, e), logic_version, execution_id),
                ("stg_departments", "stg_expenditures"),
                ("mart", "daily"),
                key("department_id"),
                stored=True,
            ),
            *extra,
        ],
    )
