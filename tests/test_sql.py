from __future__ import annotations

import pytest
from compare import rows

from millrace.functions.types import spark_type
from millrace.operators import sql


def test_constants(spark):
    result = sql.execute(spark, "SELECT 1 AS num, 'hello' AS greeting")
    assert result.as_dict() == {
        "columns": ["num", "greeting"],
        "rows": [[1, "hello"]],
        "row_count": 1,
        "truncated": False,
    }


def test_positional_and_named_parameters(spark):
    assert sql.execute(spark, "SELECT ? AS x, ? AS y", [42, "test"]).as_dict()["rows"] == [[42, "test"]]
    named = sql.execute(spark, "SELECT :x + :y AS result", {"x": 10, "y": 20})
    assert named.as_dict()["rows"] == [[30]]
    assert named.execution["details"]["parameters"] == {"x": 10, "y": 20}


def test_empty_parameters_bind_nothing(spark):
    assert sql.execute(spark, "SELECT 5 AS n", []).as_dict()["rows"] == [[5]]


@pytest.mark.parametrize(
    ("size", "cap", "count", "truncated"), [(100, 10, 10, True), (10, 10, 10, False), (11, 10, 10, True), (0, 10, 0, False)]
)
def test_cap(spark, size, cap, count, truncated):
    result = sql.execute(spark, "SELECT id FROM {n}", max_rows=cap, n=spark.range(size))
    assert (result.row_count, result.truncated) == (count, truncated)


def test_missing_sql_and_unknown_table(spark):
    with pytest.raises(ValueError, match="Missing required field: sql"):
        sql.execute(spark, "")
    with pytest.raises(Exception, match="nowhere"):
        sql.execute(spark, "SELECT * FROM nowhere")


def test_script_in_order(spark, database):
    record = sql.execute_script(
        spark,
        [
            f"CREATE TABLE {database}.test_table (id int, name string) USING parquet",
            f"INSERT INTO {database}.test_table VALUES (1, 'Alice'), (2, 'Bob')",
        ],
    )
    assert rows(spark.table(f"{database}.test_table"), "id") == [(1, "Alice"), (2, "Bob")]
    assert len(record["details"]["statements"]) == 2


def test_compound_script_is_one_statement(spark, database):
    sql.execute_script(
        spark,
        [
            f"""BEGIN
                CREATE TABLE {database}.two (id int) USING parquet;
                INSERT INTO {database}.two VALUES (1), (2);
            END"""
        ],
    )
    assert spark.table(f"{database}.two").count() == 2


def test_execute_many_counts_sets(spark, database):
    spark.sql(f"CREATE TABLE {database}.many (id int, label string) USING parquet")
    sets = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, label string")
    assert sql.execute_many(spark, f"INSERT INTO {database}.many SELECT id, label FROM {{params}}", sets) == 3
    assert spark.table(f"{database}.many").count() == 3


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("INTEGER", "int"),
        ("VARCHAR", "string"),
        ("varchar(20)", "string"),
        ("TEXT", "string"),
        ("DECIMAL(10,2)", "decimal(10,2)"),
        ("numeric(8, 3)", "decimal(8, 3)"),
        ("DECIMAL", "decimal(18,3)"),
        ("TIMESTAMP", "timestamp_ntz"),
        ("timestamp  with time zone", "timestamp"),
        ("DATE", "date"),
        ("BIGINT", "bigint"),
        ("ARRAY<INT>", "array<int>"),
    ],
)
def test_type_names(given, wanted):
    assert spark_type(given) == wanted
