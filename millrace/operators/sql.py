"""Statements with parameters, a row cap and an execution record."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.types import StructType

Parameters = Sequence[Any] | Mapping[str, Any] | None


@dataclass(frozen=True)
class CappedRows:
    """At most `max_rows` rows; `truncated` says that there was at least one more."""

    schema: StructType
    rows: list[Row]
    truncated: bool
    execution: dict[str, Any] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    @property
    def row_count(self) -> int:
        """Rows returned, not rows the statement would have."""
        return len(self.rows)

    def as_dict(self) -> dict[str, Any]:
        return {
            "columns": self.columns,
            "rows": [list(row) for row in self.rows],
            "row_count": self.row_count,
            "truncated": self.truncated,
        }


def statement(spark: SparkSession, sql: str, parameters: Parameters = None, **frames: DataFrame) -> DataFrame:
    """The statement's DataFrame. Markers are `?` with a list and `:name` with a mapping;
    `{name}` stands for a DataFrame given by keyword."""
    if not sql or not sql.strip():
        raise ValueError("Missing required field: sql")
    if parameters:
        args = dict(parameters) if isinstance(parameters, Mapping) else list(parameters)
        return spark.sql(sql, args=args, **frames)
    return spark.sql(sql, **frames)


def execution_record(sql: str | Sequence[str], parameters: Parameters = None) -> dict[str, Any]:
    """What was run, as kept in the run history."""
    statements = [sql] if isinstance(sql, str) else list(sql)
    details: dict[str, Any] = {"dialect": "spark", "statements": statements}
    if parameters:
        details["parameters"] = parameters
    return {"execution_type": "sql", "details": details}


def capped(frame: DataFrame, max_rows: int = 1000) -> CappedRows:
    """The first `max_rows` rows on the driver; one more is fetched to see whether any is left."""
    rows = frame.limit(max_rows + 1).collect()
    return CappedRows(frame.schema, rows[:max_rows], len(rows) > max_rows)


def execute(
    spark: SparkSession,
    sql: str,
    parameters: Parameters = None,
    max_rows: int = 1000,
    **frames: DataFrame,
) -> CappedRows:
    """Run one statement and return its capped rows with the execution record."""
    result = capped(statement(spark, sql, parameters, **frames), max_rows)
    return CappedRows(result.schema, result.rows, result.truncated, execution_record(sql, parameters))


def execute_script(spark: SparkSession, statements: Sequence[str] | str) -> dict[str, Any]:
    """Run statements in order for their effect.

    A list has one statement, or one `BEGIN … END` script, in each entry; a text has several statements
    with semicolons between them.
    """
    if isinstance(statements, str):
        text = statements.strip().rstrip(";").rstrip()
        statements = [statements]
        scripts = [f"BEGIN\n{text};\nEND"] if text else []
    else:
        scripts = list(statements)
    for sql in scripts:
        statement(spark, sql)
    return execution_record(statements)


def execute_many(spark: SparkSession, sql: str, parameter_sets: DataFrame, **frames: DataFrame) -> int:
    """Run one set-based statement over all parameter sets, which it reads as `{params}`.

    Returns the number of sets. The work is a single Spark job however many sets there are.
    """
    statement(spark, sql, params=parameter_sets, **frames)
    return parameter_sets.count()
