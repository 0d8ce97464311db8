"""Rows of frames for comparison, and registered queries next to their SQL twins in DuckDB."""

from __future__ import annotations

import decimal
import math
import time
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, decimal.Decimal):
        return format(value, "f")
    return value


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(normal(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, query, sql, folder) -> dict:
    started = time.perf_counter()
    frame = query(spark, folder)
    got = [tuple(r) for r in frame.collect()]
    seconds = time.perf_counter() - started
    cursor = connect(folder).execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    spark_types = {f.name: f.dataType.simpleString() for f in frame.schema}
    sql_types = {d[0]: str(d[1]).lower() for d in cursor.description}
    return {
        "columns": sorted(frame.columns) == sorted(names),
        "rows": (len(got), len(want)),
        "equal": sorted(frame.columns) == sorted(names)
        and rows_of(got, frame.columns) == rows_of(want, names),
        "types": {n: (spark_types.get(n), sql_types.get(n)) for n in spark_types},
        "seconds": seconds,
        "plan": frame._jdf.queryExecution().executedPlan().toString(),
        "sample": (rows_of(got, frame.columns)[:3], rows_of(want, names)[:3]),
        "diff": _diff(rows_of(got, frame.columns), rows_of(want, names)),
    }


def _diff(got, want):
    a, b = set(map(repr, got)), set(map(repr, want))
    return sorted(a - b)[:2], sorted(b - a)[:2]


def rows(frame, *order):
    """The frame's rows as tuples, sorted by the given columns or by everything."""
    found = [tuple(r) for r in (frame.orderBy(*order) if order else frame).collect()]
    return found if order else sorted(found, key=repr)
