"""Which steps wrote or read a location.

Locations match exactly and a step counts once however often it lists the location: its list is
made distinct inside the row, so no shuffle is spent on that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIRECTIONS = ("producers", "consumers", "both")


def _with_job(steps: DataFrame, jobs: DataFrame, environment: str | None) -> DataFrame:
    if environment:
        jobs = jobs.filter(F.col("environment") == environment)
    return steps.join(jobs.select("job_id", "environment", "logic_version"), "job_id")


def producers(
    steps: DataFrame, jobs: DataFrame, location: str, environment: str | None = None
) -> DataFrame:
    """Steps that wrote the location, latest completion first."""
    hits = steps.filter(F.exists("outputs", lambda ref: ref["location"] == location))
    return (
        _with_job(hits, jobs, environment)
        .select(
            "job_id", "step_id", "step_name", "handler_type", "logic_version", "completed_at", "executions"
        )
        .orderBy(F.desc_nulls_last("completed_at"), "step_id")
    )


def consumers(
    steps: DataFrame, jobs: DataFrame, location: str, environment: str | None = None
) -> DataFrame:
    """Steps that read the location, latest start first."""
    hits = steps.filter(F.exists("inputs", lambda ref: ref["location"] == location))
    return (
        _with_job(hits, jobs, environment)
        .select("job_id", "step_id", "step_name", "handler_type", "logic_version", "started_at")
        .orderBy(F.desc_nulls_last("started_at"), "step_id")
    )


def edges(steps: DataFrame, direction: str = "both") -> DataFrame:
    """Rows `(role, location, step…)`, both roles from one pass over the steps."""
    if direction not in DIRECTIONS:
        raise ValueError(f"Invalid direction: {direction}. Must be producers, consumers, or both")
    sides = [("producer", "outputs"), ("consumer", "inputs")]
    kept = [(r, c) for r, c in sides if direction in (f"{r}s", "both")]
    ends = [_references(role, column) for role, column in kept]
    return steps.select(
        F.inline(ends[0] if len(ends) == 1 else F.concat(*ends)),
        "job_id", "step_id", "step_name", "handler_type", "started_at", "completed_at",
    )


def _references(role: str, column: str) -> Column:
    """A step's distinct locations in one role."""
    listed = F.transform(column, lambda ref: ref["location"])
    places = F.array_distinct(F.coalesce(listed, F.array().cast("array<string>")))
    return F.transform(
        places, lambda place: F.struct(F.lit(role).alias("role"), place.alias("location"))
    )


def lineage(
    steps: DataFrame,
    jobs: DataFrame,
    locations: DataFrame | None = None,
    direction: str = "both",
    environment: str | None = None,
) -> DataFrame:
    """Producers and consumers of all wanted locations (of every location when none are given)."""
    found = edges(steps, direction)
    if locations is not None:
        found = found.join(locations.select("location").distinct(), "location", "left_semi")
    return _with_job(found, jobs, environment).select(
        "location", "role", "job_id", "step_id", "step_name", "handler_type", "environment",
        "logic_version", "started_at", "completed_at",
    )
