"""Job and step history as a patch log, and the questions asked of it.

A log row carries the record's fields (null where it changes nothing) with `op` (`create` or
`update`), `patched_at` and `seq`, which together order the patches of a record.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace import schemas
from millrace.functions.folding import compact, fold
from millrace.functions.ids import stable_id
from millrace.functions.skew import salted_join
from millrace.sources import storage

JOB_FIELDS = (
    "pipeline", "environment", "namespace", "status", "logic_version", "request", "parameters",
    "dag_run_id", "created_at", "started_at", "completed_at", "error",
)
STEP_FIELDS = (
    "job_id", "step_name", "handler_type", "action", "status", "correlation_id", "inputs", "outputs",
    "executions", "started_at", "completed_at", "duration_ms", "error",
)
STEP_NEEDS = ("job_id", "step_name", "handler_type", "action")


def _column(frame: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in frame.columns else default


def _conform(frame: DataFrame, ddl: str, *extra: str) -> DataFrame:
    """The frame under a record layout, absent fields null."""
    fields = StructType.fromDDL(ddl)
    return frame.select(
        *[
            (F.col(f.name) if f.name in frame.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields
        ],
        *extra,
    )


def _missing(names: Sequence[str]) -> Column:
    """The first of the columns that is null or empty, as a reason; null if none is."""
    return F.coalesce(
        *[F.when(F.coalesce(F.col(n) != "", F.lit(False)), None).otherwise(f"{n} is missing") for n in names]
    )


def rejected_jobs(requests: DataFrame) -> DataFrame:
    """The job requests that `create_jobs` leaves out, with the `reason`."""
    return requests.withColumn("reason", _missing(["pipeline"])).filter("reason is not null")


def rejected_steps(requests: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """The step requests that `add_steps` leaves out, with the `reason`."""
    reason = requests.withColumn("reason", _missing(STEP_NEEDS))
    incomplete = reason.filter("reason is not null")
    if jobs is None:
        return incomplete
    lost = orphan_steps(reason.filter("reason is null"), jobs)
    return incomplete.unionByName(lost.withColumn("reason", F.lit("job does not exist")).select(*incomplete.columns))


def create_jobs(requests: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Create rows for requested jobs: pending, with defaults and a `job-…` id from `identity`.

    `requests` needs `pipeline`, `patched_at` and `seq`; a given `job_id` is kept. Requests without a
    pipeline are in `rejected_jobs`.
    """
    environment = _column(requests, "environment", F.lit("dev"))
    jobs = requests.withColumns(
        {
            "job_id": _column(requests, "job_id", stable_id("job", *[F.col(c) for c in identity])),
            "namespace": _column(requests, "namespace", environment),
            "environment": environment,
            "logic_version": _column(requests, "logic_version", F.lit("unknown")),
            "status": F.lit("pending"),
            "created_at": F.col("patched_at"),
            "op": F.lit("create"),
        }
    ).filter(_missing(["pipeline"]).isNull())
    return _conform(jobs, schemas.JOB, "op", "patched_at", "seq")


def add_steps(requests: DataFrame, identity: Sequence[str], jobs: DataFrame | None = None) -> DataFrame:
    """Create rows for requested steps: pending, with empty lineage and a `step-…` id.

    `requests` needs `job_id`, `step_name`, `handler_type`, `action`, `patched_at` and `seq`. With
    `jobs`, steps of jobs that are not there are refused; `rejected_steps` has what is left out.
    """
    nothing = F.array()
    complete = requests.filter(_missing(STEP_NEEDS).isNull())
    if jobs is not None:
        complete = complete.join(jobs.select("job_id").distinct(), "job_id", "left_semi")
    steps = complete.withColumns(
        {
            "step_id": _column(requests, "step_id", stable_id("step", *[F.col(c) for c in identity])),
            "status": F.lit("pending"),
            "inputs": nothing.cast(f"array<{schemas.DATA_REF}>"),
            "outputs": nothing.cast(f"array<{schemas.DATA_REF}>"),
            "executions": nothing.cast(f"array<{schemas.EXECUTION}>"),
            "op": F.lit("create"),
        }
    )
    return _conform(steps, schemas.STEP, "op", "patched_at", "seq")


def orphan_steps(steps: DataFrame, jobs: DataFrame) -> DataFrame:
    """Steps whose job does not exist."""
    return steps.join(jobs.select("job_id").distinct(), "job_id", "left_anti")


def job_updates(patches: DataFrame) -> DataFrame:
    """Update rows in log layout; running and final states set their time unless it is given."""
    return _updates(patches, schemas.JOB, schemas.JOB_TERMINAL)


def step_updates(patches: DataFrame) -> DataFrame:
    """As `job_updates`, for steps."""
    return _updates(patches, schemas.STEP, schemas.STEP_TERMINAL)


def _updates(patches: DataFrame, ddl: str, terminal: Sequence[str]) -> DataFrame:
    rows = _conform(patches, ddl, "patched_at", "seq").withColumn("op", F.lit("update"))
    started = F.when(F.col("status") == "running", F.col("patched_at"))
    completed = F.when(F.col("status").isin(*terminal), F.col("patched_at"))
    return rows.withColumns(
        {
            "started_at": F.coalesce("started_at", started),
            "completed_at": F.coalesce("completed_at", completed),
        }
    )


def current_jobs(log: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """One row per created job: newest value of each field, metadata merged entry by entry.

    With `wanted` (job_id), only the patches of those jobs are folded.
    """
    return _current(log, "job_id", JOB_FIELDS, wanted)


def current_steps(log: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """One row per added step; lineage lists are replaced as a whole by the newest patch that has them.

    With `wanted` (step_id), only the patches of those steps are folded.
    """
    return _current(log, "step_id", STEP_FIELDS, wanted)


def _current(log: DataFrame, key: str, fields: Sequence[str], wanted: DataFrame | None = None) -> DataFrame:
    if wanted is not None:
        log = log.join(wanted.select(key).distinct(), key, "left_semi").select(*log.columns)
    created = F.max(F.col("op") == "create").alias("_created")
    state = fold(log, key, fields, maps=["metadata"], extra=[created])
    return state.filter("_created").drop("_created")


def compact_jobs(log: DataFrame) -> DataFrame:
    """The job patches that still matter; replaces a log that has grown long."""
    return compact(log, "job_id", JOB_FIELDS, ["metadata"], always=F.col("op") == "create")


def compact_steps(log: DataFrame) -> DataFrame:
    """As `compact_jobs`, for steps."""
    return compact(log, "step_id", STEP_FIELDS, ["metadata"], always=F.col("op") == "create")


def append_log(patches: DataFrame, folder: str) -> None:
    """Add log rows to a stored log, laid out by day so that a time range reads only its days.

    Rows are gathered by day first, into evenly sized files however much a day holds.
    """
    _write_log(patches, _newest(patches.sparkSession, folder) or f"{folder}/{_GENERATION}{0:08d}", "append")


def _write_log(patches: DataFrame, folder: str, mode: str) -> None:
    by_day = patches.withColumn("day", F.to_date("patched_at")).hint("rebalance", "day")
    by_day.write.mode(mode).partitionBy("day").parquet(folder)


_GENERATION = "generation-"


def _newest(spark: SparkSession, folder: str) -> str | None:
    """The newest generation of a stored log that was written to its end."""
    found = [c for c in storage.children(spark, folder) if c.rsplit("/", 1)[-1].startswith(_GENERATION)]
    done = [c for c in sorted(found) if any(n.endswith("/_SUCCESS") for n in storage.children(spark, c))]
    return done[-1] if done else None


def read_log(spark: SparkSession, folder: str, ddl: str) -> DataFrame:
    """A stored log under the layout of its records (JOB or STEP)."""
    layout = f"{ddl}, op string, patched_at timestamp, seq bigint, day date"
    place = _newest(spark, folder)
    if place is None:
        return spark.createDataFrame([], layout).drop("day")
    return spark.read.schema(layout).parquet(place).drop("day")


def renew_log(spark: SparkSession, folder: str, ddl: str) -> None:
    """Replace a stored log by the patches that still matter, so that questions fold these and what was
    added since, not the whole history.

    They go to a new generation, which counts once it is written to its end; a run that dies changes
    nothing and can be repeated. Run it while nothing is appended. The old generation stays for
    readers that still use it; `prune_log` deletes it.
    """
    place = _newest(spark, folder)
    if place is None:
        return
    shrink = {schemas.JOB: compact_jobs, schemas.STEP: compact_steps}[ddl]
    number = int(place.rsplit(_GENERATION, 1)[1]) + 1
    _write_log(shrink(read_log(spark, folder, ddl)), f"{folder}/{_GENERATION}{number:08d}", "overwrite")


def prune_log(spark: SparkSession, folder: str) -> list[str]:
    """Delete the generations before the newest complete one; run it when no reader uses them."""
    newest = _newest(spark, folder)
    old = [c for c in storage.children(spark, folder) if newest and c < newest and f"/{_GENERATION}" in c]
    for place in old:
        storage.delete(spark, place)
    return old


def unknown_patches(log: DataFrame, key: str) -> DataFrame:
    """Updates of records that were never created."""
    updates = log.filter(F.col("op") == "update")
    created = log.filter(F.col("op") == "create").select(key).distinct()
    unknown = updates.select(key).distinct().join(created, key, "left_anti")
    return salted_join(updates, unknown, [key], ["patched_at", "seq"], "left_semi")


def get_by_id(records: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The wanted records; `found` is false and the rest null where there is none."""
    return (
        wanted.select(key).distinct().join(records.withColumn("found", F.lit(True)), key, "left")
    ).withColumn("found", F.coalesce("found", F.lit(False)))


# The fields of a job query and their defaults.
@dataclass(frozen=True)
class JobQuery:
    pipeline: str | None = None
    environment: str | None = None
    namespace: str | None = None
    status: str | None = None
    logic_version: str | None = None
    created_after: Any = None
    created_before: Any = None
    limit: int = 100
    offset: int = 0


def query_jobs(jobs: DataFrame, query: JobQuery) -> DataFrame:
    """A page of the jobs meeting all criteria given, newest first; both time bounds are inclusive."""
    for field in ("pipeline", "environment", "namespace", "status", "logic_version"):
        value = getattr(query, field)
        if value:
            jobs = jobs.filter(F.col(field) == value)
    if query.created_after:
        jobs = jobs.filter(F.col("created_at") >= F.lit(query.created_after).cast("timestamp"))
    if query.created_before:
        jobs = jobs.filter(F.col("created_at") <= F.lit(query.created_before).cast("timestamp"))
    return jobs.orderBy(F.desc("created_at"), "job_id").offset(query.offset).limit(query.limit)


def job_steps(steps: DataFrame, job_id: str | None = None) -> DataFrame:
    """Steps with the sizes of their lineage lists, by start time with unstarted ones last.

    Without a job id, all jobs' steps, job by job.
    """
    if job_id is not None:
        steps = steps.filter(F.col("job_id") == job_id)
    return steps.select(
        "job_id", "step_id", "step_name", "handler_type", "action", "status",
        "started_at", "completed_at", "duration_ms",
        F.coalesce(F.size("inputs"), F.lit(0)).alias("input_count"),
        F.coalesce(F.size("outputs"), F.lit(0)).alias("output_count"),
    ).orderBy("job_id", F.asc_nulls_last("started_at"), "step_id")


def job_summary(steps: DataFrame) -> DataFrame:
    """Per job: steps, steps by status, total duration."""
    by_status = [
        F.count_if(F.col("status") == s).alias(f"{s}_steps") for s in schemas.STEP_STATUSES
    ]
    return steps.groupBy("job_id").agg(
        F.count("*").alias("steps"), *by_status, F.sum("duration_ms").alias("total_duration_ms")
    )
