"""Running an operation so that it leaves a result record, whether it succeeds or fails."""

from __future__ import annotations

import datetime
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace import schemas

Records = Sequence[Mapping[str, Any]] | Callable[[], Sequence[Mapping[str, Any]]]


@dataclass(frozen=True)
class Context:
    """Ids that tie a result to the command, job and step it belongs to."""

    handler: str
    correlation_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    job_id: str | None = None
    step_id: str | None = None


def data_ref(
    ref_type: str, location: str, format: str | None = None, metadata: Mapping[str, Any] | None = None
) -> dict[str, Any]:
    return {
        "ref_type": ref_type,
        "location": location,
        "format": format,
        "metadata": {k: str(v) for k, v in (metadata or {}).items()},
    }


class RunFailed(Exception):
    """A run that reports several errors."""

    def __init__(self, errors: Sequence[str]) -> None:
        super().__init__("; ".join(errors))
        self.errors = list(errors)


def tracked(
    spark: SparkSession,
    context: Context,
    work: Callable[[], Mapping[str, Any] | None],
    inputs: Records = (),
    outputs: Records = (),
    executions: Records = (),
) -> DataFrame:
    """Run `work` and return its one-row result; a failed run keeps the error and no lineage.

    Lineage known only afterwards may be given as functions.
    """
    started = time.perf_counter()
    try:
        data, errors, status = work() or {}, [], "success"
        inputs, outputs, executions = (r() if callable(r) else r for r in (inputs, outputs, executions))
    except Exception as error:  # noqa: BLE001 - any failure becomes an error result
        data, status = None, "error"
        errors = error.errors if isinstance(error, RunFailed) else [str(error)]
        inputs, outputs, executions = (), (), ()
    row = {
        "status": status,
        "data": None if data is None else {k: str(v) for k, v in data.items()},
        "errors": errors,
        "correlation_id": context.correlation_id,
        "job_id": context.job_id,
        "step_id": context.step_id,
        "duration_ms": int((time.perf_counter() - started) * 1000),
        "timestamp": datetime.datetime.now(datetime.UTC).isoformat(),
        "handler": context.handler,
        "inputs": list(inputs),
        "outputs": list(outputs),
        "executions": [
            {
                "execution_type": e["execution_type"],
                "details": {k: str(v) for k, v in e.get("details", {}).items()},
            }
            for e in executions
        ],
    }
    return spark.createDataFrame([row], schemas.RESULT_MESSAGE)


def tracked_write(
    frame: DataFrame,
    context: Context,
    write: Callable[[DataFrame], None],
    inputs: Records = (),
    outputs: Records = (),
    executions: Records = (),
) -> DataFrame:
    """As `tracked`, for writing a DataFrame; the rows are counted by the write itself."""

    def work() -> dict[str, Any]:
        seen = Observation()
        write(frame.observe(seen, F.count(F.lit(1)).alias("row_count")))
        return seen.get

    return tracked(frame.sparkSession, context, work, inputs, outputs, executions)
