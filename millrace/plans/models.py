"""Models as DataFrame functions: selection, run, data tests, build."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from fnmatch import fnmatchcase
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import checks, tables
from millrace.operators.runs import Context, RunFailed, data_ref, tracked
from millrace.sources.seeds import load_seed

Frames = Mapping[str, DataFrame]
REPORT = "node string, kind string, status string, failures bigint, error string"


@dataclass(frozen=True)
class DataTest:
    kind: str  # unique, not_null or relationships
    column: str
    to: str | None = None
    field: str | None = None

    def label(self, model: str) -> str:
        return f"{self.kind}_{model}_{self.column}"


@dataclass(frozen=True)
class Model:
    """A node: `build` gets the frames named in `refs`. `stored` writes a table, otherwise a view."""

    name: str
    build: Callable[..., DataFrame] | None = None
    refs: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    tests: tuple[DataTest, ...] = ()
    stored: bool = False
    seed_path: str | None = None
    seed_schema: str | None = None

    @property
    def kind(self) -> str:
        return "seed" if self.seed_path else "model"


def version_stamp(frame: DataFrame, logic_version: str | None, execution_id: str | None) -> DataFrame:
    """Adds which logic and which run made each row, and when."""
    return frame.withColumns(
        {
            "_logic_version": F.lit(logic_version or "unknown"),
            "_execution_id": F.lit(execution_id or "unknown"),
            "_processed_at": F.current_timestamp(),
        }
    )


def versions(
    metadata: Mapping[str, str] | None, repo_version: str | None = None, correlation_id: str | None = None
) -> tuple[str, str]:
    """Logic version and execution id of a command: its metadata first, then the defaults."""
    given = metadata or {}
    return (
        given.get("logic_version") or repo_version or "unknown",
        given.get("execution_id") or correlation_id or "unknown",
    )


@dataclass
class RunReport:
    """What a command did: per-node outcomes, lineage of the nodes built, and its result status."""

    command: str
    logic_version: str
    execution_id: str
    rows: list[tuple] = field(default_factory=list)
    inputs: list[dict] = field(default_factory=list)
    outputs: list[dict] = field(default_factory=list)

    @property
    def success(self) -> bool:
        return all(row[2] in ("success", "pass") for row in self.rows)

    @property
    def errors(self) -> list[str]:
        """For a failed run: the command and all its problems."""
        bad = [f"{row[0]}: {row[4] or row[2]}" for row in self.rows if row[2] not in ("success", "pass")]
        return [f"{self.command} failed", *bad] if bad else []

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, REPORT)


def transform_result(
    spark: SparkSession, context: Context, command: Callable[[], RunReport], select: str | None = None
) -> DataFrame:
    """Run a project command and return its result row: versions and lineage of a command that went
    well, or the errors of one that did not, which then has no execution record."""
    reports: list[RunReport] = []

    def work() -> dict[str, object]:
        report = command()
        if not report.success:
            raise RunFailed(report.errors)
        reports.append(report)
        return {
            "command": report.command,
            "logic_version": report.logic_version,
            "execution_id": report.execution_id,
            "nodes": len(report.rows),
        }

    return tracked(
        spark,
        context,
        work,
        inputs=lambda: reports[0].inputs,
        outputs=lambda: reports[0].outputs,
        executions=lambda: [
            {"execution_type": "models", "details": {"command": reports[0].command, "select": select or ""}}
        ],
    )


class Project:
    """A set of models living in one database."""

    def __init__(self, spark: SparkSession, database: str, models: list[Model]) -> None:
        self.spark, self.database = spark, database
        self.models = {m.name: m for m in models}
        needs = {m.name: [r for r in m.refs if r in self.models] for m in models}
        for model in models:  # what a test compares with comes first, unless it needs the model itself
            for test in model.tests:
                if test.to in self.models and model.name not in self._reach({test.to}, lambda n: needs[n]):
                    needs[model.name].append(test.to)
        self.order = list(TopologicalSorter(needs).static_order())
        self.built: dict[str, DataFrame] = {}
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")

    def selected(self, select: str | None = None, exclude: str | None = None) -> list[str]:
        """Node names in dependency order.

        Terms joined by spaces add up; within a term, parts joined by commas must all hold. A part is a
        name or a pattern with `*` and `?`, `tag:t`, or one of `seed`, `model` after `resource_type:`. `+name`
        adds what it needs, `name+` what needs it, `2+name` and `name+1` only so many steps, `@name` what
        needs it together with all that those need. A part that nothing meets is warned of.
        """
        chosen = self._matching(select) if select else set(self.models)
        left_out = self._matching(exclude) if exclude else set()
        return [n for n in self.order if n in chosen and n not in left_out]

    def _matching(self, text: str) -> set[str]:
        return {n for term in text.split() for n in set.intersection(*map(self._part, term.split(",")))}

    def _part(self, part: str) -> set[str]:
        before, up, core, down, after = re.fullmatch(r"(\d*)(\+|@)?(.*?)(\+)?(\d*)", part).groups()
        if not up:
            core, before = before + core, ""
        if not down:
            core, after = core + after, ""
        method, _, value = core.rpartition(":")
        if method not in ("", "tag", "resource_type"):
            raise ValueError(f"selection method not known: {method}")
        traits = {
            "": lambda m: [m.name],
            "tag": lambda m: m.tags,
            "resource_type": lambda m: [m.kind],
        }[method]
        hits = {n for n, m in self.models.items() if any(fnmatchcase(t, value) for t in traits(m))}
        if not hits:
            warnings.warn(f"nothing meets the selection {part!r}", stacklevel=2)
        needs = lambda n: self.models[n].refs
        found = set(hits)
        if up == "@":
            found = self._reach(self._reach(hits, self._dependents), needs)
        elif up:
            found |= self._reach(hits, needs, int(before) if before else None)
        if down:
            found |= self._reach(hits, self._dependents, int(after) if after else None)
        return found

    def _dependents(self, name: str) -> list[str]:
        return [n for n, m in self.models.items() if name in m.refs]

    def _reach(self, start: set[str], step: Callable, steps: int | None = None) -> set[str]:
        seen, edge = set(start), set(start)
        while edge and steps != 0:
            edge = {n for e in edge for n in step(e) if n in self.models} - seen
            seen |= edge
            steps = steps if steps is None else steps - 1
        return seen

    def relation(self, name: str) -> str:
        return f"{self.database}.{name}"

    def frame(self, name: str) -> DataFrame:
        """A node's rows: as built in this session, else its table, else derived on the fly."""
        if name in self.built:
            return self.built[name]
        model = self.models[name]
        if (model.stored or model.seed_path) and self.spark.catalog.tableExists(self.relation(name)):
            return self.spark.table(self.relation(name))
        return self._derive(model)

    def _derive(self, model: Model) -> DataFrame:
        return model.build(*[self.frame(r) for r in model.refs])

    def _make(self, name: str, full_refresh: bool) -> None:
        model = self.models[name]
        if model.seed_path:
            self.built[name] = load_seed(
                self.spark, model.seed_path, model.seed_schema, self.relation(name), full_refresh
            )
        elif model.stored:
            self.built[name] = tables.store(self.spark, self.relation(name), self._derive(model))
        else:
            self.built[name] = self._derive(model)
            self.built[name].createOrReplaceTempView(name)

    def _lineage(self, report: RunReport, name: str) -> None:
        report.outputs.append(data_ref("table", self.relation(name), metadata={"node": name}))
        known = {ref["metadata"]["node"] for ref in report.inputs}
        report.inputs.extend(
            data_ref("table", self.relation(r), metadata={"node": r})
            for r in self.models[name].refs
            if r in self.models and r not in known
        )

    def run(
        self, select: str | None = None, exclude: str | None = None, full_refresh: bool = False,
        logic_version: str = "unknown", execution_id: str = "unknown",
    ) -> RunReport:
        """Build the selected models; one that fails keeps those that need it from being built."""
        return self._walk("run", select, exclude, full_refresh, (logic_version, execution_id), ("model",), False)

    def seed(self, select: str | None = None, full_refresh: bool = False) -> RunReport:
        return self._walk("seed", select, None, full_refresh, ("unknown", "unknown"), ("seed",), False)

    def build(
        self, select: str | None = None, exclude: str | None = None, full_refresh: bool = False,
        logic_version: str = "unknown", execution_id: str = "unknown",
    ) -> RunReport:
        """Seeds, models and tests in dependency order; what needs a failed node or test is skipped."""
        return self._walk(
            "build", select, exclude, full_refresh, (logic_version, execution_id), ("seed", "model"), True
        )

    def _walk(self, command, select, exclude, full_refresh, stamp, kinds, with_tests) -> RunReport:
        report = RunReport(command, *stamp)
        blocked: set[str] = set()
        unbuilt: set[str] = set()
        chosen = self.selected(select, exclude)
        waiting = {n: [] for n in chosen}
        for name in chosen:
            model = self.models[name]
            if model.kind not in kinds:
                continue
            if blocked & set(model.refs):
                blocked.add(name)
                unbuilt.add(name)
                report.rows.append((name, model.kind, "skipped", None, None))
                continue
            try:
                self._make(name, full_refresh)
            except Exception as error:  # noqa: BLE001 - reported per node
                blocked.add(name)
                unbuilt.add(name)
                report.rows.append((name, model.kind, "error", None, str(error)))
                continue
            report.rows.append((name, model.kind, "success", None, None))
            self._lineage(report, name)
            if not with_tests:
                continue
            ahead = set(chosen[chosen.index(name) + 1 :])
            due = waiting.pop(name) + [(name, t) for t in model.tests if t.to not in ahead]
            for test in model.tests:  # its parent needs this very model and is still to come
                if test.to in ahead:
                    waiting[test.to].append((name, test))
            outcomes = self._test_rows([(n, t) for n, t in due if t.to not in unbuilt])
            outcomes += [(t.label(n), "test", "skipped", None, None) for n, t in due if t.to in unbuilt]
            report.rows.extend(outcomes)
            failed = {row[0] for row in outcomes if row[2] == "fail"}
            blocked |= {n for n, t in due if t.label(n) in failed}
        left = [(n, t) for tests in waiting.values() for n, t in tests]
        report.rows.extend((t.label(n), "test", "skipped", None, None) for n, t in left)
        return report

    def test(self, select: str | None = None, exclude: str | None = None) -> RunReport:
        """Run the data tests of the selected nodes; a test fails if any value offends."""
        report = RunReport("test", "unknown", "unknown")
        report.rows = self._test_rows(self._tests(self.selected(select, exclude)))
        return report

    def _tests(self, names: list[str]) -> list[tuple[str, DataTest]]:
        return [(n, t) for n in names for t in self.models[n].tests]

    def _test_rows(self, tests: list[tuple[str, DataTest]]) -> list[tuple]:
        counts = self._counts(tests)
        if counts is None:
            return []
        return [
            (r.node, "test", "fail" if r.failures else "pass", r.failures, None)
            for r in counts.orderBy("node").collect()
        ]

    def test_counts(self, names: list[str]) -> DataFrame | None:
        """Rows `(node, failures)` of all the nodes' tests."""
        return self._counts(self._tests(names))

    def _counts(self, tests: list[tuple[str, DataTest]]) -> DataFrame | None:
        """The null and uniqueness tests of a column share one count of its values, and null tests of
        columns that have no other share one scan of their node."""
        parts = []
        for name in dict.fromkeys(n for n, _ in tests):
            frame, own = self.frame(name), [t for n, t in tests if n == name]
            unique = {t.column: t for t in own if t.kind == "unique"}
            not_null = {t.column: t for t in own if t.kind == "not_null"}
            alone = [c for c in not_null if c not in unique]
            if alone:
                wide = checks.null_counts(frame, alone)
                cells = [_cell(not_null[c].label(name), F.col(c)) for c in alone]
                parts.append(wide.select(F.inline(F.array(*cells))))
            for column, test in unique.items():
                found = checks.value_faults(frame, column)
                cells = [_cell(test.label(name), F.col("repeated"))]
                if column in not_null:
                    cells.append(_cell(not_null[column].label(name), F.col("nulls")))
                parts.append(found.select(F.inline(F.array(*cells))))
            for test in own:
                if test.kind == "relationships":
                    failures = checks.orphans(frame, test.column, self.frame(test.to), test.field).agg(
                        F.coalesce(F.sum("n"), F.lit(0)).alias("n")
                    )
                    parts.append(failures.select(F.inline(F.array(_cell(test.label(name), F.col("n"))))))
        return reduce(DataFrame.unionByName, parts) if parts else None


def _cell(label: str, failures: Column) -> Column:
    return F.struct(F.lit(label).alias("node"), failures.cast("bigint").alias("failures"))
