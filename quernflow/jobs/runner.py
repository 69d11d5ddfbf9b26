"""Running a job: inputs and tasks are peers, whatever is ready runs at once, failures skip what depends on them.

One coordinator thread owns all state; workers run Spark actions and report through a queue."""

from __future__ import annotations

import contextlib
import queue
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans.engine import Catalog
from ..sources.inputs import InputFile, read_csv, read_input
from ..sources.sinks import OutputFile, clear_if_marked, csv_text, write_output
from ..sources.store import Place
from . import records
from .dag import Node, build
from .model import FAILED, INVALID, PENDING, SKIPPED, SUCCEEDED, Job, JobResult, TaskResult, ValidationResult

#: Sample rows kept of a failed validation, and tasks that run at once.
SAMPLE, WORKERS = 10, 8


class Listener:
    """What a run reports; methods do nothing by default and their errors are ignored."""

    def task_enqueued(self, name: str) -> None: ...
    def task_started(self, name: str) -> None: ...
    def task_finished(self, result: TaskResult) -> None: ...
    def input_started(self, view: str) -> None: ...
    def input_finished(self, view: str, error: str | None) -> None: ...


def _now() -> datetime:
    return datetime.now(UTC)


class _Run:
    def __init__(self, spark: SparkSession, job: Job, listener: Listener):
        self.job, self.listener, self.catalog = job, listener, Catalog(spark)
        self.spark = self.catalog.spark
        self.cached: list[DataFrame] = []
        self.events: queue.Queue = queue.Queue()

    def tell(self, what: str, *args) -> None:
        with contextlib.suppress(Exception):
            getattr(self.listener, what)(*args)

    # work of the worker threads
    def load(self, source: InputFile) -> None:
        self.tell("input_started", source.view)
        error = None
        try:
            at = self.job.at
            df = read_input(self.spark, InputFile(source.view, at.render(source.path), source.format, dict(source.options), source.cache), strict=self.job.mode == "strict")
            if source.cache:
                df = df.persist(StorageLevel.MEMORY_AND_DISK)
                self.cached.append(df)
            self.catalog.register(source.view, df)
        except Exception as e:  # noqa: BLE001  a failed input fails its dependents, not the run
            error = f"{type(e).__name__}: {e}"
        self.tell("input_finished", source.view, error)
        self.events.put(("input", source.view.lower(), error))

    def work(self, node: Node, r: TaskResult, consumers: bool) -> None:
        r.started = _now()
        self.tell("task_started", r.name)
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", r.name)
        try:
            self.execute(node, r, consumers)
            r.status = SUCCEEDED if all(v.passed for v in r.validations) else INVALID
            if r.status == INVALID:
                r.error = "Validations failed: " + ", ".join(v.name for v in r.validations if not v.passed)
        except Exception as e:  # noqa: BLE001
            r.status, r.error = FAILED, f"{type(e).__name__}: {e}"
            if "OutOfMemoryError" in r.error:
                r.error += " (inputs with \"cache\": false leave more memory to tasks)"
            r.files = []
            if node.directory:
                clear_if_marked(Place(self.spark, node.directory))
        r.finished = _now()
        self.events.put(("task", node.index, None))

    def execute(self, node: Node, r: TaskResult, consumers: bool) -> None:
        task = node.task
        df = self.catalog.sql(node.sql, self.job.mode)
        if task.output:
            out = OutputFile(node.directory, task.output.format, task.output.options, task.output.max_partitions)
            seen = Observation()
            schema = df.schema
            r.files = write_output(df.observe(seen, F.count(F.lit(1)).alias("n")), out)
            r.rows = int(seen.get["n"])
            if consumers or node.checks:
                paths = [f"{node.directory.rstrip('/')}/{f}" for f in r.files]
                again = read_csv(self.spark, paths, out.options, schema) if out.format == "csv" else self.spark.read.schema(schema).parquet(*paths)
                if task.view:
                    self.catalog.replace(task.view, again)
        else:
            kept = df.persist(StorageLevel.MEMORY_AND_DISK)
            self.cached.append(kept)
            r.rows = kept.count()
            if task.view:
                self.catalog.replace(task.view, kept)
        for name, sql in node.checks:
            r.validations.append(self.validate(name, sql, node))

    def validate(self, name: str, sql: str, node: Node) -> ValidationResult:
        bad = self.catalog.sql(sql, self.job.mode).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n = bad.count()
            if not n:
                return ValidationResult(name, True)
            sample = None
            if node.directory:
                sample = f"_validation-{records.slug(name)}.csv"
                rows = csv_text(bad.limit(SAMPLE)).toPandas()
                (Place(self.spark, node.directory) / sample).write_text(rows.to_csv(index=False))
            return ValidationResult(name, False, n, sample)
        finally:
            bad.unpersist()

    # the coordinator
    def run(self, nodes: list[Node]) -> list[TaskResult]:
        results = [TaskResult(n.task.label, directory=n.directory) for n in nodes]
        consumed = {k for n in nodes for k in n.waits}
        loaded: dict[str, str | None] = {}
        started: set[int] = set()
        names = {i.view.lower() for i in self.job.inputs}
        by_view = {n.index: n for n in nodes}
        with ThreadPoolExecutor(WORKERS) as pool:
            for i in self.job.inputs:
                pool.submit(self.load, i)

            def advance() -> None:
                moved = True
                while moved:
                    moved = False
                    for n in nodes:
                        r = results[n.index]
                        if n.index in started or r.status != PENDING:
                            continue
                        bad = [v for v in sorted(n.inputs) if loaded.get(v)]
                        broken = [results[k].name for k in sorted(n.waits) if results[k].status in (FAILED, INVALID, SKIPPED)]
                        if bad or broken:
                            r.status, r.finished = SKIPPED, _now()
                            r.error = f"Skipped: input '{bad[0]}' failed: {loaded[bad[0]]}" if bad else f"Skipped: upstream task '{broken[0]}' did not succeed"
                            self.settle(by_view[n.index], r)
                            moved = True
                        elif n.inputs <= loaded.keys() and all(results[k].status == SUCCEEDED for k in n.waits):
                            started.add(n.index)
                            r.enqueued = _now()
                            self.tell("task_enqueued", r.name)
                            pool.submit(self.work, n, r, n.index in consumed)

            advance()
            while any(r.status == PENDING for r in results) or len(loaded) < len(names):
                kind, what, error = self.events.get()
                if kind == "input":
                    loaded[what] = error
                else:
                    self.settle(by_view[what], results[what])
                advance()
        return results

    def settle(self, node: Node, r: TaskResult) -> None:
        if node.directory:
            if r.status in (SKIPPED, FAILED):
                clear_if_marked(Place(self.spark, node.directory))
            records.write_json(Place(self.spark, node.directory) / records.RECORD, records.task_record(r, self.job.at.execution_time, node.task.output.format))
        self.tell("task_finished", r)


def run_job(spark: SparkSession, job: Job, listener: Listener | None = None) -> JobResult:
    """Run a job. Errors of its set-up end it before any task; all else is told by the tasks' results."""
    result = JobResult(started=_now())
    run = _Run(spark, job, listener or Listener())
    try:
        nodes = build(run.spark, job)
    except Exception as e:  # noqa: BLE001
        result.error, result.finished = f"{type(e).__name__}: {e}", _now()
        return result
    try:
        result.tasks = run.run(nodes)
    finally:
        for df in run.cached:
            df.unpersist()
    result.finished = _now()
    result.warnings = records.warnings(run.spark, result)
    if job.record_path:
        records.write_json(Place(run.spark, job.at.render(job.record_path)), records.job_record(result, job.at.execution_time))
    return result
