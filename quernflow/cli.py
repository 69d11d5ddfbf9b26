"""Command line: run and inspect jobs, edit their directories, query views, look into Parquet files."""

from __future__ import annotations

import argparse
import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from .jobs import load_job, records, run_job
from .jobs.dag import build, layers
from .jobs.loader import delete, new_project, save_input, save_table, save_validation
from .plans.engine import Catalog
from .session import build_session
from .sources.inputs import InputFile, expand, read_csv, read_input
from .sources.sinks import OutputFile, write_output
from .sources.store import Place


def interactive_catalog(spark: SparkSession, directory: str, output: str | None = None) -> Catalog:
    """Views of a job's inputs and of its tables' latest successful outputs; what cannot be read is left out."""
    job, catalog = load_job(directory, output), Catalog(spark)
    for i in job.inputs:
        try:
            catalog.register(i.view, read_input(catalog.spark, InputFile(i.view, job.at.render(i.path), i.format, dict(i.options)), strict=job.mode == "strict"))
        except Exception as e:  # noqa: BLE001
            print(f"input {i.view}: {e}")
    for t in job.tasks:
        runs = [r for r in records.history(catalog.spark, t.output.path) if r["status"] in ("Succeeded", "ValidationFailed")]
        if runs:
            files = [f"{runs[0]['directory']}/{f}" for f in runs[0]["outputFiles"]]
            df = read_csv(catalog.spark, files, t.output.options) if runs[0]["format"] == "csv" else catalog.spark.read.parquet(*files)
            catalog.register(t.view, df)
    return catalog


def persist_result(df: DataFrame, out: OutputFile) -> list[str]:
    """Write the rows of an ad-hoc query with a record of its own."""
    from datetime import UTC

    from .jobs.model import SUCCEEDED, TaskResult

    now = datetime.now(UTC)
    files = write_output(df, out)
    r = TaskResult("interactive query", SUCCEEDED, rows=df.count(), files=files, directory=out.path, enqueued=now, started=now, finished=datetime.now(UTC))
    records.write_json(Place(df.sparkSession, out.path) / records.RECORD, records.task_record(r, now, out.format))
    return files


def peek(spark: SparkSession, path: str, rows: int = 20) -> None:
    df = spark.read.parquet(*expand(spark, path))
    df.printSchema()
    print(f"partitions: {df.rdd.getNumPartitions()}, rows: {df.count()}")
    df.show(rows, truncate=80)


def _pairs(given: list[str]) -> dict[str, str]:
    """key=value arguments."""
    bad = [x for x in given if "=" not in x]
    if bad:
        raise ValueError(f"'{bad[0]}' is not key=value")
    return dict(x.split("=", 1) for x in given)


def _add_editors(sub) -> None:
    sub.add_parser("init").add_argument("job")
    s = sub.add_parser("add-input")
    for name in ("job", "view", "path"):
        s.add_argument(name)
    s.add_argument("--format", choices=("csv", "parquet"))
    s.add_argument("--no-cache", action="store_true")
    s.add_argument("--option", action="append", default=[])
    s = sub.add_parser("add-table")
    for name in ("job", "view", "query"):
        s.add_argument(name)
    s.add_argument("--format", choices=("csv", "parquet"), default="csv")
    s.add_argument("--partition-by")
    s.add_argument("--max-partitions", type=int)
    s.add_argument("--option", action="append", default=[])
    s = sub.add_parser("add-validation")
    for name in ("job", "view", "name", "query"):
        s.add_argument(name)
    for name in ("add-input", "add-table", "add-validation"):
        sub.choices[name].add_argument("--replace", action="store_true")
    s = sub.add_parser("delete")
    s.add_argument("job")
    s.add_argument("kind", choices=("input", "table", "validation"))
    s.add_argument("view")
    s.add_argument("name", nargs="?")


def _edit(a: argparse.Namespace) -> bool:
    """Do what an editing command says; whether it was one. No session is started."""
    if a.command == "init":
        new_project(a.job)
    elif a.command == "add-input":
        save_input(a.job, a.view, {"path": a.path, "format": a.format, "cache": not a.no_cache, "options": _pairs(a.option)}, a.replace)
    elif a.command == "add-table":
        save_table(a.job, a.view, a.query, {"format": a.format, "partitionBy": a.partition_by, "maxPartitions": a.max_partitions, "options": _pairs(a.option)}, a.replace)
    elif a.command == "add-validation":
        save_validation(a.job, a.view, a.name, a.query, a.replace)
    elif a.command == "delete":
        delete(a.job, a.kind, a.view, a.name)
    else:
        return False
    return True


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quernflow")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "dag", "sql", "runs"):
        s = sub.add_parser(name)
        s.add_argument("job")
        s.add_argument("--output")
        s.add_argument("--at", type=datetime.fromisoformat)
        s.add_argument("--mode", choices=("native", "strict"), default="native")
        if name == "sql":
            s.add_argument("query")
            s.add_argument("--rows", type=int, default=20)
            s.add_argument("--save")
    s = sub.add_parser("peek")
    s.add_argument("path")
    s.add_argument("--rows", type=int, default=20)
    _add_editors(sub)
    a = p.parse_args(argv)
    if _edit(a):
        return 0
    spark = build_session()
    if a.command == "runs":
        for t in load_job(a.job, a.output).tasks:
            for r in records.history(spark, t.output.path):
                print(json.dumps({k: r[k] for k in ("taskName", "status", "rowsProduced", "writtenAt", "directory")}))
        return 0
    if a.command == "peek":
        peek(spark, a.path, a.rows)
    elif a.command == "sql":
        df = interactive_catalog(spark, a.job, a.output).sql(a.query, a.mode)
        df.show(a.rows, truncate=80)
        if a.save:
            persist_result(df, OutputFile(a.save))
    else:
        job = load_job(a.job, a.output, a.at, a.mode)
        if a.command == "dag":
            for i, names in enumerate(layers(build(spark, job))):
                print(i, ", ".join(names))
        else:
            result = run_job(spark, job)
            for t in result.tasks:
                print(f"{t.status:17} {t.name} rows={t.rows} {t.error or ''}")
            if result.error:
                print(result.error)
            return 0 if result.succeeded else 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
