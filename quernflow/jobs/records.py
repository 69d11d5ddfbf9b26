"""Run records: `_run.json` of a task, `job.json` of a job, and finding them again."""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from ..sources.sinks import RECORD
from ..sources.store import Place
from .model import JobResult, TaskResult

VERSION = 1


def instant(at: datetime | None) -> str | None:
    if at is None:
        return None
    at = at.astimezone(UTC)
    return at.strftime("%Y-%m-%dT%H:%M:%S") + (f".{at.microsecond:06d}" if at.microsecond else "") + "Z"


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9_-]+", "_", name.lower()).strip("_")


def write_json(path: Place, data: dict) -> None:
    path.write_text(json.dumps(data, indent=2))


def task_record(r: TaskResult, at: datetime, fmt: str) -> dict:
    return {
        "schemaVersion": VERSION, "taskName": r.name, "status": r.status, "errorMessage": r.error, "executionTime": instant(at),
        "enqueuedAt": instant(r.enqueued), "startedAt": instant(r.started), "finishedAt": instant(r.finished), "writtenAt": instant(datetime.now(UTC)),
        "rowsProduced": r.rows, "format": fmt, "outputFiles": r.files,
        "validations": [{"name": v.name, "passed": v.passed, "failedRowCount": v.failed_rows, "sampleFile": v.sample} for v in r.validations],
    }


def job_record(result: JobResult, at: datetime) -> dict:
    return {
        "schemaVersion": VERSION, "succeeded": result.succeeded, "errorMessage": result.error, "executionTime": instant(at),
        "startedAt": instant(result.started), "finishedAt": instant(result.finished),
        "tasks": [
            {
                "taskName": t.name, "status": t.status, "runFile": f"{t.directory}/{RECORD}" if t.directory else None, "rowsProduced": t.rows,
                "failedValidationCount": sum(not v.passed for v in t.validations), "errorMessage": t.error,
            }
            for t in result.tasks
        ],
        "warnings": result.warnings,
    }


def warnings(spark: SparkSession, result: JobResult) -> list[str]:
    """Records, parts and samples that the results name but the file system lacks."""
    out = []
    for t in result.tasks:
        if t.directory:
            there = {p.name for p in Place(spark, t.directory).children()}
            for name in (RECORD, *t.files, *(v.sample for v in t.validations if v.sample)):
                if name not in there:
                    out.append(f"{t.name}: {name} is missing in {t.directory}")
    return out


def history(spark: SparkSession, template: str, depth: int = 6) -> list[dict]:
    """Records below an output path whose templates may stand for anything, newest first. The first template stands at
    most `depth` names before the end."""
    pattern = re.sub(r"\{\{.*?\}\}", "*", template).rstrip("/")
    parts = pattern.split("/")
    first = next((i for i, p in enumerate(parts) if "*" in p), len(parts))
    if len(parts) - first > depth:
        return []
    found = [json.loads(p.read_text()) | {"directory": str(p.parent)} for p in Place(spark, f"{pattern}/{RECORD}").matching()]
    return sorted(found, key=lambda r: r.get("writtenAt") or "", reverse=True)


def layout(spark: SparkSession, directory: str) -> tuple[str, list[str]]:
    """What a job output directory holds: one run, several (newest first) or nothing."""
    root = Place(spark, directory)
    if (root / "job.json").is_file():
        return "single", [str(root)]
    runs = [p for p in root.children() if (p / "job.json").is_file()]
    runs.sort(key=lambda p: json.loads((p / "job.json").read_text()).get("finishedAt") or "", reverse=True)
    return ("multi", [str(p) for p in runs]) if runs else ("empty", [])
