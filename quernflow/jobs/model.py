"""What a job is made of, and what a run gives."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path

from ..sources.inputs import InputFile
from ..sources.sinks import OutputFile
from ..temporal import TemporalVariables

SUCCEEDED, FAILED, INVALID, SKIPPED, PENDING = "Succeeded", "Failed", "ValidationFailed", "Skipped", "Pending"


def _text(sql: str | None, file: str | None, what: str) -> str:
    if (sql is None) == (file is None):
        raise ValueError(f"{what} needs exactly one of sql and sql_file")
    return sql if sql is not None else Path(file).read_text(encoding="utf-8")


@dataclass(frozen=True)
class Validation:
    """A query that must give no rows."""

    name: str
    sql: str | None = None
    sql_file: str | None = None

    def text(self) -> str:
        return _text(self.sql, self.sql_file, f"validation '{self.name}'")


@dataclass(frozen=True)
class Task:
    """A SELECT, the view that its rows become, where they are written, and what must hold for them."""

    view: str | None = None
    sql: str | None = None
    sql_file: str | None = None
    output: OutputFile | None = None
    validations: tuple[Validation, ...] = ()
    name: str | None = None

    def __post_init__(self):
        if (self.sql is None) == (self.sql_file is None):
            raise ValueError("a task needs exactly one of sql and sql_file")

    def text(self) -> str:
        return _text(self.sql, self.sql_file, f"task '{self.label}'")

    @property
    def label(self) -> str:
        return self.name or self.view or (Path(self.sql_file).stem if self.sql_file else "task")


@dataclass(frozen=True)
class Job:
    inputs: tuple[InputFile, ...] = ()
    tasks: tuple[Task, ...] = ()
    at: TemporalVariables = field(default_factory=TemporalVariables)
    record_path: str | None = None
    mode: str = "native"


@dataclass
class ValidationResult:
    name: str
    passed: bool
    failed_rows: int = 0
    sample: str | None = None


@dataclass
class TaskResult:
    name: str
    status: str = PENDING
    error: str | None = None
    rows: int = 0
    files: list[str] = field(default_factory=list)
    validations: list[ValidationResult] = field(default_factory=list)
    directory: str | None = None
    enqueued: datetime | None = None
    started: datetime | None = None
    finished: datetime | None = None

    @property
    def duration_ms(self) -> int:
        return int((self.finished - self.started).total_seconds() * 1000) if self.started and self.finished else 0

    @property
    def queue_ms(self) -> int:
        return int((self.started - self.enqueued).total_seconds() * 1000) if self.started and self.enqueued else 0


@dataclass
class JobResult:
    tasks: list[TaskResult] = field(default_factory=list)
    error: str | None = None
    warnings: list[str] = field(default_factory=list)
    started: datetime | None = None
    finished: datetime | None = None

    @property
    def succeeded(self) -> bool:
        return self.error is None and all(t.status == SUCCEEDED for t in self.tasks)

    def task(self, name: str) -> TaskResult:
        return next(t for t in self.tasks if t.name == name)
