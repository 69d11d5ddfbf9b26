"""Jobs as directories: `inputs/<view>/*.json` and `tables/<view>/{main.sql, output.json, validations/*.sql}`."""

from __future__ import annotations

import json
import re
from datetime import datetime
from pathlib import Path

from ..sources.inputs import InputFile
from ..sources.sinks import OutputFile
from ..temporal import TemporalVariables
from .model import Job, Task, Validation

VIEW = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")
#: A file name of one part: no separators, and not hidden.
CHECK = re.compile(r"[^./\\\x00][^/\\\x00]*")


def _strings(options: dict) -> dict[str, str]:
    """Option values as text: booleans in lower case, whole numbers without a point."""
    out = {}
    for k, v in options.items():
        if isinstance(v, dict | list):
            raise ValueError(f"Option '{k}' must be a scalar")
        out[k] = str(v).lower() if isinstance(v, bool) else str(int(v)) if isinstance(v, float) and v.is_integer() else "" if v is None else str(v)
    return out


def _json(path: Path) -> dict:
    try:
        got = json.loads(path.read_text(encoding="utf-8"))
    except json.JSONDecodeError as e:
        raise ValueError(f"{path}: {e}") from e
    if not isinstance(got, dict):
        raise ValueError(f"{path}: an object is needed")
    return got


def _at(base: Path, path: str) -> str:
    return path if re.match(r"[a-z0-9]+://", path) or Path(path).is_absolute() else str(base / path)


def load_job(directory: str, output: str | None = None, execution_time: datetime | None = None, mode: str = "native") -> Job:
    """The job of a directory. Relative paths are below it; outputs go to `output` or `<directory>/output`."""
    base = Path(directory)
    if not base.is_dir():
        raise FileNotFoundError(f"No job directory {directory}")
    out = (output or str(base / "output")).rstrip("/")
    inputs = []
    for d in sorted(p for p in (base / "inputs").glob("*") if p.is_dir()):
        files = sorted(d.glob("*.json"))
        if len(files) != 1:
            raise ValueError(f"{d}: exactly one JSON file is needed, there are {len(files)}")
        spec = _json(files[0])
        if not spec.get("path"):
            raise ValueError(f"{files[0]}: 'path' is missing")
        inputs.append(InputFile(d.name, _at(base, spec["path"]), spec.get("format"), _strings(spec.get("options") or {}), bool(spec.get("cache", True))))
    tasks = []
    for d in sorted(p for p in (base / "tables").glob("*") if p.is_dir()):
        if not (d / "main.sql").is_file():
            raise FileNotFoundError(f"{d}: main.sql is missing")
        spec = _json(d / "output.json") if (d / "output.json").is_file() else {}
        most = spec.get("maxPartitions")
        if most is not None and (isinstance(most, bool) or not isinstance(most, int) or most < 1):
            raise ValueError(f"{d / 'output.json'}: maxPartitions must be a whole number, 1 at least")
        path = f"{out}/{d.name}/{spec['partitionBy']}" if spec.get("partitionBy") else f"{out}/{d.name}"
        checks = tuple(Validation(p.stem, sql_file=str(p)) for p in sorted((d / "validations").glob("*.sql")))
        tasks.append(Task(d.name, sql_file=str(d / "main.sql"), output=OutputFile(path, spec.get("format", "csv"), _strings(spec.get("options") or {}), most), validations=checks))
    at = TemporalVariables(execution_time) if execution_time else TemporalVariables()
    return Job(tuple(inputs), tuple(tasks), at, f"{out}/job.json", mode)


# editing a job directory


def check_view(name: str) -> str:
    if not VIEW.fullmatch(name):
        raise ValueError(f"'{name}' is no view name: letters, digits and underscores, not starting with a digit")
    return name


def check_unused(directory: str, view: str) -> None:
    """Views share one namespace: neither an input nor a table may have the name, in any case of letters."""
    for folder, kind in (("inputs", "input"), ("tables", "table")):
        for p in (Path(directory) / folder).glob("*"):
            if p.name.lower() == check_view(view).lower():
                raise FileExistsError(f"There is already the {kind} '{p.name}'")


def check_validation(name: str | None) -> str:
    if not name or not CHECK.fullmatch(name):
        raise ValueError(f"'{name}' is no validation name: a file name without separators is needed")
    return name


def new_project(directory: str) -> None:
    """A small job that runs as it stands, in a directory that holds no job yet."""
    base = Path(directory)
    if (base / "inputs").is_dir() or (base / "tables").is_dir():
        raise FileExistsError(f"{directory} already holds a job")
    (base / "data").mkdir(parents=True, exist_ok=True)
    (base / "data" / "example.csv").write_text("id,name,amount\n1,alice,10.00\n2,bob,25.50\n3,carol,7.25\n", encoding="utf-8")
    save_input(directory, "example", {"path": "data/example.csv"})
    save_table(directory, "example_summary", "SELECT COUNT(*) AS n_rows, SUM(amount) AS total\nFROM example\n")


def save_input(directory: str, view: str, spec: dict, replace: bool = False) -> Path:
    """Add an input, or with `replace` change one that is there."""
    d = Path(directory) / "inputs" / check_view(view)
    if not (replace and d.is_dir()):
        check_unused(directory, view)
    d.mkdir(parents=True, exist_ok=True)
    small = {k: v for k, v in spec.items() if not (k == "cache" and v is True) and v not in (None, {}, "")}
    (d / "input.json").write_text(json.dumps(small, indent=2) + "\n", encoding="utf-8")
    return d / "input.json"


def save_table(directory: str, view: str, sql: str, output: dict | None = None, replace: bool = False) -> Path:
    """Add a table, or with `replace` change one that is there."""
    d = Path(directory) / "tables" / check_view(view)
    if not (replace and d.is_dir()):
        check_unused(directory, view)
    d.mkdir(parents=True, exist_ok=True)
    (d / "main.sql").write_text(sql, encoding="utf-8")
    small = {k: v for k, v in (output or {}).items() if v not in (None, {}, "") and (k, v) != ("format", "csv")}
    if small:
        (d / "output.json").write_text(json.dumps(small, indent=2) + "\n", encoding="utf-8")
    else:
        (d / "output.json").unlink(missing_ok=True)
    return d


def save_validation(directory: str, view: str, name: str, sql: str, replace: bool = False) -> Path:
    """Add a validation to a table, or with `replace` change one that is there."""
    table = Path(directory) / "tables" / check_view(view)
    if not table.is_dir():
        raise FileNotFoundError(f"There is no table '{view}'")
    d = table / "validations"
    if (d / f"{check_validation(name)}.sql").exists() and not replace:
        raise FileExistsError(f"There is already the validation '{name}' of '{view}'")
    d.mkdir(exist_ok=True)
    (d / f"{name}.sql").write_text(sql, encoding="utf-8")
    return d / f"{name}.sql"


def delete(directory: str, kind: str, view: str, validation: str | None = None) -> None:
    """Remove an input, a table or one of its validations."""
    import shutil

    d = Path(directory) / {"input": "inputs", "table": "tables", "validation": "tables"}[kind] / check_view(view)
    if kind == "validation":
        (d / "validations" / f"{check_validation(validation)}.sql").unlink()
    else:
        shutil.rmtree(d)
