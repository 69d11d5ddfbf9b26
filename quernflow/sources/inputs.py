"""Named inputs: path expansion, format resolution, CSV type sampling, Parquet."""

from __future__ import annotations

import csv
import io
import re
import warnings
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of the first file that CSV types are inferred from.
SAMPLE_ROWS = 1000
_TRUE = frozenset(("true", "1", "yes"))
#: The type ladder: a column stands on the first step that takes all of its sampled values.
_INT = re.compile(r"[+-]?\d+")


@dataclass(frozen=True)
class InputFile:
    """An input of a job: a view's name and where it is read from."""

    view: str
    path: str
    format: str | None = None
    options: dict[str, str] = field(default_factory=dict)
    cache: bool = True

    def __post_init__(self):
        if not self.view or not self.path:
            raise ValueError("an input needs a view name and a path")

    def resolved_format(self, path: str) -> str:
        if self.format:
            if self.format.lower() not in ("csv", "parquet"):
                raise ValueError(f"Unsupported input format '{self.format}': use csv or parquet")
            return self.format.lower()
        return "parquet" if ".parquet" in path.lower() or path.lower().endswith(".pq") else "csv"


def reject_cloud(path: str) -> None:
    """Cloud paths are refused with a clear message, for inputs and outputs alike."""
    if re.match(r"(gs|s3)://", path):
        raise NotImplementedError(f"Cloud paths are not yet implemented (v1.1): {path}")


def expand(spark: SparkSession, path: str) -> list[str]:
    """The files of a path, a directory (one level) or a glob, sorted, through Hadoop's file system. Hidden files, those
    whose names begin with a dot or an underscore, are left out."""
    reject_cloud(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    stack = [(s, 0) for s in (fs.globStatus(target) or [])]
    while stack:
        status, depth = stack.pop()
        p = status.getPath()
        if status.isDirectory():
            if depth == 0:
                stack += [(s, 1) for s in fs.listStatus(p)]
        elif not p.getName().startswith((".", "_")) or depth == 0 and "*" not in path:
            found.append(p.toString())
    if not found:
        raise FileNotFoundError(f"No files match {path}")
    return sorted(found)


def _kind(value: str) -> int:
    """The lowest step of the ladder that takes a value: int, long, double, boolean, date, timestamp, string."""
    if _INT.fullmatch(value):
        n = int(value)
        return 0 if -(1 << 31) <= n < 1 << 31 else 1 if -(1 << 63) <= n < 1 << 63 else 2
    try:
        float(value)
        if not re.search(r"[_nN]", value):
            return 2
    except ValueError:
        pass
    if value.lower() in ("true", "false"):
        return 3
    try:
        if len(value) == 10 and date.fromisoformat(value):
            return 4
    except ValueError:
        pass
    try:
        if "T" in value and datetime.fromisoformat(value):
            return 5
    except ValueError:
        pass
    return 6


_STEPS = (T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.DateType(), T.TimestampType(), T.StringType())


def infer_column(values: list[str]) -> T.DataType:
    """The type of a column's sampled, non-null values; none gives string. Numbers widen among themselves; any other
    mixture is a string."""
    kinds = {_kind(v) for v in values}
    if not kinds:
        return T.StringType()
    if kinds <= {0, 1, 2} or len(kinds) == 1:
        return _STEPS[max(kinds)]
    if kinds <= {4, 5}:
        return _STEPS[5]
    return _STEPS[6]


def csv_settings(options: dict[str, str]) -> dict:
    """CSV options by their short names, with defaults."""
    sep = options.get("delimiter", ",")
    return {
        "header": options.get("header", "true").lower() in _TRUE,
        "sep": "\t" if sep == "\\t" else sep,
        "quote": options.get("quote", '"'),
        "escape": options.get("escape", options.get("quote", '"')),
        "null": options.get("nullValue", ""),
        "encoding": options.get("charset", "UTF-8"),
        "strict": options.get("mode", "").upper() == "FAILFAST",
    }


class _Bytes(io.RawIOBase):
    """A file's bytes through Hadoop's file system, read as far as they are asked for."""

    def __init__(self, spark: SparkSession, path: str):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self.stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        got = self.stream.readNBytes(len(buffer))
        buffer[: len(got)] = got
        return len(got)

    def close(self) -> None:
        if not self.closed:
            self.stream.close()
        super().close()


def infer_csv(spark: SparkSession, first: str, s: dict) -> T.StructType:
    """Column names and types from the first whole rows of the first file, however long they are."""
    with io.TextIOWrapper(io.BufferedReader(_Bytes(spark, first), 1 << 20), s["encoding"], "replace", newline="") as text:
        rows = _rows(text, s, SAMPLE_ROWS + s["header"])
    if not rows:
        return T.StructType()
    names = rows.pop(0) if s["header"] else [f"_c{i}" for i in range(max(map(len, rows)))]
    columns = [[r[i] for r in rows if i < len(r) and r[i] != s["null"]] for i in range(len(names))]
    return T.StructType([T.StructField(n, infer_column(c)) for n, c in zip(names, columns, strict=True)])


def _rows(text: Iterable[str], s: dict, limit: int) -> list[list[str]]:
    double = s["escape"] == s["quote"]
    csv.field_size_limit((1 << 31) - 1)  # Python's own limit is 128 KB a value
    reader = csv.reader(text, delimiter=s["sep"], quotechar=s["quote"], doublequote=double, escapechar=None if double else s["escape"])
    out = []
    for row in reader:
        if row and row != [""]:  # blank rows are skipped
            out.append(row)
            if len(out) >= limit:
                break
    return out


def _cast(raw: Column, kind: T.DataType) -> Column:
    """A value as a type of the ladder; NULL where it does not fit."""
    form = {"int": r"^[+-]?[0-9]+$", "bigint": r"^[+-]?[0-9]+$", "boolean": "(?i)^(true|false)$", "date": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"}.get(kind.simpleString())
    value = raw.try_cast(kind)
    return F.when(raw.rlike(form), value) if form else value


def _widened(rows: DataFrame, schema: T.StructType) -> T.StructType:
    """`schema` with each column on the first step that takes all of its values, not the sampled ones only. One pass."""
    wider = {"int": _STEPS[1:3], "bigint": _STEPS[2:3], "date": _STEPS[5:6]}
    tests = {}
    for i, f in enumerate(schema):
        if f.dataType != T.StringType():
            for k, kind in enumerate((f.dataType, *wider.get(f.dataType.simpleString(), ()))):
                raw = F.col(f"_{i}")
                tests[i, k] = kind, F.coalesce(F.bool_and(raw.isNull() | _cast(raw, kind).isNotNull()), F.lit(True)).alias(f"_{i}_{k}")
    if not tests:
        return schema
    fits = dict(zip(tests, rows.agg(*[c for _, c in tests.values()]).first(), strict=True))
    out = []
    for i, f in enumerate(schema):
        kinds = [kind for (j, k), (kind, _) in tests.items() if j == i and fits[j, k]]
        out.append(T.StructField(f.name, kinds[0] if kinds else T.StringType()))
        if out[-1].dataType != f.dataType:
            warnings.warn(f"column {f.name}: values after the sample do not fit {f.dataType.simpleString()}, read as {out[-1].dataType.simpleString()}", stacklevel=4)
    return T.StructType(out)


def read_csv(spark: SparkSession, files: list[str], options: dict[str, str] | None = None, schema: T.StructType | None = None, strict: bool = False) -> DataFrame:
    """CSV by RFC 4180: doubled quotes, embedded separators and line breaks; short rows end in NULLs. Without a schema,
    types come from the first file's sample. A later value that does not fit its type fails the read if `strict` (or
    mode=FAILFAST); otherwise its column's type is widened over all files, so no value is lost. A file is one task, as
    values may hold line breaks; multiLine=false splits files whose values hold none."""
    s = csv_settings(options or {})
    given = schema
    if schema is None:
        if (options or {}).get("inferSchema", "true").lower() not in _TRUE:
            raise ValueError("inferSchema=false needs a schema")
        schema = infer_csv(spark, files[0], s)
    texts = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(schema))])
    reader = spark.read.schema(texts if given is None else given).options(
        header=s["header"], sep=s["sep"], quote=s["quote"], escape=s["escape"], nullValue=s["null"], encoding=s["encoding"],
        multiLine=(options or {}).get("multiLine", "true").lower() in _TRUE, enforceSchema=True, mode="FAILFAST" if s["strict"] else "PERMISSIVE",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    rows = reader.csv(files)
    if given is not None:
        return rows
    strict = strict or s["strict"]
    columns = []
    for i, f in enumerate(schema if strict else _widened(rows, schema)):
        raw, value = F.col(f"_{i}"), _cast(F.col(f"_{i}"), f.dataType)
        if strict and f.dataType != T.StringType():
            wrong = F.raise_error(F.concat(F.lit(f"column {f.name}: not of type {f.dataType.simpleString()}: "), raw)).cast(f.dataType)
            value = F.when(raw.isNull() | value.isNotNull(), value).otherwise(wrong)
        columns.append(value.alias(f.name))
    return rows.select(*columns)


def read_input(spark: SparkSession, source: InputFile, schema: T.StructType | None = None, strict: bool = False) -> DataFrame:
    """The rows of an input. Parquet keeps the first file's schema, column pruning and pushed filters are Spark's. The
    option read_partition_size_bytes is a setting of the whole session: of several inputs that give it the last one's
    holds for all of a job."""
    files = expand(spark, source.path)
    if source.resolved_format(source.path) == "parquet":
        size = source.options.get("read_partition_size_bytes")
        if size:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        return spark.read.parquet(*files)
    return read_csv(spark, files, source.options, schema, strict)
