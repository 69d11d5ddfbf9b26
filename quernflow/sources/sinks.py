"""Outputs: directories of part files, written aside and moved into place."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .inputs import csv_settings, reject_cloud
from .store import Place

RECORD = "_run.json"
#: The compression names of the Parquet option.
_COMPRESSION = {"snappy": "snappy", "gzip": "gzip", "uncompressed": "none", "none": "none"}


@dataclass(frozen=True)
class OutputFile:
    """Where and how a task's rows are written."""

    path: str
    format: str = "csv"
    options: dict[str, str] = field(default_factory=dict)
    max_partitions: int | None = None

    def __post_init__(self):
        if self.max_partitions is not None and self.max_partitions < 1:
            raise ValueError(f"maxPartitions must be at least 1, not {self.max_partitions}")
        if self.format not in ("csv", "parquet"):
            raise ValueError(f"Unsupported output format '{self.format}': use csv or parquet")


def clear_if_marked(directory: Place) -> bool:
    """Empty an output directory that holds a run record: its files only, the record first. Sub-directories stay, and
    directories without a record are left alone."""
    record = directory / RECORD
    if not record.is_file():
        return False
    record.delete()
    for p in directory.children():
        if p.is_file():
            p.delete()
    return True


def csv_text(df: DataFrame) -> DataFrame:
    """Columns as CSV text: ISO instants with only the fractional digits they need, Base64 for binary."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            digits = F.date_format(c, "SSSSSS")
            short = F.when(digits == "000000", "").when(digits.endswith("000"), F.concat(F.lit("."), F.substring(digits, 1, 3))).otherwise(F.concat(F.lit("."), digits))
            c = F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), short, F.lit("Z"))
        elif isinstance(f.dataType, T.BinaryType):
            c = F.base64(c)
        out.append(c.alias(f.name))
    return df.select(out)


def write_output(df: DataFrame, out: OutputFile) -> list[str]:
    """Write part-00000 and so on; the names of the files. Rows are staged in a hidden sibling first: a failed write
    leaves the directory as it was. The number of parts is never raised, only capped."""
    reject_cloud(out.path)
    target = Place(df.sparkSession, out.path)
    stage = target / f".staging-{uuid.uuid4().hex}"
    capped = df.coalesce(out.max_partitions) if out.max_partitions else df
    try:
        if out.format == "csv":
            s = csv_settings(out.options)
            csv_text(capped).write.options(
                header=s["header"], sep=s["sep"], quote=s["quote"], escape=s["escape"], nullValue=s["null"], emptyValue="", encoding=s["encoding"],
                lineSep=out.options.get("lineEnding", "\n"), ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
            ).csv(str(stage))
        else:
            name = out.options.get("compression", "snappy").lower()
            if name not in _COMPRESSION:
                raise ValueError(f"Unsupported compression '{name}'")
            writer = capped.write.option("compression", _COMPRESSION[name])
            if "row_group_size_bytes" in out.options:
                writer = writer.option("parquet.block.size", out.options["row_group_size_bytes"])
            writer.parquet(str(stage))
        clear_if_marked(target)
        names = []
        for i, part in enumerate(p for p in stage.children() if p.name.startswith("part-")):
            names.append(f"part-{i:05d}.{out.format}")
            part.move(target / names[-1])
        return names
    finally:
        stage.delete()
