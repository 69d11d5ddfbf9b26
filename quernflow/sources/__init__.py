"""Sources and sinks: CSV and Parquet, by path, directory or glob."""

from .inputs import InputFile, read_input
from .sinks import OutputFile, write_output

__all__ = ["InputFile", "OutputFile", "read_input", "write_output"]
