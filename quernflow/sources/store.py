"""Paths of outputs and records, through Hadoop's file system: any store that Spark's writers reach will do.

A path without a scheme belongs to the default file system, as it does for Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Place:
    """A file or a directory."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/") or "/"
        self._at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = self._at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        # the raw local one leaves no checksum files beside the parts
        self._fs = fs.getRawFileSystem() if fs.getClass().getSimpleName() == "LocalFileSystem" else fs

    def __truediv__(self, name: str) -> Place:
        return Place(self.spark, f"{self.path}/{name}")

    def __str__(self) -> str:
        return self.path

    @property
    def name(self) -> str:
        return self._at.getName()

    @property
    def parent(self) -> Place:
        return Place(self.spark, self._at.getParent().toString())

    def exists(self) -> bool:
        return self._fs.exists(self._at)

    def is_file(self) -> bool:
        return self.exists() and self._fs.getFileStatus(self._at).isFile()

    def is_dir(self) -> bool:
        return self.exists() and self._fs.getFileStatus(self._at).isDirectory()

    def children(self) -> list[Place]:
        """What a directory holds, by name."""
        return [self / n for n in sorted(s.getPath().getName() for s in self._fs.listStatus(self._at))] if self.is_dir() else []

    def matching(self) -> list[Place]:
        """The places that a path with wildcards stands for, written as the pattern is, with or without a scheme."""
        found = [s.getPath() for s in self._fs.globStatus(self._at) or []]
        return [Place(self.spark, p.toString() if ":/" in self.path else p.toUri().getPath()) for p in found]

    def read_text(self) -> str:
        stream = self._fs.open(self._at)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write_text(self, text: str) -> None:
        """Written aside and moved into place: readers never see half a file."""
        aside = self.parent / f".{self.name}.tmp"
        stream = aside._fs.create(aside._at, True)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        aside.move(self)

    def move(self, to: Place) -> None:
        """Rename within the file system, in place of what `to` was."""
        self._fs.mkdirs(to._at.getParent())
        to.delete()
        if not self._fs.rename(self._at, to._at):
            raise OSError(f"{self} was not moved to {to}")

    def delete(self) -> None:
        """Remove a file, or a directory with all it holds; nothing if there is none."""
        self._fs.delete(self._at, True)
