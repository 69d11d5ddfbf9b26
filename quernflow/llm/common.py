"""What the corpus operators share: table reading, Arrow batch limits, the shared work folder."""

from __future__ import annotations

import re
import uuid
import weakref

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and TAB..CR.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Rows per Arrow batch handed to Python: whole texts can be long, so batches stay small.
ARROW_ROWS = 1500
#: Folders of stored tables that are still in use, by the table's identity; None for those in Spark's block store.
_PATHS: dict[int, tuple] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the generated tables, read through Spark's own file system layer."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts (rows; Spark itself bounds the bytes)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key) or 0) in (0, 10000):
        spark.conf.set(key, str(ARROW_ROWS))


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z and nothing else. Texts of ASCII alone take the faster function, which is the same there."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words of a text in order, as an array: what stands between white space of the contracts."""
    return F.array_remove(F.split(F.regexp_replace(text, "[\\t-\\r]", " "), " ", -1), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset and all runs in one
    process (master local) a folder below /tmp stands in; on a cluster the setting is needed."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not got:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        got = "file:///tmp/quernflow-checkpoints"
    return got.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/quernflow/{label}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Cut lineage: write `df` to the shared folder and read it back, so that lost executors cost no recomputation. The
    folder goes when the driver ends; `discard` removes it before."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.options(**options).parquet(path)
    drop_at_end(spark, path)
    return _known(spark.read.schema(df.schema).parquet(path), path)


def cached(df: DataFrame) -> DataFrame:
    """`df` computed once, in the executors' block stores on disk, until `discard` or the driver's end. Parts that are
    lost with an executor are computed again. Unlike `stored` this creates no files in Hadoop's file system, which
    without its native library starts a process for the mode of each one."""
    # the literal tells its plan from that of an earlier call: Spark takes equal plans over the same paths for the same
    # rows, also when the files have changed
    out = df.where(F.lit(uuid.uuid4().hex).isNotNull()).persist(StorageLevel.DISK_ONLY)
    out.count()
    return _known(out, None)


def _known(table: DataFrame, path: str | None) -> DataFrame:
    _PATHS[id(table)] = (weakref.ref(table, lambda _, k=id(table): _PATHS.pop(k, None)), path)
    return table


def discard(*tables: DataFrame) -> None:
    """Free the tables that `stored` and `cached` gave and that nothing reads any more."""
    for table in tables:
        _, path = _PATHS.pop(id(table), (None, ""))
        if path:
            drop_path(table.sparkSession, path)
        elif path is None:
            table.unpersist()


def drop_at_end(spark: SparkSession, path: str) -> None:
    """Remove a folder that has been written when the driver ends."""
    files, target = _file_system(spark, path)
    files.deleteOnExit(target)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a work folder through Hadoop's file system."""
    files, target = _file_system(spark, path)
    files.delete(target, True)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """An inner join of `many` with the one row that `one`, a stored or cached table, has for each key; its column `n` says how many
    rows of `many` that is. Keys with more than a task's share of all rows meet theirs by broadcast: there are fewer of
    these than tasks. All others are shuffled."""
    share = (one.agg(F.sum(n)).first()[0] or 0) // partitions(many.sparkSession)
    hot = F.broadcast(one.where(F.col(n) > share).drop(n))
    few = many.join(hot.select(*keys), keys, "left_anti").join(one.where(F.col(n) <= share).drop(n), keys)
    out = many.join(hot, keys)
    return out.unionByName(few.select(*out.columns))


def id_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most parts - 1 ascending split points of an integer column: a range partitioning that needs only that
    column's scan. The list's length is bounded by the number of partitions; empty tables give none."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    found = df.select(F.col(column).cast("double").alias("v")).approxQuantile("v", at, 0.2 / parts)
    return sorted({int(x) for x in found})


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that `df` does not have, whatever its own are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
