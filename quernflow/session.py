"""Sessions with the settings that the engine's semantics need."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import SparkSession

#: Settings of the dialect; they hold for every session that runs jobs or strict SQL.
DIALECT = {
    "spark.sql.ansi.enabled": "false",  # overflow wraps, division by zero is NULL
    "spark.sql.session.timeZone": "UTC",
}
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.scheduler.mode": "FAIR",
    "spark.hadoop.mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
}


def build_session(app: str = "quernflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the dialect's settings; `conf` keys may use `__` for dots."""
    builder = SparkSession.builder.appName(app).config(map={**TUNING, **DIALECT, **{k.replace("__", "."): v for k, v in conf.items()}})
    if master or "MASTER" in os.environ:
        builder = builder.master(master or os.environ["MASTER"])
    return builder.getOrCreate()


def dialect_session(spark: SparkSession) -> SparkSession:
    """A session of its own views in the same application, with the dialect's settings."""
    session = spark.newSession()
    for k, v in DIALECT.items():
        session.conf.set(k, v)
    return session


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh folder in the one that driver and executors share, spark.checkpoint.dir; it goes when the driver ends. Only
    where the setting is missing and all runs in one process (master local) a folder below /tmp stands in; on a cluster it
    is needed."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file:///tmp/quernflow-shared"
    path = f"{root.rstrip('/')}/quernflow/{label}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(target)
    files.deleteOnExit(target)
    return path
