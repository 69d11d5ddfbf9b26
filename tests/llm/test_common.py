"""What the corpus operators share."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from quernflow.llm import common


class Conf:
    def __init__(self, got):
        self.got = got

    def get(self, *_):
        return self.got


class Session:
    def __init__(self, master, got=None):
        self.conf = Conf(None)
        self.sparkContext = type("Context", (), {"master": master, "getConf": lambda _: Conf(got)})()


def test_shared_folder_is_needed_on_clusters():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(Session(master))
    assert common.shared_dir(Session("local[4]")).startswith("file:///tmp/")
    assert common.shared_dir(Session("yarn", "hdfs://c/shared/")) == "hdfs://c/shared"


def test_stored_tables_can_be_removed(spark):
    table = common.stored(spark.range(10).toDF("a"), "some")
    path = table.inputFiles()[0].rsplit("/", 1)[0]
    assert table.count() == 10 and path.startswith(common.shared_dir(spark).replace("file:///", "file:/").replace("file:/", "file:///"))
    common.discard(table)
    files, target = common._file_system(spark, path)
    assert not files.exists(target)
    common.discard(table)  # nothing happens


def test_words_and_lower_case(spark):
    texts = [None, "", "  ", "A b\tC\x0bd\x0ce\rf\n g", "É À ñ ÀB İ K", "x\x1cy\x85z", "Z" * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", common.words_of(F.col("t")).alias("w"), common.lower_ascii(F.col("t")).alias("l")).collect()
    for r in rows:
        t = texts[r.i]
        assert r.w == (None if t is None else [x for x in t.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if x])
        assert r.l == (None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))


def test_cached_tables(spark, tmp_path):
    """Kept without files until they are discarded, and an equal plan over changed files has the new rows."""
    path = str(tmp_path / "t.parquet")
    pq.write_table(pa.table({"id": range(10)}), path)
    first = common.cached(spark.read.parquet(path))
    assert first.storageLevel.useDisk and not first.storageLevel.useMemory and not [f for f in first.inputFiles() if common.shared_dir(spark) in f]
    pq.write_table(pa.table({"id": range(20)}), path)
    assert first.count() == 10
    second = common.cached(spark.read.parquet(path))
    assert second.count() == 20
    common.discard(first, second)
    assert not first.storageLevel.useDisk and not second.storageLevel.useDisk
    mine = spark.range(3).persist()
    common.discard(mine)  # not its own
    assert mine.storageLevel.useDisk
    mine.unpersist()
