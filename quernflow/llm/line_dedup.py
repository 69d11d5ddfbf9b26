"""Operator 7: line dedup by range-partitioned hashes, secondary sort and keep bitmaps.

Every line's key (stripped, A-Z lower-cased) of at least `min_chars` code points becomes a 128-bit hash. Hashes are
partitioned by ranges of (hash, document, position) and sorted so that the largest document of a hash comes first; a
task streams through them, lets a hash's first document pass and marks the lines of the others once `min_docs`
documents are seen. A hash that holds a large share of all lines spreads over several ranges: the run that opens a
task, and one that ends it undecided, stay open until the counts of those ranges are added up. What is returned are
compressed keep bitmaps per document, not texts; `apply_bitmaps` puts them into effect.

Defined cases: null and empty texts are one empty line; rows that share a doc_id count as one document and are told
apart by their texts, repeated rows lose the same lines; all lines of the largest doc_id that holds a key stay; very long
texts are split whole, and a task holds at most `HELD` undecided lines; a null doc_id counts as the smallest document; an
empty table gives no rows; extra columns pass through `apply_bitmaps` unchanged, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, bound_batches, cached, discard, fresh, lower_ascii, partitions

MIN_CHARS, MIN_DOCS = 40, 5
#: Lines of an undecided run that a task holds before it leaves them to the counts of all tasks.
HELD = 200_000
_LEAST = -(1 << 63)
_MARKS = "h1 bigint, h2 bigint, doc bigint, row bigint, pos int, n_lines int, n_docs int, open boolean"
_SCHEMA = pa.schema([(n, pa.bool_() if n == "open" else pa.int32() if n in ("pos", "n_lines", "n_docs") else pa.int64()) for n in "h1 h2 doc row pos n_lines n_docs open".split()])


def _text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def _doc(col: str) -> Column:
    return F.coalesce(F.col(col).cast("bigint"), F.lit(_LEAST).cast("bigint"))


def hashed_lines(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """h1, h2, doc, row (hash of the text), pos, n_lines of every line that is long enough. JVM only."""
    text = _text(text_col)
    rows = docs.select(_doc(id_col).alias("doc"), F.split(text, "\n", -1).alias("lines"), F.xxhash64(text).alias("row"))
    lines = rows.select("doc", "row", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    keyed = lines.select("doc", "row", "n_lines", "pos", lower_ascii(F.btrim("line", F.lit(BLANKS))).alias("key"))
    return keyed.where(F.length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc", "row", "pos", "n_lines"
    )


class Marks:
    """Marks of one task's lines, which come sorted by hash, document downwards and position, a batch at a time. A mark
    is a line to drop; open marks belong to a run that may go on in another task, or whose undecided lines are more than
    `most`: those are decided by the counts of all tasks. A marker (pos -1) stands for a run's first document, or, with
    n_docs, tells that a run is already decided."""

    def __init__(self, min_docs: int, most: int = HELD):
        self.min_docs, self.most = min_docs, most
        self.key: tuple[int, int] | None = None  # the run at the end of what was read
        self.first = True  # it is the task's first one
        self.leader = self.last = self.docs = 0
        self.held: list[list[np.ndarray]] = []
        self.spilled = False

    def _out(self, cols: list[np.ndarray], open_: bool) -> pa.RecordBatch:
        n = len(cols[0])
        return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, open_))], schema=_SCHEMA)

    def _marker(self, n_docs: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, (*self.key, self.leader, 0, -1, 0, n_docs, True), strict=True))], schema=_SCHEMA)

    def _release(self, open_: bool) -> Iterator[pa.RecordBatch]:
        for cols in self.held:
            yield self._out(cols, open_)
        self.held = []

    def add(self, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """cols: h1, h2, doc, row, pos, n_lines."""
        h1, h2, doc = cols[:3]
        n = len(h1)
        if not n:
            return
        goes_on = self.key == (int(h1[0]), int(h2[0]))
        new_run = np.r_[not goes_on, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        new_doc = new_run | np.r_[goes_on and int(doc[0]) != self.last, doc[1:] != doc[:-1]]
        starts = np.flatnonzero(new_run) if not goes_on else np.r_[0, np.flatnonzero(new_run)]
        run = np.searchsorted(starts, np.arange(n), "right") - 1
        ends = np.r_[starts[1:], n]
        seen = np.r_[0, np.cumsum(new_doc)]
        docs = seen[ends] - seen[starts]
        leader = doc[starts].copy()
        if goes_on:
            docs[0] += self.docs
            leader[0] = self.leader
        other = doc != leader[run]
        at = 0
        if goes_on and (self.first or self.spilled):  # decided by all tasks together
            pick = np.ones(ends[0], bool) if self.first else other[: ends[0]]
            yield self._out([c[: ends[0]][pick] for c in cols], True)
            at = 1
        elif self.key is None:
            yield self._out([c[: ends[0]] for c in cols], True)
            at = 1
        elif goes_on and docs[0] >= self.min_docs:
            yield from self._release(False)
        last = len(starts) - 1
        if last > 0 or not goes_on:  # another run ends the batch
            self.held, self.spilled, self.first = [], False, self.key is None and last == 0
        self.key, self.leader, self.last, self.docs = (int(h1[-1]), int(h2[-1])), int(leader[-1]), int(doc[-1]), int(docs[-1])
        sure = other & (run >= at) & (docs >= self.min_docs)[run]
        if sure.any():
            yield self._out([c[sure] for c in cols], False)
        if last >= at and docs[-1] < self.min_docs:
            wait = slice(int(starts[-1]), n)
            self.held.append([c[wait][other[wait]] for c in cols])
            if sum(len(x[0]) for x in self.held) > self.most:
                yield self._marker(0)
                yield from self._release(True)
                self.spilled = True

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.key is None or self.first or self.spilled:
            return
        yield from self._release(True)
        yield self._marker(self.docs if self.docs >= self.min_docs else 0)


def drop_marks(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, row, pos, n_lines of every line to drop. Texts are split and hashed once: the ranges' bounds are sampled
    from the kept hashes. Neither these nor the marks become files, so no task starts processes for them."""
    parts = partitions(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(min_docs)
        for batch in batches:
            yield from marks.add([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        yield from marks.end()

    lines = cached(hashed_lines(docs, min_chars, id_col, text_col))
    ordered = lines.repartitionByRange(parts, "h1", "h2", F.desc("doc"), "pos", "row").sortWithinPartitions("h1", "h2", F.desc("doc"), "pos", "row")
    marks = cached(ordered.mapInArrow(run, _MARKS))
    discard(lines)
    opened = marks.where("open")
    by_doc = opened.groupBy("h1", "h2", "doc").agg(F.max("n_docs").alias("n"))
    runs = by_doc.groupBy("h1", "h2").agg(
        (F.sum(F.when(F.col("n") > 0, F.col("n")).otherwise(1)) >= min_docs).alias("many"), F.max("doc").alias("leader")
    )  # at most two hashes a task, and one for each HELD lines
    late = opened.where("pos >= 0").join(F.broadcast(runs), ["h1", "h2"]).where("many and doc <> leader")
    cols = ["doc", "row", "pos", "n_lines"]
    return marks.where("not open").select(cols).unionByName(late.select(cols))


def keep_bitmaps(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, row, n_dropped and keep (zlib of a bit for each line, set where it stays) of every document that loses
    lines; all other documents keep all of theirs."""
    marks = drop_marks(docs, min_chars=min_chars, min_docs=min_docs, id_col=id_col, text_col=text_col)
    grouped = marks.groupBy("doc", "row").agg(F.collect_set("pos").alias("drop"), F.max("n_lines").alias("n_lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drops, maps = batch.column(2), []
            for drop, n in zip(drops, batch.column(3).to_pylist(), strict=True):
                keep = np.ones(n, bool)
                keep[drop.values.to_numpy()] = False
                maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), drops.value_lengths().cast(pa.int64()), pa.array(maps, pa.binary())], names=["doc", "row", "n_dropped", "keep"]
            )

    return grouped.mapInArrow(run, "doc bigint, row bigint, n_dropped bigint, keep binary")


def kept_lines(text: str, keep: bytes) -> str:
    """The lines of a text whose bits are set."""
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join([x for x, b in zip(lines, bits.tolist(), strict=True) if b])


def _kept(text: pa.Array, keep: pa.Array) -> pa.Array:
    return pa.array((None if k is None else kept_lines(t, k) for t, k in zip(text.to_pylist(), keep.to_pylist(), strict=True)), pa.string())


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str, str]:
    """`docs` with the kept text in place of the text, and two columns more, whose names are returned: the lines
    before dropping and the lines dropped."""
    bound_batches(docs.sparkSession)
    n_lines, n_dropped, keep, doc, row = fresh(docs, "n_lines", "n_dropped", "keep", "doc", "row")
    maps = bitmaps.select(F.col("doc").alias(doc), F.col("row").alias(row), F.col("keep").alias(keep), F.col("n_dropped").alias(n_dropped))
    text, kept = _text(text_col), F.arrow_udf(_kept, "string")
    keyed = docs.withColumns({doc: _doc(id_col), row: F.xxhash64(text)})
    joined = keyed.join(maps, [doc, row], "left")
    out = joined.select(
        *[F.when(F.col(keep).isNull(), F.col(c)).otherwise(kept(F.when(F.col(keep).isNotNull(), text), F.col(keep))).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.size(F.split(text, "\n", -1)).cast("bigint").alias(n_lines),
        F.coalesce(F.col(n_dropped), F.lit(0).cast("bigint")).alias(n_dropped),
    )
    return out, n_lines, n_dropped


def dedup_lines(docs: DataFrame, **options) -> tuple[DataFrame, str, str]:
    """`docs` without the lines that repeat over documents; see `apply_bitmaps`."""
    keys = {k: options[k] for k in ("id_col", "text_col") if k in options}
    return apply_bitmaps(docs, keep_bitmaps(docs, **options), **keys)
