"""Operator 2: exact top-k search with block-at-a-time pruning.

Vectors are integer documents whose terms are their dimensions. Rows are dealt evenly over shards. A shard brings its
documents into an order that keeps alike ones together (halves along the dimension that varies most, down to blocks);
each range of `block` documents has a forward index (its own matrix) and, per term, the largest and smallest value. For
a query the blocks are ordered by the sum of the best each term can give there; blocks are scored through their forward
indexes in this order until the bounds fall below the k-th score found. A bound equal to it is still scored, so ties go
to the smaller id exactly. How many are scored depends on the vectors: on ones without structure nearly all
(`scored_share`; README has figures).

Queries are sent to every shard, packed; a task holds one shard and one batch of queries. The k best of each shard are
merged in Spark.

Defined cases: vectors that are null, or hold a null or a non-finite component, take no part; empty vectors score zero;
shorter vectors count as padded with zeros, however long others are; ids may repeat: each such row is a candidate and a
query of its own, with k results, and a query never gets its own id; an empty table gives no rows; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, partitions

#: Results of a query, documents of a block, and of a shard at least if there are enough tasks.
K, BLOCK, LEAST, SCALE = 10, 2, 4096, 1024
#: Components of a shard's vectors (64 MB, and as much again for bounds): queries meet every shard, so few wide ones.
SHARD_VALUES = 1 << 23
#: Documents scored together at first; twice as many each time.
STEP = 256


def clustered(rows: np.ndarray, block: int) -> np.ndarray:
    """An order of rows in which blocks hold alike ones: parts are halved at the median of their widest dimension."""
    out, parts = [], [np.arange(len(rows))]
    while parts:
        part = parts.pop()
        if len(part) <= block:
            out.append(part)
            continue
        spread = rows[part].var(axis=0)
        half = -(-len(part) // (2 * block)) * block  # whole blocks on the left
        order = part[np.argsort(rows[part, int(spread.argmax())], kind="stable")] if len(spread) else part
        parts += [order[half:], order[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Shard:
    """Blocks of one range of documents. `scored` counts the documents scored, over all queries."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, block: int = BLOCK):
        order = clustered(rows, block)
        self.ids, self.rows, self.block = ids[order], rows[order], block
        starts = np.arange(0, len(ids), block)
        self.top = np.maximum.reduceat(self.rows, starts, axis=0)
        self.low = np.minimum.reduceat(self.rows, starts, axis=0)
        self.scored = 0

    def search(self, own: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per query the ids and scores of its k best."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        bounds = up @ self.top.T + down @ self.low.T
        for q, me, bound in zip(queries, own, bounds, strict=True):
            order = np.argsort(-bound, kind="stable")
            fall = -bound[order]
            best_ids, best = self.ids[:0], self.rows[:0, 0] if self.rows.shape[1] else np.zeros(0)
            a, step = 0, max(1, STEP // self.block)
            while a < len(order):
                end = min(len(order), a + step)
                if len(best) == k:
                    end = min(end, int(np.searchsorted(fall, -best[-1], "right")))
                if end <= a:
                    break
                at = (order[a:end, None] * self.block + np.arange(self.block)).ravel()
                at = at[at < len(self.ids)]
                self.scored += len(at)
                score, ids = self.rows[at] @ q, self.ids[at]
                fair = ids != me
                if len(best) == k:
                    fair &= score >= best[-1]
                score, ids = np.r_[best, score[fair]], np.r_[best_ids, ids[fair]]
                pick = np.lexsort((ids, -score))[:k]
                best_ids, best = ids[pick], score[pick]
                a, step = end, 2 * step
            yield best_ids, best


def scored_share(ids: np.ndarray, rows: np.ndarray, own: np.ndarray, queries: np.ndarray, k: int = K, block: int = BLOCK) -> float:
    """The share of documents that a shard scores for queries on average."""
    index = Shard(ids, rows, block)
    for _ in index.search(own, queries, k):
        pass
    return index.scored / max(1, len(ids) * len(queries))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer vectors as rows, padded with zeros; floats where their products stay exact, for the sake of BLAS."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def search(vectors: DataFrame, queries: DataFrame, *, k: int = K, shard: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best among `vectors`. Scores are 64-bit integers. `shard`: rows
    of a shard, by default as many as have SHARD_VALUES components."""
    spark = vectors.sparkSession
    bound_batches(spark)

    def whole(df: DataFrame) -> DataFrame:
        v = F.col(vec_col)
        good = v.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return df.where(good).select(F.col(id_col).cast("bigint").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))

    docs, asked = whole(vectors), whole(queries)
    size = docs.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
    wide = asked.agg(F.max(F.size("v")).alias("w")).first().w or 0
    width = max(1, size.w or 0, wide)
    shard = shard or max(1, SHARD_VALUES // width)
    shards = max(1, -(-size.n // shard), min(partitions(spark), -(-size.n // LEAST)))
    # a row's number in its file deals it, so equal ids and vectors spread too; numbered again, a row keeps its number
    number = F.monotonically_increasing_id()
    none = F.lit(None).cast("bigint")
    placed = docs.select(F.pmod(F.xxhash64(number), F.lit(shards)).cast("int").alias("shard"), none.alias("asked"), "id", "v")
    sent = asked.select(number.alias("asked"), "id", "v").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "asked", "id", "v")
    both = placed.unionByName(sent).repartition(shards, "shard").sortWithinPartitions("shard", F.asc_nulls_first("asked"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        for batch in batches:
            shards = batch.column(0).to_numpy()
            asks = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])) + 1
            edges = [0, *cut.tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if shards[a] != at:
                    at, held, index = shards[a], [], None
                part = batch.slice(a, b - a)
                ids, rows = part.column(2).to_numpy(), _matrix(part.column(3), width)
                if not asks[a]:
                    held.append((ids, rows))
                    continue
                if not held:
                    continue
                if index is None:
                    ids_, rows_ = (np.concatenate(x) for x in zip(*held, strict=True))
                    peak = max(int(np.abs(rows_).max(initial=0)), int(np.abs(rows).max(initial=0)))
                    index = Shard(ids_, rows_)
                    exact = peak * peak * width < 1 << 52
                if exact and int(np.abs(rows).max(initial=0)) * max(1, peak) * width < 1 << 52:
                    index.rows, index.top, index.low, rows = (x.astype(np.float64, copy=False) for x in (index.rows, index.top, index.low, rows))
                else:
                    index.rows, index.top, index.low, rows = (x.astype(np.int64, copy=False) for x in (index.rows, index.top, index.low, rows))
                out = list(index.search(ids, rows, k))
                of = np.repeat(np.arange(len(out)), [len(i) for i, _ in out])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part.column(1).to_numpy()[of]),
                        pa.array(ids[of]),
                        pa.array(np.concatenate([i for i, _ in out]).astype(np.int64)),
                        pa.array(np.concatenate([s for _, s in out]).astype(np.int64)),
                    ],
                    names=["asked", "query_id", "vec_id", "score"],
                )

    found = both.mapInArrow(run, "asked bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
