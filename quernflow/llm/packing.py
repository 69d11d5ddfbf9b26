"""Operator 8: packing by power-of-two decomposition.

A document of n tokens (its ids and one end id) is cut into as many whole sequences of `length` as fit and into the
powers of two of the rest. Every piece is a sequence of its own and its length is a power of two, so nothing is padded
and no sequence crosses documents. Equal lengths share a bucket: a sequence number's highest bits are its bucket, the
longest first, then come the task and a running number of that bucket in the task, so the numbers of a bucket are one
range, gapless within a task, and sorting by them sorts by bucket. `write_buckets` lays each bucket in a folder of its
own, from which batches of one length are read; `read_bucket` reads one.

Defined cases: null and empty texts give the end id alone, one piece of length 1; very long texts give many whole
sequences, in order; repeated rows are packed each on their own; a null id stays null; an empty table gives no rows;
other columns are ignored, whatever their names. An end id is an unsigned 32-bit number, others are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches
from .wordbpe import encoder, spans

#: Bits of a running number and of a task's partition in a sequence number; the bucket stands above them.
RUN_BITS, TASK_BITS = 33, 24


def cut_powers(totals: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and size of every piece, in order: whole sequences first, then falling powers of two."""
    bits = length.bit_length() - 1
    whole = totals // length
    rest = totals % length
    sizes = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
    has = (rest[:, None] & sizes[None, :]) != 0
    rows = np.r_[np.repeat(np.arange(len(totals)), whole), np.nonzero(has)[0]]
    size = np.r_[np.full(int(whole.sum()), length, np.int64), np.broadcast_to(sizes, has.shape)[has]]
    order = np.lexsort((-size, rows))
    rows, size = rows[order], size[order]
    before = np.cumsum(size) - size
    base = np.r_[0, np.cumsum(totals)][rows]
    return rows, before - base, size


def pack_documents(
    docs: DataFrame, tokenizer: str, *, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, bucket (the binary
    logarithm of the length), sequence_id, offset. A sequence number holds the bucket, the input partition and a running
    number, so a task that runs again gives the same ones. No row is shuffled. `length` is a power of two, 2 to 2**32."""
    if not 2 <= length <= 1 << 32 or length & (length - 1):
        raise ValueError("length must be a power of two, 2 to 2**32")
    if not 0 <= end_id < 1 << 32:
        raise ValueError("end_id must be an unsigned 32-bit number")
    top = length.bit_length() - 1
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe = encoder(tokenizer)
        task = TaskContext.get().partitionId()
        if task >> TASK_BITS:
            raise ValueError(f"more than 2**{TASK_BITS} input partitions")
        run = np.zeros(top + 1, np.int64)  # pieces so far, by bucket
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, offsets = bpe.encode_array(batch.column(1))
            ends = offsets[1:] + np.arange(1, len(offsets))
            whole = np.full(int(ends[-1]), end_id, "<u4")
            whole[spans(offsets[:-1] - offsets[0] + np.arange(len(offsets) - 1), np.diff(offsets))] = ids
            totals = np.diff(offsets) + 1
            rows, start, size = cut_powers(totals, length)
            at = (np.cumsum(totals) - totals)[rows] + start
            bucket = np.log2(size).astype(np.int64)
            order = np.argsort(-bucket, kind="stable")
            of = bucket[order]
            more = np.bincount(of, minlength=top + 1)
            place = np.empty(len(size), np.int64)  # among the pieces of its bucket
            place[order] = run[of] + np.arange(len(of)) - (np.cumsum(more[::-1]) - more[::-1])[::-1][of]
            run += more
            sequence = (((top - bucket) << TASK_BITS | task) << RUN_BITS) + place
            raw = memoryview(whole.tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)),
                    pa.array(start),
                    pa.array(size),
                    pa.array([bytes(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), size.tolist(), strict=True)], pa.binary()),
                    pa.array(totals[rows]),
                    pa.array(bucket.astype(np.int32)),
                    pa.array(sequence),
                    pa.array(np.zeros(len(size), np.int64)),
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "bucket", "sequence_id", "offset"],
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        run, "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, bucket int, sequence_id bigint, offset bigint"
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write packed pieces by bucket: one folder for each piece length, without an exchange."""
    pieces.write.partitionBy("bucket").parquet(path)


def read_bucket(spark: SparkSession, path: str, size: int) -> DataFrame:
    """The sequences of one length: no other bucket's files are read."""
    return spark.read.parquet(path).where(F.col("bucket") == size.bit_length() - 1)
