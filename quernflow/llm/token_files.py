"""Operator 6: token files coded with a static range asymmetric numeral system.

Documents are encoded, each with its end id, brought into ascending doc_id order by ranges, and written as segments.
A segment is self-contained binary: one frequency table that all its blocks share, the documents' ids and lengths, and
independent blocks. A block's tokens are dealt over interleaved lanes, each a 64-bit coder state that sheds 32-bit
words; its directory entry (byte offset, tokens, lanes, CRC-32) is a checkpoint from which that block is decoded alone,
in parallel with all others. Files are written and read by Spark, so any shared file system holds them.

Defined cases: null and empty texts hold the end id alone; a very long text stays whole in one segment, over as many
blocks as it needs; repeated doc_ids stay as many documents, in order of their ids' bytes; a null doc_id sorts first; an
empty table gives no rows; other columns are ignored, whatever their names. An end id is an unsigned 32-bit number,
others are refused; symbols in a segment may be any such numbers, 2**19 distinct ones at most.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, drop_at_end, id_bounds, partitions, work_path
from .wordbpe import encoder, spans

MAGIC = b"QFR1"
#: Bits of the frequency scale, the lower bound of a coder state, and lanes of a block.
SCALE, LOW, LANES = 20, np.uint64(1 << 31), 2048
#: Tokens of a segment before it is closed, and of a block.
SEGMENT, BLOCK = 2_000_000, 500_000
_HEAD = struct.Struct("<4sIQI")  # magic, table entries, documents, blocks
_ENTRY = struct.Struct("<QIIIII")  # offset, tokens, lanes, words, crc of the body, reserved


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE, at least one for every symbol that occurs."""
    total = 1 << SCALE
    seen = np.flatnonzero(counts)
    if len(seen) > total // 2:
        raise ValueError("too many symbols for the frequency scale")
    share = np.maximum(1, counts[seen] * (total / counts.sum())).astype(np.int64)
    excess = int(share.sum()) - total
    while excess:
        if excess < 0:
            share[np.argmax(share)] -= excess
            break
        order = np.argsort(-share, kind="stable")
        room = np.maximum(share[order] - 1, 0)
        take = np.minimum(room, np.maximum(1, excess * share[order] // total + 1))
        take = np.minimum(take, np.maximum(0, excess - (np.cumsum(take) - take)))
        share[order] -= take
        excess -= int(take.sum())
    out = np.zeros(len(counts), np.int64)
    out[seen] = share
    return out


def encode_block(ids: np.ndarray, freq: np.ndarray, low: np.ndarray) -> tuple[bytes, int, int]:
    """Body of a block (lane states, then words in reading order), its lanes and words."""
    n = len(ids)
    lanes = int(min(LANES, max(1, n // 128)))
    state = np.full(lanes, LOW, np.uint64)
    f_all, c_all = freq[ids], low[ids]
    words: list[np.ndarray] = []
    limit_shift, scale, w = np.uint64(63 - SCALE), np.uint64(SCALE), np.uint64(32)
    for a in range((n - 1) // lanes * lanes, -1, -lanes):
        f, c = f_all[a : a + lanes], c_all[a : a + lanes]
        x = state[: len(f)]
        shed = x >= (f << limit_shift)
        if shed.any():
            words.append(x[shed].astype("<u4"))
            x = np.where(shed, x >> w, x)
        q = x // f
        state[: len(f)] = (q << scale) + (x - q * f) + c
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    return state.astype("<u8").tobytes() + stream.tobytes(), lanes, len(stream)


def decode_block(body: bytes, n: int, lanes: int, freq: np.ndarray, low: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    state = np.frombuffer(body, "<u8", lanes).astype(np.uint64)
    words = np.frombuffer(body, "<u4", -1, 8 * lanes).astype(np.uint64)
    out, at = np.empty(n, np.uint32), 0
    mask, scale, w = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    for a in range(0, n, lanes):
        x = state[: min(lanes, n - a)]
        slot = x & mask
        got = symbol[slot.astype(np.int64)]
        out[a : a + len(x)] = got
        x = freq[got] * (x >> scale) + slot - low[got]
        need = x < LOW
        k = int(np.count_nonzero(need))
        if k:
            x[need] = (x[need] << w) | words[at : at + k]
            at += k
        state[: len(x)] = x
    if at != len(words) or (state != LOW).any():
        raise ValueError("a block's coder states do not close")
    return out


def write_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment's bytes. Null doc_ids are flagged in the length's lowest bit."""
    if ids.max(initial=0) < 1 << 24:
        counts = np.bincount(ids)
        used = np.flatnonzero(counts)
        place = np.zeros(len(counts), np.int64)
        place[used] = np.arange(len(used))
        ids, counts = place[ids], counts[used]
    else:
        used, ids, counts = np.unique(ids, return_inverse=True, return_counts=True)
    # from here on a symbol is its place among those that occur
    freq = scaled(counts)
    low = (np.cumsum(freq) - freq).astype(np.uint64)
    freq = freq.astype(np.uint64)
    known = np.array([d is not None for d in doc_ids])
    index = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + (lengths.astype("<u8") << np.uint64(1) | ~known).astype("<u8").tobytes()
    table = np.r_[used, freq.astype(np.int64)].astype("<u4").tobytes()
    entries, bodies, at = [], [], 0
    for a in range(0, len(ids), BLOCK):
        part = ids[a : a + BLOCK]
        body, lanes, words = encode_block(part, freq, low)
        entries.append(_ENTRY.pack(at, len(part), lanes, words, zlib.crc32(body), 0))
        bodies.append(body)
        at += len(body)
    meta = zlib.compress(table + index, 1)
    head = _HEAD.pack(MAGIC, len(used), len(doc_ids), len(bodies)) + struct.pack("<II", len(meta), zlib.crc32(meta))
    return b"".join([head, meta, *entries, *bodies])


class Segment:
    """A reader of one segment; blocks can be decoded in any order."""

    def __init__(self, data: bytes):
        magic, used, docs, blocks = _HEAD.unpack_from(data)
        size, crc = struct.unpack_from("<II", data, _HEAD.size)
        at = _HEAD.size + 8
        meta = data[at : at + size]
        if magic != MAGIC or zlib.crc32(meta) != crc:
            raise ValueError("not a token segment, or its header is damaged")
        meta = zlib.decompress(meta)
        pair = np.frombuffer(meta, "<u4", 2 * used)
        self.symbols, share = pair[:used].astype(np.uint32), pair[used:]
        self.freq = share.astype(np.uint64)
        self.low = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(used, dtype=np.uint32), share)
        ids = np.frombuffer(meta, "<i8", docs, 8 * used)
        packed = np.frombuffer(meta, "<u8", docs, 8 * used + 8 * docs)
        self.lengths = (packed >> np.uint64(1)).astype(np.int64)
        self.doc_ids = [None if p & 1 else d for d, p in zip(ids.tolist(), packed.tolist(), strict=True)]
        at += size
        self.entries = [_ENTRY.unpack_from(data, at + i * _ENTRY.size) for i in range(blocks)]
        self.data, self.base = data, at + blocks * _ENTRY.size

    def block(self, i: int) -> np.ndarray:
        at, n, lanes, words, crc, _ = self.entries[i]
        body = self.data[self.base + at : self.base + at + 8 * lanes + 4 * words]
        if zlib.crc32(body) != crc:
            raise ValueError(f"block {i} is damaged")
        return self.symbols[decode_block(body, n, lanes, self.freq, self.low, self.symbol)]

    def tokens(self) -> np.ndarray:
        parts = [self.block(i) for i in range(len(self.entries))]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write the token files of a table. Rows of the files: shard (ascending ranges of doc_id), segment (ascending in
    the shard), start (ids of the shard before it), n_docs, n_tokens, data. Range bounds come from a scan of the id column alone; ids then travel
    in one exchange, as 16-bit numbers where the vocabulary and the end id allow it and as 32-bit ones elsewhere, to the
    task of their range's number; a task holds one segment at a time."""
    if not 0 <= end_id < 1 << 32:
        raise ValueError("end_id must be an unsigned 32-bit number")
    spark = docs.sparkSession
    bound_batches(spark)
    width = 2 if max(encoder(tokenizer).size, end_id + 1) <= 1 << 16 else 4
    kind = f"<u{width}"
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = partitions(spark)
    bounds = id_bounds(rows, "doc_id", parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, offsets = bpe.encode_array(batch.column(1))
            out = np.full(len(ids) + batch.num_rows, end_id, kind)
            out[spans(offsets[:-1] + np.arange(batch.num_rows), np.diff(offsets))] = ids
            at = (offsets + np.arange(len(offsets))).tolist()
            raw = memoryview(out.tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([0 if d is None else bisect_right(bounds, d) for d in batch.column(0).to_pylist()], pa.int32()),
                    batch.column(0),
                    pa.array([bytes(raw[width * a : width * b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                ],
                names=["shard", "doc_id", "ids"],
            )

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, start, doc_ids, held, size = None, 0, 0, [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), kind).astype(np.int64)
            lengths = np.fromiter((len(x) // width for x in held), np.int64, len(held))
            data = write_segment(doc_ids, lengths, ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), *(pa.array([x], pa.int64()) for x in (start, len(held), len(ids))), pa.array([data], pa.binary())],
                names=["shard", "segment", "start", "n_docs", "n_tokens", "data"],
            )

        for batch in batches:
            for s, d, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (s != shard or size >= SEGMENT):
                    yield close()
                    number, start = (number + 1, start + size) if s == shard else (0, 0)
                    doc_ids, held, size = [], [], 0
                shard = s
                doc_ids.append(d)
                held.append(x)
                size += len(x) // width
        if held:
            yield close()

    encoded = rows.mapInArrow(encode, "shard int, doc_id bigint, ids binary")
    ordered = encoded.repartitionById(parts, "shard").sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "ids")
    ordered.mapInArrow(code, "shard int, segment int, start bigint, n_docs bigint, n_tokens bigint, data binary").write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of token files: doc_id, start (ids of all documents before it), n_tokens, ids (unsigned 32-bit)."""
    bound_batches(spark)
    files = spark.read.schema("shard int, segment int, start bigint, n_docs bigint, n_tokens bigint, data binary").parquet(path)
    # one number for each shard, of which there are no more than shuffle partitions
    sizes = {r.shard: r.n for r in files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}
    before, total = [], 0
    for shard in sorted(sizes):
        before.append((shard, total))
        total += sizes[shard]
    bases = F.broadcast(spark.createDataFrame(before, "shard int, base bigint"))
    segments = files.join(bases, "shard").select((F.col("base") + F.col("start")).alias("start"), "data")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                segment = Segment(data)
                raw = memoryview(segment.tokens().astype("<u4").tobytes())
                ends = np.cumsum(segment.lengths)
                begin = ends - segment.lengths
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(segment.doc_ids, pa.int64()),
                        pa.array(begin + start),
                        pa.array(segment.lengths),
                        pa.array([bytes(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return segments.mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def token_files(docs: DataFrame, tokenizer: str, *, end_id: int = 1) -> DataFrame:
    """Write a table's token files below the shared folder and read them back; they go when the driver ends."""
    path = work_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id=end_id)
    drop_at_end(docs.sparkSession, path)
    return read_tokens(docs.sparkSession, path)
