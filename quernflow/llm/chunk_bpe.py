"""Operator 4: BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes of a text cuts it into chunks; the same passage gives the same chunks in any document.
Chunk hashes are counted over the whole table. Those that occur more than once are shared: each is encoded once in the
whole cluster, by the task that its hash falls to, and its ids meet every document that holds it by a join. What no other
text holds is encoded where it lies, so a document without shared chunks is never shuffled, and of the others only ids and
one copy of each shared chunk a task are. Tasks tell shared chunks by a bit filter of fixed size; a chunk that it takes for
shared by chance just goes the same way.

An encoded chunk keeps the ids between its first and last white space, and its two rims as text. Where chunks join, the
last rim of one and the first rim of the next are encoded again as one piece, widened over whole chunks until the piece
begins and ends at white space: the vocabulary drops white space before it merges, so there both sides agree with the
encoding of the whole text, and the result is exact.

Defined cases: null and empty texts give no ids and an empty decoded text; very long texts are many chunks, a text without
white space is one piece; repeated rows each give a row and share all their chunks; an empty table gives no rows; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, partitions, spread_join, stored
from .wordbpe import _BLANK, _KINDS, WordBPE, encoder, spans

#: Mean bytes of a chunk (a power of two), its least and greatest size.
MEAN, LEAST, MOST = 1024, 64, 16384
#: Bytes of ids that are gathered before the joints of their texts are encoded together.
JOIN_BYTES = 1 << 21
#: Bits of the filter of shared chunks that tasks get (4 MB).
FILTER_BITS = 1 << 25


def _gear() -> np.ndarray:
    """A 32-bit value for each byte, from the SplitMix64 finalizer's rule."""
    z = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(32)).astype(np.uint32)


_GEAR = _gear()
_PARTS = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int64()), ("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())]
    + [(n, pa.binary()) for n in ("chunk", "head", "ids", "tail")]
    + [("blank", pa.bool_())]
)


def chunk_edges(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which chunks begin, and the end. The hash of a position takes in the 32 bytes before it;
    it is built by doubling, five passes in all. No cut falls inside a UTF-8 character or in a text's first bytes."""
    if not len(data):
        return offsets[:1].copy()
    roll = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        shifted = roll[:-step] << np.uint32(step)
        roll[step:] += shifted
    cut = np.flatnonzero((roll[:-1] & np.uint32((MEAN - 1) << 16)) == 0) + 1
    cut = cut[(data[cut] & 0xC0) != 0x80]
    begin = offsets[np.searchsorted(offsets, cut, "right") - 1]
    cut = cut[cut - begin >= LEAST]
    edges = np.unique(np.r_[offsets, cut])
    wide = np.flatnonzero(np.diff(edges) > MOST)
    extra = [np.arange(edges[i] + MOST, edges[i + 1], MOST) for i in wide]
    if extra:
        more = np.concatenate(extra)
        edges = np.unique(np.r_[edges, more[(data[more] & 0xC0) != 0x80]])
    return edges


def cut(texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The chunks of texts and where each text's begin among them."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, raw = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)
    edges = chunk_edges(data[offsets[0] : offsets[-1]], offsets - offsets[0]) + offsets[0]
    view = memoryview(data)
    keys = [bytes(view[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    return keys, np.searchsorted(edges, offsets)


def digests(chunks: list[bytes]) -> np.ndarray:
    """A row of two 64-bit hashes for each chunk."""
    import xxhash

    raw = b"".join(xxhash.xxh3_128_digest(c) for c in chunks)
    return np.frombuffer(raw, ">i8").astype(np.int64).reshape(-1, 2)


#: Of an encoded chunk: its text before the first white space, the ids up to the last one, the text after it, and whether
#: there is any white space (without, all of the text is the first rim).
Entry = tuple[bytes, np.ndarray, bytes, bool]


def encode_chunks(bpe: WordBPE, chunks: list[bytes]) -> list[Entry]:
    if not chunks:
        return []
    sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(chunks), np.uint8)
    blanks = np.flatnonzero(_KINDS[data] == _BLANK)
    lo = np.searchsorted(blanks, ends - sizes)
    hi = np.searchsorted(blanks, ends)
    some = hi > lo
    a, b = ends.copy(), ends.copy()  # the middle is from the first to the last white space
    a[some], b[some] = blanks[lo[some]], blanks[hi[some] - 1]
    middle = data[spans(a, b - a)]
    ids, at = bpe.encode_bytes(middle, np.r_[0, np.cumsum(b - a)])
    raw, begin = data.tobytes(), ends - sizes
    return [
        (raw[s:x], ids[p:q].copy(), raw[y + 1 : e] if w else b"", w)
        for s, x, y, e, p, q, w in zip(begin.tolist(), a.tolist(), b.tolist(), ends.tolist(), at[:-1].tolist(), at[1:].tolist(), some.tolist(), strict=True)
    ]


def join_chunks(bpe: WordBPE, texts: list[list[Entry]]) -> list[np.ndarray]:
    """The ids of texts from their encoded chunks: joints are encoded again, all together."""
    plans, joints = [], []
    for entries in texts:
        plan, rim = [], b""
        for head, ids, tail, blank in entries:
            rim += head
            if not blank:  # no white space in the whole chunk: the piece to repair grows over it
                continue
            if rim:
                plan.append(len(joints))
                joints.append(rim)
            plan.append(ids)
            rim = tail
        if rim:
            plan.append(len(joints))
            joints.append(rim)
        plans.append(plan)
    offsets = np.r_[0, np.cumsum(np.fromiter(map(len, joints), np.int64, len(joints)))]
    ids, at = bpe.encode_bytes(np.frombuffer(b"".join(joints), np.uint8), offsets)
    parts = [[ids[at[x] : at[x + 1]] if isinstance(x, int) else x for x in plan] for plan in plans]
    return [np.concatenate(p).astype("<u4") if p else np.zeros(0, "<u4") for p in parts]


def _result(bpe: WordBPE, doc_ids: pa.Array, rows: list[np.ndarray], chunks: list[int], reused: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            doc_ids, pa.array([len(x) for x in rows], pa.int64()), pa.array([x.tobytes() for x in rows], pa.binary()),
            pa.array([bpe.decode(x.tolist()) for x in rows], pa.string()), pa.array(chunks, pa.int64()), pa.array(reused, pa.int64()),
        ],
        names=["doc_id", "n_tokens", "ids", "decoded", "n_chunks", "n_reused"],
    )


def shared_chunks(rows: DataFrame) -> DataFrame:
    """h1, h2 and n of every chunk hash that occurs more than once in the column text, n times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                h, n = np.unique(digests(cut(batch.column(0))[0]), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(n.astype(np.int64))], names=["h1", "h2", "n"])

    counted = rows.select("text").mapInArrow(run, "h1 bigint, h2 bigint, n bigint")
    return counted.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 1")


def _filter_of(shared: DataFrame) -> np.ndarray:
    """The filter's bits: at most FILTER_BITS / 64 rows come to the driver."""
    slot = F.pmod("h1", F.lit(FILTER_BITS))
    words = shared.groupBy(F.floor(slot / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(slot, F.lit(64)).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def encode_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids (little-endian unsigned 32-bit, as binary) and decoded text of every row, with the chunks that its text was cut
    into and how many of these are shared. Columns: doc_id, n_tokens, ids, decoded, n_chunks, n_reused."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = stored(shared_chunks(rows), "shared-chunks")
    bits = spark.sparkContext.broadcast(_filter_of(shared))

    def look(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """The chunks of a batch, where each text's begin, their hashes, and whether they are shared."""
        keys, first = cut(batch.column(1))
        h = digests(keys)
        slot = np.mod(h[:, 0], FILTER_BITS)
        return keys, first, h, (bits.value[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def texts_with(first: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Whether each text has a shared chunk."""
        before = np.r_[0, np.cumsum(hit)]
        return before[first[1:]] > before[first[:-1]]

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without shared chunks, encoded where they are."""
        bpe = encoder(tokenizer)
        for batch in batches:
            if not batch.num_rows:
                continue
            _, first, _, hit = look(batch)
            mine = np.flatnonzero(~texts_with(first, hit))
            ids, at = bpe.encode_array(batch.column(1).take(pa.array(mine)))
            own = [ids[a:b].astype("<u4") for a, b in zip(at[:-1], at[1:], strict=True)]
            yield _result(bpe, batch.column(0).take(pa.array(mine)), own, np.diff(first)[mine].tolist(), [0] * len(mine))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts with shared chunks, as runs of own chunks, encoded, and references to shared ones. Of a shared chunk the
        batch's first reference has the bytes."""
        from pyspark import TaskContext

        bpe = encoder(tokenizer)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, first, h, hit = look(batch)
            out, runs, sent = [], [], set()
            for i in np.flatnonzero(texts_with(first, hit)).tolist():
                doc, a, end = batch.column(0)[i].as_py(), int(first[i]), int(first[i + 1])
                while a < end:
                    b = a + 1
                    if hit[a]:
                        key = (int(h[a, 0]), int(h[a, 1]))
                        out.append((row + i, doc, a, 1, *key, None if key in sent else keys[a], None, None, None, None))
                        sent.add(key)
                    else:
                        while b < end and not hit[b]:
                            b += 1
                        runs.append((len(out), b"".join(keys[a:b])))
                        out.append((row + i, doc, a, b - a))
                    a = b
            for (at, _), (head, ids, tail, blank) in zip(runs, encode_chunks(bpe, [r for _, r in runs]), strict=True):
                out[at] = (*out[at], None, None, None, head, ids.astype("<u4").tobytes(), tail, blank)
            row += batch.num_rows
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PARTS, strict=True)], schema=_PARTS)

    def encode_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for batch in batches:
            made = encode_chunks(bpe, batch.column(2).to_pylist())
            cols = [pa.array([e[0] for e in made], pa.binary()), pa.array([e[1].astype("<u4").tobytes() for e in made], pa.binary()), pa.array([e[2] for e in made], pa.binary()), pa.array([e[3] for e in made], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *cols], names=["h1", "h2", "refs", "head", "ids", "tail", "blank"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts from their parts, which come sorted by text and place."""
        bpe = encoder(tokenizer)
        at, doc_ids, texts, chunks, reused, size = None, [], [], [], [], 0
        for batch in batches:
            for row, doc, n, own, head, ids, tail, blank in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row != at:
                    if size > JOIN_BYTES:
                        yield _result(bpe, pa.array(doc_ids, pa.int64()), join_chunks(bpe, texts), chunks, reused)
                        doc_ids, texts, chunks, reused, size = [], [], [], [], 0
                    at = row
                    doc_ids.append(doc)
                    texts.append([])
                    chunks.append(0)
                    reused.append(0)
                texts[-1].append((head, np.frombuffer(ids, "<u4"), tail, blank))
                chunks[-1] += n
                reused[-1] += not own
                size += len(ids)
        if texts:
            yield _result(bpe, pa.array(doc_ids, pa.int64()), join_chunks(bpe, texts), chunks, reused)

    made = stored(rows.mapInArrow(parts, "row bigint, doc_id bigint, pos bigint, n int, h1 bigint, h2 bigint, chunk binary, head binary, ids binary, tail binary, blank boolean"), "chunk-parts")
    # equal hashes, equal bytes
    whole = made.where("ids is null").groupBy("h1", "h2").agg(F.first("chunk", ignorenulls=True).alias("chunk"), F.count("*").alias("refs"))
    entries = stored(whole.mapInArrow(encode_shared, "h1 bigint, h2 bigint, refs bigint, head binary, ids binary, tail binary, blank boolean"), "shared-entries")
    cols = ["row", "doc_id", "pos", "n", "own", "head", "ids", "tail", "blank"]
    own = made.where("ids is not null").withColumn("own", F.lit(True)).select(cols)
    refs = made.where("ids is null").select("row", "doc_id", "pos", "n", "h1", "h2", F.lit(False).alias("own"))
    discard(shared)
    pieces = own.unionByName(spread_join(refs, entries, ["h1", "h2"], "refs").select(cols))
    n_parts = partitions(spark)
    ordered = pieces.repartition(n_parts, "row").sortWithinPartitions("row", "pos").drop("pos")
    schema = "doc_id bigint, n_tokens bigint, ids binary, decoded string, n_chunks bigint, n_reused bigint"
    return rows.mapInArrow(alone, schema).unionByName(ordered.mapInArrow(join, schema))
