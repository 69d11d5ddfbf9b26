"""Operator 10: SimHash near-dedup with pivot distance tables.

Fingerprints are 64-bit SimHashes of word shingles. Pairs within `radius` bits are sought among distinct fingerprints
only. A table holds each one's Hamming distances to reference fingerprints (pivots): by the triangle inequality a pair
whose distances to any pivot differ by more than the radius is no link, so the maximum coordinate difference discards
pairs and only the survivors' own distances are taken.

All pairs would be too many for any table, and pivots cannot deal fingerprints to tasks: distances between 64-bit strings
concentrate, so a pivot tells apart about half of the pairs, and cells of pivot distances overlap so much that halving
them copies a third of the rows. Pairs are therefore formed in wide buckets first: the bits are cut into radius + 1
blocks, and two fingerprints within the radius agree on one of them at least. A bucket of more than `bucket` fingerprints
is cut again in the same way on its remaining bits, twice at most, and then dealt over pairs of sub-buckets, so no task
holds more than two of them and no pair goes missing. A bucket gives a spanning forest of its links, not all pairs;
components come from contraction rounds in Spark.

Defined cases: null, empty and wordless texts have fingerprint zero and are linked like any other; very long texts are
hashed whole, their bits counted in stretches; a bit set in exactly half of the shingles (a tie) is not set; a null
doc_id takes part and never names a component unless all ids in it are null; repeated rows each give a row; an empty
table gives no rows; extra columns are ignored by `near_duplicates` and kept by `drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, bound_batches, discard, fresh, partitions, spread_join, stored

WORDS, RADIUS, BUCKET, PIVOTS = 3, 3, 4096, 24
#: Times that crowded buckets are cut again.
DEPTH = 2
_BLANK = str.maketrans("\t\n\x0b\x0c\r" + UPPER, "     " + LOWER)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of word shingles, repeats included: a bit is set if it is in over half of the shingles' hashes."""
    import xxhash

    w = [x for x in (text or "").translate(_BLANK).split(" ") if x]
    if not w:
        return 0
    shingles = map(" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(s, 42) for s in shingles], "<u8"))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    h = h.astype("<u8", copy=False)
    counts = np.zeros(64, np.int64)
    for a in range(0, len(h), 65536):
        counts += np.unpackbits(h[a : a + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (hash of the text) and fp (the fingerprint as a signed 64-bit integer) of every row."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, words) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "row", "fp"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("row"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, row bigint, fp bigint")


def _masks(parts: int, depth: int) -> list[list[int]]:
    """By level, the bits on which a bucket's fingerprints agree: a mask's own bits and one part of those left."""
    levels = [[0]]
    for _ in range(depth + 1):
        out = []
        for m in levels[-1]:
            left = [b for b in range(64) if not m >> b & 1]
            edges = [round(i * len(left) / parts) for i in range(parts + 1)]
            out += [m | sum(1 << b for b in left[i:j]) for i, j in zip(edges, edges[1:], strict=False)]
        levels.append(out)
    return levels[1:]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pivots(n: int) -> np.ndarray:
    """Reference fingerprints: a fixed pseudo-random sequence."""
    z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def forest(group: np.ndarray, fp: np.ndarray, radius: int, pivots: np.ndarray, counts: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within groups (equal neighbours in `group`): each row that is not a root, with
    its root. Rows are compared at growing distance in their group, all groups together; pairs that are already
    connected are passed over. `counts` gathers the pairs before the pivots, after them, and within the radius."""
    seen = [0, 0, 0] if counts is None else counts
    table = np.bitwise_count(fp[:, None] ^ pivots[None, :]).astype(np.int8)
    root = np.arange(len(fp))
    ends = np.searchsorted(group, group, "right")
    live = np.arange(len(fp))
    for step in range(1, len(fp)):
        live = live[live + step < ends[live]]
        if not len(live):
            break
        a, b = live, live + step
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        seen[0] += len(a)
        for p in range(len(pivots)):
            near = np.abs(table[a, p] - table[b, p]) <= radius
            a, b = a[near], b[near]
            if not len(a):
                break
        seen[1] += len(a)
        near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        a, b = a[near], b[near]
        seen[2] += len(a)
        while len(a):
            x, y = root[a], root[b]
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            if not len(a):
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
    child = np.flatnonzero(root != np.arange(len(fp)))
    return child, root[child]


def buckets(prints: DataFrame, radius: int, bucket: int) -> DataFrame:
    """g, fp: the fingerprints (column fp) of each group whose pairs are to be compared."""
    levels = _masks(radius + 1, DEPTH)
    rows, out = prints.select(F.lit(0).alias("t"), F.lit(0).cast("bigint").alias("bits"), "fp"), None
    for level, masks in enumerate(levels):
        finer = F.array(*[F.array(*[F.lit(_signed(m)) for m in masks[i : i + radius + 1]]) for i in range(0, len(masks), radius + 1)])
        each = rows.select("t", "fp", F.posexplode(F.get(finer, F.col("t"))).alias("i", "mask"))
        rows = each.select((F.col("t") * (radius + 1) + F.col("i")).alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("bits"), "fp")
        full = stored(rows.groupBy("t", "bits").count().where(F.col("count") > bucket), "crowded")
        crowded = bool(full.take(1))
        last = level == len(levels) - 1
        if last or not crowded:
            m = F.ceil(F.col("count") / bucket).cast("int")
            rows = rows.join(full, ["t", "bits"], "left") if crowded else rows.withColumn("count", F.lit(None).cast("bigint"))
            dealt = rows.withColumn("m", F.coalesce(m, F.lit(1))).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
            # sub-bucket i meets every j: both sides of a pair of sub-buckets carry the same (smaller, larger)
            spread = dealt.select("t", "bits", "fp", "i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"))
            done = spread.select(F.xxhash64(F.lit(level), "t", "bits", F.least("i", "j"), F.greatest("i", "j")).alias("g"), "fp")
            return done if out is None else out.unionByName(done)
        small = rows.join(full, ["t", "bits"], "left_anti").select(F.xxhash64(F.lit(level), "t", "bits").alias("g"), "fp")
        out = small if out is None else out.unionByName(small)
        rows = rows.join(full, ["t", "bits"], "left_semi")
    raise AssertionError


def links(prints: DataFrame, *, radius: int = RADIUS, bucket: int = BUCKET, pivots: int = PIVOTS) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect all that are within the radius."""
    spark = prints.sparkSession
    parts = partitions(spark)
    spread = buckets(prints, radius, bucket)
    at = _pivots(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(g: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            child, root = forest(g, fp, radius, at)
            if len(child):
                yield pa.RecordBatch.from_arrays([pa.array(fp[child].view(np.int64)), pa.array(fp[root].view(np.int64))], names=["a", "b"])

        gs, fps, size = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            gs.append(batch.column(0).to_numpy())
            fps.append(batch.column(1).to_numpy().view(np.uint64))
            size += batch.num_rows
            if size >= 50_000:
                g, fp = np.concatenate(gs), np.concatenate(fps)
                cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
                yield from found(g[:cut], fp[:cut])
                gs, fps, size = [g[cut:]], [fp[cut:]], len(g) - cut
        if size:
            yield from found(np.concatenate(gs), np.concatenate(fps))

    return spread.repartition(parts, "g").sortWithinPartitions("g", "fp").mapInArrow(run, "a bigint, b bigint")


def components(pairs: DataFrame, label: str = "components") -> DataFrame:
    """node, root of every node of the links (a, b). In each round every node joins the neighbour that comes first in
    a random order of that round and the graph is contracted, so rounds grow with the logarithm of the graph."""
    edges = stored(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), label)
    roots = None
    turn = 0
    while edges.take(1):
        turn += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("b"))
        joined = both.groupBy("a").agg(F.least(F.min(order("b")), F.min(order("a"))).alias("m")).select(F.col("a").alias("node"), F.col("m").getField("b").alias("root"))
        step, before = stored(joined, label), roots
        if roots is None:
            roots = step
        else:
            roots = stored(
                roots.join(step.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left").select("node", F.coalesce("above", "root").alias("root")),
                label,
            )
        left = step.select(F.col("node").alias("a"), F.col("root").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("y"))
        moved = edges.join(left, "a").join(right, "b").where("x <> y")
        done, edges = edges, stored(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), label)
        discard(done, *(t for t in (step, before) if t is not roots and t is not None))
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots


def near_duplicates(docs: DataFrame, *, words: int = WORDS, radius: int = RADIUS, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (hash of the text), fp and component_id (the smallest doc_id that links reach) of every row."""
    prints = stored(fingerprints(docs, words=words, id_col=id_col, text_col=text_col), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes.select("fp"), radius=radius, bucket=bucket))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = stored(named.join(least, "root").select("fp", "n", "component_id"), "named")
    return spread_join(prints, of, ["fp"]).select("doc_id", "row", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with one row of each component: the one with the smallest id (of several, the one whose text's hash is
    least). Components whose ids are all null keep one row each."""
    doc, row = fresh(docs, "doc", "row")
    dup = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    least = F.lit(-(1 << 63)).cast("bigint")  # stands for a null id; rows are told apart by their texts anyway
    heads = (
        dup.where("doc_id <=> component_id")
        .groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp"))
        .agg(F.min("row").alias(row))
        .select(F.coalesce("component_id", least).alias(doc), row)
    )
    keyed = docs.withColumns({doc: F.coalesce(F.col(id_col).cast("bigint"), least), row: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    # a row that is repeated whole stays once
    return keyed.join(heads.distinct(), [doc, row], "left_semi").dropDuplicates([doc, row]).select(*docs.columns)
