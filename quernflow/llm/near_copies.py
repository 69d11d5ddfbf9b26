"""Operator 10 with an exact similarity: near copies by Jaccard similarity of five-word shingles, the pipeline's stage.

Each text has a SimHash of its shingle set; pairs within `RADIUS` bits come from operator 10's buckets, pivot distance
tables and distances (`simhash.links`). Pairs of Jaccard similarity 0.8 differ by about 10 bits, though, and a radius that
holds them has no selective buckets, nor do pivots discard anything there. So texts also have `BANDS` min-wise fingerprints
of `ROWS` minima each, and those that share one are candidates as well. A pair of similarity s shares none of them with
probability (1 - s^ROWS)^BANDS: 0.0002 at 0.8. Texts with the same set are one node. Nodes that are candidates, directly
or through others, form a group; each group's texts come together once and all its pairs that are not yet connected are
compared by their exact similarity. In a group of more than `block` nodes all are first compared with its most central
one, of which copies of one original mostly are; only pairs with a node that this leaves unlinked remain. Those are dealt
over pairs of sub-groups, so no task holds more than two of them and no pair goes missing. Links connect to components, as
in operator 10.

Defined cases: a text of fewer words than a shingle is one shingle; null, empty and wordless texts are copies of each
other; very long texts are shingled whole, their minima taken in stretches; a similarity of exactly 0.8 (a tie) links; a
null doc_id names a component's row only if all ids in it are null; repeated rows stay once; an empty table gives no
rows; extra columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import bound_batches, cached, discard, fresh, partitions, spread_join, stored
from .simhash import _BLANK, RADIUS, _pivots, components

#: Words of a shingle; similarity of near copies as a fraction.
WORDS, TOP, BOTTOM = 5, 4, 5
BANDS, ROWS, BLOCK = 28, 6, 512
_FACTORS = _pivots(WORDS + 2 * BANDS * ROWS + ROWS) | np.uint64(1)  # fixed odd numbers


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    w = np.array([digest(x, 42) for x in (text or "").translate(_BLANK).split(" ") if x], np.uint64)
    n = max(len(w) - WORDS + 1, min(len(w), 1))
    sums = np.zeros(n, np.uint64)
    for i in range(min(WORDS, len(w))):
        sums += w[i : i + n] * _FACTORS[i]
    return np.unique(_mix(sums))


def bands(hashes: np.ndarray) -> np.ndarray:
    """The min-wise fingerprints of a set of shingles."""
    k = BANDS * ROWS
    a, b = _FACTORS[WORDS : WORDS + k, None], _FACTORS[WORDS + k : WORDS + 2 * k, None]
    least = np.full(k, ~np.uint64(0))
    for i in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[None, i : i + 1024] * a + b).min(axis=1))
    rows = _mix(least).reshape(BANDS, ROWS) * _FACTORS[None, -ROWS:]
    return _mix(rows.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def prints(docs: DataFrame, doc: str, row: str, text_col: str) -> DataFrame:
    """doc, row, node (hash of the shingle set; 0 without words), fp (its SimHash) and keys (its min-wise fingerprints, and
    the SimHash as one more) of every row."""
    import xxhash

    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints_, keys = [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text)
                nodes.append(xxhash.xxh64_intdigest(s.tobytes(), 42) if len(s) else 0)
                prints_.append(simhash.majority(s) if len(s) else 0)
                own = _mix(np.array([prints_[-1]], np.uint64) + np.uint64(BANDS))
                keys.append(np.r_[bands(s), own].view(np.int64) if len(s) else np.zeros(0, np.int64))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, prints_)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *signed, pa.array(keys, pa.list_(pa.int64()))], names=["doc", "row", "node", "fp", "keys"])

    rows = docs.select(F.col(doc).alias("doc"), F.col(row).alias("row"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc bigint, row bigint, node bigint, fp bigint, keys array<bigint>")


def forest(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs that are similar enough: child and parent positions."""
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    own = [ids[e - n : e] for e, n in zip(ends, sizes, strict=True)]
    has = np.zeros(int(ids.max()) + 1, bool)
    child, parent, queue = [], [], []
    left, flat = np.arange(len(sets)), ids
    while len(left) > 1 or (len(left) and queue):
        if not queue:
            queue.append(int(left[0]))
            flat, left = flat[sizes[left[0]] :], left[1:]
        x = queue.pop()
        has[own[x]] = True
        starts = np.cumsum(sizes[left]) - sizes[left]
        both = np.add.reduceat(has[flat], starts, dtype=np.int64)
        has[own[x]] = False
        near = BOTTOM * both >= TOP * (sizes[x] + sizes[left] - both)
        if near.any():
            found = left[near].tolist()
            child += found
            parent += [x] * len(found)
            queue += found
            flat, left = flat[np.repeat(~near, sizes[left])], left[~near]
    return child, parent


def central_links(members: DataFrame, sizes: DataFrame, marks: DataFrame, block: int) -> DataFrame | None:
    """a, b: links of nodes of large groups to the most central one of their group: the one whose fingerprints most nodes
    of the group share. None without large groups. sizes: g, n; marks: node, keys."""
    large = stored(sizes.where(F.col("n") > block), "near-large")
    if not large.take(1):
        return None
    inside = spread_join(members.select("g", "node"), large, ["g"])
    keys = stored(inside.join(marks.select("node", "keys").dropDuplicates(["node"]), "node").select("g", "node", F.explode("keys").alias("key")), "near-large-keys")
    counts = stored(keys.groupBy("g", "key").agg(F.count("*").alias("n")), "near-large-counts")
    weights = spread_join(keys, counts.withColumn("w", F.col("n")), ["g", "key"]).groupBy("g", "node").agg(F.sum("w").alias("w"))
    heads = weights.groupBy("g").agg(F.max(F.struct("w", "node")).getField("node").alias("head"))
    texts = members.select(F.col("g").alias("hg"), F.col("node").alias("head"), F.col("text").alias("head_text"))
    with_text = heads.join(texts, [F.col("g") == F.col("hg"), heads["head"] == texts["head"]]).select("g", heads["head"], "head_text")
    pairs = spread_join(members, stored(with_text.join(large, "g"), "near-heads"), ["g"]).select("node", "text", "head", "head_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            out: list[tuple[int, int]] = []
            for node, text, head, head_text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if head != at:
                    at, own = head, shingles(head_text)
                if node != head:
                    s = shingles(text)
                    both = len(np.intersect1d(s, own, assume_unique=True))
                    if BOTTOM * both >= TOP * (len(s) + len(own) - both):
                        out.append((node, head))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return stored(pairs.mapInArrow(run, "a bigint, b bigint"), "near-central")


def dealt_members(members: DataFrame, sizes: DataFrame, central: DataFrame | None, block: int) -> DataFrame:
    """g, node, text: members dealt to cells in which all pairs are compared. Every pair of a group is in one of them but
    those of two nodes that are linked to the central one already."""
    if central is None:
        return members
    done = central.select(F.col("a").alias("node"), F.lit(1).alias("done"))
    flagged = stored(members.join(done, "node", "left").withColumn("done", F.coalesce("done", F.lit(0))), "near-flagged")
    each = flagged.groupBy("g").agg(F.sum("done").alias("linked"), F.count("*").alias("n"))
    cells = lambda c: F.ceil(c / block).cast("int")
    rest = F.col("n") - F.col("linked")
    parts = stored(each.select("g", "n", cells(rest).alias("u"), F.when(rest > 0, cells(F.col("linked"))).otherwise(0).alias("l")), "near-cells")
    rows = spread_join(flagged, parts, ["g"])
    first = F.col("done") == 0
    rows = rows.withColumn("i", F.pmod(F.xxhash64("node"), F.greatest(F.when(first, F.col("u")).otherwise(F.col("l")), F.lit(1))).cast("int"))
    # an unlinked node's block meets all blocks, a linked node's block those of unlinked ones
    meets = F.when(first, F.sequence(F.lit(0), F.col("u") + F.col("l") - 1)).when(F.col("u") > 0, F.sequence(F.lit(0), F.col("u") - 1))
    spread = rows.withColumn("i", F.when(first, F.col("i")).otherwise(F.col("u") + F.col("i"))).select("g", "node", "text", "i", F.explode(meets).alias("j"))
    return spread.select(F.xxhash64("g", F.least("i", "j"), F.greatest("i", "j")).alias("g"), "node", "text")


def links(members: DataFrame, marks: DataFrame, block: int) -> DataFrame:
    """a, b: links between nodes that connect all similar ones of a group. members: g (group), node, text, a table that is stored or cached."""
    sizes = stored(members.groupBy("g").agg(F.count("*").alias("n")), "near-sizes")
    central = central_links(members, sizes, marks, block)
    spread = dealt_members(members, sizes, central, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(nodes: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                child, parent = forest(sets)
                if child:
                    yield pa.RecordBatch.from_arrays([pa.array([nodes[c] for c in child], pa.int64()), pa.array([nodes[p] for p in parent], pa.int64())], names=["a", "b"])

        at, nodes, sets = None, [], []
        for batch in batches:
            for g, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != at:
                    yield from found(nodes, sets)
                    at, nodes, sets = g, [], []
                nodes.append(node)
                sets.append(shingles(text))
        yield from found(nodes, sets)

    out = spread.repartition(partitions(members.sparkSession), "g").sortWithinPartitions("g").mapInArrow(run, "a bigint, b bigint")
    return out if central is None else out.unionByName(central)


def drop_near_copies(docs: DataFrame, *, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each component of near copies: the one with the smallest id, of several the one whose
    text's hash is least."""
    doc, row = fresh(docs, "doc", "row")
    least = F.lit(-(1 << 63)).cast("bigint")  # stands for a null id
    keyed = docs.withColumns({doc: F.coalesce(F.col(id_col).cast("bigint"), least), row: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    marks = cached(prints(keyed, doc, row, text_col))
    first = F.min(F.struct((F.col("doc") == least).alias("none"), "doc", "row")).alias("first")
    nodes = cached(marks.groupBy("node").agg(first))
    # a node's fingerprints are the same in all its rows
    keys = cached(marks.select("node", F.explode("keys").alias("key")).distinct())
    firsts = cached(keys.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1"))
    stars = spread_join(keys, firsts, ["key"]).where("a <> node").select("a", F.col("node").alias("b"))
    prints_ = cached(marks.where(F.size("keys") > 0).groupBy("fp").agg(F.min("node").alias("node")))
    near = stored(simhash.links(prints_.select("fp"), radius=RADIUS), "near-fingerprint-links")
    one, two = (prints_.select(F.col("fp").alias(c), F.col("node").alias(n)) for c, n in (("a", "x"), ("b", "y")))
    bits = near.join(one, "a").join(two, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    groups = components(stars.unionByName(bits), "near-groups")
    discard(keys, firsts, prints_, near)
    wanted = nodes.join(groups, "node").select(F.col("root").alias("g"), "node", F.col("first.doc").alias(doc), F.col("first.row").alias(row))
    texts = keyed.select(doc, row, F.col(text_col).cast("string").alias("text"))
    members = cached(texts.join(wanted, [doc, row]).select("g", "node", "text").dropDuplicates(["node"]))
    found = stored(links(members, marks, block), "near-links")
    discard(members)
    roots = components(found, "near-components")
    discard(found)
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc").alias(doc), F.col("first.row").alias(row))
    return keyed.join(heads, [doc, row], "left_semi").dropDuplicates([doc, row]).select(*docs.columns)
