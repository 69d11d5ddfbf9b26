"""SimHash: fingerprints, links and components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from quernflow.llm import queries, simhash


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, prints, radius=3):
    parent = {i: i for i in range(len(ids))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [least.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one two", "A b C d", "x y z " * 50, "é É\x0b b c d"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def walk(r, start, steps):
    """Fingerprints in a chain, each a few bits from the last."""
    out = [start]
    for _ in range(steps):
        x = out[-1]
        for b in r.sample(range(64), r.randint(1, 4)):
            x ^= 1 << b
        out.append(x)
    return out


@pytest.mark.parametrize("bucket", [4, 24, 4096])
def test_links_connect_all_pairs(spark, bucket):
    r = random.Random(bucket)
    prints = sorted({x for _ in range(8) for x in walk(r, r.getrandbits(64), 40)} | {r.getrandbits(64) for _ in range(200)})
    near = [prints[0] ^ sum(1 << b for b in r.sample(range(12), 2)) for _ in range(60)]  # one crowded bucket
    prints = sorted({*prints, *near})
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    pairs = simhash.links(nodes, bucket=bucket)
    got = {r.node: r.root for r in simhash.components(pairs).collect()}
    want = slow_components(list(range(len(prints))), prints)
    groups = {}
    for s, w in zip(signed, want, strict=True):
        groups.setdefault(w, set()).add(got.get(s, s))
    assert all(len(g) == 1 for g in groups.values())
    assert len({min(g) for g in groups.values()}) == len(groups)


def test_masks_lose_no_pair():
    r = random.Random(2)
    levels = simhash._masks(4, 2)
    assert [len(x) for x in levels] == [4, 16, 64] and {bin(m).count("1") for m in levels[1]} == {28}
    for _ in range(300):
        x = sum(1 << b for b in r.sample(range(64), 3))  # the bits that differ
        at = [0]
        for level in levels:  # whichever bucket is cut again, one of its parts holds the pair
            at = [4 * t + i for t in at for i in range(4) if not level[4 * t + i] & x]
            assert at


def test_pivots_discard_the_pairs(spark):
    """Pairs that buckets form, those that the pivots leave, and those within the radius: the pivots do the pruning."""
    r = np.random.default_rng(3)
    fp = r.integers(0, 1 << 63, 60_000, np.uint64)
    fp = np.unique(np.r_[fp, fp[:300] ^ np.uint64(5)])
    counts = [0, 0, 0]
    for mask in simhash._masks(4, 0)[0]:
        g = fp & np.uint64(mask)
        order = np.argsort(g, kind="stable")
        simhash.forest(g[order], fp[order], 3, simhash._pivots(simhash.PIVOTS), counts)
    print("pairs in buckets, after pivots, within the radius:", counts)
    assert counts[2] >= 300 and counts[0] > 100_000 and counts[1] - counts[2] < counts[0] / 500


def test_very_long_texts_and_one_hot_print(spark):
    long = " ".join(f"w{i * i % 9973}" for i in range(200_000))
    rows = [(i, "same text as all the others", "x") for i in range(3, 60)] + [(2, long, "x"), (1, long + " end", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string")
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert len(got) == 59 and all(got[i][1] == 3 for i in range(3, 60)) and got[2][1] == got[1][1] == 1
    assert got[2][0] & (1 << 64) - 1 == slow_fingerprint(long)


def test_components_of_rows(spark):
    texts = ["a b c d e f g h", "A B c d e f g h", None, "", "one", "one", "q w e r t y u i o p", None]
    ids = [7, 3, 9, 8, 5, 4, 1, None]
    rows = spark.createDataFrame([(i, t, 0, 0) for i, t in zip(ids, texts, strict=True)], "doc_id bigint, text string, fp int, row int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(rows).collect()), key=str)
    want = sorted(zip(ids, slow_components(ids, [slow_fingerprint(t) for t in texts]), strict=True), key=str)
    assert got == want
    kept = simhash.drop_near_duplicates(rows)
    assert kept.columns == rows.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 8]
    assert simhash.near_duplicates(rows.limit(0)).count() == 0


def test_query(spark, sf_dir):
    got = queries.op10_simhash(spark, sf_dir).collect()
    rows = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    prints = [slow_fingerprint(r.text) for r in rows]
    want = slow_components([r.doc_id for r in rows], prints)
    assert sorted(map(tuple, got)) == [(r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, want, strict=True)]
