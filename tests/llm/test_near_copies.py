"""The pipeline's near copies against brute force."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import numpy as np
import pytest
from quernflow.llm import near_copies, simhash


def slow_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def slow_heads(rows):
    """doc_ids that stay: the smallest of each component."""
    sets = [slow_shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and similar(sets[i], sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    return sorted(min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root))


def corpus(seed):
    """Originals, copies with words replaced here and there, and chains of copies of copies."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    texts = []
    for k in range(30):
        w = [word() for _ in range(r.randint(60, 300))]
        texts.append(w)
        for _ in range(r.randint(0, 5)):
            w = list(texts[-1] if k % 3 else w)
            for _ in range(r.randint(1, 1 + len(w) // 40)):
                w[r.randrange(len(w))] = word()
            texts.append(w)
    ids = r.sample(range(10_000), len(texts))
    return [(i, " ".join(w)) for i, w in zip(ids, texts, strict=True)]


def test_near_copies_of_the_pipeline(spark):
    rows = corpus(1)
    pairs = [(a, b) for _, a in rows for _, b in rows if a < b and similar(slow_shingles(a), slow_shingles(b))]
    far = [p for p in pairs if bin(simhash.fingerprint(p[0]) ^ simhash.fingerprint(p[1])).count("1") > 3]
    assert len(far) > 10  # pairs that three bits do not reach
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, df, "").collect())
    assert got == slow_heads(rows) and len(got) < len(rows)


@pytest.mark.parametrize("block", [2, 512])
def test_groups_over_blocks(spark, block):
    rows = corpus(2)
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id bigint, text string, row bigint")
    kept = near_copies.drop_near_copies(df, block=block)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == slow_heads(rows)


def test_similarity_is_exact():
    sets = [np.arange(100, dtype=np.uint64), np.arange(80, dtype=np.uint64), np.arange(79, dtype=np.uint64) + np.uint64(1000), np.arange(1, 64, dtype=np.uint64)]
    child, parent = near_copies.forest(sets)
    assert (child, parent) == ([1], [0])  # 80 of 100 is near, 63 of 80 is not
    for text in (None, "", " \n\t", "One", "a b c d", "A b C d e", "x y z " * 50):
        assert len(near_copies.shingles(text)) == len(slow_shingles(text))


def test_cases(spark):
    rows = [(7, "a b c d e f"), (3, "A b c d  e f"), (9, None), (8, ""), (5, "one"), (4, "one"), (None, "one"), (4, "one"), (None, "q w"), (None, "Q w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [r.doc_id for r in near_copies.drop_near_copies(df).collect()]
    assert sorted(x for x in got if x is not None) == [3, 4, 8] and got.count(None) == 1
    assert near_copies.drop_near_copies(df.limit(0)).count() == 0


def test_large_group_of_one_original(spark):
    """Copies that are near their original but not each other, copies of copies, and strangers that share half a text: the
    central text links most, few are dealt over blocks, and none is lost."""
    r = random.Random(9)
    word = lambda: f"w{r.randrange(90_000)}"
    first = [word() for _ in range(200)]

    def edited(w, n):
        w = list(w)
        for k in r.sample(range(len(w) // 10), n):
            w[10 * k + r.randrange(5)] = word()
        return w

    texts = [first] + [edited(first, 4) for _ in range(150)]
    texts += [edited(texts[k], 4) for k in range(1, 30)] + [first[:100] + [word() for _ in range(100)] for _ in range(20)]
    rows = [(i, " ".join(w)) for i, w in zip(r.sample(range(10_000), len(texts)), texts, strict=True)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen = []
    plain = near_copies.dealt_members

    def counted(members, sizes, central, block):
        out = near_copies.stored(plain(members, sizes, central, block), "dealt")
        seen.append((members.count(), central.count(), out.count()))
        return out

    near_copies.dealt_members = counted
    try:
        got = sorted(x.doc_id for x in near_copies.drop_near_copies(df, block=16).collect())
    finally:
        near_copies.dealt_members = plain
    assert got == slow_heads(rows) and len(got) < 25
    (n, linked, dealt), blocks = seen[0], -(-seen[0][0] // 16)
    assert linked >= 140 and dealt < n * blocks / 2


def test_large_tables_are_not_files(spark, monkeypatch):
    """Every file that a task creates starts processes that are counted with the executor's memory."""
    labels = []
    monkeypatch.setattr(near_copies, "stored", lambda df, label, f=near_copies.stored: labels.append(label) or f(df, label))
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, text + " x"), (3, "other words here")], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(df).collect()) == [1, 3]
    assert not {"near-prints", "near-nodes", "near-keys", "near-firsts", "near-fingerprints", "near-members"} & {*labels}
