"""The pipeline's stages one after another against brute force over planted junk, repeated lines and near copies."""

from __future__ import annotations

import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
from quernflow.llm import queries, wordbpe
from test_near_copies import slow_heads

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fixture():
    r = random.Random(5)
    text = lambda n: "\n".join(" ".join(f"w{r.randrange(2000)}" for _ in range(10)) for _ in range(n // 10))
    good = [text(r.randrange(80, 200)) for _ in range(60)]
    for i in range(0, 40, 2):  # copies with a word or two replaced, of texts of 80 words or more
        w = re.split(r"([ \n])", good[i])
        w[len(w) // 4 * 2] = "changed"
        good.append("".join(w))
    repeated = "Subscribe to our newsletter and never miss a story again"
    good = [f"{repeated}\n{t}" if i % 9 == 0 else f"{t}\n  {repeated.upper()} " if i % 9 == 4 else t for i, t in enumerate(good)]
    rare = "A line that only four of the documents have between them"
    good = [f"{t}\n{rare}" if 40 <= i < 44 else t for i, t in enumerate(good)]
    junk = [text(100).replace("w1", "#$%&") + " #" * 60 for _ in range(40)]
    bad = [text(40), "", "a b c d " * 40, None]
    rows = [(t, k) for part, k in ((good, 1), (junk, 0), (bad, None)) for t in part]
    ids = r.sample(range(1000), len(rows))
    return [(i, t, k) for i, (t, k) in zip(ids, rows, strict=True)], {i for i, (_, k) in zip(ids, rows, strict=True) if k == 0}


def slow_quality(rows, junk):
    def fails(t):
        w = WORD.findall(t or "")
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i in range(len(w) - 2) for k in range(3) if grams[tuple(w[i : i + 3])] > 1}
        return len(w) < 50 or 2 * len(covered) > len(w)

    return {i: t for i, t in rows.items() if i not in junk and not fails(t)}


def slow_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    docs = {}
    for i, t in rows.items():
        for x in t.split("\n"):
            docs.setdefault(key(x), set()).add(i)
    drop = lambda x, i: len(key(x)) >= 40 and len(docs[key(x)]) >= 5 and i != max(docs[key(x)])
    return {i: "\n".join(x for x in t.split("\n") if not drop(x, i)) for i, t in rows.items()}


def test_stages_against_brute_force(spark, tmp_path):
    rows, junk = fixture()
    spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, k) for i, _, k in rows if k is not None], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    want = slow_quality({i: t for i, t, _ in rows}, junk)
    after = [want, slow_lines(want)]
    heads = slow_heads(list(after[1].items()))
    after.append({i: t for i, t in after[1].items() if i in heads})
    assert len(rows) > len(after[0]) == len(after[1]) > len(after[2]) and after[0] != after[1]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), left in zip(corpus_pipeline.STAGES, after, strict=False):
        docs = corpus_pipeline.common.stored(stage(spark, docs, str(tmp_path)), "stage")
        assert {r.doc_id: r.text for r in docs.collect()} == left and docs.count() == len(left), name
    bpe = wordbpe.encoder(queries.vocabulary())
    packed = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        packed.setdefault(r.doc_id, []).append((r.start, r.ids))
    got = {i: np.frombuffer(b"".join(x for _, x in sorted(p)), "<u4").tolist() for i, p in packed.items()}
    assert got == {i: [*bpe.library.encode(t, add_special_tokens=False).ids, 1] for i, t in after[2].items()}


def words(n, start=0):
    return " ".join(f"word{(start + i) * 7919 % 100_003}" for i in range(n))


EDGE = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, doc string, keep int, node string, kept string, base_failed int, n_words string"


def edge_rows():
    rest = ("en", None, 5, 1, "d", 2, "n", "k", 3, "w")
    line = "The same line of boilerplate that many of the documents share"
    long = "\n".join(words(50, 50 * i) for i in range(1000))
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, words(20)), (None, words(100, 9000)), (None, None), (10, words(120, 500)), (10, words(120, 500)), (11, words(120, 500))]
    texts += [(20 + i, f"{words(80, 1000 + 200 * i)}\n{line}") for i in range(5)] + [(30, long), (31, long + " end"), (40, words(60, 7000) + "é \U0001f600\r\n" + words(60, 8000))]
    return [(i, t, *rest) for i, t in texts], line, long


def test_stages_on_odd_rows(spark, tmp_path):
    rows, line, long = edge_rows()
    spark.createDataFrame(rows, EDGE).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, str(tmp_path))
    assert good.columns == docs.columns
    assert sorted(((r.doc_id or 0, r.text) for r in good.collect())) == sorted((i or 0, t) for i, t, *_ in rows if t and len(t.split()) >= 50)
    for each in (docs, good):  # null and empty texts too
        kept = stages["line dedup"](spark, each, str(tmp_path))
        got = kept.collect()
        assert kept.columns == docs.columns and len(got) == each.count()
        for r in got:
            before = {t for i, t, *_ in rows if i == r.doc_id}
            assert r.text in {t.replace(f"\n{line}", "") if t and r.doc_id < 24 else t for t in before} if r.doc_id else r.text in before
            assert (r.n_chars, r.row, r.doc, r.kept) == (len(r.text) if r.text is not None else r.n_chars, 1, "d", "k")
        one = stages["near-dedup"](spark, kept, str(tmp_path))
        left = sorted((str(r.doc_id), r.text) for r in one.collect())
        assert one.columns == docs.columns
        wordless = [] if each is good else [("1", None)]  # of null, empty and blank texts the smallest id's
        want = wordless + ([] if each is good else [("4", words(20))]) + [("None", words(100, 9000)), ("10", words(120, 500))]
        want += [(str(20 + i), words(80, 1000 + 200 * i) + (f"\n{line}" if i == 4 else "")) for i in range(5)] + [("30", long), ("40", rows[-1][1])]
        assert left == sorted(want, key=lambda x: (x[0], x[1] or "")) or sorted(left, key=str) == sorted(want, key=str)
        packed = {}
        for r in stages["packing"](spark, one, str(tmp_path)).collect():
            packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
            assert r.length & (r.length - 1) == 0 and r.doc_tokens >= r.length
        assert len(packed) == len(left)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()} == {None, 10, 20, 21, 22, 23, 24, 30, 40}


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], EDGE).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
