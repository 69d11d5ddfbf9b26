"""Encoding, chunk reuse, token files and packing against the library."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from quernflow.llm import chunk_bpe, packing, queries, token_files, wordbpe

PATH = queries.vocabulary()
TEXTS = [
    None, "", "  \n ", "Hello World", "it's'd've''tt's I'LL don't", "café CAF\u00c9 cafe\u0301 \u0130stanbul", "<|endoftext|>x ><|startoftext|> y", "a\tb\rc\x0bd\x1ce\x85f",
    "\n\u0301a", "漢字 \U0001f600 ¿Qué? a×b÷c", "12 3x45_6", "x" * 300, "word " * 900, "aB" * 9000, "long line without end " * 3 + "z" * 3000,
]


@pytest.fixture(scope="module")
def bpe():
    return wordbpe.encoder(PATH)


def library(bpe, text):
    return bpe.library.encode(text or "", add_special_tokens=False).ids


@pytest.fixture
def rows(spark):
    data = [(i, t, 1, "c") for i, t in enumerate([*TEXTS, TEXTS[3]])] + [(3, TEXTS[3], 1, "c"), (None, "null id", 1, "c")]
    return spark.createDataFrame(data, "doc_id bigint, text string, ids int, start string")


@pytest.mark.parametrize("slab", [200, 3_000_000])
def test_encoder(bpe, monkeypatch, slab):
    monkeypatch.setattr(wordbpe, "SLAB", slab)
    ids, at = bpe.encode_array(pa.array(TEXTS, pa.string()))
    for i, t in enumerate(TEXTS):
        assert ids[at[i] : at[i + 1]].tolist() == library(bpe, t)
        assert bpe.decode(library(bpe, t)) == bpe.library.decode(library(bpe, t), skip_special_tokens=False)


@pytest.mark.parametrize("bits", [64, 1 << 25])
def test_chunks_are_shared_and_exact(spark, bpe, rows, monkeypatch, bits):
    monkeypatch.setattr(chunk_bpe, "FILTER_BITS", bits)  # 64: the filter takes nearly every chunk for shared
    monkeypatch.setattr(chunk_bpe, "JOIN_BYTES", 500)
    got = chunk_bpe.encode_documents(rows, PATH).collect()
    text = {r.doc_id: r.text for r in rows.collect()}
    assert len(got) == rows.count()
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == library(bpe, text[r.doc_id])
        assert r.decoded == bpe.library.decode(library(bpe, text[r.doc_id]), skip_special_tokens=False)
    assert chunk_bpe.encode_documents(rows.limit(0), PATH).count() == 0


def test_shared_chunks_are_encoded_once(spark, bpe, monkeypatch):
    """Passages in documents of different tasks, in one run-on word too; a chunk that a third of all documents hold."""
    passage = " ".join(f"word{i * i}" for i in range(3000))
    run_on = "".join(f"run{i * i}" for i in range(2000))
    texts = [f"document {i} begins {passage if i % 2 else run_on} and ends {i}" * (1 + i % 3) for i in range(30)] + ["no other text holds this"] * 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(7)
    got = {r.doc_id: r for r in chunk_bpe.encode_documents(df, PATH).collect()}
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == library(bpe, t)
    assert sum(r.n_reused for r in got.values()) > 0.8 * sum(r.n_chunks for r in got.values()) and got[30].n_reused == 0
    shared = chunk_bpe.shared_chunks(df).collect()
    keys = [k for t in texts for k in chunk_bpe.cut(pa.array([t]))[0]]
    assert sum(r.n for r in shared) == len(keys) - sum(keys.count(k) == 1 for k in keys)


def test_joins_of_any_cut(bpe):
    """Whatever the cuts, joined chunks give the ids of the whole text."""
    r = np.random.default_rng(8)
    for t in [t for t in TEXTS if t and len(t) < 2000]:
        raw = t.encode()
        for _ in range(5):
            cuts = sorted({0, len(raw), *(int(c) for c in r.integers(0, len(raw) + 1, 6) if c == len(raw) or raw[c] & 0xC0 != 0x80)})
            entries = chunk_bpe.encode_chunks(bpe, [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
            assert chunk_bpe.join_chunks(bpe, [entries])[0].tolist() == library(bpe, t)


@pytest.mark.parametrize("n", [1, 2, 130, 5000, 70000])
def test_numeral_system(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.zipf(1.3, n), 49407).astype(np.int64)
    lengths = np.array([n // 2, n - n // 2])
    data = token_files.write_segment([5, None], lengths, ids)
    segment = token_files.Segment(data)
    assert segment.doc_ids == [5, None] and segment.lengths.tolist() == lengths.tolist()
    assert np.array_equal(segment.tokens(), ids)
    broken = bytearray(data)
    broken[-1] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_files.Segment(bytes(broken)).tokens()


def test_any_symbols():
    ids = np.array([0, (1 << 32) - 1, 5, 70_000, 5] * 300, np.int64)
    assert np.array_equal(token_files.Segment(token_files.write_segment([1], np.array([1500]), ids)).tokens(), ids)


def test_files(spark, bpe, rows):
    got = sorted(token_files.token_files(rows, PATH).collect(), key=lambda r: r.start)
    order = sorted(rows.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    start = 0
    for r, want in zip(got, order, strict=True):
        ids = [*library(bpe, want.text), 1]
        assert (r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (want.doc_id, start, len(ids), ids)
        start += len(ids)
    assert token_files.token_files(rows.limit(0), PATH).count() == 0


@pytest.mark.parametrize("end", [70_000, (1 << 32) - 1])
def test_large_end_ids(spark, bpe, rows, end):
    some = rows.where("doc_id < 13")
    got = {(r.doc_id, r.n_tokens): np.frombuffer(r.ids, "<u4").tolist() for r in token_files.token_files(some, PATH, end_id=end).collect()}
    assert got == {(r.doc_id, len(library(bpe, r.text)) + 1): [*library(bpe, r.text), end] for r in some.collect()}
    assert {np.frombuffer(r.ids, "<u4")[-1] for r in packing.pack_documents(some.where("text = 'null id' or doc_id = 2"), PATH, end_id=end).collect()} == {end}
    for bad in (-1, 1 << 32):
        for make in (token_files.token_files, packing.pack_documents):
            with pytest.raises(ValueError, match="32-bit"):
                make(some, PATH, end_id=bad)


def test_very_long_text(spark, bpe, monkeypatch):
    text = " ".join(f"word{i % 4999}" for i in range(120_000))
    df = spark.createDataFrame([(1, text), (2, "b"), (3, text)], "doc_id bigint, text string")
    want = library(bpe, text)
    for r in token_files.token_files(df, PATH).where("doc_id <> 2").collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == [*want, 1]
    pieces = sorted((r.doc_id, r.start, r.ids) for r in packing.pack_documents(df, PATH).collect())
    assert np.frombuffer(b"".join(x for d, _, x in pieces if d == 3), "<u4").tolist() == [*want, 1]
    for r in chunk_bpe.encode_documents(df, PATH).where("doc_id = 3").collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == want


def test_buckets(spark, rows, tmp_path):
    got = packing.pack_documents(rows.repartition(3), PATH, length=256).collect()
    order = sorted(got, key=lambda r: r.sequence_id)
    assert [r.length for r in order] == sorted((r.length for r in got), reverse=True)  # numbers run bucket by bucket
    tasks = {}
    for r in order:
        tasks.setdefault(r.sequence_id >> packing.RUN_BITS, []).append(r)
    for mine in tasks.values():  # gapless in a bucket of a task
        assert len({r.length for r in mine}) == 1
        assert [r.sequence_id & (1 << packing.RUN_BITS) - 1 for r in mine] == list(range(len(mine)))
    packing.write_buckets(packing.pack_documents(rows, PATH, length=256), str(tmp_path / "packed"))
    for size in (1, 64, 256):
        batch = packing.read_bucket(spark, str(tmp_path / "packed"), size)
        assert sorted(len(r.ids) for r in batch.collect()) == [4 * size] * sum(r.length == size for r in got)


def test_packing(spark, bpe, rows):
    got = packing.pack_documents(rows, PATH, length=2048).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    pieces = {}
    for r in got:
        assert r.length == 1 << r.bucket <= 2048 and r.offset == 0
        pieces.setdefault((r.doc_id, r.start), []).append(r)
    for d in {r.doc_id for r in rows.collect()}:
        mine = [r for r in rows.collect() if r.doc_id == d]
        ids = [*library(bpe, mine[0].text), 1]
        joined = b"".join(p[0].ids for (k, s), p in sorted(pieces.items(), key=lambda x: x[0][1]) if k == d)
        assert np.frombuffer(joined, "<u4").tolist() == ids
        assert all(len(p) == len(mine) and p[0].doc_tokens == len(ids) for (k, _), p in pieces.items() if k == d)
    assert packing.pack_documents(rows.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(rows, PATH, length=100)


def test_queries(spark, sf_dir, bpe):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = {k: np.array(library(bpe, v), "<u4") for k, v in text.items()}
    ended = {k: np.r_[v, 1].astype("<u4") for k, v in ids.items()}
    for r in queries.op4_chunk_bpe(spark, sf_dir).collect():
        decoded = bpe.library.decode(ids[r.doc_id].tolist(), skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(ids[r.doc_id].tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    start = 0
    for r in sorted(queries.op6_token_files(spark, sf_dir).collect()):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ended[r.doc_id]), zlib.crc32(ended[r.doc_id].tobytes()))
        start += r.n_tokens
    total = 0
    for r in queries.op8_packing(spark, sf_dir).collect():
        assert r.ids_crc32 == zlib.crc32(ended[r.doc_id][r.start : r.start + r.length].tobytes())
        total += r.length
    assert total == start
