"""Operator 9: language-model scoring by subword lattice likelihood.

An existing subword vocabulary spells every word in many ways. Its pieces carry unigram probabilities: they start from
the vocabulary's own order, the only scores that it has, and expectation maximisation over all segmentations of the
training words, each with its count, fits them to the corpus. The sum over all segmentations is taken by the forward
recursion in log space; a document's probability is the product over its words and its end (`score`). Word counts of the
whole corpus are gathered in one aggregation; every distinct word is scored once, and documents meet the scores by a
broadcast of the frequent words (a bounded number) and a join for all others. A plain word unigram with add-half
smoothing stands beside it as the base score. `word_score` goes beyond the method: there a training word is one more arc
over its lattice, with its count less a discount (from the numbers of words seen once and twice), and what the discount
frees is shared out by the pieces' sum, so the probabilities of all words still add up to one.

Defined cases: null and empty texts are the end token alone; very long texts are counted by word, very long words summed
in stretches (`LONG`); a null doc_id counts as a training document; repeated rows are scored and counted each; words of
equal count (ties) are all broadcast or all joined; without training words the base counts are zero, the pieces keep
their first probabilities and both scores are the same; an empty table gives no rows; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, bound_batches, discard, lower_ascii, stored, words_of
from .wordbpe import byte_letters

#: Words that are broadcast at most, rounds of re-estimation, and what is added to every piece's expected count.
HEAD, ROUNDS, ADDED = 131_072, 2, 0.05
_TABLE = str.maketrans("\t\n\x0b\x0c\r" + UPPER, "     " + LOWER)
_BASE = np.uint64(0x100000001B3)
#: Cells of a lattice handled together, and words gathered from Arrow batches before they are spelled.
CELLS, WORDS = 200_000, 32_768
#: Bytes above which a word's lattice is built and summed in stretches of as many positions.
LONG = 4096
#: Bits of the filter that comes before a piece table, and the multiplier that spreads a hash over it.
_FILTER, _SPREAD = 17, np.uint64(0x9E3779B97F4A7C15)


def pieces(path: str) -> tuple[list[bytes], list[bool]]:
    """The vocabulary's pieces as bytes, and whether each ends a word, in the vocabulary's order."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    back = {c: i for i, c in enumerate(byte_letters())}
    suffix = model["end_of_word_suffix"]
    out, last = [], []
    for token in sorted(model["vocab"], key=model["vocab"].get):
        ends = token.endswith(suffix) and token != suffix
        text = token[: -len(suffix)] if ends else token
        out.append(bytes(back[c] for c in text))
        last.append(ends)
    return out, last


def _step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    return h * _BASE + (c.astype(np.uint64) + np.uint64(1))


def _spots(h: np.ndarray) -> np.ndarray:
    return (h * _SPREAD >> np.uint64(64 - _FILTER)).astype(np.int64)


def _log_sum(terms: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of exponentials over the first axis."""
    top = terms.max(0)
    safe = np.where(top > -np.inf, top, 0)
    terms -= safe
    with np.errstate(divide="ignore"):
        return np.log(np.exp(terms, out=terms).sum(0)) + safe


class Lattice:
    """Sums over all segmentations of words into pieces. Arrays have a row for each position and a column for each
    word, so that every sum runs over whole rows. Pieces of one and two bytes are found in direct tables; longer ones in
    sorted tables of hashes, behind a small filter that turns most of the misses away."""

    def __init__(self, path: str, log_p: np.ndarray | None = None):
        parts, ends = pieces(path)
        self.size = len(parts)
        if log_p is None:  # the vocabulary lists pieces from the most to the least frequent
            weight = 1.0 / np.arange(1, self.size + 1)
            log_p = np.log(weight / weight.sum())
        self.log_p = log_p
        self.scores = np.append(log_p, -np.inf)  # the last is of no piece
        self.longest = max(map(len, parts))
        self.tables = {}
        grouped: dict[tuple[int, bool], list[int]] = {}
        for i, (p, e) in enumerate(zip(parts, ends, strict=True)):
            grouped.setdefault((len(p), e), []).append(i)
        for (length, end), found in grouped.items():
            ids = np.array(found, np.int32)
            rows = np.frombuffer(b"".join(parts[i] for i in found), np.uint8).reshape(-1, length).T
            if length <= 2:
                direct = np.full(256**length, -1, np.int32)
                direct[rows[0] if length == 1 else rows[0].astype(np.int64) * 256 + rows[1]] = ids
                self.tables[length, end] = direct
            elif length:
                h = np.zeros(len(ids), np.uint64)
                for c in rows:
                    h = _step(h, c)
                order = np.argsort(h)
                seen = np.zeros(1 << _FILTER, bool)
                seen[_spots(h)] = True
                self.tables[length, end] = (h[order], ids[order], seen)

    def _find(self, length: int, end: bool, key: np.ndarray, out: np.ndarray) -> None:
        """Write the pieces with these keys (bytes' codes up to two bytes, then hashes) to `out`, -1 for none."""
        got = self.tables.get((length, end))
        if got is None:
            out[...] = -1
        elif length <= 2:
            np.take(got, key, out=out)
        else:
            hashes, ids, seen = got
            out[...] = -1
            maybe = np.nonzero(seen[_spots(key)])
            h = key[maybe]
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            out[maybe] = np.where(hashes[at] == h, ids[at], -1)

    def _edges(self, words: np.ndarray, a: int = 0, b: int | None = None) -> list[np.ndarray]:
        """For each piece length, the piece (or -1) that starts at each position from a to b of each word."""
        n, m = words.shape
        b = n if b is None else b
        part = words[a : b + self.longest]
        h, out = np.zeros((b - a, m), np.uint64), []
        for length in range(1, min(n - a, self.longest) + 1):
            starts = min(b, n - length + 1) - a
            h = _step(h[:starts], part[length - 1 : length - 1 + starts])
            key = part[:starts] if length == 1 else part[:starts].astype(np.int64) * 256 + part[1 : starts + 1] if length == 2 else h
            found = np.empty(h.shape, np.int32)
            inner = starts - 1 if a + starts + length - 1 == n else starts  # the last one may end the word
            self._find(length, False, key[:inner], found[:inner])
            if inner < starts:
                self._find(length, True, key[-1], found[-1])
            out.append(found)
        return out

    def _stretch(self, rows: np.ndarray, a: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and scores of a long word's positions from a on: a row for each position, a column for each length."""
        b = min(len(rows), a + LONG)
        edges = self._edges(rows, a, b)
        ids = np.full((b - a, len(edges)), self.size, np.int64)
        for k, e in enumerate(edges):
            ids[: len(e), k] = np.where(e[:, 0] < 0, self.size, e[:, 0])
        return ids, self.scores[ids]

    def _long_forward(self, rows: np.ndarray) -> np.ndarray:
        """The forward sums of one long word; what is held besides grows with LONG, not with the word."""
        n = len(rows)
        alpha = np.full(n + 1, -np.inf)
        alpha[0] = 0
        for a in range(0, n, LONG):
            for j, s in enumerate(self._stretch(rows, a)[1], a):
                reach = alpha[j + 1 : j + 1 + len(s)]
                np.logaddexp(reach, alpha[j] + s[: len(reach)], out=reach)
        return alpha

    def _long_expected(self, rows: np.ndarray, count: float) -> np.ndarray:
        """Expected counts of the pieces of one long word."""
        n, total = len(rows), np.zeros(self.size + 1)
        alpha, beta = self._long_forward(rows), np.full(n + 1, -np.inf)
        if alpha[n] == -np.inf:  # no segmentation
            return total[:-1]
        beta[n] = 0
        for a in range((n - 1) // LONG * LONG, -1, -LONG):
            ids, scores = self._stretch(rows, a)
            for j in range(a + len(ids) - 1, a - 1, -1):
                reach = beta[j + 1 : j + 1 + ids.shape[1]]
                beta[j] = np.logaddexp.reduce(reach + scores[j - a, : len(reach)])
            for k in range(ids.shape[1]):
                m = min(len(ids), n - a - k)
                share = alpha[a : a + m] + scores[:m, k] + beta[a + k + 1 : a + k + 1 + m] - alpha[n]
                total += np.bincount(ids[:m, k], np.exp(share), self.size + 1)
        return total[:-1] * count

    def _forward(self, edges: list[np.ndarray], n: int) -> tuple[np.ndarray, list[np.ndarray]]:
        scores = [self.scores[e] for e in edges]
        alpha = np.full((n + 1, edges[0].shape[1]), -np.inf)
        alpha[0] = 0
        for j in range(1, n + 1):
            alpha[j] = _log_sum(np.stack([alpha[j - k] + scores[k - 1][j - k] for k in range(1, min(j, len(edges)) + 1)]))
        return alpha, scores

    def _groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions and bytes (a column for each word) of words of one length, so many at a time."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        for n in np.unique(sizes).tolist():
            same = order[np.searchsorted(sizes[order], n) : np.searchsorted(sizes[order], n, "right")]
            step = 1 if n > LONG else max(1, CELLS // (n * min(n, self.longest)))
            for a in range(0, len(same), step):
                at = same[a : a + step]
                yield at, np.ascontiguousarray(np.frombuffer(b"".join([words[i] for i in at.tolist()]), np.uint8).reshape(-1, n).T)

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithm of each word's probability over all segmentations."""
        out = np.zeros(len(words))
        for at, rows in self._groups(words):
            out[at] = self._long_forward(rows)[-1] if len(rows) > LONG else self._forward(self._edges(rows), len(rows))[0][-1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces, over all segmentations of the words, weighted by the words' counts."""
        total = np.zeros(self.size)
        ids, weights, gathered = [], [], 0
        for at, rows in self._groups(words):
            n = len(rows)
            if n > LONG:  # one word
                total += self._long_expected(rows, counts[at[0]])
                continue
            edges = self._edges(rows)
            alpha, scores = self._forward(edges, n)
            beta = np.full(alpha.shape, -np.inf)
            beta[n] = 0
            for i in range(n - 1, -1, -1):
                beta[i] = _log_sum(np.stack([beta[i + k] + scores[k - 1][i] for k in range(1, min(n - i, len(edges)) + 1)]))
            whole = alpha[n]
            with np.errstate(divide="ignore"):
                share = np.where(whole > -np.inf, np.log(counts[at]) - np.where(whole > -np.inf, whole, 0), -np.inf)
            alpha += share
            for k, (e, s) in enumerate(zip(edges, scores, strict=True), 1):
                hit = np.flatnonzero(e >= 0)
                ids.append(e.ravel()[hit])
                weights.append(np.exp(alpha.ravel()[hit] + s.ravel()[hit] + beta[k:].ravel()[hit]))
                gathered += len(hit)
            if gathered > 4 * CELLS:
                total += np.bincount(np.concatenate(ids), np.concatenate(weights), self.size)
                ids, weights, gathered = [], [], 0
        if gathered:
            total += np.bincount(np.concatenate(ids), np.concatenate(weights), self.size)
        return total


def in_bulk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in batches of WORDS rows: words are short, and a lattice of many at once costs less."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= WORDS or batch.nbytes > 1 << 20:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def word_counts(docs: DataFrame, text: str, train: str) -> DataFrame:
    """word and its count c in training documents, for every word of the corpus. JVM only, combined before the shuffle."""
    words = docs.select(F.explode(words_of(F.col(text))).alias("word"), F.col(train).cast("int").alias("one"))
    return words.groupBy(lower_ascii(F.col("word")).alias("word")).agg(F.sum("one").cast("bigint").alias("c"))


@dataclass(frozen=True)
class WordArcs:
    """What a lattice's whole-word arcs need besides the word's own count: the training words, the distinct ones, and
    how many were seen once and twice."""

    total: int
    distinct: int
    once: int
    twice: int

    @property
    def discount(self) -> float:
        return (self.once + 0.5) / (self.once + 2 * self.twice + 1)

    def join(self, counts: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """Natural logarithms of words' probabilities, from their counts and the sums over their pieces."""
        if not self.total:
            return spelled
        with np.errstate(divide="ignore"):
            own = np.log(np.maximum(counts - self.discount, 0) / self.total)
        return np.logaddexp(own, math.log(self.discount * self.distinct / self.total) + spelled)


def fit_pieces(words: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Logarithms of the pieces' probabilities after re-estimation on the training words (word, c), each counted c times.
    As many numbers as the vocabulary has pieces come to the driver in each round."""
    log_p = Lattice(path).log_p
    trained = words.where("c > 0")
    for _ in range(rounds):
        now = log_p

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(path, now)  # noqa: B023
            total = np.zeros(lattice.size)
            for batch in in_bulk(batches):
                total += lattice.expected([w.encode() for w in batch.column(0).to_pylist()], batch.column(1).to_numpy().astype(float))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["piece", "n"])

        got = trained.select("word", "c").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        if not got:
            break
        counts = np.full(len(log_p), ADDED)
        for r in got:
            counts[r.piece] += r.n
        log_p = np.log(counts / counts.sum())
    return log_p


def score_documents(docs: DataFrame, path: str, *, head: int = HEAD, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and word_score (log10) of every row."""
    spark = docs.sparkSession
    bound_batches(spark)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), held.alias("held_out"))
    counts = stored(word_counts(rows.withColumn("train", ~F.col("held_out")), "text", "train"), "lm-words")
    n_docs = rows.where("not held_out").count()
    got = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), *[F.count(F.when(x, 1)).alias(k) for k, x in (("v", F.col("c") > 0), ("once", F.col("c") == 1), ("twice", F.col("c") == 2))]).first()
    total, distinct = got.n + n_docs, got.v + (n_docs > 0)
    under = total + 0.5 * (distinct + 1)
    arcs = WordArcs(got.n, got.v, got.once, got.twice)
    log_p = fit_pieces(counts, path, rounds)
    p_end = (n_docs + 0.5) / (total + 1.0)
    go_on = math.log10(1 - p_end)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(path, log_p)
        for batch in in_bulk(batches):
            s = lattice.log_probability([w.encode() for w in batch.column(0).to_pylist()])
            w = arcs.join(batch.column(1).to_numpy(), s)
            both = [pa.array(x / math.log(10) + go_on) for x in (s, w)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *both], names=["word", "c", "score", "whole"])

    spelled = counts.select("word", "c").mapInArrow(spell, "word string, c bigint, score double, whole double")
    base = F.log10((F.col("c") + 0.5) / F.lit(under))
    scored = stored(spelled.select("word", "c", base.alias("base"), "score", "whole"), "lm-scores")
    discard(counts)
    # the frequent words: a count threshold that at most `head` words reach, from a histogram of powers of two
    bins = {r.b: r.n for r in scored.where("c > 0").groupBy(F.floor(F.log2("c")).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()}
    bar, room = 1 << 62, head
    for b in sorted(bins, reverse=True):
        room -= bins[b]
        if room < 0:
            break
        bar = 1 << b
    common = scored.where(F.col("c") >= bar).select("word", "base", "score", "whole").collect()
    known = spark.sparkContext.broadcast(({r.word: i for i, r in enumerate(common)}, np.array([r[1:] for r in common]).reshape(-1, 3)))
    end_base, end_score = math.log10((n_docs + 0.5) / under), math.log10(p_end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        index, values = known.value
        find = index.get
        row = TaskContext.get().partitionId() << 40
        names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "whole", "word", "tf"]
        for batch in batches:
            k = batch.num_rows
            tail_row, tail_word, tail_tf, sums = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                tf = Counter(text.translate(_TABLE).split(" "))
                tf.pop("", None)
                at = np.fromiter(map(find, tf, (-1 for _ in tf)), np.int64, len(tf))
                n = np.fromiter(tf.values(), np.int64, len(tf))
                hit = at >= 0
                base, score, whole = n[hit] @ values[at[hit]] if hit.any() else (0.0, 0.0, 0.0)
                sums.append((int(n.sum()) + 1, int(n[hit].sum()) + (n_docs > 0), base + end_base, score + end_score, whole + end_score))
                words = list(tf)
                for j in np.flatnonzero(~hit).tolist():
                    tail_row.append(row + i)
                    tail_word.append(words[j])
                    tail_tf.append(int(n[j]))
            none = pa.nulls(len(tail_row), pa.int64())
            cols = list(zip(*sums, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + k)), batch.column(0), batch.column(2), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                    *(pa.array(c, pa.float64()) for c in cols[2:]), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()),
                ],
                names=names,
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(tail_row, pa.int64()), none, none.cast(pa.bool_()), none, none,
                    *[none.cast(pa.float64())] * 3, pa.array(tail_word, pa.string()), pa.array(tail_tf, pa.int64()),
                ],
                names=names,
            )
            row += k

    schema = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, whole double, word string, tf bigint"
    parts = stored(rows.select("doc_id", "text", "held_out").mapInArrow(run, schema), "lm-documents")
    tail = parts.where("word is not null").select("row", "word", "tf").join(scored, "word")
    rest = tail.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("k2"), F.sum(F.col("tf") * F.col("base")).alias("b2"), F.sum(F.col("tf") * F.col("score")).alias("s2"),
        F.sum(F.col("tf") * F.col("whole")).alias("w2"),
    )
    main = parts.where("word is null").select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "whole")
    zero = F.lit(0.0)
    return main.join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k2", F.lit(0))).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("b2", zero)).alias("base_score"), (F.col("score") + F.coalesce("s2", zero)).alias("score"),
        (F.col("whole") + F.coalesce("w2", zero)).alias("word_score"),
    )
