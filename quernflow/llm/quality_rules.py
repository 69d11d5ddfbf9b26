"""Operator 3: quality rules as learned decision lists, in DataFrame functions alone.

Statistics of every text are native expressions over its word and line arrays. Rules are learned on the driver from
the statistics of a bounded sample of labelled rows by sequential covering: a rule grows by the threshold with the best
information gain on two thirds of the sample, is pruned back on the other third, and is kept while it stays precise
there; what it covers is taken out and the next rule is sought. The list is emitted as an ordered chain of Spark
conditional expressions: the first rule that holds rejects, the end of the chain keeps.

Defined cases: null and empty texts have no words and fail the base rule; very long texts are counted whole, as arrays
of their words; null labels take no part, of an id's several labels the least counts, of several texts the one with the
least statistics; of thresholds of equal gain (ties) the first in the order of the features and the lowest wins; a table
without labels, or with one class only, gives an empty list, which keeps all that passes the base rule; repeated rows
each give a row; an empty table gives no rows; extra columns pass through `add_statistics`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, fresh, words_of

#: Labelled rows that a list is learned from at most, taken in the order of a hash of their ids.
MAX_LABELLED = 20_000
#: Words below which a text fails, and percent of words in repeated windows above which it does.
MIN_WORDS, MAX_REPEATED = 50, 50
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Statistics of a text, in the order of the result.
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_pipes")
#: What thresholds are sought on, as (name, numerator, denominator).
RATIOS = (
    ("symbols_per_word", "n_symbols", "n_words"),
    ("bangs_per_word", "n_bangs", "n_words"),
    ("pipes_per_word", "n_pipes", "n_words"),
    ("upper_per_char", "n_upper", "word_chars"),
    ("repeated_words", "n_repeat_words", "n_words"),
    ("duplicate_lines", "n_dup_lines", "n_lines"),
    ("chars_per_word", "word_chars", "n_words"),
)


def add_statistics(docs: DataFrame, names: list[str], text_col: str = "text") -> DataFrame:
    """`docs` with the statistics as long columns `names`, in the order of STATISTICS. Arrays are projected before
    lambdas refer to them, so no array is built again for each of its elements."""
    text, words, lines, grams, order, spots = fresh(docs, "_text", "_words", "_lines", "_grams", "_order", "_spots")
    def gone(pattern: str) -> Column:
        return (F.length(text) - F.length(F.regexp_replace(F.col(text), pattern, ""))).cast("bigint")

    one = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    two = one.withColumns(
        {
            words: words_of(F.col(text)),
            lines: F.filter(F.split(F.col(text), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != ""),
        }
    )
    at = F.col(words)
    three = two.withColumn(
        grams,
        F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(at, i), F.get(at, i + 1), F.get(at, i + 2)))),
    )
    # windows by hash; those next to an equal one are repeated
    four = three.withColumn(order, F.sort_array(F.transform(F.col(grams), lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    o = F.col(order)
    same = lambda x, k: F.get(o, k).getField("h") == x.getField("h")
    five = four.withColumn(
        spots,
        F.sort_array(F.transform(F.filter(o, lambda x, k: F.coalesce(same(x, k + 1), F.lit(False)) | ((k > 0) & same(x, F.greatest(k - 1, F.lit(0))))), lambda x: x.getField("i"))),
    )
    s = F.col(spots)
    covered = F.aggregate(
        F.transform(s, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - x, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, b: a + b
    )
    made = {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.length(F.regexp_replace(F.col(text), "[ \\t-\\r]+", "")).cast("bigint"),
        "n_symbols": gone(f"[{SYMBOLS}]"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("bigint")),
        "n_lines": F.size(lines).cast("bigint"),
        "n_upper": gone("[A-Z]+"),
        "n_bangs": gone("!+"),
        "n_pipes": gone("[|]+"),
    }
    # A generator of one row: filters on statistics stay above it. Pushed below, each would repeat the whole expression.
    return five.select(*docs.columns, F.inline(F.array(F.struct(*[made[k].alias(n) for k, n in zip(STATISTICS, names, strict=True)]))))


@dataclass(frozen=True)
class Condition:
    """A threshold on a statistic or a ratio of two: value >= threshold, or value <= threshold."""

    name: str
    top: str
    bottom: str | None
    above: bool
    threshold: float

    def column(self, at: dict[str, str]) -> Column:
        value = F.col(at[self.top]).cast("double")
        if self.bottom:
            value = value / F.greatest(F.col(at[self.bottom]), F.lit(1)).cast("double")
        return value >= F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _features(stats: np.ndarray) -> list[tuple[str, str, str | None, np.ndarray]]:
    col = dict(zip(STATISTICS, stats.T, strict=True))
    out = [(n, a, b, col[a] / np.maximum(col[b], 1)) for n, a, b in RATIOS]
    return [*out, ("n_words", "n_words", None, col["n_words"])]


def _holds(rule: list[tuple[int, bool, float]], values: list[np.ndarray]) -> np.ndarray:
    out = np.ones(len(values[0]), bool)
    for f, above, t in rule:
        out &= values[f] >= t if above else values[f] <= t
    return out


def _best(values: list[np.ndarray], bad: np.ndarray, inside: np.ndarray) -> tuple[float, tuple[int, bool, float] | None]:
    """The threshold with the greatest information gain among the rows inside: FOIL's measure."""
    p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
    base = np.log2(p0 / (p0 + n0))
    gain, found = 0.0, None
    rows = np.flatnonzero(inside)
    for f, v in enumerate(values):
        order = rows[np.argsort(v[rows], kind="stable")]
        x, y = v[order], bad[order]
        change = np.flatnonzero(x[1:] != x[:-1]) + 1  # a threshold lies between two values
        if not len(change):
            continue
        below_p = np.cumsum(y)[change - 1]
        below_n = change - below_p
        for above, p, n in ((True, p0 - below_p, n0 - below_n), (False, below_p, below_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                g = np.where(p > 0, p * (np.log2(p / (p + n)) - base), 0)
            k = int(np.argmax(g))
            if g[k] > gain + 1e-9:
                a, b = x[change[k] - 1], x[change[k]]
                gain, found = float(g[k]), (f, above, float((a + b) / 2))
    return gain, found


def learn_rules(stats: np.ndarray, bad: np.ndarray, *, max_rules: int = 12, max_conditions: int = 4, precision: float = 0.98, least: int = 3) -> list[Rule]:
    """An ordered list of rules that reject. stats: rows of STATISTICS; bad: the rows to reject. A rule must cover
    `least` rows of the pruning part with the given precision there. Rows are split by their order."""
    if not len(stats) or bad.all() or not bad.any():
        return []
    features = _features(stats.astype(float))
    values = [v for *_, v in features]
    grow = np.arange(len(bad)) % 3 != 2
    left = np.ones(len(bad), bool)
    rules: list[Rule] = []
    while len(rules) < max_rules and (left & grow & bad).any():
        rule: list[tuple[int, bool, float]] = []
        inside = left & grow
        while len(rule) < max_conditions and (inside & ~bad).any():
            gain, found = _best(values, bad, inside)
            if found is None:
                break
            rule.append(found)
            inside = left & grow & _holds(rule, values)
        if not rule:
            break
        test = left & ~grow

        def worth(r: list) -> float:
            c = test & _holds(r, values)
            p, n = int((c & bad).sum()), int((c & ~bad).sum())
            return (p - n) / (p + n) if p + n else -1.0

        best = rule
        for k in range(1, len(rule)):
            if worth(rule[:k]) >= worth(best):
                best = rule[:k]
                break
        covered = _holds(best, values)
        hit = test & covered
        if (hit & bad).sum() < least or (hit & bad).sum() < precision * hit.sum():
            break
        rules.append(tuple(Condition(features[f][0], features[f][1], features[f][2], above, t) for f, above, t in best))
        left &= ~covered
    return rules


def verdict(rules: list[Rule], at: dict[str, str]) -> Column:
    """The list as an ordered conditional expression over statistics columns (`at`: statistic to column name)."""
    out = None
    for rule in rules:
        test = rule[0].column(at)
        for c in rule[1:]:
            test = test & c.column(at)
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Learn a list from labelled rows (label 0 rejects). At most `max_labelled` of them are read: the first in the
    order of a hash of their ids."""
    sample = (
        labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("label"))
        .where("id is not null and label is not null")
        .groupBy("id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_labelled)
    )
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), "id")  # bounded by max_labelled
    # of documents that share an id the one with the least statistics counts: as many rows as labels
    got = add_statistics(rows, list(STATISTICS)).groupBy("id", "label").agg(F.min(F.struct(*STATISTICS)).alias("s"))
    found = sorted(got.collect(), key=lambda r: r.id)
    return learn_rules(np.array([tuple(r.s) for r in found], float).reshape(len(found), len(STATISTICS)), np.array([r.label == 0 for r in found], bool))


def judge(docs: DataFrame, rules: list[Rule], *, text_col: str = "text") -> tuple[DataFrame, dict[str, str], str, str]:
    """`docs` with statistics, base_failed and kept; the names of the added columns are returned with it."""
    names = fresh(docs, *STATISTICS, "base_failed", "kept")
    at = dict(zip(STATISTICS, names, strict=False))
    failed, kept = names[-2:]
    rows = add_statistics(docs, names[: len(STATISTICS)], text_col)
    n, rep = F.col(at["n_words"]), F.col(at["n_repeat_words"])
    rows = rows.withColumn(failed, (n < MIN_WORDS) | (100 * rep > MAX_REPEATED * n))
    return rows.withColumn(kept, ~F.col(failed) & verdict(rules, at)), at, failed, kept


def filter_quality(docs: DataFrame, rules: list[Rule], *, text_col: str = "text") -> DataFrame:
    """The rows that pass the base rule and the list, with their own columns."""
    rows, _, _, kept = judge(docs, rules, text_col=text_col)
    return rows.where(F.col(kept)).select(*docs.columns)
