"""Operator 5: URL filter with host and path rules and a weighted vocabulary.

A rule (host, path) fits its host and all subdomains where the URL's path starts with the rule's; the longest one wins
and decides. Elsewhere one Aho-Corasick pass finds the terms of a vocabulary in host and path. A term counts only
between boundaries (no ASCII letter or digit on either side); one strict term rejects, or `soft_limit` distinct soft
ones.

The shipped vocabulary is a small example; `read_vocabulary` loads own lists, which travel to the workers once.

Defined cases: a null URL and one without `://` have an empty host and path, no rule and no terms, and are allowed; very
long URLs are searched whole, in one pass; of rules of one length (ties) the one given first wins; a term that is both
strict and soft is strict, a term given twice counts once; an empty table gives no rows; repeated rows each give a row;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, bound_batches

#: Rules as (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Terms of which one is enough, and terms of which several are.
STRICT = ("adult", "casino", "escort", "porn", "spam", "viagra", "warez", "xxx")
SOFT = ("ads", "bet", "bets", "bonus", "cheap", "free", "jackpot", "loan", "loans", "pills", "poker", "track", "tracker", "win")
SOFT_LIMIT = 2
#: Terms that a loaded vocabulary may hold; larger ones are refused.
MAX_TERMS = 1_000_000
_LOW = str.maketrans(UPPER, LOWER)
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of a URL."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    return (rest.translate(_LOW), "") if slash < 0 else (rest[:slash].translate(_LOW), rest[slash:])


class UrlFilter:
    """Rules and vocabulary in matching form."""

    def __init__(self, rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT):
        import ahocorasick

        self.rules: dict[str, list[tuple[int, str, str, str]]] = {}
        for i, (what, text) in enumerate(rules):
            host, path = text.split("/", 1)
            self.rules.setdefault(host, []).append((i, text, what, "/" + path))
        self.labels = max((h.count(".") + 1 for h in self.rules), default=0)
        self.limit = soft_limit
        self.terms = ahocorasick.Automaton()
        weights = dict.fromkeys(soft, 1) | dict.fromkeys(strict, soft_limit)
        for term, weight in weights.items():
            self.terms.add_word(term, (term, weight))
        if weights:
            self.terms.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits, and its verdict. Looked up by the host's last labels, as many as any rule has."""
        fits = []
        suffix = None
        for label in reversed(host.rsplit(".", self.labels)[-self.labels :] if self.labels else ()):
            suffix = label if suffix is None else f"{label}.{suffix}"
            fits += [(-len(text), i, text, what) for i, text, what, p in self.rules.get(suffix, ()) if path.startswith(p)]
        return min(fits)[2:] if fits else None

    def weight(self, text: str) -> int:
        """The summed weights of the distinct terms between boundaries."""
        found = {}
        for end, (term, weight) in self.terms.iter(text) if len(self.terms) else ():
            start = end + 1 - len(term)
            if (start == 0 or text[start - 1] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
                found[term] = weight
        return sum(found.values())

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        """Host, path, rule and verdict."""
        host, path = split_url(url)
        rule = self.rule(host, path)
        if rule:
            return host, path, *rule
        return host, path, None, "block" if self.weight(host + path.translate(_LOW)) >= self.limit else "allow"


def read_vocabulary(spark: SparkSession, path: str, most: int = MAX_TERMS) -> dict[str, tuple[str, ...]]:
    """The terms of a text file, one a line as `strict <term>` or `soft <term>`, as arguments of `filter_urls`. Blank lines
    and those that begin with # are passed over; terms are lower-cased."""
    lines = [r[0].strip() for r in spark.read.text(path).limit(most + 1).collect()]
    if len(lines) > most:
        raise ValueError(f"{path}: more than {most} lines")
    out: dict[str, list[str]] = {"strict": [], "soft": []}
    for line in lines:
        if line and not line.startswith("#"):
            kind, _, term = line.partition(" ")
            if kind not in out or not term.strip():
                raise ValueError(f"{path}: '{line}' is neither 'strict <term>' nor 'soft <term>'")
            out[kind].append(term.strip().translate(_LOW))
    return {k: tuple(dict.fromkeys(v)) for k, v in out.items()}


_made: dict[str, UrlFilter] = {}


def filter_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", **vocabulary) -> DataFrame:
    """page_id, host, path, rule and verdict of every row."""
    bound_batches(pages.sparkSession)
    shared, key = pages.sparkSession.sparkContext.broadcast(vocabulary), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _made:  # a worker builds its automaton once
            _made.clear()
            _made[key] = UrlFilter(**shared.value)
        judge = _made[key].judge
        for batch in batches:
            rows = [judge(u) for u in batch.column(1).to_pylist()]
            cols = zip(*rows, strict=True) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), pa.string()) for c in cols)], names=["page_id", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return rows.mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string")
