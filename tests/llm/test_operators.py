"""The other corpus operators against brute force, SQL or held-out pages, and their defined cases."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from quernflow.llm import block_search, crf, html_extract, lattice_lm, line_dedup, oracles, quality_rules, queries, url_filter
from quernflow.llm.html_blocks import leaf_blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_oracle(spark, duck, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    want = duck.sql(oracles.oracle_sql()[name])
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want.fetchall(), key=repr)


# 1: HTML


def test_field_on_held_out_pages():
    model = html_extract.default_model()
    right = total = 0
    for html, labels in html_extract.training_pages(100, seed=99):
        got = model.decode(html_extract.features(leaf_blocks(html)))
        right += sum(a == b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert right / total > 0.98


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(1)
    model = crf.ChainCRF({f"f{i}": tuple(r.normal(size=2)) for i in range(6)}, r.normal(size=(2, 2)), r.normal(size=2), r.normal(size=2))
    blocks = [[f"f{i}"] for i in range(6)]

    def score(path):
        s = model.begin[path[0]] + model.end[path[-1]] + sum(model.edges[a, b] for a, b in zip(path, path[1:], strict=False))
        return s + sum(model.weights[f"f{i}"][y] for i, y in enumerate(path))

    best = max(([k >> i & 1 for i in range(6)] for k in range(64)), key=score)
    assert model.decode(blocks) == best


def test_pages(spark, sf_dir):
    page = '<nav><a href="/">Menu</a></nav><article><h1>T&amp;T</h1><p>One&nbsp;&eacute;\n two<p>Three.<br>Four<div class="ad">Buy</div></article><script>x="</p>"</script><footer>&copy;</footer>'
    rows = [(1, "u", page, 0), (2, None, None, 0), (3, "u", "", 0), (4, "u", "<<a <p", 0), (None, "u", "<!-- open", 0)]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")).collect()}
    assert got[1].text == "T&T\nOne é two\nThree. Four" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == got[None].text == ""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op1_html_extract(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.DOTALL)[1]
        from html import unescape

        blocks = (" ".join(unescape(re.sub(r"</?(b|br)>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n".join(b for b in blocks if b)


def test_parts_that_are_not_the_article():
    model = html_extract.default_model()
    text = "Several of the towns in the north were flooded after a long night of rain, and more is on the way."
    pages = (
        f'<header><h1>Site name</h1></header><div class="cookie-notice"><p>{text}</p></div><article><h1>Title</h1><p>{text}</p></article>',
        f'<div id="menu"><ul><li><a href="x">A</a></li></ul></div><div id="content"><h1>Title</h1><p>{text}</p></div><div id="sidebar"><p>{text}</p></div>',
        f'<article><h1>Title</h1><p>{text}</p><section class="comments"><h3>2 comments</h3><p>{text}</p></section></article>',
        f'<main><h1>Title</h1><form><label>Mail</label><button>Subscribe</button></form><p>{text}</p></main><div id="comments"><ul><li>{text}</li></ul></div>',
        f'<article><h1>Title</h1><aside><p>{text}</p></aside><div class="advert">{text}</div><p>{text}</p></article><template><p>{text}</p></template>',
    )
    for page in pages:
        assert html_extract.main_text(f"<html><body>{page}</body></html>", model) == f"Title\n{text}"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><h1>Title</h1><p>One para here.</p><!--><p>Second para.</p><!---><p>Third one.</p></article>", "Title\nOne para here.\nSecond para.\nThird one."),
        ("<article><ul><li><a>One link item</a></li><li><a>Other link item</a></li></ul><p>Text of some length.</p></article>", "One link item\nOther link item\nText of some length."),
        ("<p>Only para.</p>", "Only para."), ("<body><h1>Head</h1><p>Para.</p></body>", "Head\nPara."), ("plain text, no markup at all.", "plain text, no markup at all."),
        ("<article><p>a <b c=\"x>y\">bold</b> text.</p><p title=it's>c &lt;d&gt;</p></article>", "a bold text.\nc <d>"), ("<article><p>Kept.</p><p>Lost <a href=\"", "Kept.\nLost"),
        ("<article><p>3 < 4 and 5 > 4.</p></article>", "3 < 4 and 5 > 4."), ("<title>a <p> b</title><article><p>Text.<script>'</p>'</script></p></article>", "Text."),
        ("<article><p>Text.</p><template><p>No.</p><template>no</template><p>No.</p></template><p>More.</p></article>", "Text.\nMore."),
    ],
)
def test_markup(page, want):
    assert html_extract.main_text(page, html_extract.default_model()) == want


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 1_600_000, "<div>" * 1_000_000 + "x", "<div><p>hello there." * 250_000, "</x>" * 1_000_000, '<a b="' * 800_000, "<!-- " * 1_000_000,
        "<p><div>" + "<label>" * 300_000 + "<li>x" * 300_000, "".join(f'<div class="{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}">t' for i in range(200_000)),
    ],
    ids="unclosed nested paragraphs strays quotes comments walls classes".split(),
)
def test_hostile_pages_take_linear_time(page):
    import time

    model = html_extract.default_model()
    began = time.process_time()
    html_extract.main_text(page, model)
    assert time.process_time() - began < 20


def test_layouts():
    """Held-out pages of each layout that come out without a wrong block."""
    model, got = html_extract.default_model(), {}
    for html, labels in html_extract.training_pages(400, seed=7):
        kind = "article" if "<article>" in html or "<article class=" in html else "main" if "<main>" in html else "fragment" if "<html>" not in html else "other"
        blocks = leaf_blocks(html)
        right = html_extract.labels_of(blocks, model)
        assert right == model.decode(html_extract.features(blocks))
        got.setdefault(kind, []).append(right == labels)
    print({k: f"{sum(v)} of {len(v)}" for k, v in got.items()})
    assert all(np.mean(v) > 0.85 for v in got.values())


def test_empty_and_repeated_pages(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>Text.</p></article>", "t", 3)] * 2, "page_id bigint, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in html_extract.extract(df).collect()] == [(1, "u", "Text.", 5)] * 2
    assert html_extract.extract(df.limit(0)).count() == 0


# 2: search


def test_search_cases(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 0.5]), (1, [1.0]), (2, []), (3, None), (4, [nan, 1.0]), (5, [inf]), (6, [None, 1.0]), (100, [0.5, -0.5]), (7, [1.0, 0.5]), (8, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = [tuple(r) for r in block_search.search(df, df.where("vec_id % 100 = 0"), k=3, shard=2).orderBy("query_id", "rank").collect()]
    one = 1024 * 1024
    assert got == [(0, 1, 7, one + 512 * 512), (0, 2, 8, one + 512 * 512), (0, 3, 1, one), (100, 1, 1, one // 2), (100, 2, 0, one // 2 - one // 4), (100, 3, 7, one // 2 - one // 4)]
    assert block_search.search(df.limit(0), df.limit(0)).count() == 0


def test_repeated_query_ids_and_clashing_names(spark):
    r = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in r.normal(size=4)], 1, "s", 2.0) for i in [100, 100, 100, 200, *range(1, 60), 7, 7]]
    rows.append(rows[0])  # repeated whole
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, shard int, asked string, id double")
    got = {}
    for x in block_search.search(df, df.where("vec_id % 100 = 0"), k=10, shard=16).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    mats = [(i, np.floor(1024 * np.array(v, np.float32).astype(float))) for i, v, *_ in rows]
    want = {}
    for i, q in mats:
        if i % 100 == 0:
            best = sorted((-int(q @ v), j) for j, v in mats if j != i)[:10]
            want.setdefault(i, []).extend((n, j, -s) for n, (s, j) in enumerate(best, 1))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} and len(got[100]) == 40


def test_blocks_are_pruned():
    r = np.random.default_rng(0)
    rows = (r.normal(size=(4096, 8)) * 50 * (1 + np.arange(4096)[:, None] // 64 % 17)).astype(np.float64).round()
    ids = r.permutation(4096)
    q = rows[:5]
    for block in (2, 16, 64):
        index = block_search.Shard(ids, rows, block)
        for (got, score), v, me in zip(index.search(ids[:5], q, 10), q, range(5), strict=True):
            full = rows @ v
            full[me] = -np.inf
            want = np.lexsort((ids, -full))[:10]
            assert got.tolist() == ids[want].tolist() and score.tolist() == full[want].tolist()
        assert index.scored < 0.7 * 5 * 4096


def test_share_scored_on_the_table(duck):
    """Vectors without structure: wide blocks prune nothing, narrow ones some."""
    got = duck.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.1/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, rows = np.array([i for i, _ in got]), np.floor(1024 * np.array([v for _, v in got], float))
    own = np.flatnonzero(ids % 100 == 0)
    share = {b: block_search.scored_share(ids, rows, ids[own], rows[own], block=b) for b in (2, 4, 16, 64)}
    print("share scored by block size:", share)
    assert share[block_search.BLOCK] < 0.9 and share[64] == 1


# 3: quality


def slow_statistics(text):
    w = WORD.findall(text or "")
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) for k in range(3) if grams[tuple(w[i : i + 3])] > 1}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, sf_dir):
    texts = [None, "", " \n\t\n", "a", "a b c a b c", "a a a a", "x\nx\n\nx \n", "é#é <b> $1\x0b2 " * 30, "w " * 5000]
    df = spark.createDataFrame([(i, t, 5, True) for i, t in enumerate(texts)], "doc_id bigint, text string, n_words int, kept boolean")
    rows, at, failed, kept = quality_rules.judge(df, [])
    assert rows.columns[:4] == df.columns and len(set(rows.columns)) == len(rows.columns)
    for r in rows.collect():
        got = tuple(r[at[k]] for k in quality_rules.STATISTICS[:5])
        assert got == slow_statistics(texts[r.doc_id])
        assert r[failed] == (got[0] < 50 or 100 * got[4] > 50 * got[0]) and r[kept] == (not r[failed])
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op3_quality_rules(spark, sf_dir).collect():
        assert tuple(r)[1:6] == slow_statistics(text[r.doc_id])
        assert not (r.base_failed and r.kept)
    assert quality_rules.filter_quality(df.limit(0), []).count() == 0


def condition(name, top, bottom, above, threshold):
    return quality_rules.Condition(name, top, bottom, above, threshold)


def test_emitted_expression(spark):
    """The chain that a non-empty list emits, against the rules applied by hand, in their order."""
    texts = [None, "", *("word " * 60 + "#" * k for k in range(0, 80, 9)), "A B C " * 40, *(" ".join(f"w{i}" for i in range(60 + k)) for k in range(0, 300, 40))]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, n_symbols int")
    rules = [
        (condition("symbols_per_word", "n_symbols", "n_words", True, 0.3),),
        (condition("n_words", "n_words", None, True, 200.0), condition("chars_per_word", "word_chars", "n_words", False, 3.9)),
    ]
    rows, at, failed, kept = quality_rules.judge(df, rules)
    found = set()
    for r in rows.collect():
        n, chars, symbols = (r[at[k]] for k in ("n_words", "word_chars", "n_symbols"))
        bad = symbols / max(n, 1) >= 0.3 or (n >= 200 and chars / max(n, 1) <= 3.9)
        assert r[kept] == (not r[failed] and not bad)
        found.add((r[failed], bad))
    assert (False, True) in found and (False, False) in found
    assert "CASE WHEN" in str(quality_rules.verdict(rules, at)) and quality_rules.filter_quality(df, rules).columns == df.columns


def test_learning_does_not_depend_on_order(spark):
    docs = [(i, "w " * (60 + i % 40) + "# " * (i % 3 * 30)) for i in range(300)] + [(i, "other text " * 40) for i in range(0, 300, 7)]
    labels = spark.createDataFrame([(i, 0 if i % 3 else 1) for i in range(300)] + [(5, None), (None, 1), (6, 0)], "doc_id bigint, quality int")
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    one = quality_rules.fit(df, labels)
    assert one and one == quality_rules.fit(df.repartition(5).orderBy(F.desc("text")), labels.repartition(3))
    assert quality_rules.fit(df, labels.limit(0)) == [] == quality_rules.fit(df.limit(0), labels)


def test_long_text_statistics(spark):
    text = "\n".join(f"line {i} of {i % 50} words" for i in range(40_000))
    rows, at, _, _ = quality_rules.judge(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), [])
    assert tuple(rows.first()[at[k]] for k in quality_rules.STATISTICS[:5]) == slow_statistics(text)


def test_rules_are_learned_and_held_out():
    r = np.random.default_rng(3)
    n = 3000
    words = r.integers(50, 900, n)
    bad = r.random(n) < 0.2
    kind = r.integers(0, 2, n)
    symbols = np.where(bad & (kind == 0), words, r.integers(0, 5, n))
    upper = np.where(bad & (kind == 1), words * 4, r.integers(0, 30, n))
    stats = np.stack([words, words * 5, symbols, 0 * words, 0 * words, words // 20 + 1, upper, 0 * words, 0 * words], axis=1)
    rules = quality_rules.learn_rules(stats[:2000], bad[:2000])
    assert 1 <= len(rules) <= 6
    values = dict(zip(quality_rules.STATISTICS, stats[2000:].T, strict=True))
    hit = np.zeros(1000, bool)
    for rule in rules:
        one = np.ones(1000, bool)
        for c in rule:
            v = values[c.top] / np.maximum(values[c.bottom], 1) if c.bottom else values[c.top]
            one &= v >= c.threshold if c.above else v <= c.threshold
        hit |= one
    assert (hit == bad[2000:]).mean() > 0.97
    assert quality_rules.learn_rules(stats, np.ones(n, bool)) == [] and quality_rules.learn_rules(stats[:0], bad[:0]) == []


# 5: URLs


@pytest.mark.parametrize(
    ("url", "want"),
    [
        (None, ("", "", None, "allow")), ("no scheme", ("", "", None, "allow")), ("http://A.Example.NET/en/x?q", ("a.example.net", "/en/x", "example.net/en/", "allow")),
        ("http://b.net/x", ("b.net", "/x", "net/", "block")), ("http://b.net", ("b.net", "", None, "allow")), ("http://x.org/fr/a#b", ("x.org", "/fr/a", "org/fr/", "allow")),
        ("http://myexample.com/de/", ("myexample.com", "/de/", None, "allow")), ("x://example.com/de/casino", ("example.com", "/de/casino", "example.com/de/", "block")),
        ("http://casino.io/", ("casino.io", "/", None, "block")), ("http://casinos.io/", ("casinos.io", "/", None, "allow")), ("http://free.io/free", ("free.io", "/free", None, "allow")),
        ("http://free.io/Cheap", ("free.io", "/Cheap", None, "block")), ("http://a.io/?casino", ("a.io", "/", None, "allow")), ("http://?x/", ("", "", None, "allow")),
    ],
)
def test_urls(url, want):
    assert url_filter.UrlFilter().judge(url) == want


def test_url_rows(spark, tmp_path):
    rows = [(1, "http://free.io/Cheap", "h", "v"), (1, "http://free.io/Cheap", "h", "v"), (2, None, "h", "v"), (3, "", "h", "v"), (None, "http://x/" + "cheap-" * 200_000, "h", "v"), (4, "http://" + "a." * 300_000 + "net/free/bet", "h", "v")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, host string, rule string")
    got = sorted(((r.page_id, r.host[:6], r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()), key=str)
    assert got == [(1, "free.i", None, "block")] * 2 + [(2, "", None, "allow"), (3, "", None, "allow"), (4, "a.a.a.", "net/", "block"), (None, "x", None, "allow")]
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    (tmp_path / "terms").write_text("# own terms\nstrict CHEAP\nsoft x\n\nsoft free\n")
    own = url_filter.read_vocabulary(spark, str(tmp_path / "terms"))
    assert own == {"strict": ("cheap",), "soft": ("x", "free")}
    assert {r.verdict for r in url_filter.filter_urls(df.where("page_id = 1 or page_id is null"), **own).collect()} == {"block"}
    with pytest.raises(ValueError, match="more than"):
        url_filter.read_vocabulary(spark, str(tmp_path / "terms"), most=3)


def test_many_rules_and_ties():
    rules = [("block", "a.b/"), ("allow", "b/xx"), ("allow", "b/"), ("block", "c.a.b/x/")]
    judge = url_filter.UrlFilter(rules=rules).judge
    assert judge("q://z.a.b/xx")[2:] == ("a.b/", "block") and judge("q://b/xxx")[2:] == ("b/xx", "allow")  # a tie: the first
    assert judge("q://1.c.a.b/x/y")[2:] == ("c.a.b/x/", "block") and judge("q://ab/x")[2:] == (None, "allow") and judge("q://.b/")[2:] == ("b/", "allow")


# 7: lines


def test_lines(spark):
    line = "This line is long enough to be counted as a passage"
    texts = [None, "", f"{line}\nown 1", f" {line.upper()} \n\nown 2\n{line}", line, f"a\n{line}", f"{line}\nb", "short\nshort", f"{line}\r\nc"]
    ids = [1, 2, 3, 4, 5, 6, 7, 8, None]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in zip(ids, texts, strict=True)], "doc_id bigint, text string, n_lines int, keep int")
    rows, n_lines, n_dropped = line_dedup.dedup_lines(df)
    got = {r.doc_id: (r.text, r[n_lines], r[n_dropped]) for r in rows.collect()}
    assert got == {
        1: (None, 1, 0), 2: ("", 1, 0), 3: ("own 1", 2, 1), 4: ("\nown 2", 4, 2), 5: ("", 1, 1), 6: ("a", 2, 1), 7: (f"{line}\nb", 2, 0), 8: ("short\nshort", 2, 0), None: ("c", 2, 1),
    }
    assert line_dedup.dedup_lines(df.limit(0))[0].count() == 0


def decided(parts, min_docs, most, batch):
    """The (hash, doc, pos) to drop, from the marks of each task's sorted rows."""
    out, opened = set(), []
    for rows in parts:
        marks = line_dedup.Marks(min_docs, most)
        found = []
        for a in range(0, len(rows), batch):
            found += marks.add([np.array(c) for c in zip(*rows[a : a + batch], strict=True)])
        for b in [*found, *marks.end()]:
            for m in b.to_pylist():
                if m["open"]:
                    opened.append(m)
                else:
                    assert (m["h1"], m["doc"], m["pos"]) not in out
                    out.add((m["h1"], m["doc"], m["pos"]))
    for key in {m["h1"] for m in opened}:
        mine, docs = [m for m in opened if m["h1"] == key], {}
        for m in mine:
            docs[m["doc"]] = max(docs.get(m["doc"], 0), m["n_docs"])
        if sum(v or 1 for v in docs.values()) >= min_docs:
            out |= {(key, m["doc"], m["pos"]) for m in mine if m["pos"] >= 0 and m["doc"] != max(docs)}
    return out


@pytest.mark.parametrize("seed", range(60))
def test_runs_over_tasks(seed):
    """Runs that are cut anywhere between tasks and batches give the lines that a plain count gives."""
    r = np.random.default_rng(seed)
    rows = sorted({(int(r.integers(0, 6) ** 2 // 5), int(r.integers(0, 9)), int(r.integers(0, 5))) for _ in range(90)}, key=lambda x: (x[0], -x[1], x[2]))
    full = [(h, 0, d, 0, p, 9) for h, d, p in rows]
    cuts = [0, *sorted(r.integers(0, len(full), 3).tolist()), len(full)]
    docs = {}
    for h, d, _ in rows:
        docs.setdefault(h, set()).add(d)
    want = {x for x in rows if len(docs[x[0]]) >= 6 and x[1] != max(docs[x[0]])}
    assert decided([full[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], 6, int(r.integers(1, 40)), int(r.integers(1, 50))) == want


def test_lines_of_repeated_rows_and_clashing_names(spark):
    line = "This line is long enough to be counted as a passage"
    rows = [(i, f"{line}\n{i}\n{line}", 1, "x") for i in (1, 2, 3, 3, 4, 5)] + [(9, "\n".join([line] * 30_000), 1, "x")] + [(8, "\n".join([line] * 30_000), 1, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, doc int, row string")
    out, n_lines, n_dropped = line_dedup.dedup_lines(df)
    got = sorted((r.doc_id, len(r.text), r[n_lines], r[n_dropped], r.doc, r.row) for r in out.collect())
    assert got == [*((i, 1, 3, 2, 1, "x") for i in (1, 2, 3, 3, 4, 5)), (8, 0, 30_000, 30_000, 1, "x"), (9, len(rows[-1][1]), 30_000, 0, 1, "x")]


def test_lines_are_dropped_without_files(spark, monkeypatch):
    """Every file that a task creates starts processes that are counted with the executor's memory."""
    from pyspark.sql import DataFrameWriter

    line = "This line is long enough to be counted as a passage"
    df = spark.createDataFrame([(i, f"{line}\n{i}") for i in range(6)], "doc_id bigint, text string")
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda *_: pytest.fail("a table was written"))
    rows, _, n_dropped = line_dedup.dedup_lines(df)
    assert {r.doc_id: (r.text, r[n_dropped]) for r in rows.collect()} == {i: (str(i), 1) for i in range(5)} | {5: (f"{line}\n5", 0)}


# 9: language model


def piece_table(log_p):
    """Probabilities by (bytes, whether the piece ends a word)."""
    parts, ends = lattice_lm.pieces(queries.vocabulary())
    return {(a, b): math.exp(x) for a, b, x in zip(parts, ends, log_p, strict=True)}


def slow_forward(w, p, longest=60):
    a = [1.0] + [0.0] * len(w)
    for j in range(1, len(w) + 1):
        a[j] = sum(a[i] * p.get((w[i:j], j == len(w)), 0) for i in range(max(0, j - longest), j))
    return a[-1]


def segmentations(w, p, last=True):
    if not w:
        yield []
    for k in range(1, len(w) + 1):
        if (w[:k], k == len(w)) in p:
            for rest in segmentations(w[k:], p):
                yield [(w[:k], k == len(w)), *rest]


def test_pieces_against_all_segmentations(spark):
    """Expectation maximisation and the marginal likelihood by listing every segmentation of every word."""
    counts = {"the": 5, "theatre": 2, "a": 3, "cat": 1, "é": 2, "x1!?": 1}
    parts, ends = lattice_lm.pieces(queries.vocabulary())
    keys = list(zip(parts, ends, strict=True))
    p = {k: 1 / (i + 1) for i, k in enumerate(keys)}
    p = {k: v / sum(p.values()) for k, v in p.items()}
    for _ in range(lattice_lm.ROUNDS):
        expected = dict.fromkeys(keys, lattice_lm.ADDED)
        for w, c in counts.items():
            ways = list(segmentations(w.encode(), p))
            each = [math.prod(p[x] for x in s) for s in ways]
            for s, m in zip(ways, each, strict=True):
                for x in s:
                    expected[x] += c * m / sum(each)
        p = {k: v / sum(expected.values()) for k, v in expected.items()}
    got = lattice_lm.fit_pieces(spark.createDataFrame([*counts.items(), ("unseen", 0)], "word string, c bigint"), queries.vocabulary())
    assert np.exp(got) == pytest.approx([p[k] for k in keys])
    docs = [(i, " ".join([w] * c), "s") for i, (w, c) in enumerate(counts.items()) if zlib.crc32(str(i).encode()) % 5 != 1]
    assert len(docs) < len(counts) or zlib.crc32(b"7") % 5 != 1
    rows = {r.doc_id: r for r in lattice_lm.score_documents(spark.createDataFrame([*docs, (7, "theatre cat", "s")], "doc_id bigint, text string, word string"), queries.vocabulary(), rounds=0).collect()}
    p = {k: 1 / (i + 1) for i, k in enumerate(keys)}
    whole = sum(p.values())
    for i, text, _ in [*docs, (7, "theatre cat", "s")]:
        words = text.split()
        end = (sum(not r.held_out for r in rows.values()) + 0.5) / (rows[i].train_tokens + 1)
        want = math.log10(end) + sum(math.log10(sum(math.prod(p[x] / whole for x in s) for s in segmentations(w.encode(), p)) * (1 - end)) for w in words)
        assert rows[i].score == pytest.approx(want)


def test_scores(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    words = {r.doc_id: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) for r in rows}
    train = [d for d in words if zlib.crc32(str(d).encode()) % 5 != 1]
    counts = Counter(w for d in train for w in words[d])
    total, distinct = sum(counts.values()) + len(train), len(counts) + 1
    whole, some = queries.op9_lattice_lm(spark, sf_dir).collect(), None
    for r in whole:
        c = [*(counts[w] for w in words[r.doc_id]), len(train)]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(c), sum(x > 0 for x in c), total)
        assert r.base_score == pytest.approx(sum(math.log10((x + 0.5) / (total + 0.5 * (distinct + 1))) for x in c))
        assert r.held_out == (r.doc_id not in train) and r.score < 0
    log_p = lattice_lm.fit_pieces(spark.createDataFrame([(w, c) for w, c in counts.items()], "word string, c bigint"), queries.vocabulary())
    p = piece_table(log_p)
    each = Counter(counts.values())
    d, n, v = (each[1] + 0.5) / (each[1] + 2 * each[2] + 1), sum(counts.values()), len(counts)
    p_end = (len(train) + 0.5) / (total + 1)
    for r in whole[::10]:
        spelled = [slow_forward(w.encode(), p) for w in words[r.doc_id]]
        go_on = math.log10(1 - p_end)
        assert r.score == pytest.approx(sum(math.log10(s) + go_on for s in spelled) + math.log10(p_end))
        want = [math.log10(max(counts[w] - d, 0) / n + d * v / n * s) + go_on for w, s in zip(words[r.doc_id], spelled, strict=True)]
        assert r.word_score == pytest.approx(sum(want) + math.log10(p_end))
    some = {r.doc_id: r.score for r in lattice_lm.score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), queries.vocabulary(), head=50).collect()}
    assert all(some[r.doc_id] == pytest.approx(r.score) for r in whole)  # broadcast and join agree


def test_lattice():
    lattice = lattice_lm.Lattice(queries.vocabulary())
    parts, ends = lattice_lm.pieces(queries.vocabulary())
    p = {(a, b): math.exp(x) for a, b, x in zip(parts, ends, lattice.log_p, strict=True)}

    def slow(w):
        a = [1.0] + [0.0] * len(w)
        for j in range(1, len(w) + 1):
            a[j] = sum(a[i] * p.get((w[i:j], j == len(w)), 0) for i in range(j))
        return math.log(a[-1])

    words = [w.encode() for w in ("a", "the", "thanedble", "éàü", "x1!?", "abc", "abd", "ab`", "zz" * 20)]
    assert lattice.log_probability(words) == pytest.approx([slow(w) for w in words])
    got = lattice.expected(words, np.arange(1.0, len(words) + 1))
    assert (got * [len(x) for x in parts]).sum() == pytest.approx(sum((i + 1) * len(w) for i, w in enumerate(words)))


@pytest.mark.parametrize("size", [3, 7, 40])
def test_long_words_in_stretches(monkeypatch, size):
    lattice = lattice_lm.Lattice(queries.vocabulary())
    words = ["".join(chr(97 + i * i * k % 26) for i in range(n)).encode() for k, n in ((3, 60), (5, 41), (7, 200), (1, 80))] + [b"thethethe" * 9, b"ethethe_1" * 9, "é".encode() * 50]
    counts = np.arange(1.0, len(words) + 1)
    want, whole = lattice.log_probability(words), lattice.expected(words, counts)
    monkeypatch.setattr(lattice_lm, "LONG", size)
    assert lattice.log_probability(words) == pytest.approx(want)
    assert lattice.expected(words, counts) == pytest.approx(whole, abs=1e-9)


def test_whole_word_arcs():
    counts = np.array([3, 2, 1, 1, 0])
    arcs = lattice_lm.WordArcs(7, 4, 2, 1)
    spelled = np.log([0.1, 0.2, 0.3, 0.15, 0.25])
    assert np.exp(arcs.join(counts, spelled)).sum() == pytest.approx(1)
    assert lattice_lm.WordArcs(0, 0, 0, 0).join(counts * 0, spelled).tolist() == spelled.tolist()
    assert np.isfinite(lattice_lm.WordArcs(4, 2, 0, 2).join(np.array([2, 2, 0]), spelled[:3])).all()


def test_bulk_batches_keep_all_rows():
    import pyarrow as pa

    sizes = [0, 1500, 40_000, 7, 1500, 0]
    batches = [pa.RecordBatch.from_arrays([pa.array([f"{k}-{i}" for i in range(n)], pa.string())], names=["word"]) for k, n in enumerate(sizes)]
    out = list(lattice_lm.in_bulk(iter(batches)))
    assert [x for b in out for x in b.column(0).to_pylist()] == [x for b in batches for x in b.column(0).to_pylist()]
    assert len(out) == 2 and list(lattice_lm.in_bulk(iter([]))) == []


def test_score_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "A b\x0bc", 0), (None, "a", 0), (3, "A b\x0bc", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    got = lattice_lm.score_documents(df, queries.vocabulary()).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 2, 4, 4]
    assert lattice_lm.score_documents(df.limit(0), queries.vocabulary()).count() == 0


# the pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf_dir)
        assert at.columns == docs.columns
    assert corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().count() == at.select("doc_id").distinct().count() <= docs.count()
