"""Main text, source divergence and lexical search against plain loops, and their edge cases."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm import divergence, extract, lexical

LONG = "The river carries seven silent letters past the old stone bridge every morning before the market opens and the yellow music starts again in the garden."

PAGES = [
    (f"<html><body><div id='nav'><a href=x>Home</a> <a href=y>About us</a></div><div id='content'><h1>Title here</h1><p>{LONG}</p><p>Short.</p><ul><li>One</li><li>Two</li></ul></div><div id='sidebar'><p>{LONG}</p></div><div id='footer'>c 2020</div></body></html>", f"Title here {LONG} Short. One Two"),
    (f"<body><header><h1>Site</h1></header><main><article><h1>T</h1><p>a</p><aside>{LONG}</aside><p>b</p></article></main><section class='comments'><h2>Comments</h2><p>{LONG}</p></section><form><p>Search</p></form><footer>x</footer>", "T a b"),
    (f"<body><div class='cookie-banner'>{LONG}</div><div class='article-body'><p>a&nbsp;b &lt;c&gt; &#8217;</p><div class='ad'>{LONG}</div><p>x <b>y</b>z<br>w</p><div class='comment-list'>{LONG}</div></div>", "a b <c> ’ x yz w"),
    (f"<body><div>Home</div><div><h2>Big news today</h2><p>{LONG}</p><p>Fine.</p><p>{LONG}</p></div><div>Copyright</div></body>", f"Big news today {LONG} Fine. {LONG}"),
    (f"<nav>a</nav><article><h1>T</h1><p>x</p><div class='shareButtons'>Share this</div><form><input><label>Email</label></form></article><div role=alert>{LONG}</div>", "T x"),
    ("<script>var a = '<p>no</p>';</script><style>p{}</style><title>t</title><article><p>only<p>two<!-- no --></article>", "only two"),
    ("<article><p title='a > b'>kept</p><p class=\"cut", "kept"),
    ("<article><p>a < b and 3 <4 &amp; c &am</p>", "a < b and 3 <4 & c &am"),
    ("", ""),
    (None, ""),
    ("no markup", ""),
    (f"<nav><a>x</a></nav><div class=ad>{LONG}</div><article><header><h1>Big title</h1><p class=byline>By me</p></header><p>{LONG}</p><p>end</p></article><aside>{LONG}</aside>", f"Big title {LONG} end"),
    ("<header><h1>Site name</h1></header><article><header><h2>T</h2></header><p>one</p></article>", "T one"),
]


def test_main_texts(spark):
    pages = spark.createDataFrame([(i, f"u{i}", h, "clash") for i, (h, _) in enumerate(PAGES)] + [(None, None, "<article>x</article>", None)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in extract.extract(pages.union(pages.where("page_id = 0"))).collect()}
    assert [got[i]["text"] for i in range(len(PAGES))] == [w for _, w in PAGES]
    assert got[None]["text"] == "x" and got[None]["url"] is None and got[0]["url"] == "u0"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert extract.extract(pages.limit(0)).count() == 0 and extract.extract(pages.union(pages)).count() == 2 * len(PAGES) + 2
    blocks = extract.text_blocks(pages.where("page_id = 1")).orderBy("position").collect()
    assert [(b["text"], b["main"]) for b in blocks][:3] == [("Site", False), ("T", True), ("a", True)] and "header" in blocks[0]["roles"]


def test_features_by_hand():
    blocks = extract.blocks_of("<nav><a>one two</a> three</nav><h2>four</h2>")
    assert [(b.text, b.words, b.linked) for b in blocks] == [("one two three", 3, 2), ("four", 1, 0)]
    names = list(extract.FEATURES)
    rows = extract.features(blocks)
    assert rows[0, names.index("density")] == pytest.approx(2 / 3) and rows[1, names.index("words before")] == 3 and rows[1, names.index("words behind")] == 0
    assert rows[:, names.index("heading")].tolist() == [0, 1] and rows[:, names.index("other role")].tolist() == [1, 0]


def test_tree_against_every_split():
    """The first split is the best of all, by trying each."""
    draw = np.random.default_rng(3)
    rows, main = draw.integers(0, 6, (60, 3)).astype(float), draw.random(60) < 0.4
    tree = extract.grown(rows, main, depth=1, leaf=4)
    gini = lambda part: len(part) * part.mean() * (1 - part.mean())
    tried = [(gini(main[low]) + gini(main[~low]), f, cut) for f in range(3) for cut in np.arange(0.5, 5.5) if 4 <= (low := rows[:, f] <= cut).sum() <= 56]
    assert (tree[0], tree[1]) == min(tried)[1:]
    assert (extract.is_main(extract.grown(rows, rows[:, 1] > 2), rows) == (rows[:, 1] > 2)).all()


def test_labelled_pages_are_learned():
    from larkspur.llm import labelled

    tree, right, total = extract.fitted_tree(), 0, 0
    for page in labelled.pages():
        for block, kept in extract.judged(page, tree):
            right, total = right + (kept == block.mark), total + 1
    assert right / total > 0.99


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/=\"'!- apdivnscrt&;x", max_size=60))
def test_any_markup_is_read(page):
    text = extract.main_text(f"<article>{page}")
    assert text == " ".join(text.split())


def test_long_broken_markup_is_linear():
    for page in ("<a " * 200_000, '<a b="' * 100_001, "<!--" * 100_000, "<script>" * 100_000, "</b>" * 200_000):
        extract.blocks_of(page)


WORDS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_audit(rows, least, ranks):
    rows = [(lang or "", source or "", WORDS.findall((text or "").translate(lower))) for lang, source, text in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in rows:
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang in {r[0] for r in rows}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        share = lambda own, kept=kept: {t: 1 + 1_000_000_000 * (own[t] + 5) // (sum(own[t] for t in kept) + 5 * len(kept)) for t in kept}
        groups = {s: counts[x, s] for x, s in {(r[0], r[1]) for r in rows} if x == lang}
        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counter()))
        for s in groups:
            found = {"pair": [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in groups if o != s], "term": [(q[t] - p[s][t], t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t]]}
            out += [(lang, s, part, item.decode(), -value, i + 1) for part, of in found.items() for i, (value, item) in enumerate(sorted(of)) if part == "pair" or i < ranks]
    return sorted(out)


def corpus():
    draw = np.random.default_rng(5)
    vocabulary = ["alpha", "Beta", "ÄPFEL", "été", "日本", "x", "zeta", "ox-ide", "a1b", "Ü"]
    rows = [(("en", "de", None)[i % 3], (None, "s1", "s2", "s3", "Ä")[int(draw.integers(5))], " ".join(draw.choice(vocabulary, 1 + i % 9, p=np.arange(1, 11) / 55))) for i in range(150)]
    return rows + rows[:7] + [("en", "s9", None), ("xx", "s1", ""), ("xx", "s2", "alpha"), ("en", "s1", "alpha " * 3000)]


def test_bounded_tables_and_tiles(monkeypatch):
    """What the tasks do, with tables of 5 terms and tiles of 2 sources of which 2 are kept at once."""
    for name, value in (("TILE", 2), ("KEPT_TILES", 2), ("HELD_TERMS", 5), ("SLICE_ROWS", 4)):
        monkeypatch.setattr(divergence, name, value)
    rows = [(lang, source, text) for lang, source, text in corpus() if lang == "en" and source and text]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["lang", "source", "text"])
    counts, docs, emitted = defaultdict(Counter), Counter(), 0
    for part in divergence.count_terms(iter([batch])):
        emitted += 1
        for r in part.to_pylist():
            counts[r["term"]][r["source"]] += r["n"]
            docs[r["term"]] += r["docs"]
    assert emitted > 5 and docs == Counter(t for *_, text in rows for t in set(WORDS.findall(text.translate(lower))))
    sources = sorted({r[1] for r in rows})
    totals = np.array([sum(c[s] for c in counts.values()) + 5 * len(counts) for s in sources])
    vectors = pa.array([[{"source": s, "n": c[s]} for s in sources if c[s]] for c in counts.values()], pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))
    sums, parts = divergence.PairSums({"en": (sources, totals)}), []
    for at in range(0, len(vectors), 3):
        parts += sums.add("en", vectors.slice(at, 3), np.ones(len(vectors.slice(at, 3)), np.int64))
    parts += [x for key in list(sums.tiles) for x in sums.emit(key)]
    got = Counter()
    for r in (r for part in parts for r in part.to_pylist()):
        got[r["source"], r["item"]] += r["value"]
    want = {(s, o): sum(abs(10**9 * (c[s] + 5) // int(totals[i]) - 10**9 * (c[o] + 5) // int(totals[j])) for c in counts.values()) for i, s in enumerate(sources) for j, o in enumerate(sources) if i < j}
    assert got == want and len(want) > 5


def test_divergence(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit("clash")).withColumn("vector", F.lit(1))
    got = sorted(tuple(r) for r in divergence.audit(docs.repartition(5), least=12, ranks=3).collect())
    assert got == plain_audit(rows, 12, 3) and len(got) > 20
    assert divergence.audit(docs.limit(0)).count() == 0
    assert [tuple(r) for r in divergence.audit(docs.where("lang = 'xx'")).orderBy("source").collect()] == [("xx", "s1", "pair", "s2", 0, 1), ("xx", "s2", "pair", "s1", 0, 1)]


@given(st.integers(0, 10**13), st.integers(1, 10**13))
def test_shares_are_exact(count, more):
    assert int(divergence.share(np.array([count]), np.array([count + more]))[0]) == 1 + 10**9 * count // (count + more)


def test_share_columns_are_exact(spark):
    rows = [(0, 1), (1, 3), (5, 5), (7_000_000_000_001, 9_000_000_000_000), (9_007_199_254_740, 9_007_199_254_741)]
    got = spark.createDataFrame(rows, "a long, b long").select(divergence.share_column(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * a // b for a, b in rows]


def plain_search(docs, items, k):
    cut = lambda text: re.findall(lexical.PATTERN, (text or "").translate(lower))
    found = [(d, Counter(cut(t))) for d, t in docs if cut(t)]
    n_docs, n_terms = len(found), sum(sum(c.values()) for _, c in found)
    df, asked, out = Counter(t for _, c in found for t in c), defaultdict(set), []
    for item, text in items:
        asked[item] |= set(cut(text))
    for item, terms in asked.items():
        scores = []
        for d, c in found:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [8192, 3])
def test_search(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    monkeypatch.setattr(lexical, "BLOCK_CELLS", 2_000_000 if block > 3 else 7)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 1_000_000 if block > 3 else 4)
    draw = np.random.default_rng(9)
    words = ["Stone", "river", "ÉTÉ", "42", "the", "of", "日本", "rare", "a_b", "x"]
    docs = [(i, " ".join(draw.choice(words, 1 + i % 13))) for i in range(80)] + [(3, "river of stone"), (None, "rare rare"), (500, "rare rare"), (501, "rare rare"), (90, None), (91, ""), (92, "!!"), (93, "river " * 4000)]
    items = [(1, "stone RIVER river"), (2, "rare"), (2, "42 rare"), (1, "stone RIVER river"), (3, None), (4, ""), (5, "absent"), (None, "the of"), (6, " ".join(words))]
    of_docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(0)).repartition(6)
    of_items = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(0))
    got = sorted((tuple(r) for r in lexical.search(of_docs, of_items, 4).collect()), key=str)
    assert got == plain_search(docs, items, 4) and len(got) == 16
    assert lexical.search(of_docs.limit(0), of_items).count() == 0 and lexical.search(of_docs, of_items.limit(0)).count() == 0
