"""Main text of pages, hard negatives and ranked lexical search, each against a plain version."""

import html as htmllib
import math
import random
import re
import time

import numpy as np
import pandas as pd
import pytest

from ghgspark.llm import hardneg, lexical
from ghgspark.llm.html import extract, main_text
from ghgspark.llm.queries import op11_html_extraction

SF = "/root/testdata/sf0.01"


# Main text of pages -------------------------------------------------------------------------------------------------

def plain_article(page: str) -> str:
    """The text of the article element of the generated pages: its headings and paragraphs, nothing else."""
    body = page.split("<article>", 1)[1].split("</article>", 1)[0] if "<article>" in page else ""
    cut = body.rfind("<")
    if cut > body.rfind(">"):
        body = body[:cut]
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?(?:b|br)>", " ", body))
    texts = (" ".join(htmllib.unescape(b).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def test_generated_pages_give_their_article(spark):
    got = op11_html_extraction(spark, SF).toPandas()
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    assert len(got) == len(pages)
    want = dict(zip(pages.page_id, pages.html.map(plain_article)))
    wrong = [p for p, t in zip(got.page_id, got.text) if t != want[p]]
    assert not wrong, wrong[:5]
    assert (got.n_chars == got.text.str.len()).all()


PAGE = """<!DOCTYPE html><html><head><title>Title only</title><style>p{color:red}</style>
<script>var x = "<p>not text</p>";</script></head><body>
<header><div class="logo">Site name</div></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div id="cookie-notice">We use cookies to make this site work, please accept them all now.</div>
<main><h2>Short</h2>
<p>The first paragraph of the story is here, and it is long enough to stand on its own.</p>
<p>Tom &amp; Jerry &lt;3 caf&eacute; &#233;t&#xE9;&nbsp;ok</p>
<p>  spread
   over   lines  </p>
<div class="ad-slot">Buy now and save a lot of money on the things that you want.</div>
<form><label>Your email</label><input name="e"><button>Send</button></form>
<section class="comments"><p>A reader comment that is long enough to look like text.</p></section>
<p>Last words.</p></main>
<aside><p>Related stories that are here on the side of the page for you.</p></aside>
<footer>&copy; 2024 Example</footer><!-- hidden comment --></body></html>"""


def test_boilerplate_goes_and_references_are_decoded():
    assert main_text(PAGE) == "\n".join([
        "Short",
        "The first paragraph of the story is here, and it is long enough to stand on its own.",
        "Tom & Jerry <3 café été ok",
        "spread over lines",
        "Last words.",
    ])


def test_pages_without_an_article_keep_running_text():
    page = ("<div><a href='/x'>Menu one</a> <a href='/y'>Menu two</a></div>"
            "<div>This is the running text of the page and it has many of the words that a text has in it.</div>"
            "<div>Tiny</div><div>It goes on with more words in the text so that it is clear that it is text.</div>"
            "<div><a href='/z'>Contact us</a></div>")
    assert main_text(page) == ("This is the running text of the page and it has many of the words that a text has in it."
                               "\nTiny\nIt goes on with more words in the text so that it is clear that it is text.")


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("just words", "just words"),
    ("<article><p>cut off in a ta", "cut off in a ta"), ("<article><p>cut tag<p cla", "cut tag"),
    ("<article><p>open <b>bold<p>next", "open bold\nnext"), ("<p>&am &amp &quot;x&quot;", '&am & "x"'),
])
def test_edge_pages(page, text):
    assert main_text(page) == text


def test_long_page_is_linear():
    page = "<article>" + "<p>Some words of the text and of the story.</p>" * 40_000 + "</article>"
    started = time.time()
    got = main_text(page)
    assert got.count("\n") == 39_999 and time.time() - started < 20


def test_messy_pages(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", ""), (3, "w", "<p>x</p>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'x' as text", "'y' as n_chars", "1 as _row")
    got = extract(frame).orderBy("page_id", "text").collect()
    assert [r["page_id"] for r in got] == [None, 1, 1, 2, 3]
    assert [r["n_chars"] for r in got] == [0, len(main_text(PAGE)), len(main_text(PAGE)), 0, 1]
    assert extract(frame.where("false")).count() == 0


# Hard negatives -----------------------------------------------------------------------------------------------------

def plain_negatives(rows, positives=5, negatives=10, scale=256):
    good = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        good.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label,
                     np.floor(scale * np.array(vector, float)).astype(np.int64)))
    anchors = {}
    for vec_id, label, x in good:
        if vec_id % 100 == 0:
            anchors[vec_id] = min((tuple(x), label), anchors.get(vec_id, (tuple(x), label)))
    out = []
    for a, (ax, al) in anchors.items():
        ax = np.array(ax, np.int64)
        scored = [(int(ax @ x), i, l) for i, l, x in good if i != a and len(x) == len(ax)]
        scored.sort(key=lambda t: (-t[0], t[1]))
        for ps, p, _ in [s for s in scored if s[2] == al][:positives]:
            band = [s for s in scored if s[2] != al and 30 * ps <= 100 * s[0] <= 90 * ps][:negatives]
            out += [(a, p, r + 1, n, ps, ns) for r, (ns, n, _) in enumerate(band)]
    return sorted(out)


def random_vectors(n, width=16, seed=3):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        vector = [round(draw.uniform(-1, 1), 2) for _ in range(width)]      # coarse values: many ties
        rows.append((i, vector, draw.randrange(3)))
    rows[5] = (5, None, 1)
    rows[9] = (9, [float("nan")] + rows[9][1][1:], 1)
    rows[11] = (11, rows[11][1], None)
    rows[13] = (13, [None] + rows[13][1][1:], 0)
    rows += [(None, rows[1][1], 1), (700, rows[3][1][:8], 1), (701, rows[3][1][:8], 1), (4, rows[4][1], rows[4][2])]
    rows += [(300, rows[200][1], rows[200][2]), (300, rows[201][1], 2)]                  # a repeated anchor id
    return rows


@pytest.mark.parametrize("blocks", [(8192, 2048), (37, 2)])
def test_hard_negatives_equal_the_plain_version(spark, blocks):
    rows = random_vectors(520)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr(
        "*", "'x' as rank", "'y' as x", "2 as width")
    got = hardneg.mine(frame, rows_per_block=blocks[0], anchors_per_block=blocks[1], chunk=3)
    got = sorted(tuple(r) for r in got.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    floats = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows]
    assert got == plain_negatives(floats) and len(got) > 50


def test_bounds_hold():
    draw = np.random.default_rng(4)
    a, b = np.floor(256 * draw.normal(size=(30, 50))), np.floor(256 * draw.normal(size=(40, 50)))
    exact = a @ b.T
    for left, right in zip(hardneg.summaries(a), hardneg.summaries(b)):
        lower, upper = hardneg.bounds(left, right)
        assert (lower <= exact).all() and (exact <= upper).all()


def test_no_anchors(spark):
    frame = spark.createDataFrame([(1, [0.5], 1), (2, [0.1], 1)], "vec_id long, embedding array<float>, label int")
    assert hardneg.mine(frame).count() == 0 and hardneg.mine(frame.where("false")).count() == 0


# Ranked lexical search ----------------------------------------------------------------------------------------------

TERM = re.compile(lexical.TERM)


def plain_terms(text):
    return TERM.findall((text or "").translate(str.maketrans(lexical.UPPER, lexical.LOWER)))


def plain_search(documents, items, k=10):
    docs = [(d, plain_terms(t)) for d, t in documents]
    docs = [(d, t) for d, t in docs if t]
    big_n, big_l = len(docs), sum(len(t) for _, t in docs)
    df = {}
    for _, t in docs:
        for term in set(t):
            df[term] = df.get(term, 0) + 1
    weight = {t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * c + 1))) for t, c in df.items()}
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, query in asked.items():
        scores = []
        for d, t in docs:
            if d is None:
                continue
            m = 10 + (90 * len(t) * big_n) // big_l
            score = sum(weight[q] * ((10**9 * t.count(q)) // (1000 * t.count(q) + 8 * m)) for q in query if q in t)
            if score > 0:
                scores.append((-score, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


WORDS = "alpha beta gamma delta Epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau ü漢 x2 9".split()


def random_documents(n, seed=5):
    draw = random.Random(seed)
    rows = [(i, " ".join(draw.choice(WORDS[:draw.randrange(3, len(WORDS))]) for _ in range(draw.randrange(1, 40))))
            for i in range(n)]
    rows += [(None, "alpha beta"), (n, None), (n + 1, ""), (n + 2, "...,;"), (3, rows[3][1]), (n + 3, rows[7][1])]
    return rows


@pytest.mark.parametrize("per_block, first_round", [(1024, 2), (3, 1)])
def test_search_equals_the_plain_version(spark, per_block, first_round):
    documents = random_documents(300)
    items = [(1, "alpha beta"), (2, "ZETA, zeta! rho"), (3, None), (4, "nothing here"), (5, "ü漢 x2"),
             (None, "gamma"), (6, "alpha"), (6, "kappa"), (7, "9")]
    docs = spark.createDataFrame(documents, "doc_id long, text string").selectExpr("*", "'x' as term", "1 as block")
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'y' as w", "2 as slot")
    got = lexical.search(docs, asked, docs_per_block=per_block, slots=64, first_round=first_round).collect()
    got = sorted((tuple(r) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert got == plain_search(documents, items)


def test_postings_and_counts(spark):
    documents = random_documents(200)
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    vocabulary = spark.createDataFrame([("alpha",), ("zeta",), ("x2",)], "term string")
    postings, n_docs, n_terms = lexical.index(docs, vocabulary, docs_per_block=16)
    texts = [plain_terms(t) for _, t in documents]
    assert (n_docs, n_terms) == (sum(1 for t in texts if t), sum(len(t) for t in texts))
    got = postings.toPandas()
    assert set(got.term) <= {"alpha", "zeta", "x2"} and len(got) == sum(len({"alpha", "zeta", "x2"} & set(t)) for t in texts)
    assert (got.groupby("_row").block.nunique() == 1).all()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert lexical.search(docs, items).count() == 0
    assert lexical.search(spark.createDataFrame([(1, "alpha")], "doc_id long, text string"), items.where("false")).count() == 0
