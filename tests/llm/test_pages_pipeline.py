"""HTML extraction on hand-made pages, minimum cuts by brute force, and the pipeline stage by stage."""

import html
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from attrilens.llm import html_extract, line_dedup, packing, quality_rules, secret_scan, simhash_dedup

from .helpers import documents, prose


def test_pages_table(spark, sf):
    """The article element of each page, cut by hand."""
    got = {r["page_id"]: r for r in html_extract.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        parts = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", body)]
        want = " ".join(x for x in parts if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site name</h1><nav><a href=/>Home</a> <a href=/a>About us and more</a></nav></header>
<div class="cookie-notice"><p>We use cookies to improve your visit. Accept them all now, please.</p></div>
<main><article><header><h1>The  title</h1></header><p>First paragraph &amp; more text that goes on for a good while.</p><p>Ok.</p>
<div class="advert">Buy this wonderful thing today, it is very cheap and good.</div><script>var x = "<p>no</p>";</script>
<ul><li>One <b>bold</b> item<li>Two items</ul><blockquote>A quotation<br>over lines.</blockquote>
<aside><p>Related reading that should not be part of this at all.</p></aside><form><label>Mail</label><input><button>Go</button></form>
<p hidden>Hidden words.</p><p>Last paragraph.</article></main>
<section id="comments"><h2>Comments</h2><article class="comment"><p>Nice article, I liked it very much indeed, thanks a lot for it!</p></article></section>
<div class="sidebar"><p>Popular posts of the week are listed here for you to read.</p></div><footer><p>&copy; 2020 Somebody. All rights reserved.</p></footer></body></html>"""


def test_page():
    want = "The title First paragraph & more text that goes on for a good while. Ok. One bold item Two items A quotation over lines. Last paragraph."
    assert html_extract.main_text(PAGE) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("<p>An unclosed paragraph of text <script>no</script>", "An unclosed paragraph of text"),
        ("<nav><a href=x>menu</a></nav><div id=content><p>Some words make up this page, and they go on.</p><p>Few.</p></div><div id=footer>foot</div>", "Some words make up this page, and they go on. Few."),
        ("<!-- <p>no</p> --><p>Yes it is a real sentence of some length here.</p><![CDATA[x]]>", "Yes it is a real sentence of some length here."),
        ("<article><p>a&nbsp;&nbsp;b &am &#x41;&notin;</p></article>", "a b &am A∉"),
        ("<script>only</script><style>x</style>", ""),
    ],
)
def test_small_pages(page, want):
    assert html_extract.main_text(page) == want


def test_minimum_cut_is_least():
    rng = random.Random(1)
    for _ in range(120):
        n = rng.randint(1, 8)
        capacity = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(a, b, rng.randint(1, 6)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        cost = lambda side: sum(max(c, 0) for c, s in zip(capacity, side) if not s) + sum(max(-c, 0) for c, s in zip(capacity, side) if s) + sum(w for a, b, w in edges if side[a] != side[b])  # noqa: E731, B023
        best = min(cost(s) for s in itertools.product([False, True], repeat=n))
        assert cost(html_extract.minimum_cut(capacity, edges)) == best
        assert html_extract.cut(capacity, edges) == html_extract.minimum_cut(capacity, edges)


def soup(rng):
    """A page without article, main or telling names, its content blocks, and its other blocks."""
    name = iter(rng.sample(range(100, 999), 60))
    box = lambda inner: f'<div class="c{next(name)}">{inner}</div>'
    content, other = [], []

    def words(into, low, high, end="."):
        into.append(prose(rng, rng.randint(low, high)) + end)
        return into[-1]

    def link(into):
        return f'<a href="/x">{words(into, 1, 4, "")}</a>'

    menu = box("".join(f"<div>{link(other)}</div>" for _ in range(rng.randint(3, 7))))
    body = [f"<h1>{words(content, 4, 8, '')}</h1>"]
    for _ in range(rng.randint(4, 8)):
        # Long paragraphs, and between them headings, short lines and lines that are links for the most part.
        body.append(f"<p>{words(content, 25, 60)}</p>")
        kind = rng.randrange(4)
        if kind == 0:
            body.append(f"<div>{words(content, 1, 2, '')}</div>")
        elif kind == 1:
            body.append(f"<div>{link(content)}</div>")
    side = box("".join(f"<div>{link(other)}</div><div>{words(other, 1, 3, '')}</div>" for _ in range(rng.randint(3, 6))))
    foot = box(f"<div>{link(other)}</div><div>&copy; {words(other, 2, 3, '')}</div>")
    other[-1] = "© " + other[-1]
    return f"<html><body>{menu}{box(''.join(body))}{side}{foot}</body></html>", content, other


def token_f1(found, want):
    both = sum((Counter(found) & Counter(want)).values())
    return 2 * both / max(1, len(found) + len(want))


def test_cut_decides():
    """On pages without telling elements or names the cut changes labels, for the better."""
    rng = random.Random(3)
    with_cut, alone, changed, n = [], [], 0, 200
    for _ in range(n):
        page, content, _ = soup(rng)
        want = " ".join(content).split()
        nodes, blocks = html_extract.parse(page)
        capacity = html_extract.evidence(nodes, blocks)
        side = html_extract.cut(capacity, html_extract.ties(blocks))
        changed += side != [c > 0 for c in capacity]
        with_cut.append(token_f1(html_extract.main_text(page).split(), want))
        alone.append(token_f1(" ".join(b.text for b, c in zip(blocks, capacity) if c > 0).split(), want))

    assert changed > 0.5 * n
    assert sum(with_cut) / n > 0.97 and sum(with_cut) > sum(alone) + 0.005 * n


@pytest.mark.parametrize("name", ["side-by-side", "more-content", "author-essay", "story-header", "share-of-voice", "column-right", "text-more"])
def test_misleading_names(name):
    """Inside the main element a name that only holds a telling word does not take content away."""
    words = "Some words make up this paragraph, and it goes on for a while."
    page = f'<body><nav><a href="/">Home</a></nav><article><h1>The title</h1><p>{words}</p><div class="{name}"><p>{words}</p><p>Few.</p></div><p>{words}</p></article><footer>foot</footer></body>'
    assert html_extract.main_text(page) == f"The title {words} {words} Few. {words}"


@pytest.mark.parametrize("name", ["cookie-banner", "ad-slot", "related-posts-list", "sidebar", "comments", "newsletterSignup", "share-box", "ad"])
def test_telling_names(name):
    words = "Some words make up this paragraph, and it goes on for a while."
    page = f'<body><article><h1>The title</h1><p>{words}</p><div class="{name}"><p>{words}</p></div><p>{words}</p></article></body>'
    assert html_extract.main_text(page) == f"The title {words} {words}"


def test_deep_and_wide_pages():
    deep = "<article>" + "<div>" * 20_000 + "<p>Deep words that make up a sentence of some length.</p>" + "</div>" * 20_000 + "</article>"
    assert html_extract.main_text(deep) == "Deep words that make up a sentence of some length."
    unclosed = "<div>text of the page goes here, on and on. " * 5000
    assert html_extract.main_text(unclosed).count("text of the page") == 5000
    wide = "<nav>" + "<a href=x>y</a><p>" * 3000 + "</nav><main>" + "<p>Words of a sentence here.</p><div>x</div>" * 10_000 + "</b></i>" * 5000 + "</main>"
    assert html_extract.main_text(wide).split().count("Words") == 10_000


def test_weights_are_fitted(spark, sf):
    """Fitted on pages that tell, the text measures alone part their blocks."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    weights = html_extract.fit(pages, fit_pages=20)
    x, y = (np.concatenate(v) for v in zip(*[html_extract.self_labelled(r["html"]) for r in pages.collect()]))
    assert ((x @ weights > 0) == y).mean() > 0.95
    assert html_extract.fit(pages.where("false")).tolist() == list(html_extract.WEIGHTS)
    assert html_extract.fitted(x[:0], y[:0]).tolist() == list(html_extract.WEIGHTS)


def corpus(spark):
    rng = random.Random(12)
    clean = ["\n".join(prose(rng, rng.randint(15, 40)) + "." for _ in range(rng.randint(2, 6))) for _ in range(80)]
    shared = prose(rng, 20)
    texts = [f"{t}\n{shared}" if i % 4 == 0 else t for i, t in enumerate(clean)]
    texts += [texts[0], texts[3], "short text", "", None, " ".join(["same words over and over again now yes"] * 20), f"{prose(rng, 30)}\ntoken = \"{'ab12' * 8}\" {prose(rng, 25)}"]
    return documents(spark, texts)


def test_stages(spark, tmp_path):
    docs = corpus(spark)
    columns = docs.columns
    kept = corpus_pipeline.quality(spark, docs, "")
    assert kept.columns == columns
    judged = {(r["doc_id"], r["kept"]) for r in quality_rules.judged(docs).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, k in judged if k} and {i for i, k in judged if k} >= set(range(80))

    lines = corpus_pipeline.lines(spark, kept, "")
    assert lines.columns == columns
    want = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(kept).collect() if r["text"] and re.search(r"\S", r["text"])}
    got = lines.collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)
    assert 80 not in want and 81 not in want  # whole copies are gone

    near = corpus_pipeline.near_duplicates(spark, docs, "")
    groups = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_groups(docs).collect()}
    assert near.columns == columns and {r["doc_id"] for r in near.collect()} == set(groups.values())

    clean = corpus_pipeline.secrets(spark, docs, "")
    found = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert clean.columns == columns and secret_scan.REDACTED in found[86] and "ab12ab12" not in found[86]
    assert all(found[r["doc_id"]] == r["text"] for r in docs.collect() if r["doc_id"] != 86)

    rows = corpus_pipeline.packed(spark, docs, "").collect()
    assert {r["doc_id"] for r in rows} == set(range(len(groups)))


def test_run(spark, sf):
    """run() equals its stages applied by hand."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = quality_rules.filter_documents(docs).checkpoint()
    texts = secret_scan.redact(simhash_dedup.keep_one(line_dedup.dedup_lines(kept).where("text rlike '[^ \\n\\t]'").select(*docs.columns).checkpoint()).checkpoint())
    want = {(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packing.pieces(texts).collect()}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None
