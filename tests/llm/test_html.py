"""Pages put together from parts of known kind, the failures that pages are known for, and linear time."""

from __future__ import annotations

import html
import random
import time

import pytest
from pyspark.sql import functions as F

ht = pytest.importorskip("termloom.llm.html_text")
from termloom.llm.q_html import op1_html_extraction  # noqa: E402

TEXT = "This is the text of the page and it has many of the words that are in such a text, as it was written for us by them."
STOP = ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was"]


def sentence(r, n):
    return " ".join(r.choice(STOP) if r.random() < 0.4 else "".join(r.choice("abcdefgé&<") for _ in range(r.randint(2, 8))) for _ in range(n))


def page(r):
    """A page and its article's text."""
    shown, want = [], []

    def block(tag, text, attrs=""):
        words = text.split(" ")
        k = r.randrange(len(words))
        marked = [html.escape(w, quote=False) for w in words]
        marked[k] = r.choice(["<b>{}</b>", "<a href='x>y'>{}</a>", "<i class=x>{}</i>", "{}"]).format(marked[k])
        shown.append(f"<{tag}{attrs}>" + r.choice([" ", "\n ", "<!-- c --> "]).join(marked) + f"</{tag}>")
        want.append(text)

    def junk():
        of = html.escape(sentence(r, r.randint(3, 60)), quote=False)
        shown.append(r.choice([
            f"<div class=ad>{of}</div>", f"<aside><p>{of}</p></aside>", f"<form action=x><p>{of}</p><input></form>", f"<script>var a = '<p>{r.random()}</p>';</script>", f"<nav><a href=a>{of}</a></nav>",
            f"<div class='comment-list'><p>{of}</p></div>", f"<section id=comments><article class=comment><p>{of}</p></article></section>", f"<div class='share-bar'>{of}</div>", "<style>p{}</style>", f"<div class='newsletter box'>{of}</div>",
        ]))

    around = r.choice(["article", "main", "div class=post"])
    before, after = [f"<header><h1>Site</h1><nav><a href=/>{sentence(r, 3)}</a></nav></header>"], [f"<footer>{html.escape(sentence(r, 30), quote=False)}</footer>", f"<div class=responses><p>{TEXT}</p></div>"]
    block("h1", sentence(r, r.randint(2, 6)))
    for _ in range(r.randint(2, 7)):
        block(r.choice(["p", "p", "p", "blockquote"]), sentence(r, r.randint(30, 80)), r.choice(["", " data-x=it's", " id='a\"b'"]))
        if r.random() < 0.5:
            junk()
    return "".join([*before, f"<{around}>", *shown, f"</{around.split()[0]}>", *after]), "\n".join(want)


def test_pages_of_known_parts():
    r = random.Random(8)
    for _ in range(400):
        source, want = page(r)
        assert ht.main_text(source) == want, source


def test_names_that_only_look_bad():
    for name in ("commentary", "verse-form", "article-header", "has-sidebar", "heading", "admission", "shared-history", "formula"):
        assert ht.main_text(f"<article><div class='{name}'><p>{TEXT}</p><p>{TEXT}</p></div></article>") == f"{TEXT}\n{TEXT}", name
        assert ht.main_text(f"<body><div class='{name}'><p>{TEXT}</p><p>{TEXT}</p></div></body>") == f"{TEXT}\n{TEXT}", name
    assert ht.main_text(f"<article><div class='article-header'><h1>Title of it</h1></div><p>{TEXT}</p></article>") == f"Title of it\n{TEXT}"
    for name in ("site-header", "form", "search-form", "notice", "page_footer", "legal-notice", "responses", "comment-section"):
        assert ht.main_text(f"<article><p>{TEXT}</p><div class='{name}'><p>{TEXT}</p></div></article>") == TEXT, name


def test_odd_markup():
    assert ht.main_text(f"<article><p data-x=it's>{TEXT}</p><p title=\"a>b\">{TEXT}</p></article>") == f"{TEXT}\n{TEXT}"
    assert ht.main_text(f"<article><p>We know <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x = 2</annotation></math> is so. {TEXT}</p></article>") == f"We know x=2 is so. {TEXT}"
    assert ht.main_text(f"<article><p>A&am<b>p;</b> and &amp;lt; {TEXT}</p></article>") == f"A&amp; and &lt; {TEXT}"


def test_time_is_linear():
    n = 100_000
    for source in ("<div>" * n + TEXT + "</div>" * n, f"<article><p>{TEXT}</p>" + "<p>short one</p>" * n + f"<p>{TEXT}</p></article>", "<div class=sidebar>" * n + TEXT, "<ul>" + "<li>item" * n, "<b class=ad>" * n + "</i>" * n, "<a b='" * n):
        begin = time.time()
        ht.main_text(source)
        assert time.time() - begin < 30, source[:40]


def test_query_on_nulls_repeated_rows_clashing_and_empty_tables(spark, tmp_path):
    rows = [(1, "u", f"<article><p>{TEXT}</p></article>", "x"), (1, "u", f"<article><p>{TEXT}</p></article>", "x"), (None, None, None, None), (2, None, "", "y")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumn("n_chars", F.lit(1))
    d.write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in op1_html_extraction(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(0, None, "", 0), (2, None, "", 0)], key=str)
    d.where("false").write.parquet(str(tmp_path / "e" / "pages.parquet"))
    assert op1_html_extraction(spark, str(tmp_path / "e")).count() == 0


P1 = "The mayor of the town opened the new bridge on Monday, and many people came to see it with their children."
P2 = "It was built in two years by a firm from the coast that had made the old one, which stood for over a century."
P3 = "The work was paid for by the state and by the town, as the council said when it met in the hall last week."
LONG_P = f"{P1} {P2} {P3}"
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/n>News of the day</a></li><li><a href=/c>Contact us</a></li></ul>"
#: (page, lines of its article): layouts without an article element, or with one that isn't the article.
LAYOUTS = [
    ("<h1>News</h1><p>The mayor opened the new bridge on Monday.</p><p>It was built in two years by a firm.</p>", ["News", "The mayor opened the new bridge on Monday.", "It was built in two years by a firm."]),
    (f"<div>{MENU}</div><h1>News</h1><p>The mayor opened the new bridge on Monday.</p><p>It was built in two years by a firm.</p>", ["News", "The mayor opened the new bridge on Monday.", "It was built in two years by a firm."]),
    (f"<article><p>Read this teaser text now</p></article><p>{LONG_P}</p><p>{LONG_P}</p><p>{LONG_P}</p>", [None, LONG_P, LONG_P, LONG_P]),
    (f"<p>{LONG_P}</p><p>Water is H<sub class=subscript>2</sub>O, as the book says of it in a part.</p><p>{LONG_P}</p>", [LONG_P, "Water is H2O, as the book says of it in a part.", LONG_P]),
    (f"<p>{LONG_P}</p><p class=promoted-by>{LONG_P}</p>", [LONG_P, LONG_P]),
    (f"<h1>A study</h1><p>{LONG_P}</p><section class=related-work><h2>Related work</h2><p>{LONG_P}</p></section>", ["A study", LONG_P, "Related work", LONG_P]),
    (f"<div class=content><p>{LONG_P}</p></div><div class=related-posts><a href=x>Another text</a></div>", [LONG_P]),
    (f"<div><p>{LONG_P}</p><ins class=adsbygoogle>Buy this now</ins></div>", [LONG_P]),
    (f"<div id=content><h1>The bridge</h1><p>{P1}</p><p>{P2}</p></div><div id=sidebar><p>{P3}</p></div>", ["The bridge", P1, P2]),
    (f"<table><tr><td>{MENU}</td><td><h1>The bridge</h1><p>{LONG_P}</p></td></tr></table>", ["The bridge", LONG_P]),
    (f"<body class=has-sidebar><div class=page><p>{LONG_P}</p><blockquote><p>{P2}</p></blockquote><p>{LONG_P}</p></div>", [LONG_P, P2, LONG_P]),
    (f"<div class=post><h2>One</h2><p>{LONG_P}</p><h2>Two</h2><p>{LONG_P}</p></div><div id=comments><p>{LONG_P}</p></div>", ["One", LONG_P, "Two", LONG_P]),
    (f"<div class=cookie-notice><p>{P1}</p></div><div><p>{LONG_P}</p></div>", [LONG_P]),
    (f"<div role=navigation>{MENU}</div><div role=main><p>{LONG_P}</p></div><div role=contentinfo><p>All rights are with us.</p></div>", [LONG_P]),
    (f"<form><h1>The bridge</h1><p>{LONG_P}</p><p>{LONG_P}</p></form>", ["The bridge", LONG_P, LONG_P]),
    (f"<div class=header><a href=/>The Site</a></div><div class=body><p>{LONG_P}</p><ul><li>{P1}</li><li>{P2}</li></ul><p>{LONG_P}</p></div>", [LONG_P, P1, P2, LONG_P]),
    (f"<font size=2>{LONG_P}<br><br>{P1}</font>", [f"{LONG_P} {P1}"]),
    (f"<div>{LONG_P}</div><div style='display:none'>{LONG_P}</div><div aria-hidden=true>{P1}</div>", [LONG_P]),
    (f"<div class=story><p>{LONG_P}</p><div class=share>Share this with friends</div><p>{LONG_P}</p></div>", [LONG_P, LONG_P]),
    (f"<main><p>{LONG_P}</p></main><footer><p>{P1}</p></footer>", [LONG_P]),
    (f"<p class=copyright>The rights are with us.</p><p>{LONG_P}</p>", [LONG_P]),
    ("<h1>Un pont</h1><p>Le maire a ouvert le pont de la ville.</p><p>Il est fait par une firme de la cote.</p>", ["Un pont", "Le maire a ouvert le pont de la ville.", "Il est fait par une firme de la cote."]),
]


@pytest.mark.parametrize("k", range(len(LAYOUTS)))
def test_layouts_without_an_article_element(k):
    page, lines = LAYOUTS[k]
    got = ht.main_text(page).split("\n")
    assert got == [x for x in lines if x is not None] or lines[0] is None and got[-len(lines) + 1 :] == lines[1:]
