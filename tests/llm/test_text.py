"""The text operators against plain versions, with nulls, empty and long texts, ties, repeated rows and odd columns."""

from __future__ import annotations

import hashlib
import random
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("termloom.llm.queries")
P = pytest.importorskip("public_tokenizers")

from termloom.llm import bpe, chat, decontamination, html_text, licenses, line_dedup, near_dup, quality, token_counts, warc  # noqa: E402
from termloom.llm.common import checkpointed, sha256  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ODD = [None, "", " ", "\n\n", "x", "a  b   c\n \nd", "é" * 50_000, "the of and " * 3000, "All RIGHTS reserved CC-BY", "same line here\nsame line here\n"]


def docs(spark, texts, extra=True):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, DOCS)
    return d.withColumn("words", F.lit(1)).withColumn("k", F.lit("x")).withColumn("kept", F.lit(0)) if extra else d


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "and", "in"]) if r.random() < 0.4 else "".join(r.choice("abcdefg") for _ in range(r.randint(2, 7))) for _ in range(n))


# line dedup


def plain_lines(rows):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    order = lambda i: (i is None, i)
    first = {}
    for i, t in rows:
        for s in (t or "").split("\n"):
            k = key(s)
            if len(k) >= 10 and (k not in first or order(i) < order(first[k])):
                first[k] = i
    return [(i, "\n".join(s for s in (t or "").split("\n") if first.get(key(s), i) == i)) for i, t in rows]


def test_lines_match_a_plain_version(spark):
    shared = ["A line that many share", "  a LINE that many share\t", "Ünique Üpper Case", "ünique üpper case"]
    texts = [*ODD, *("\n".join(random.Random(k).choices([*shared, "short", prose(k % 7, 6)], k=150)) for k in range(40))]
    rows = list(enumerate(texts)) + [(None, shared[0]), (None, shared[0] + "\n" + prose(99, 5))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit(1)).withColumn("pos", F.lit(2))
    got = line_dedup.with_bitmaps(df, line_dedup.keep_bitmaps(df)).select("doc_id", line_dedup.kept_text(F.col("text")).alias("t")).collect()
    assert Counter(map(tuple, got)) == Counter(plain_lines(rows))


def test_repeated_rows_and_empty_tables_of_lines(spark):
    rows = [(1, "first common line\nx"), (1, "first common line\nx"), (1, "other\nfirst common line"), (2, "y\nfirst common line")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, line_dedup.deduplicate_lines(df).collect())) == sorted([*rows[:3], (2, "y")])
    assert line_dedup.deduplicate_lines(df.where("false")).collect() == []


# quality


def test_base_figures_match_a_plain_version(spark):
    texts = [*ODD, prose(1, 200), "a b c a b c a b c d e", "x y z\n" * 30, "# a | b $ <x>\n" * 5, "w " * 60]
    got = quality.base_figures(docs(spark, texts, False)).collect()
    for r, t in zip(sorted(got, key=lambda r: r.doc_id), texts, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        win = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(win)
        hit = {k + j for k, x in enumerate(win) if n[x] > 1 for j in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_model_keeps_prose_and_drops_junk(spark):
    good = [prose(k, 120) for k in range(60)]
    junk = [" ".join(f"{w}%%%" for w in prose(k, 100).split()) for k in range(12)] + [prose(k, 90).upper().replace(" ", "!! ") for k in range(6)]
    d = docs(spark, [*good, *junk, *ODD])
    for r in quality.judge_quality(d).collect():
        if r.doc_id < len(good) + len(junk):
            assert r.kept == (r.doc_id < len(good)), r
    assert quality.judge_quality(d.where("false")).count() == 0
    both = {r.doc_id: r.kept for r in quality.judge_quality(d, keep_text=False).collect()}
    assert both == {r.doc_id: r.kept for r in quality.judge_quality(d).collect()}


def test_model_is_plain_em(spark):
    """fit() against the same steps in plain Python."""
    rows = [(1, 1, 80), (-1, -1, 15), (1, 0, 9), (0, -1, 6), (-1, 1, 2)]
    got = quality.fit(spark.createDataFrame(rows, "a int, b int, n long"), ["a", "b"], rounds=5, tolerance=0)
    first = {1: 0.4, 0: 0.5, -1: 0.1}
    prior, model = 0.8, {"good": [dict(first)] * 2, "bad": [{1: 0.1, 0: 0.5, -1: 0.4}] * 2}
    for _ in range(5):
        post = []
        for *v, n in rows:
            g, b = prior, 1 - prior
            for k in range(2):
                g, b = g * model["good"][k][v[k]], b * model["bad"][k][v[k]]
            post.append(g / (g + b))
        total = {"good": sum(n * p for (*_, n), p in zip(rows, post, strict=True)), "bad": sum(n * (1 - p) for (*_, n), p in zip(rows, post, strict=True))}
        weight = lambda c, p: p if c == "good" else 1 - p
        model = {c: [{x: max(quality.FLOOR, (sum(r[2] * weight(c, p) for r, p in zip(rows, post, strict=True) if r[k] == x) + 1) / (total[c] + 3)) for x in (1, 0, -1)} for k in range(2)] for c in total}
        prior = total["good"] / sum(total.values())
    assert got["prior"] == pytest.approx(prior) and got["good"]["a"][1] == pytest.approx(model["good"][0][1]) and got["bad"]["b"][-1] == pytest.approx(model["bad"][1][-1])


# licenses


def test_license_base_figures_and_labels(spark):
    texts = [*ODD, "Licensed under the Apache License, Version 2.0.", "under the terms of the GNU General Public License, version 3", "cc by cc by, CC.BY x", "This work is now licensed under the GNU General Public License, version 3."]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at = [(k, x) for p, x in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert got[i].base_labels == ",".join(sorted({x for _, x in at}))
    n = len(ODD)
    assert got[n].labels == "apache-2.0" and got[n].score == 1.0 and got[n + 1].labels == "gpl"
    spans = licenses.license_spans(docs(spark, texts)).where(f"doc = {n + 3} AND NOT exact").collect()
    assert got[n + 3].labels == "gpl,gpl-3.0" and [(x.tpl, x.first, x.last) for x in spans] == [("gpl-3.0", 0, 12)] and 0.8 <= spans[0].cover < 1  # a word put in: two diagonals merged
    assert licenses.scan_licenses(docs(spark, []).where("false")).count() == 0


# decontamination


def plain_hits(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - min(13, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    sizes = {len(x) for x in windows}
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= names
        yield len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [10**9, 400])
def test_decontamination_matches_a_plain_version(spark, block):
    items = [(k, prose(1000 + k, 40 if k % 3 else 5)) for k in range(12)] + [(50, None), (51, "!!"), (52, "solitary"), (53, prose(1000, 40))]
    texts = [*ODD, *(prose(k, 100) for k in range(10)), prose(3, 60) + " " + items[1][1] + " " + prose(4, 30), "Say " + items[2][1].upper().replace(" ", ", ") + items[0][1], "solitary " * 3, items[4][1][:60]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_contamination(docs(spark, texts), bench, block_chars=block).orderBy("doc_id").collect()
    for r, (n, hit, names) in zip(found, plain_hits(texts, items), strict=True):
        c = r.contamination
        assert (c.n_words, c.n_hit, c["items"]) == (n, hit, names)
        assert sum(b - a for a, b in c.spans) == hit and (c.longest > 0) == (hit > 0)
    k = len(ODD) + 10
    assert found[k].contamination.longest == 40 and found[k].contamination.longest_at == 60 and found[k].contamination.longest_item == "1"
    assert decontamination.decontaminate(docs(spark, texts), bench.where("false")).count() == len(texts)
    assert decontamination.decontaminate(docs(spark, texts).where("false"), bench).count() == 0


@pytest.mark.parametrize("block", [10**9, 100])
def test_decontamination_with_a_null_item_id(spark, block):
    items = [(None, prose(1, 20)), (5, prose(2, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, [f"{items[0][1]} % {items[1][1]}", items[0][1]])
    r = [x.contamination for x in decontamination.find_contamination(d, bench, block_chars=block).orderBy("doc_id").collect()]
    assert [(x.n_words, x.n_hit, x["items"], x.longest) for x in r] == [(50, 50, ["5"], 30), (20, 20, [], 20)] and r[1].longest_item is None


# tokens


def blanks(n):
    r = random.Random(5)
    return ["".join(r.choice(" \n\tab'sré1,!_ 　​日") for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_bpe_is_what_the_library_gives():
    tiktoken = pytest.importorskip("tiktoken")
    for name in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"):
        table = bpe.merges(P.path(name))
        enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table.ranks, special_tokens={})
        texts = [t for t in ODD if t is not None] + blanks(800) + [prose(k, 80) for k in range(30)] + ["a" * 999, "ab" * 500, "don't 'S we'LL"]
        got = list(bpe._joined(bpe.encode_batch(texts, table, P.PATTERN)))
        assert all(g.tolist() == enc.encode_ordinary(t) for g, t in zip(got, texts, strict=True))


def test_replay_equals_the_plain_rule():
    table = bpe.merges(P.path("byte_bpe_50k.tiktoken"))
    words = [t.encode() for t in blanks(300)] + [b"", b"aaaa", b"the", bytes(range(256))]
    assert table.replay(words) == [table.slowly(w) if w else [] for w in words]
    with pytest.raises(ValueError):
        bpe.Merges({b"a": 0})


def test_bpe_columns(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    d = docs(spark, ODD).select("doc_id", "text", bpe.encode(F.col("text"), path, P.PATTERN).alias("ids"), bpe.digests(F.col("text"), path, P.PATTERN).alias("d"))
    d = d.select("*", bpe.decode(F.col("ids"), path).alias("back"), sha256(F.coalesce("text", F.lit(""))).alias("sha"))
    for r in d.collect():
        assert bytes(r.back).decode() == (r.text or "") and r.d.n_tokens == len(r.ids) and r.d.decoded_sha256 == r.sha
        assert r.d.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
    assert bpe.shards(["a" * 5, None, "b" * 5, "c"], 6) is not None and list(bpe.shards(["a" * 5, None, "b" * 5, "c"], 6)) == [(0, 2), (2, 4)]


def test_token_counts_match_a_plain_version(spark):
    import regex

    m = token_counts.model(P.path("byte_bpe_50k.tiktoken"))
    texts = [t for t in ODD if not t or len(t) < 1000] + blanks(60) + [prose(1, 60)]

    def plain(t):
        n = k = c = 0
        for w in regex.findall(P.PATTERN, t or ""):
            b, best = w.encode(), [(0, 0)]
            for e in range(1, len(b) + 1):
                best.append(min((best[s][0] + m.costs[b[s:e]], best[s][1] + 1) for s in range(e) if b[s:e] in m.costs))
            n, k, c = n + best[-1][1], k + 1, c + best[-1][0]
        return n, k, c

    got = docs(spark, texts).select("doc_id", token_counts.token_counts(F.col("text"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).alias("c")).orderBy("doc_id").collect()
    assert [tuple(r.c) for r in got] == [plain(t) for t in texts]


# near-duplicates


def plain_components(texts, width):
    sets = [near_dup.shingle_set(t, width) for t in texts]
    at = list(range(len(texts)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                at[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("width, long_list", [(2, 48), (5, 48), (2, 4)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, width, long_list):
    """Chains, clouds around the threshold, copies and short texts; with a low LONG_LIST the blocks decide, three a list."""
    monkeypatch.setattr(near_dup, "LONG_LIST", long_list)
    if long_list < 48:
        monkeypatch.setattr(near_dup, "BLOCK_DOCS", 8)
    r = random.Random(width)
    texts = [*ODD, "one", "one two", "One  Two\n"]
    for k in range(4):
        base = prose(k, 150).split()
        for _ in range(14):
            w = list(base)
            for _ in range(r.randint(0, 14)):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(w))
        texts += [" ".join(base)] * 3
    got = near_dup.near_duplicates(docs(spark, texts), width=width).orderBy("doc").collect()
    assert [(x.n_shingles, x.component_id) for x in got] == plain_components(texts, width)


def test_near_duplicates_of_odd_rows(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (1, "A b c d e F"), (2, None)], "doc_id long, text string")
    got = near_dup.near_duplicates(d, width=2).collect()
    assert Counter((x.doc, x.component_id) for x in got) == Counter({(None, None): 1, (3, 1): 2, (1, 1): 1, (2, 2): 1})
    assert near_dup.drop_near_duplicates(d).count() == 3  # no id, 1 and 2
    assert near_dup.near_duplicates(d.where("false")).count() == 0
    with pytest.raises(ValueError):
        near_dup.near_duplicates(d, percent=50)


# HTML


def test_html_articles():
    page = """<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><header>Site <a href=/>Home</a></header><nav><ul><li><a href=x>Menu</a></li></ul></nav>
    <div class="cookie-notice">We use cookies and the like for all of you.</div><article><h1>A &amp; B &lt;1&gt;</h1><p>The first   paragraph of it,\n with <b>bold</b> words<br>and a break.<p>Te.
    <div class="ad">Buy the best of it now</div><p>The last one is here to stay &#8212; in the end.</p><section id="comments"><p>I like the text and all that is in it.</p></section></article>
    <aside>Other news of the day</aside><form>Name <input></form><footer>&copy; all</footer></body></html>"""
    assert html_text.main_text(page) == "A & B <1>\nThe first paragraph of it, with bold words and a break.\nTe.\nThe last one is here to stay — in the end."
    assert [html_text.main_text(x) for x in (None, "", "<p>", "<!--", "<script>x", "<a href='")] == [""] * 6


def test_html_without_article_by_density():
    text = "This is the text of the page and it has many of the words that are in such a text, as it was written for us by them."
    page = f"<div class=menu><a href=1>One</a> <a href=2>Two</a></div><div><h2>Short head</h2><p>{text}</p><p>So be it.</p><p>{text}</p></div><div><a href=3>More links here</a></div><footer>x</footer>"
    assert html_text.main_text(page) == f"Short head\n{text}\nSo be it.\n{text}"


def test_html_wrappers_of_the_article():
    """Layout names, one form around the page and named wrappers don't take the article away; its comments and adverts go."""
    text = "This is the text of the page and it has many of the words that are in such a text, as it was written for us by them."
    article = f"<h1>Head of it</h1><p>{text}</p><div class=ad>Buy the best of all that is in the shop of the day</div><p>{text}</p>"
    rest = f"<div id=comments><p>{text} I</p><p>{text} II</p><p>{text} III</p></div><aside><p>{text} IV</p></aside>"
    for around in ("<div class='page has-sidebar'>", "<div class='no-sidebar with-comments social-enabled'>", "<form id=aspnetForm>", "<div class=sidebar-wrapper>", "<form><div class='header-wrap'>", "<header>"):
        for inner in ("<article>", "<main>", "<div>"):
            page = f"<nav>Menu of the site</nav>{around}{inner}{article}{'</' + inner[1:]}{rest}{''.join('</' + x.split()[0].strip('>') + '>' for x in around.split('<')[:0:-1])}<footer>x</footer>"
            assert html_text.main_text(page) == f"Head of it\n{text}\n{text}", page
    aside = f"<article><p>{text}</p><p>{text}</p></article><div class=sidebar><article><p>{text}</p></article></div><form><h2>Write to us</h2><p>{text}</p></form>"
    assert html_text.main_text(aside) == f"{text}\n{text}"


def test_html_in_languages_without_known_stop_words():
    texts = {
        "pl": "Wczoraj wieczorem mieszkańcy miasta spotkali się nad rzeką, żeby wspólnie obejrzeć pokaz świateł, który przygotowali uczniowie tamtejszej szkoły plastycznej razem ze swoimi nauczycielami i rodzicami.",
        "ru": "Вчера вечером жители города собрались у реки, чтобы вместе посмотреть представление, которое подготовили ученики местной художественной школы вместе со своими учителями и родителями для всех гостей.",
        "tr": "Dün akşam şehrin sakinleri nehir kıyısında buluşarak yerel sanat okulu öğrencilerinin öğretmenleri ve aileleriyle birlikte hazırladığı ışık gösterisini hep beraber büyük bir ilgiyle izlediler ve alkışladılar.",
        "ja": "昨日の夕方、町の人々は川のほとりに集まり、地元の美術学校の生徒たちが先生や保護者と一緒に準備した光のショーを楽しみました。会場には多くの家族連れが訪れ、夜遅くまで笑い声が響いていました。",
    }
    for text in texts.values():
        page = f"<div class=menu><a href=1>{text[:20]}</a></div><div><h2>{text[:12]}</h2><p>{text}</p><p>{text[:9]}</p><p>{text}!</p></div><div><a href=3>{text}</a></div><footer>{text}</footer>"
        assert html_text.main_text(page) == f"{text[:12].strip()}\n{text}\n{text[:9].strip()}\n{text}!"
        assert html_text.main_text(f"<form><article><p>{text}</p></article></form><form class=side><div><p>{text}</p></div></form>") == text
    text = "This is the text of the page and it has many of the words that are in such a text, as it was written for us by them."
    names = "Anna Bell, Carl Dorn, Ella Frey, Gus Hahn, Ida Jung, Kurt Lang, Mia Noll"
    assert html_text.main_text(f"<div><p>{text}</p><p>{names}</p><p>{text}</p></div><footer>x</footer>") == f"{text}\n{names}\n{text}"


def test_html_adverts_do_not_vote():
    text = "This is the text of the page and it has many of the words that are in such a text, as it was written for us by them."
    ad = "<div class=ad>Buy the best of all that is in the shop of the day</div>"
    body = f"{ad}<div>Short head</div><div>By A. Writer</div><div class=share>Share it</div><div><p>{text}</p></div>{ad}<div>Last words</div>"
    assert html_text.main_text(f"<article>{body}</article>") == f"Short head\nBy A. Writer\n{text}\nLast words"
    assert html_text.main_text(f"<div>{body}</div>") == f"Short head\nBy A. Writer\n{text}\nLast words"


def test_html_columns(spark):
    d = spark.createDataFrame([(1, None), (2, "<article>x" + " y" * 100_000), (3, "")], "page_id long, html string")
    assert [len(r.t) for r in d.select("page_id", html_text.extract(F.col("html")).alias("t")).orderBy("page_id").collect()] == [0, 200_001, 0]


# chat


def test_chat_read_back_gives_the_same_turns():
    r = random.Random(2)
    for _ in range(3000):
        role = lambda: "assistant" if r.random() < 0.5 else "".join(r.choice("ab\\\n<|n") for _ in range(r.randint(0, 4)))
        turns = [(role(), "".join(r.choice(["<", "|", "\\", "\n", "im_end", "<|im_end|>", "<|im_start|>", "a"]) for _ in range(r.randint(0, 6)))) for _ in range(r.randint(0, 3))]
        text, mask = chat.render(turns)
        assert chat.read_back(text) == turns
        assert "".join(chat.unescape(text[a:b]) for a, b in mask) == "".join(t for x, t in turns if x == "assistant")


def test_layouts(spark):
    import json

    given = [
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "meta": {"id": 3}},
        {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
        {"instruction": "hi", "output": "yo"},
        {"instruction": "hi", "input": "there", "output": "yo", "system": "be"},
        {"prompt": "hi", "completion": "yo"},
        {"turns": [{"turn": 1, "role": "assistant", "text": "yo"}, {"turn": 0, "role": "user", "text": "hi"}]},
        {"something": "else"},
    ]
    texts = [json.dumps(x) for x in given] + [None, "{broken"]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, j string").select("k", chat.format_chat(F.col("j")).alias("f")).orderBy("k").collect()
    assert [r.f.layout for r in d] == ["messages", "speakers", "instruction", "instruction", "prompt", "ordered turns", None, None, None]
    turns = [chat.read_back(r.f.formatted) if r.f.formatted else None for r in d]
    plain = [("user", "hi"), ("assistant", "yo")]
    assert turns == [plain, plain, plain, [("system", "be"), ("user", "hi\n\nthere"), ("assistant", "yo")], plain, plain, None, None, None]
    assert d[6].f.fingerprint is not None and all(r.f.formatted[slice(*r.f.loss_mask[0])] == "yo" for r in d[:6])


# WARC


def test_audit_finds_all_damage_and_nothing_else(spark):
    rows = [(k, f"http://x/{k}", "text " * (k % 9)) for k in range(300)] + [(7, "http://x/7", "text"), (None, None, None)]
    a = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    b = a.where("page_id IS NULL OR page_id NOT IN (20, 299)").withColumn("html", F.when(F.col("page_id") == 123, "other").otherwise(F.col("html")))
    b = b.unionByName(spark.createDataFrame([(900, "u", "new", 1)], "page_id long, url string, html string, digest int"))
    found = {(r.key, r.damage) for r in warc.audit(warc.manifest(a), warc.manifest(b), checkpointed).collect()}
    assert found == {(20, "missing"), (299, "missing"), (123, "altered"), (900, "extra")}
    assert warc.audit(warc.manifest(a), warc.manifest(a), checkpointed).count() == 0
    none = a.where("false")
    assert warc.audit(warc.manifest(none), warc.manifest(none), checkpointed).count() == 0
    assert warc.audit(warc.manifest(a), warc.manifest(none), checkpointed).count() == 301


def test_audit_gives_each_record_of_a_key(spark):
    """A key with many records, null ids and equal records: as many rows as multisets of digests differ by."""
    rows = [(k, f"http://x/{k}", "text") for k in range(40)] + [(7, f"http://y/{k}", "t" * k) for k in range(200)] + [(None, "n", "same")] * 50 + [(None, "m", "other")]
    a = spark.createDataFrame(rows, "page_id long, url string, html string")
    changed = [(k, u, "altered" if u in ("http://y/3", "http://y/90") else h) for k, u, h in rows if u not in ("http://y/5", "http://x/20")]
    changed = [x for x in changed if x[0] is not None] + [(None, "n", "same")] * 47 + [(None, "m", "other"), (900, "u", "new"), (900, "u", "new")]
    b = spark.createDataFrame(changed, a.schema).repartition(5)
    m = checkpointed(warc.manifest(a.repartition(3)))
    for file in {r.file for r in m.select("file").distinct().collect()}:  # ranges of a file lie end to end
        at = sorted((r.begin, r.end) for r in m.where(F.col("file").eqNullSafe(file)).collect())
        assert at[0][0] == 0 and all(x[1] == y[0] for x, y in zip(at, at[1:], strict=False))
    found = warc.audit_records(m, warc.manifest(b), checkpointed).collect()
    none = None
    assert Counter((r.key, r.damage) for r in found) == Counter({(7, "altered"): 2, (7, "missing"): 1, (20, "missing"): 1, (none, "missing"): 3, (900, "extra"): 2})
    assert len({(r.key, r.begin, r.end) for r in found}) == len(found)
    ranges = {(r.key, r.begin, r.end, r.digest) for r in m.collect()}
    assert all((r.key, r.begin, r.end, r.digest) in ranges for r in found if r.damage != "extra")
    assert warc.audit_records(m, warc.manifest(a), checkpointed).count() == 0
    empty = a.where("false")
    assert warc.audit_records(m, warc.manifest(empty), checkpointed).count() == len(rows)
    assert warc.audit_records(warc.manifest(empty), warc.manifest(empty), checkpointed).count() == 0


def test_warc_files_round_trip(spark, tmp_path):
    rows = [(k, f"http://x/{k}", None if k == 3 else f"<p>é\r\n\r\n {k}</p>\n") for k in range(20)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(d, str(tmp_path / "w"))
    assert sorted(map(tuple, warc.read_warc(spark, str(tmp_path / "w")).collect())) == sorted((u, h or "") for _, u, h in rows)


def test_line_hashes_are_gone_before_texts_are_cut(spark, monkeypatch):
    made = []

    class Seen(line_dedup.Scratch):
        def __call__(self, df):
            made.append((self.folder.removeprefix("file:"), df.columns))
            return super().__call__(df)

    monkeypatch.setattr(line_dedup, "Scratch", Seen)
    cut = line_dedup.deduplicate_lines(spark.createDataFrame([(1, "a line of text\nb"), (2, "A line of text \nc")], "doc_id long, text string"))
    assert "pos" in made[0][1] and not os.path.exists(made[0][0])
    assert sorted(map(tuple, cut.collect())) == [(1, "a line of text\nb"), (2, "c")]
