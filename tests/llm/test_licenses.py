"""License spans against a plain alignment: words put in, left out and repeated, strays near a notice, long templates."""

from __future__ import annotations

import random
from collections import Counter

import pytest

lic = pytest.importorskip("termloom.llm.licenses")
from termloom.llm.license_texts import TEMPLATES, WORD  # noqa: E402


def plain_spans(text):
    """Every (tpl, first, last) by laying each template over each diagonal word by word."""
    w, out = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)})), set()
    at = {}
    for i, x in enumerate(w):
        at.setdefault(x, []).append(i)
    for tpl, (_, body, exact) in TEMPLATES.items():
        t = body.split()
        k, far = min(lic.K, len(t)), 0 if exact else lic.slack(len(t))
        n = len(t) - k + 1
        diagonals = {}
        for j in range(n):
            for i in at.get(t[j], ()):
                if w[i : i + k] == t[j : j + k]:
                    diagonals.setdefault(i - j, set()).add(j)
        good = []
        for d, own in diagonals.items():
            if exact:
                if len(own) == n:
                    out.add((tpl, d, d + len(t) - 1))
                continue
            reach = 0 if len(own) >= lic.COVER * n else far
            run = {(x, j) for x, js in diagonals.items() if abs(x - d) <= reach for j in js}
            mine, theirs = {x + j + m for x, j in run for m in range(k)}, {j + m for _, j in run for m in range(k)}
            if len(theirs) >= lic.COVER * len(t) and len(mine) >= lic.DENSITY * (max(mine) - min(mine) + 1):
                good.append((len({j for _, j in run}) / n, len(own), -d, min(mine), max(mine)))
        out |= {(tpl, g[3], g[4]) for g in good if all(g[:3] >= h[:3] for h in good if abs(h[2] - g[2]) <= 2 * far)}
    return out


def changed(words, r):
    w = list(words)
    for _ in range(r.randint(0, max(1, len(w) // 20))):
        k, how = r.randrange(len(w)), r.random()
        w[k : k + 1] = [w[k], "odd"] if how < 0.3 else [] if how < 0.6 else [w[k], w[k]] if how < 0.8 else ["other"]
    return w


def test_spans_match_a_plain_alignment(spark):
    r = random.Random(4)
    filler = [w for _, body, _ in TEMPLATES.values() for w in body.split()]
    texts = [None, "", "cc", "CC-BY", "cc by", "cc by " * 2000]
    for _ in range(60):
        parts = []
        for _ in range(r.randint(1, 4)):
            parts += r.choices(filler, k=r.randint(0, 12)) + changed(r.choice(list(TEMPLATES.values()))[1].split(), r) + r.choices("x y z".split(), k=r.randint(0, 3))
        texts.append(" ".join(parts))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS words", "2 AS tpl", "3 AS each", "4 AS label")
    got = lic.license_spans(d).collect()
    found = Counter((x.doc, x.tpl, x.first, x.last) for x in got)
    assert found == Counter((k, *s) for k, t in enumerate(texts) for s in plain_spans(t)) and len(found) > 60
    rows = lic.scan_licenses(d).orderBy("doc_id").collect()
    for k, t in enumerate(texts):
        spans = plain_spans(t)
        base = [first for tpl, first, _ in spans if TEMPLATES[tpl][2]]
        assert (rows[k].n_base, rows[k].first_word, rows[k].last_word) == (len(base), min(base, default=None), max(base, default=None))
        assert rows[k].labels == ",".join(sorted({TEMPLATES[tpl][0] for tpl, _, _ in spans})) and 0 <= rows[k].score <= 1


def test_every_notice_is_found_whole(spark):
    d = spark.createDataFrame([(k, f"Some words. {body} More words.") for k, (_, body, _) in enumerate(TEMPLATES.values())], "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in lic.scan_licenses(d).collect()}
    assert all(label in got[k] for k, (label, _, _) in enumerate(TEMPLATES.values()))


def test_strays_near_a_notice_do_not_lose_it(spark):
    d = spark.createDataFrame([(1, "licensed under cc by nc 4 0 x 4 0 x 4 0"), (2, "cc by nc 4 0 cc by nc 4 0 licensed under cc by nc 4 0 cc by nc 4 0")], "doc_id long, text string")
    assert ["cc-by-nc-4.0" in r.labels.split(",") for r in lic.scan_licenses(d).collect()] == [True, True]


def test_repeated_rows_nulls_and_empty_tables(spark):
    rows = [(1, "cc by"), (1, "cc by"), (1, "all rights reserved"), (None, "cc by"), (None, None), (None, None), (2, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_base, r.labels) for r in lic.scan_licenses(d).collect())
    assert got == Counter({(1, 1, "cc-by"): 2, (1, 1, "reserved"): 1, (None, 1, "cc-by"): 1, (None, 0, ""): 2, (2, 0, ""): 1})
    assert lic.scan_licenses(d.where("false")).count() == 0
    with pytest.raises(ValueError):
        lic.template_grams(spark, {"x": ("x", "one", True)})


def test_identifiers_and_further_notices(spark):
    from termloom.llm.license_texts import NOTICES, SPDX

    texts = [f"// SPDX-License-Identifier: {name}\nint main" for name in SPDX]
    texts += ["# SPDX-License-Identifier: GPL-3.0-only", "/* SPDX-License-Identifier: GPL-2.0-or-later */", "spdx license identifier of another kind"]
    short = [(label, text) for label, text in NOTICES if label in ("cc-by-3.0", "cc-by-sa-3.0", "cc-by-nc-3.0", "cc-by-nc-sa-3.0", "lgpl-3.0", "agpl-3.0") and "SPDX" not in text]
    texts += [f"Some words before. {text}. Some words after." for _, text in short]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [set(filter(None, r["labels"].split(","))) for r in lic.scan_licenses(d).orderBy("doc_id").collect()]
    n = len(SPDX)
    assert [x - {"cc-by"} for x in got[: n + 3]] == [*({label} for label in SPDX.values()), {"gpl-3.0"}, {"gpl-2.0"}, set()]
    assert all(label in x for (label, _), x in zip(short, got[n + 3 :], strict=True)) and len(short) == 6
    assert all(not any(y.endswith("4.0") for y in x) for x in got[n + 3 :])
