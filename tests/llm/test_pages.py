"""Page extraction on pages that the training pages are not made from, and on odd markup."""

import pytest

from quire.llm import html

BODY = "Body text of the article that goes on for a while. " * 8
P = f"<p>{BODY}</p>"
KEPT = BODY.strip()

CASES = {
    "article head": (f"<article><header><h1>My title</h1><p>What it is about.</p></header>{P}</article>", f"My title\nWhat it is about.\n{KEPT}"),
    "site head": (f"<header><h1>Site</h1><ul><li><a href=x>A</a></li><li><a href=y>B</a></li></ul></header><article><h1>T</h1>{P}</article><footer>x</footer>", f"T\n{KEPT}"),
    "legal class": (f"<div class='content'><h1>T</h1>{P}</div><div class='legal'>All rights reserved</div>", f"T\n{KEPT}"),
    "legal words": (f"<main>{P}</main><div>Copyright 2020 Some Company. All rights reserved.</div>", KEPT),
    "own last line": (f"<article><h1>T</h1>{P}<p>All rights reserved.</p></article><footer>&copy; x</footer>", f"T\n{KEPT}\nAll rights reserved."),
    "plain comments": (f"<article><h1>T</h1>{P}</article><div><h3>3 comments</h3><div><p>Nice one, thank you for it</p></div><div><p>I disagree with this</p></div></div>", f"T\n{KEPT}"),
    "named comments": (f"<article><h1>T</h1>{P}</article><section id=comments><div class=comment><p>Nice</p></div></section>", f"T\n{KEPT}"),
    "side": (f"<main><article><h2>T</h2>{P}<aside><p>Read also this</p></aside></article></main><div class='sidebar'><p>More</p></div>", f"T\n{KEPT}"),
    "references": (f"<article><p>a &lt; b &amp;amp; c&nbsp;d &#233;\n\t e</p>{P}</article>", f"a < b &amp; c d é e\n{KEPT}"),
    "scripts": (f"<script>var a = '<p>no</p>';</script><style>p {{}}</style><article>{P}<script>x()</script></article>", KEPT),
    "unclosed": (f"<article><p>one<p>two<ul><li>three<li>four</ul>{P}", f"one\ntwo\nthree\nfour\n{KEPT}"),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    source, want = CASES[name]
    assert html.main_text([f"<html><body>{source}</body></html>"], html.forest()) == [want]


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    rows = [(1, "u", None), (2, None, ""), (3, "v", "plain words"), (4, "w", deep), (5, "w", "<<p <a <!-- x"), (5, "w", "<<p <a <!-- x"), (None, "n", f"<article>{P}</article>"), (6, "z", "<p>" + "long " * 100_000)]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = html.extract(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got if r.page_id in (None, 1, 2)} == {None: KEPT, 1: "", 2: ""}
    assert html.extract(pages.where("false")).count() == 0


def test_nothing_below_a_dropped_element_is_kept():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(100):
        n = int(rng.integers(1, 9))
        parent = [-1, *(int(rng.integers(0, i)) for i in range(1, n))]
        keep = rng.random(n)
        out = html.decode(parent, keep)
        cost = lambda c: sum(-np.log(np.clip(k if x else 1 - k, 1e-6, 1)) for x, k in zip(c, keep))
        legal = [c for c in ([bool(m >> i & 1) for i in range(n)] for m in range(1 << n)) if c[0] and all(c[parent[i]] or not c[i] for i in range(1, n))]
        assert abs(cost(out) - min(map(cost, legal))) < 1e-9 and out in legal
