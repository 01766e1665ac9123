"""Main text of pages: planted pages, odd markup, windows against loops."""

import random

import numpy as np
import pytest

from dashframe.llm import page_text as P

LONG = "a sentence of the article that is long enough to be taken for running text by its length alone"


def test_given_shape():
    page = ('<!DOCTYPE html><html lang="fr"><head><meta charset="utf-8"><title>T&amp</title><style>p{margin:0}</style>'
            '<script>var t="</p>";track(0);</script></head><body><nav><ul><li><a href="/a">The</a></li></ul></nav>'
            '<!-- ad 0 --><div class="ad">Buy\nthis.</div><article><h1>T&amp</h1><p><b>T a &amp; b c.<br>'
            '<p>x\n\n  y</p><p>z.</p></article><footer>&copy; w &middot; x</footer>')
    assert P.main_text(page) == "T& T a & b c. x y z."


def test_without_article():
    page = (f'<html><body class="has-sidebar"><div id="page-header"><h1>Site</h1><a href="1">Home</a></div>'
            f'<div class="wrap"><div class="content"><h2>Title</h2><p>{LONG}</p><div class="ad-slot">Buy cheap</div>'
            f'<p>Second, with <a href="#">a link</a> and more.</p><p>Short.</p></div>'
            f'<div class="sidebar"><p>Side {LONG}</p></div></div><div id="comments"><p>Nice {LONG}</p></div>'
            f'<form><p>Your email</p><input name=x></form><div class="cookie-notice">We use cookies {LONG}</div>'
            f'<footer>c</footer></body></html>')
    assert P.main_text(page) == f"Title {LONG} Second, with a link and more. Short."


def test_menu_of_links_is_a_gap():
    links = "".join(f'<p><a href="/{i}">entry number {i} of the menu</a></p>' for i in range(8))
    page = f"<body><div>{links}</div><div><h1>Only</h1><p>{LONG}</p><p>end</p></div><div>{links}</div></body>"
    assert P.main_text(page) == f"Only {LONG} end"


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("   ", ""), ("just words\nhere", "just words here"), ("<p>abc <a href=\"x", "abc"),
    ("<p>1 < 2 and 3 > 2 &lt;b&gt; &nbsp; &eacute;&#233;&copy</p>", "1 < 2 and 3 > 2 <b> éé©"),
    ("<body><nav><li><a href=x>Home</a></nav><article><h1>T<p>a b<p>c d<footer>no</footer>", "T a b c d"),
    ("<main><article><header><h1>H</h1></header><p>A.<section class='comments'><article class='comment'>"
     "<p>nice</article></section><aside>note</aside><p>B.</article></main>", "H A. B."),
    ("<article><p class=\"ad\">buy<p>keep <span class=\"ad\">x</span>me<p hidden>no<p>two</article>", "keep me two"),
    ("<form id=f><div><article><p>in a form</p></article></div></form>", "in a form"),
    ("<article>a<!-- b -->c<script>d</script><style>e</style><noscript>f</noscript>g", "acg"),
    ("<ARTICLE><P>Up<BR/>per</P></ARTICLE>", "Up per"), ("<nav>only a menu</nav>", ""),
    ("<!-- never closed <p>x</p>", ""), ("<script>never closed <p>x</p>", ""),
    ("<article><table><tr><td>1</td><td>2</td></tr></table><pre>a\n b</pre><ul><li>i<li>j</ul></article>", "1 2 a b i j"),
])
def test_pages(page, text):
    assert P.main_text(page) == text


def brute_regions(w, window, surge, share):
    n = len(w)
    sums = [sum(w[i:i + window]) for i in range(n)]
    if not any(w):
        return []
    least, out, i = min(surge, max(sums) - 1), [], 0
    while i < n:
        if sums[i] == 0:
            i += 1
            continue
        j = i
        while j < n and sums[j] > 0:
            j += 1
        if max(sums[i:j]) > least:
            out.append((i, j))
        i = j
    most = max(sum(w[a:b]) for a, b in out)
    return [(a, b) for a, b in out if sum(w[a:b]) >= share * most]


def test_regions_like_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        w = [rng.choice([0, 0, 0, rng.randint(1, 200)]) for _ in range(rng.randint(0, 40))]
        window, surge = rng.randint(1, 5), rng.choice([0, 50, 86, 1000])
        assert P.regions(np.array(w, np.int64), window, surge) == brute_regions(w, window, surge, P.SHARE)


def test_large_and_broken_pages_end():
    many = "<article>" + "".join(f"<p>word{i}" for i in range(60000)) + "</article>"
    assert len(P.main_text(many).split()) == 60000
    for page in ('<a "' * 20000, "<div>" * 20000 + "x", "<!--" * 50000, "<script" * 20000, "<x '" * 20000):
        P.main_text(page)


def test_rows(spark):
    rows = [(1, "u", "<article>one</article>", "t", 5), (1, "u", "<article>one</article>", "t", 5),
            (None, None, "<article>two é</article>", "t", 6), (2, "v", None, "t", 7), (3, "w", "", "t", 8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = sorted(map(tuple, P.extract(df).collect()), key=repr)
    assert got == sorted([(1, "u", "one", 3), (1, "u", "one", 3), (None, None, "two é", 5), (2, "v", "", 0),
                          (3, "w", "", 0)], key=repr)
    assert P.extract(df.limit(0)).collect() == []
