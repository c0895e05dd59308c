from __future__ import annotations

import os

import pytest

from sessionlens.llm.main_text import Weights, extract_main_text, main_text

SF = "/root/testdata/sf0.001"
PRIOR = Weights({})
PAGES = {
    "": "",
    "<p>a": "a",
    "plain words only here": "plain words only here",
    '<div class="site-header">Menu</div><div id="content"><h1>T</h1><p>One two three four five.</p><ul><li>first item here</li><li>second</li></ul></div>'
    '<div class="comments"><p>nice post</p></div>': "T\nOne two three four five.\nfirst item here\nsecond",
    '<body class="has-sidebar"><main><h2>Head</h2><p>Body text is here &amp; there&nbsp;now<br>next</p><aside>side words</aside>'
    '<section class="post-comments"><article class="comment"><p>reader says</p></article></section></main><footer>foot</footer>': "Head\nBody text is here & there now next",
    "<article><h1>T</h1><p>x &lt;b&gt; y</p><form><input><label>mail</label></form><div class='cookie-notice'>We use cookies</div>"
    "<table><tr><td>a</td><td>b</td></tr></table><p class=ad>buy<p>last one</article><p>tail": "T\nx <b> y\na b\nlast one",
    "<nav><a href=/>Home</a></nav><article><!-- <p>no</p> --><p>a<b>b</b> c<script>var t='</p>'</script></p><p>d\n\t e</article>": "ab c\nd e",
    "<title>t</title><style>p{}</style><article><header><h1>Title</h1></header><p>text</p><footer>by</footer></article>": "Title\ntext",
    "<article><p>unclosed <b>bold <p>next</p></div></span> tail <blockquote>quote": "unclosed bold\nnext\ntail\nquote",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    assert main_text(page, PRIOR) == PAGES[page]


def test_scan_chooses_on_pages_with_teasers_and_without_labels():
    body, teaser = " ".join(f"b{i}" for i in range(600)), " ".join(f"t{i}" for i in range(100))
    page = f"<div><p>{body}</p></div>" + f"<article><p>{teaser}</p></article>" * 3
    assert body in main_text(page, PRIOR)  # the label held a third of the words and took it all
    one = " ".join(f"t{i}" for i in range(300))
    assert body in main_text(f"<div><p>{body}</p></div><article><p>{one}</p></article>", PRIOR)
    assert main_text(f"<div><ul>{'<li><a>go there</a>' * 20}</ul></div><div><p>{body}</p></div><footer>foot</footer>", PRIOR) == body
    beside = f"<article><p>{body}</p></article><div><p>{body}</p></div>"
    assert main_text(beside, PRIOR) == f"{body}\n{body}"  # a label with half of the words says nothing
    assert main_text(f"<article><p>{body}</p></article><div><p>{teaser}</p></div>", PRIOR) == body


def test_names_of_wrappers_do_not_empty_a_page():
    body, few = " ".join(f"b{i}" for i in range(200)), " ".join(f"t{i}" for i in range(20))
    for wrapper in ("div id=page class=has-sidebar", "div class=content-with-sidebar", "article class='post comments-open'", "div class=social-enabled", "div class=widget", "div id=pageHeader"):
        name = wrapper.split()[0]
        assert main_text(f"<{wrapper}><p>{body}</p><div class=sidebar>{few}</div></{name}><p class='share-buttons'>{few}</p>", PRIOR) == body, wrapper
    assert main_text(f"<div><p>{few}</p></div><article><p>{few}</p></article><div class=comments><p>{body}</p></div>", PRIOR) == f"{few}\n{few}"
    assert main_text("<div class=ad>" * 20_000 + body, PRIOR) == body
    long, advert = " ".join(f"w{i}" for i in range(100)), " ".join(f"a{i}" for i in range(150))
    assert main_text(f"<div><p>{long}</p><div class=newsletter-signup>{advert}</div><p>{body}</p></div>", PRIOR) == f"{long}\n{body}"


def test_weights_learned_from_labelled_pages_choose_on_others(spark):
    words = "some words of a text " * 20
    rows = [(i, "u", f"<div><dl><dd>{words}</dd></dl></div><article><p>{words * 4}</p></article>") for i in range(20)]
    rows.append((99, "u", f"<div><dl><dd>{words}</dd></dl></div><div><p>{words}</p></div>"))
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[99] == words.strip() and got[0] == (words * 4).strip()


def test_odd_markup_does_not_break_it():
    for page in ("<", "<<p>>", "<a href='x>y", "<p " * 5000, "<b>" * 20_000 + "x" + "</i>" * 20_000, "&#0; &bogus; &#xD800;", "<!--", "<script>x", "\x00<p>퟿"):
        assert isinstance(main_text(page, PRIOR), str)


def test_edge_cases(spark):
    page = "<nav>menu</nav><article><p>hello there</p></article>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "<article>" + "<p>long words é</p>" * 50_000)]
    got = extract_main_text(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text long"))
    out = [tuple(r) for r in got.collect()]
    assert out.count((1, "u", "hello there", 11)) == 2 and (2, None, "", 0) in out and (None, "v", "", 0) in out
    assert next(r[3] for r in out if r[0] == 3) == 50_000 * 13 - 1
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_articles_of_the_test_pages(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extract_main_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", body))
        assert got[r["page_id"]] == "\n".join(x for x in blocks if x)
