"""Main text: the labelled table, pages of other styles than its own (held out),
malformed markup, and the landed pages against their known article element."""

import html
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from medlake.llm import main_text as mt
from medlake.llm.common import read_table
from tests.llm.odd import CLASH

P = " ".join(f"word{i}" for i in range(40))
Q = " ".join(f"other{i}" for i in range(25))


@pytest.fixture(scope="module")
def tree():
    return mt.trained()


#: (page, its main blocks); none of the styles is in the labelled table.
HELD_OUT = [
    # blog software: class names, a header inside the article, threaded comments
    (f"""<body class="post has-sidebar nav-open"><div id="page"><header class="site-header"><p class="site-title"><a href=/>Blog</a></p>
     <nav id="site-navigation"><ul><li><a>Home</a></li><li><a>About</a></li></ul></nav></header><div id="content"><article class="post">
     <header class="entry-header"><h1 class="entry-title">A title</h1></header><div class="entry-content"><p>{P}</p><p>Short.</p>
     <blockquote><p>{Q}</p></blockquote><div class="sharedaddy social-share"><ul><li>Tweet</li></ul></div></div>
     <footer class="entry-footer">Posted in <a>News</a></footer></article><div id="comments" class="comments-area">
     <ol><li><article class="comment-body"><p>{Q} {Q}</p></article></li></ol><div id="respond"><form><textarea>x</textarea></form></div>
     </div></div><aside id="secondary" class="widget-area"><p>{P}</p></aside><footer id="colophon">Copyright</footer></div></body>""",
     ["A title", P, "Short.", Q]),
    # old tables without any hint
    (f"""<html><body><table><tr><td><a href=a>Home</a><br><a href=b>News</a><br><a href=c>Links</a></td><td><h1>Old page</h1><p>{P}<p>{Q}
     <p>{P}</td></tr></table><center><a href=m>Mail me</a></center></body></html>""", ["Old page", P, Q, P]),
    # roles and camel case
    (f"""<div role="banner"><p>{Q}</p></div><div role="navigation">Menu words here</div><div role=main><h2>Head</h2><p>{P}</p><p>Tiny</p></div>
     <div class="cookieBanner"><p>{Q}</p></div><div class="adBox">{Q}</div><div role="contentinfo">{P}</div>""", ["Head", P, "Tiny"]),
    # hidden blocks, notices, sign-up forms inside the article
    (f"""<main><h1>T</h1><p>{P}</p><div style="display: none">{Q}</div><div class="newsletter-signup"><p>{Q}</p></div>
     <p class="notice">Read our terms of use before you go on reading this.</p><p>{Q}</p></main>""", ["T", P, Q]),
    # lists and tables of content
    (f"""<nav>x</nav><article><h1>List</h1><ul><li>one thing</li><li>another thing</li></ul><table><tr><td>cell a</td><td>cell b</td></tr></table>
     <p>{P}</p></article>""", ["List", "one thing", "another thing", "cell a", "cell b", P]),
]


@pytest.mark.parametrize(("page", "want"), HELD_OUT)
def test_held_out_styles(tree, page, want):
    assert mt.main_text(page, tree).split("\n\n") == want


def test_tree_fits_its_table_and_generalises():
    x, y = mt.labelled()
    assert len(y) < 200 and (mt.Tree(x, y).keep(x) == y).all()
    hits = 0
    for fold in range(5):
        out = np.arange(len(y)) % 5 == fold
        hits += (mt.Tree(x[~out], y[~out]).keep(x[out]) == y[out]).sum()
    assert hits / len(y) > 0.9
    one = mt.Tree(x[:1], y[:1])
    assert one.keep(x).tolist() == [bool(y[0])] * len(x)


def art(body):
    return f"<nav><a>m</a></nav><article><p>{P}</p>{body}</article><footer>f</footer>"


@pytest.mark.parametrize(("body", "want"), [
    ("<p>a &amp; b &lt;i&gt; &eacute;&#233;&#xe9; &nbsp; c</p>", "a & b <i> ééé c"),
    ("<p>in<b>li</b>ne <i>tags</i><br>break</p>", "inline tags break"),
    ("<p>a\n\t  b  c</p>", "a b c"),
    ('<p>x<script>var t="</p>";</script>y<style>p{}</style><!-- <p>no</p> --></p>', "xy"),
    ("<p>1 < 2 <3 and a<b</p>", "1 < 2 <3 and a"),      # a tag's name swallows up to the next >
    ('<p title="a > b">quoted</p>', "quoted"),
    ("<pre>line 1\n  line 2</pre>", "line 1 line 2"),
    ("<P>UPPER</P>", "UPPER"),
    ("<p>&#0;&#xD800;&#x110000;&bogus; z</p>", "���&bogus; z"),
])
def test_markup_inside_blocks(tree, body, want):
    assert mt.main_text(art(body), tree) == f"{P}\n\n{want}"


@pytest.mark.parametrize("tail", ["<script>var x", "<!-- open", '<p class="x', "<p", "<", "<textarea>form", "</", "<!doctype"])
def test_unclosed_ends_with_the_page(tree, tail):
    assert mt.main_text(f"<article><p>{P}</p><p>end</p>{tail}", tree).startswith(f"{P}\n\nend")


def test_long_hostile_pages_take_linear_time(tree):
    for piece in ("<div>", "</div>", '<a "', "<p class='", "<!--", "< ", "<li>x", "<script>", "&", "<b>"):
        start = time.time()
        mt.main_text(piece * 100_000, tree)
        assert time.time() - start < 10, piece


def test_pages_of_the_tables(spark, sf):
    got = {r["page_id"]: r for r in mt.extract(read_table(spark, sf, "pages")).collect()}
    rows = read_table(spark, sf, "pages").collect()
    assert len(got) == len(rows)
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        want = "\n\n".join(p for p in parts if p)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (want, len(want))
        assert got[r["page_id"]]["url"] == r["url"]


def test_odd_rows(spark, tree):
    long = "<article>" + f"<p>{P}</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "v", art("<p>x</p>")), (3, "w", long), (3, "w", long), (4, "x", "no tags at all"),
            (5, "y", "\U0001f600" * 3 + f"<article><p>{P} \U0001f600</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in CLASH})
    out = mt.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = [tuple(r) for r in out.collect()]
    want = [(i, u, mt.main_text(h or "", tree)) for i, u, h in rows]
    assert sorted(got, key=str) == sorted(((*w, len(w[2])) for w in want), key=str)
    assert (1, "u", "", 0) in got and (2, None, "", 0) in got
    assert mt.extract(df.limit(0)).count() == 0


def test_blocks_table(spark):
    df = spark.createDataFrame([(1, art("<p>x</p>")), (2, None), (None, "<p>y</p>")], "page_id long, html string")
    got = mt.blocks(df).orderBy("page_id", "place").collect()
    assert [(r["page_id"], r["place"], r["kept"]) for r in got if r["page_id"]] == [(1, 0, False), (1, 1, True), (1, 2, True), (1, 3, False)]
    assert got[0]["text"] == "y" and len(got) == 5
    assert mt.blocks(df.limit(0)).count() == 0
