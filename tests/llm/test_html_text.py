"""Main texts against pages whose article is known."""

import html
import math
import re

import pytest
from pyspark.sql import functions as F

from glossator.llm import html_text
from glossator.llm.html_text import main_text

CASES = [
    (None, ""),
    ("", ""),
    ("plain &amp; text", "plain & text"),
    ("<nav><a>menu</a></nav>", ""),
    ("<body><div class='sidebar'>all there is</div></body>", "all there is"),
    ("<header>Site</header><main><header><h1>Head</h1></header><p>Of.</p><p>" + "long text " * 30 + "</p><p>a&nbsp;b\n c</p></main><footer>f</footer>", "Head Of. " + "long text " * 30 + "a b c"),
    ("<article><p>one <b>bo</b>ld</p><p>two</p><div id=comments><p>reader says a long thing that isn't the article</p></div><form>f<p>q</p></form></article>", "one bold two"),
    ("<body><div id='cookie-notice'>We use cookies</div><div class='content'><p>x</p><p>" + "body words " * 9 + "</p></div><div class=ad>buy</div><!-- c --><script>var a='<p>';</script>", "x " + "body words " * 8 + "body words"),
    ("<article><p>unclosed <p>next<br>line &lt;b&gt; &am", "unclosed next line <b> &am"),
    ("<body><p>a</p><p style='display: none'>hid</p><p hidden>hid</p><ul><li>i<li>j</ul></body>", "a i j"),
    ("<article><p>" + "w " * 100000 + "</p></article>", ("w " * 100000).strip()),
    ("<![CDATA[x]]><p>y</p><!unclosed", "y"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_cases(page, want):
    assert main_text(page) == want


LEAD, BODY, END = "lead words " * 45, "<p>" + "body words " * 100 + "</p>", "closing words " * 20


@pytest.mark.parametrize("outer,inner", [("div", "div"), ("main", "article"), ("section", "div")])
def test_clusters_outside_the_largest_box(outer, inner):
    page = f"<body><nav>menu</nav><{outer}><h1>Head</h1><p>{LEAD}</p><{inner}>{BODY * 10}</{inner}><p>{END}</p></{outer}><footer>f</footer></body>"
    assert main_text(page) == " ".join(f"Head {LEAD} {'body words ' * 1000} {END}".split())


ART = "".join(f"<p>{'the story goes on ' * n}</p>" for n in (9, 30, 2, 14, 25))
TEXT = " ".join("the story goes on" for _ in range(80))
SIDE = "<p>" + "something else entirely " * 12 + "</p>"


@pytest.mark.parametrize("page", [
    f"<body><div class='legal-analysis'>{ART}</div><div class=sidebar>side box x</div></body>",
    f"<body><div class='related-work'>{ART}</div><div class='related'>{SIDE}</div></body>",
    f"<body><article>{ART}<div class='user-comments'>{SIDE * 9}</div></article></body>",
    f"<body><div>{ART}</div><section id='reader-responses'>{SIDE * 4}</section></body>",
    f"<body><div>{ART}</div><div class='story-related-links'>{SIDE}</div></body>",
    f"<body><div class=wrap><div class='promo box'>{SIDE}</div>{ART}</div></body>",
    f"<body><div><a href=a>Home</a><br><a href=b>News</a><br><a href=c>Contact</a><br><a href=d>Imprint</a></div><div>{ART}</div></body>",
    f"<body><div class=page><div id=top-menu><ul><li><a>x</a><li><a>y</a></ul></div><div><div>{ART}</div></div></div><div class=footer-legal>(c) us</div></body>",
    f"<body><article>{ART}</article><div class='notice'>{SIDE * 60}</div></body>",
    f"<body><table><tr><td class=nav><a>a</a><td>{ART}<td class=ads>{SIDE}</table></body>",
    f"<body><main><div class=header-ad>{SIDE}</div><section>{ART}</section></main><aside>{SIDE}</aside></body>",
    f"<body><div class='cookie-consent-bar'>{SIDE}</div><div class='entry-content'>{ART}</div><div class='newsletter-signup'>{SIDE}</div></body>",
])
def test_clusters_decide(page):
    assert main_text(page) == TEXT


def test_headings_and_short_lines_stay():
    page = f"<body><div id=nav><a>x</a></div><div class=post><div class=post-header><h1>Title here</h1></div><div class=post-body><p>Short.</p>{ART}<ul><li>one<li>two</ul></div></div><div class=share>tell them</div></body>"
    assert main_text(page) == f"Title here Short. {TEXT} one two"


def test_scores_are_those_of_the_method():
    """Ratio, smoothing and threshold, written out plainly, on lines whose tags are counted by hand."""
    page = html_text.Lines().read("<body><nav><p>menu</nav><div><h2>Head</h2><p>" + "x" * 300 + "</p><p>a <b>b</b> <i>c</i></p></div><div class=ad>" + "y" * 40 + "</div></body>")
    assert [(x.text[:4], x.tags, x.out) for x in page.lines] == [("menu", 4, True), ("Head", 3, False), ("xxxx", 2, False), ("a b ", 6, False), ("yyyy", 3, False)]
    ratio = [0, math.log(1 + 4 / 3), math.log(1 + 300 / 2), math.log(1 + 5 / 6), math.log(1 + 40 / 3 / 1000)]
    w = [math.exp(-d * d / 2) for d in range(3)]
    smooth = [sum(ratio[j] * w[abs(i - j)] for j in range(5) if abs(i - j) < 3) / sum(w[abs(i - j)] for j in range(5) if abs(i - j) < 3) for i in range(5)]
    smooth[4] = ratio[4]  # alone in its element
    got, least, low = html_text.scored(page)
    assert got == pytest.approx(smooth) and least == pytest.approx(sum(smooth[1:4]) / 3 / 2) and [k >= 0 for k in low] == [False] * 4 + [True]
    assert html_text.region(page) == ["Head", "x" * 300, "a b c"]


def plain(page):
    """The article of the driver's pages, which have no other markup in it than p, br, h1 and b."""
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"</?(p|br|h1|b)>", lambda m: "" if m[1] == "b" else " ", body)).split())


def test_pages(spark, sf):
    got = html_text.op3_html_text(spark, sf).collect()
    page = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(got) == len(page)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (page[r.page_id].url, plain(page[r.page_id].html), len(r.text))


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>", "t"), (1, "u", "<p>x</p>", "t"), (None, None, None, None)], "page_id int, url string, html string, text string")
    assert html_text.extract(df, F.col("html"), ("page_id", "url")).count() == 3
    assert html_text.extract(df.limit(0), F.col("html"), ("page_id", "url")).count() == 0
