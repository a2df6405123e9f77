import html
import re

import pytest
from foliant.llm import html_text
from foliant.llm.html_text import main_text

LONG = "A sentence that is long enough to look like the text of an article, and not a menu. "


def plain(page):
    """The blocks between a page's article tags, for pages of the driver's simple form."""
    article = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|li|ul)>", article)
    lines = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", b)))).strip() for b in blocks)
    return "\n".join(x for x in lines if x)


def test_like_the_articles(spark):
    path = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    got = html_text.op4_html(spark, path).collect()
    assert len(got) == len(pages)
    for r in got:
        page = pages[r["page_id"]]
        assert r["text"] == plain(page["html"]), r["page_id"]
        assert r["n_chars"] == len(r["text"]) and r["url"] == page["url"]


def test_frame_goes_and_content_stays():
    page = f"""<html><head><title>T</title><style>x</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
    <div id="cookie-notice">{LONG}</div><div class="wrap"><div class="post"><h1>Head &amp; line</h1><p>{LONG}</p><p>Short.</p><ul><li>One<li>Two</ul>
    <p>be<script>var a="</p>";</script>fore <b>bold</b>,&nbsp;<a href=x>link</a><br>next</p><div class="ad-slot">{LONG}</div><p>{LONG}{LONG}</p></div>
    <div class="sidebar"><p>{LONG}</p></div><section id="comments"><p>{LONG}</p></section></div><form><p>{LONG}</p></form><footer><p>{LONG}</p></footer></body></html>"""
    line = LONG.strip()
    assert main_text(page).split("\n") == ["Head & line", line, "Short.", "One", "Two", "before bold, link next", f"{line} {line}"]
    page = f"<body><main><article><header><h1>Title</h1><p>By A. Uthor</p></header><p>{LONG}</p><article class='comment'><p>{LONG}</p></article></article></main><aside>{LONG}</aside></body>"
    assert main_text(page).split("\n") == ["Title", "By A. Uthor", line]


def test_pages_without_names_for_things():
    line = LONG.strip()
    page = f"<body><div><a href=/>Home</a> <a href=/b>About</a></div><div><h1>Title</h1><div><p>{LONG}</p><p>Short</p><p>{LONG}</p></div></div><div class='side-bar'>{LONG}</div><div class=header>Logo</div></body>"
    assert main_text(page).split("\n") == ["Title", line, "Short", line]
    page = f"<body><ul><li><a href=/>Home</a><li><a href=/b>About</a></ul><h1>Title</h1><p>{LONG}</p><p><a href=x>all link</a></p><p>{LONG}</p><p><a href=y>next page</a></p></body>"
    assert main_text(page).split("\n") == ["Title", line, "all link", line]


@pytest.mark.parametrize("page", [None, "", "<nav>x</nav>", "<script>", "<!-- -->", "<p>", "</p></div></b>", "<a <b <c", "&#0;&bogus;", "<" * 500])
def test_odd_pages(page):
    assert isinstance(main_text(page), str)


def test_broken_and_long_pages():
    assert main_text("just words") == "just words"
    assert main_text("<p>un<b>closed<p>next") == "unclosed\nnext"
    assert main_text(f"<article><p>{'word ' * 200_000}</article>").count("word") == 200_000
    assert main_text("<article>" + "<p>line</p>" * 3000 + "</article>").count("line") == 3000
    assert main_text("<div>" * 3000 + "deep") == "deep"


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>"), (None, None, None), (1, "u", "<p>a</p>")], "page_id long, url string, html string").selectExpr("*", "5 text")
    assert sorted((str(r["page_id"]), r["text"]) for r in html_text.extract(df).collect()) == [("1", "a"), ("1", "a"), ("None", "")]
    assert html_text.extract(df.limit(0)).count() == 0
