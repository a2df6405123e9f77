import re
import time

from foliant.llm.html_text import main_text

LONG = "A sentence that is long enough to look like the text of an article, and not a menu. "
LINE = LONG.strip()
ITEMS = "".join(f"<li>{LONG}{LONG}</li>" for _ in range(20))
PARAS = f"<p>{LONG}{LONG}</p>" * 20


def ends(page):
    lines = main_text(page).split("\n")
    return len(lines), lines[0], lines[-1]


def test_text_beside_the_densest_element_stays():
    for many in (f"<ul>{ITEMS}</ul>", f"<table>{ITEMS.replace('<li>', '<tr><td>').replace('</li>', '</td></tr>')}</table>", f"<div>{PARAS}</div>", f"<section>{PARAS}</section>"):
        assert ends(f"<body><div class=header>Logo</div><div class=post><p>Lead. {LONG}</p>{many}<p>End. {LONG}</p></div></body>") == (22, f"Lead. {LINE}", f"End. {LINE}")
    assert ends(f"<body><div class=post><p>Lead</p><ul>{ITEMS}</ul><p>End</p></div></body>") == (22, "Lead", "End")


def test_text_beside_a_nested_article_stays():
    assert ends(f"<body><main><p>Lead</p><article>{PARAS}</article><p>End</p></main><p>frame</p></body>") == (22, "Lead", "End")
    assert ends(f"<body><div><article>{PARAS}</article><article><p>Last. {LONG}{LONG}</p></article></div></body>") == (21, f"{LINE} {LINE}", f"Last. {LINE} {LINE}")


def test_link_paragraphs_of_an_article_stay():
    page = f"<body><ul><li><a href=/>Home</a></ul><article><p><a href=a>First link</a></p>{PARAS}<p><a href=b>Last link</a></p></article><ul><li><a href=/>More</a></ul></body>"
    assert ends(page) == (22, "First link", "Last link")


def test_clusters_find_the_article_without_names_of_elements(spark):
    """The driver's pages with every structural element made a div: the ratios alone must find the text."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    same = sum(main_text(re.sub(r"<(/?)(?:nav|header|footer|aside|article|main|section)\b", r"<\1div", h)) == main_text(h) for h in pages)
    assert same >= 0.9 * len(pages)


def test_notices():
    page = "<div><div><p>" + "Words of the article, quite a few. " * 9 + "</p><p>Copyright law is old.</p></div><div>© 2024 somebody else entirely</div></div>"
    assert main_text(page).endswith("Copyright law is old.") and "©" in main_text(f"<article><p>{'Words. ' * 40}</p><p>© me</p></article>")


def test_time_is_linear_in_unclosed_elements():
    for part in ("<div>x", "<b>x", "<span></i>y", "<ul><b>z", "<p><div>q", "<article>w"):
        at = time.process_time()
        main_text(part * 20_000)
        assert time.process_time() - at < 6, part
