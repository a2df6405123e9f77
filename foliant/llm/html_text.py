"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser streams a page's events. Each block of text is a line with its text,
the letters of it that stand in links, the tags met in it, and the elements that hold it. Blocks in menus, page headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments are set apart by their elements' names,
roles and class or id words, and outside articles copyright notices by how they begin. The ratio of a line's letters outside links to its tags, smoothed over the
lines by a Gaussian, is held against a threshold (the mean of the smoothed ratios less half a
standard deviation); runs of lines above it are clusters. The innermost element that holds all
clusters (article and main elements first, lists and tables never) is the content region, and every block in it that isn't
set apart is text: short ones, too, and inside articles those that are only links. Where that region is no article, paragraphs, lists
and tables directly in the elements around it are text as well, as a short lead may be below the threshold.

Character references are decoded; white space inside a block becomes one space, and line breaks
inside a block are white space. Null or empty html gives an empty text. Rows are independent; repeated
rows and other columns of any name need nothing; null ids and urls stay null. An empty table gives an empty one. Elements
are numbered as they open, so a page of any length and depth, closed or not, takes time in proportion to its length.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import map_arrow, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose text is never content.
APART = frozenset("nav footer aside form script style noscript template button select option textarea input iframe object svg math canvas audio video head title dialog menu datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of classes and ids that name such blocks; a name's words are cut at -, _ and capitals.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner sidebar sidebars aside rail menu menus nav navbar navigation navigations topnav subnav breadcrumb breadcrumbs pagination pager footer footers masthead cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist commentary discussion disqus adbox adslot adunit adcontainer adwrapper adbanner skyscraper reply replies respond responses toolbar search skip copyright".split()
)
#: With such a word, a name says what a block has or lacks, not what it is.
DENIES = frozenset("has with no without".split())
#: With such a word, a header is a text's, not the page's.
TITLED = frozenset("article post entry content story section has with no without".split())
#: Articles that are no content.
ASIDE_ARTICLE = frozenset("comment comments reply ad advert sponsored related".split())
#: Elements that hold the page itself, whatever they are called.
WHOLE = frozenset("html body article main".split())
#: Elements set apart that may stand in the middle of a block, which goes on behind them.
WITHIN = frozenset("script style noscript template button select option textarea iframe object svg math canvas audio video datalist".split()) | INLINE
ARTICLES = frozenset(("article", "main"))
#: Pieces of a text, which more of it may stand beside: never the content region.
PIECES = frozenset("p li td th tr pre blockquote ul ol dl dt dd table thead tbody tfoot caption figure figcaption address details summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A paragraph ends where one of these begins.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: What an opening tag closes, and which elements it doesn't look beyond.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SPACE = re.compile(r"\s+")
#: How a block outside articles begins that is a page's copyright notice, whatever its element is called.
NOTICE = re.compile(r"\s*(?:©|\([cC]\)\s*[0-9]{4}|[Cc]opyright\s+(?:©|\([cC]\)|[0-9]{4}))")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Block:
    """A block of text: the number of the element that it stands in, and what the elements say of it."""

    __slots__ = ("apart", "chars", "holder", "linked", "tags", "text")

    def __init__(self, holder: int, apart: bool):
        self.holder, self.apart, self.text, self.linked, self.tags, self.chars = holder, apart, [], 0, 1, 0


def set_apart(tag: str, attrs: list[tuple[str, str | None]], inside_article: bool) -> bool:
    """Whether an element's blocks are no content, by its name, role, classes and id."""
    if tag in APART or tag == "header" and not inside_article:
        return True
    for key, value in attrs:
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            return True
        if key == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True
        if key in ("class", "id") and value and tag not in HEADINGS:
            words = [w.lower() for w in NAME_WORD.findall(value)] + ["".join(NAME_WORD.findall(w)).lower() for w in value.split()]
            if "header" in words and not inside_article and tag not in WHOLE and not any(w in TITLED for w in words):
                return True
            names = ASIDE_ARTICLE if tag == "article" else () if tag in WHOLE else NAMES
            if any(w in names for w in words) and not any(w in DENIES for w in words):
                return True
    return False


class Reader(HTMLParser):
    """Blocks of text in page order, and the elements, numbered as they open: 0 is the page.

    Of each element: its tag, the block element it stands in, the last number within it, the innermost article it is in (0 for none),
    and the innermost element, itself or around it, that is no piece of a text. An element holds what has its number to its last one.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, int, bool, Block | None]] = []
        self.opened: Counter = Counter()
        self.holders = [0]
        self.tag_of, self.parent, self.last, self.article, self.frame = [""], [0], [0], [0], [0]
        self.block: Block | None = None
        self.links = 0
        self.articles = 0
        self.apart = 0

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._close({"p"}, {"table", "td", "th", "button", "div", "article", "section", "main"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag == "br":
            self._add(" ")
        if tag in VOID:
            if self.block:
                self.block.tags += 1
            if tag not in INLINE:
                self.block = None
            return
        away = set_apart(tag, attrs, self.articles > 0)
        number, up = len(self.tag_of), self.holders[-1]
        self.tag_of.append(tag)
        self.parent.append(up)
        self.last.append(number)
        self.article.append(number if tag in ARTICLES else self.article[up])
        self.frame.append(self.frame[up] if tag in PIECES or tag in HEADINGS else number)
        if tag not in INLINE:
            self.holders.append(number)
        self.open.append((tag, number, away, self.block if tag in WITHIN else None))
        self.opened[tag] += 1
        self.links += tag == "a"
        self.articles += tag in ARTICLES
        self.apart += away
        if tag not in INLINE or away:
            self.block = None
        elif self.block:
            self.block.tags += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("path", "rect", "circle", "use", "line", "g"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.opened[tag]:
            if tag in ("br", "p"):
                self.handle_starttag(tag, [])
            return
        bound = () if tag in WHOLE or tag not in INLINE else ("p", "div", "li", "td", "th", "article", "section")
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._cut(k)
                return
            if self.open[k][0] in bound:
                return

    def _close(self, tags: set[str], until: set[str]) -> None:
        if not any(self.opened[t] for t in tags):
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                self._cut(k)
                return
            if self.open[k][0] in until:
                return

    def _cut(self, k: int) -> None:
        """Closes the k-th open element and what is open in it."""
        for tag, number, away, outer in reversed(self.open[k:]):
            self.last[number] = len(self.tag_of) - 1
            self.opened[tag] -= 1
            self.links -= tag == "a"
            self.articles -= tag in ARTICLES
            if tag not in INLINE:
                self.holders.pop()
            self.apart -= away
            if tag not in INLINE or away:
                self.block = outer
        del self.open[k:]

    def _add(self, data: str) -> None:
        if self.block is None:
            if not data.strip():
                return
            self.block = Block(self.holders[-1], self.apart > 0)
            self.blocks.append(self.block)
        self.block.text.append(data)
        n = len(data.strip())
        self.block.chars += n
        if self.links:
            self.block.linked += n

    def handle_data(self, data):
        self._add(data)

    def done(self) -> None:
        """Closes the page."""
        self.close()
        self._cut(0)
        self.last[0] = len(self.tag_of) - 1

    def holds(self, element: int, block: Block) -> bool:
        return element <= block.holder <= self.last[element]

    def shared(self, blocks: list[Block]) -> int:
        """The innermost element that holds every one of the blocks."""
        low, high = min(b.holder for b in blocks), max(b.holder for b in blocks)
        while self.last[low] < high:
            low = self.parent[low]
        return low


def smoothed(ratios: np.ndarray, sigma: float = 1.5) -> np.ndarray:
    reach = int(3 * sigma) + 1
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), "valid")


def region(page: Reader, blocks: list[Block]) -> tuple[int, int, int]:
    """The number of the element that holds the page's content (0 is the page), and the first and last block above the threshold."""
    ratios = np.array([0.0 if b.apart else max(0, b.chars - 2 * b.linked) / b.tags for b in blocks])
    smooth = smoothed(ratios)
    dense = (smooth >= smooth.mean() - 0.5 * smooth.std()) & (ratios > 0)
    above_at = np.nonzero(dense)[0].tolist() or [0]
    ends = above_at[0], above_at[-1]
    clusters = [b for b, above in zip(blocks, dense.tolist(), strict=True) if above]
    if not clusters:
        return (0, *ends)
    within = [b for b in clusters if page.article[b.holder]]
    # the letters of each article, those of articles in it, too: inner ones have higher numbers
    weight: Counter = Counter()
    for b in within:
        weight[page.article[b.holder]] += b.chars
    inner = sorted(weight)
    while inner:
        around = page.article[page.parent[inner[-1]]]
        own = weight[inner.pop()]
        if around:
            if around not in weight:
                bisect.insort(inner, around)
            weight[around] += own
    if within and max(weight.values()) >= 0.3 * sum(b.chars for b in clusters):
        # articles beside each other are one region: the innermost element that holds all of their clusters; of articles in each other, the outermost
        inside = page.shared(within)
        while around := page.article[inside]:
            inside, at = around, page.parent[around]
            if not page.article[at]:
                break
            inside = at
        return (inside, *ends)
    # the innermost element with all the clusters: beyond it, only the page's frame, but for a title that stands before
    inside = page.frame[page.shared(clusters)]
    own = next((k for k, b in enumerate(blocks) if page.holds(inside, b)), 0)
    for b in blocks[: min(own, ends[1])]:
        if page.tag_of[b.holder] == "h1" and not b.apart:
            inside = page.shared([b, blocks[own]])
            break
    return (inside, *ends)


def is_menu(b: Block, page: Reader) -> bool:
    """Before the first or behind the last cluster, a block outside articles that is nothing but links, and no heading."""
    return b.linked >= 0.9 * b.chars and page.tag_of[b.holder] not in HEADINGS and not page.article[b.holder]


def above(page: Reader, inside: int) -> set[int]:
    """The elements that the content region stands in."""
    found = set()
    while inside:
        inside = page.parent[inside]
        found.add(inside)
    return found


def main_text(html: str | None) -> str:
    """The blocks of the content region, in page order, one line each."""
    if not html:
        return ""
    page = Reader()
    page.feed(html)
    page.done()
    blocks = [b for b in page.blocks if any(t.strip() for t in b.text)]
    for b in blocks:
        b.apart = b.apart or not page.article[b.holder] and NOTICE.match("".join(b.text)) is not None
    if all(b.apart for b in blocks):
        return ""
    inside, first, last = region(page, blocks)
    holders = set() if page.tag_of[inside] in ARTICLES else above(page, inside)

    def stays(k: int, b: Block) -> bool:
        # beside the region: a paragraph, heading, list, table or bare text directly in an element that the region stands in
        own = page.holds(inside, b)
        return not b.apart and (own and first <= k <= last or (own or page.frame[b.holder] in holders) and not is_menu(b, page))

    kept = [b for k, b in enumerate(blocks) if stays(k, b)]
    lines = (SPACE.sub(" ", "".join(b.text)).strip() for b in kept)
    return "\n".join(x for x in lines if x)


def extract(df: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``df`` with the main text of ``html_col`` in ``text_col`` (replaced if there)."""
    rest = df.drop(text_col)
    at = rest.columns.index(html_col)
    schema = rest.select("*", F.lit(None).cast("string").alias(text_col)).schema

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text_col])

    return map_arrow(rest, each, schema, 256)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
