"""Scalar functions on text columns; all run in the JVM.

Python's Unicode-wide classes are meant by \\s and \\d, hence (?U); lines end at \\n alone, hence (?d).
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, patterns and marks that results depend on.
HEADING = r"(?md)^(#{1,8})[ \t]+(.+?)[ \t#]*$"
IMAGE = r"!\[[^\]]*\]\(([^)]+)\)"
TABLE_REF_COMMENT = r"<!--\s*table-ref:\s*(tables/t\d+\.json)\s*-->"
TABLE_REF_MARK = r"⟦table:([^⟧]+)⟧"
CHAPTER = r"(?U)^第[一二三四五六七八九十百千0-9]+[章节编部分卷篇]\s+(.+)$"
ENUM = r"^[一二三四五六七八九十百零]+、(.+)$"
LIST_ITEM = r"(?U)^\d+、"
COLON_BODY = r"^[^：:\n]{2,40}[：:].+"
LOCAL_ENUM = r"(?U)^[一二三四五六七八九十]+、.+[：:]\s*$"
SECTIONED = r"(?U)^(\d+(?:\.\d+)+)([^\d].+)$"
DOTTED = r"(?U)^(\d+)\.[ \t]+(.+)$"
SPACED = r"(?U)^(\d+)[ \t]+(.+)$"
LIST_PREFIX = r"(?U)^(?:[一二三四五六七八九十百]+|\d+)[、.．]"
NUMBER_PREFIX = r"(?U)^\d+(?:\.\d+)*[\s、.．]+"
PARENTHESES = r"[（(][^）)]*[）)]|[（()）]"
SCORING_TEXT = r"(?U)评分说明|分值|得分|\d+\s*[-~–—]\s*\d+\s*分"
ENUM_MOST, LINE_MOST, TITLE_MOST = 60, 120, 50
FILE_TYPES = {".docx": "docx", ".doc": "doc", ".docm": "docm", ".pdf": "pdf"}
MISSING = "（未提供）"
COUNTING, LEGAL = "零一二三四五六七八九", "零壹贰叁肆伍陆柒捌玖"
CONFIDENCE = {"high": 0.9, "medium": 0.7, "low": 0.5}
BLOCK_CHARS = 32_000


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def normalize_ws(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def estimate_tokens(c: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(c) / 4).cast("long")


def truncate(c: Column, most: int = BLOCK_CHARS) -> Column:
    return F.left(c, F.lit(most))


def file_type(path: Column) -> Column:
    """docx, doc, docm or pdf by the path's suffix; null for any other."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    return F.coalesce(*[F.when(suffix == k, F.lit(v)) for k, v in FILE_TYPES.items()])


def image_refs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(IMAGE), F.lit(1))


def distinct_image_refs(c: Column) -> Column:
    """Trimmed references, first seen first."""
    return F.array_distinct(F.transform(image_refs(c), strip))


def table_ref(line: Column) -> Column:
    """The sidecar that a line refers to, by a comment or a mark; else null."""
    found = lambda p: F.nullif(F.regexp_extract(line, p, 1), F.lit(""))
    return F.coalesce(found(TABLE_REF_COMMENT), found(TABLE_REF_MARK))


def table_ref_comment(ref: Column) -> Column:
    return F.concat(F.lit("<!-- table-ref:"), ref, F.lit(" -->"))


def normalize_title(c: Column) -> Column:
    """Without a leading section number, trimmed, in lower case."""
    return F.lower(strip(F.regexp_replace(strip(c), NUMBER_PREFIX, "")))


def is_list_body(line: Column) -> Column:
    s = strip(line)
    return (s != "") & (s.rlike(LIST_ITEM) | (s.rlike(COLON_BODY) & ~s.rlike(ENUM)))


def is_local_enum(line: Column) -> Column:
    """A paragraph that opens a local list, such as 一、……："""
    return strip(line).rlike(LOCAL_ENUM)


def is_enum_line(line: Column) -> Column:
    return strip(line).rlike(ENUM)


def heading_line(line: Column) -> Column:
    """struct(level, title) of a numbered heading in plain text; null for any other line."""
    s = strip(line)
    part = lambda p, k: strip(F.regexp_extract(s, p, k))
    colon = lambda t: t.endswith("：") | t.endswith(":")
    made = lambda level, title: F.struct(level.cast("int").alias("level"), title.alias("title"))
    numeric = F.coalesce(*[F.when(s.rlike(p), F.struct(F.regexp_extract(s, p, 1).alias("seq"), part(p, 2).alias("title"))) for p in (SECTIONED, DOTTED, SPACED)])
    depth = F.least(F.length(numeric["seq"]) - F.length(F.replace(numeric["seq"], F.lit("."))) + 1, F.lit(8))
    title = numeric["title"]
    ok = (title != "") & ~colon(title) & ~((depth == 1) & ((F.length(title) > TITLE_MOST) | title.contains("：") | title.contains(":")))
    body = part(ENUM, 1)
    return (
        F.when((s == "") | (F.length(s) > LINE_MOST) | is_list_body(line), F.lit(None))
        .when(s.rlike(CHAPTER), made(F.lit(1), F.coalesce(F.nullif(part(CHAPTER, 1), F.lit("")), s)))
        .when(s.rlike(ENUM), F.when((body != "") & ~colon(body) & (F.length(s) <= ENUM_MOST), made(F.lit(1), s)))
        .when(numeric.isNotNull() & ok, made(depth, title))
    )


def merge_list_prefix(text: Column, prefix: Column) -> Column:
    """The list prefix before a text that has no number of its own."""
    s = strip(text)
    own = (s == "") | (F.coalesce(prefix, F.lit("")) == "") | s.rlike(LIST_PREFIX) | heading_line(text).isNotNull() | F.startswith(s, prefix)
    return F.when(own, s).otherwise(F.concat(prefix, s))


def chinese_number(n: Column) -> Column:
    """Counting numerals below 1000, digits beyond and below 1."""
    digit = lambda x: F.substring(F.lit(COUNTING), x + 1, F.lit(1))
    whole = lambda x: F.floor(x).cast("int")
    ones = lambda x: F.when(x % 10 == 0, F.lit("")).otherwise(digit((x % 10).cast("int")))
    tens = lambda x: F.when(x < 10, digit(x.cast("int"))).when(x < 20, F.concat(F.lit("十"), ones(x))).otherwise(F.concat(digit(whole(x / 10)), F.lit("十"), ones(x)))
    rest = n % 100
    hundreds = F.concat(digit(whole(n / 100)), F.lit("百"), F.when(rest == 0, F.lit("")).when(rest < 10, F.concat(F.lit("零"), digit(rest.cast("int")))).otherwise(tens(rest)))
    return F.when((n <= 0) | (n >= 1000), n.cast("string")).when(n < 100, tens(n)).otherwise(hundreds)


def legal_number(n: Column) -> Column:
    return F.when((n <= 0) | (n >= 10), n.cast("string")).otherwise(F.substring(F.lit(LEGAL), n.cast("int") + 1, F.lit(1)))


def format_number(n: Column, form: Column) -> Column:
    return F.when(form.isin("chineseCounting", "chineseCountingThousand", "ideographTraditional"), chinese_number(n)).when(form.isin("chineseLegalSimplified", "chineseLegalTenThousand"), legal_number(n)).otherwise(n.cast("string"))


@functools.cache
def _compatible() -> tuple[str, str]:
    """The letters below U+10000 that compatibility normalisation (NFKC) makes one other letter, and those."""
    found = [(c, x) for c in map(chr, range(0x80, 0xD800)) if len(x := unicodedata.normalize("NFKC", c)) == 1 and x != c]
    found += [(c, x) for c in map(chr, range(0xF900, 0xFFF0)) if len(x := unicodedata.normalize("NFKC", c)) == 1 and x != c]
    return "".join(c for c, _ in found), "".join(x for _, x in found)


def wide_to_narrow(c: Column) -> Column:
    """Full-width forms, the wide space and other letters as the ones that compatibility normalisation makes of them; those it makes several of stay."""
    return F.translate(c, *_compatible())


def loose_title(c: Column) -> Column:
    """For comparing titles: narrow forms, no parentheses nor what they hold, no white space, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(wide_to_narrow(c), PARENTHESES, ""), r"(?U)\s+", ""))


def char_jaccard(a: Column, b: Column) -> Column:
    """Shared over all letters of two texts; 1 if both are empty, 0 if one is."""
    x, y = F.split(a, ""), F.split(b, "")
    return F.when((a == "") & (b == ""), F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def limit_summary(c: Column, most: int) -> Column:
    """At most so many characters; cut behind the first of 。；\\n， or space, in this order, whose last place is past the half."""
    head = F.left(c, F.lit(most))
    cuts = []
    for mark in ("。", "；", "\n", "，", " "):
        last = F.length(head) - F.locate(mark, F.reverse(head))
        cuts.append(F.when((F.locate(mark, head) > 0) & (last > most // 2), strip(F.left(head, last + 1))))
    return F.when(F.length(c) <= most, c).otherwise(F.coalesce(*cuts, strip(head)))


def confidence(c: Column) -> Column:
    """Words or numbers as a number from 0 to 1; 0.8 for what is neither."""
    word = F.coalesce(*[F.when(F.lower(strip(c)) == k, F.lit(v)) for k, v in CONFIDENCE.items()])
    number = c.try_cast("double")
    return F.coalesce(word, F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0))), F.lit(0.8))


def weight_text(c: Column) -> Column:
    """A number's text without a needless .0."""
    return F.regexp_replace(c.cast("string"), r"\.0+$", "")


def first_text(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in columns], F.lit(MISSING))


def is_scoring_text(c: Column) -> Column:
    return c.rlike(SCORING_TEXT)


def is_small_image(size: Column, width: Column, height: Column) -> Column:
    """Logos that no model looks at."""
    return (size <= 10_240) & ((width < 128) | (height < 128))


def sha256_hex(c: Column) -> Column:
    """The digest that files and images are known by."""
    return F.sha2(c.cast("binary"), 256)


def base64_text(c: Column) -> Column:
    """Bytes as they are sent to a model, without line breaks."""
    return F.regexp_replace(F.base64(c.cast("binary")), r"\s", "")


def seconds_between(start: Column, end: Column) -> Column:
    """A duration in seconds, to two places."""
    return F.round(F.unix_micros(end.cast("timestamp")) / 1e6 - F.unix_micros(start.cast("timestamp")) / 1e6, 2)


def run_timestamp() -> Column:
    """The run's time in UTC as text, one value in all rows of a query."""
    return F.date_format(F.convert_timezone(None, F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def new_id() -> Column:
    """A random id; not for what is compared between runs."""
    return F.expr("uuid()")
