"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression yields a Boolean query over trigrams that any match must hold: an OR
of alternatives, each an AND of trigrams (in lower case, so that letter case doesn't matter). The texts are indexed
by the trigrams that some query asks for: postings (trigram, row), kept as a table in the shared folder, a row being the hash of
id and text. Postings are intersected per alternative; what is left, (row, rule), becomes a bit map of bounded size, and rules are
verified where the texts lie, on the rows whose bit is set: no text is ever moved, and a bit set by another row costs a
search that finds nothing. A rule whose matches hold no fixed three letters has no query and scans every text.

Spans are in code points, end exclusive; per rule leftmost and non-overlapping, then those that fail the
rule's check are dropped. Null texts count as empty. Null ids and repeated rows keep their rows; rows equal in id and text
share their postings. An empty table gives an empty one; texts of any length are searched whole. Only the id and text columns are read.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import table, written

#: Bits of the map of what is to be verified: a megabyte, whatever the number of texts.
MAP_BITS = 1 << 23


@dataclass(frozen=True)
class Rule:
    """``pattern`` in Java's syntax with no group of its own but ``value``'s; ``least`` is what the match or, if given, that group must have in characters."""

    kind: str
    pattern: str
    least: int
    value: int = 0
    ignore_case: bool = False


BASE = (
    Rule("assign", r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 1, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),  # shorter runs hold no match, so this drops what the check would
)
#: Kinds beyond the base ones.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 20),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]+", 39),
)
RULES = BASE + MORE


def _alternatives(pattern: str) -> list[list[str]]:
    """For each way through the pattern's groups and optional single signs, its runs of fixed letters."""
    ways: list[list[str]] = [[""]]
    at = 0

    def each(options: list[list[str]]) -> None:
        """Goes on with every option; an option's first run continues the last one."""
        nonlocal ways
        ways = [[*w[:-1], w[-1] + o[0], *o[1:]] for w, o in itertools.product(ways, options)]

    while at < len(pattern):
        c = pattern[at]
        if c == "(":
            depth, end = 1, at + 1
            while depth:
                depth += {"(": 1, ")": -1}.get(pattern[end], 0) if pattern[end - 1] != "\\" else 0
                end += 1
            inner = pattern[at + 1 : end - 1].removeprefix("?:")
            options = [w for part in _top_level(inner) for w in _alternatives(part)]
        elif c == "[":
            end = pattern.index("]", at + 1) + 1
            options = [["", ""]]
        elif c == "\\":
            end = at + (4 if pattern[at + 1] == "x" else 2)
            options = [[pattern[at + 1]]] if not pattern[at + 1].isalnum() else [[chr(int(pattern[at + 2 : end], 16))]] if pattern[at + 1] == "x" else [["", ""]]
        else:
            end, options = at + 1, [["", ""]] if c == "." else [[c]]
        repeat = re.match(r"[*+?]|\{[0-9,]*\}", pattern[end:])
        if repeat:
            end += repeat.end()
            if repeat[0] == "?":
                options = [*options, [""]]
            elif repeat[0] == "+":
                options = [[*o, ""] if o[-1] else o for o in options]
            else:
                options = [["", ""]]
        each(options)
        at = end
    return ways


def _top_level(pattern: str) -> list[str]:
    parts, depth = [""], 0
    for c in pattern:
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The OR of these ANDs holds for any text with a match; None if an alternative has no mandatory trigram."""
    queries = set()
    for way in _alternatives(pattern):
        grams = {run[i : i + 3].lower() for run in way for i in range(len(run) - 2)}
        if not grams:
            return None
        queries.add(frozenset(grams))
    return sorted((q for q in queries if not any(p < q for p in queries)), key=sorted)


def trigrams_of(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """The trigrams that the rules' queries ask for."""
    return sorted({g for r in rules for q in trigram_query(r.pattern) or () for g in q})


def row_of(id_col: Column, text: Column) -> Column:
    return F.xxhash64(id_col, text)


def postings(df: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(trigram, row): the index over some trigrams, a table in the shared folder that any rules within them can be asked on."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    low = df.select(row_of(F.col(id_col), text).alias("row"), F.lower(text).alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in trigrams]))
    return written(low.select("row", F.explode(present).alias("trigram")), "postings")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, rule): the rows whose postings satisfy a rule's query, by the rule's place in ``rules``."""
    asked = [(k, a, g, 1 << n, (1 << len(q)) - 1) for k, r in enumerate(rules) for a, q in enumerate(trigram_query(r.pattern) or ()) for n, g in enumerate(sorted(q))]
    query = index.sparkSession.createDataFrame(asked, "rule int, way int, trigram string, bit long, needed long")
    found = index.join(F.broadcast(query), "trigram")  # a row for each of the rules' own trigrams
    met = found.groupBy("row", "rule", "way", "needed").agg(F.bit_or("bit").alias("got"))
    return met.where("got = needed").select("row", "rule").distinct()


def _bit(row: Column, rule: Column) -> Column:
    return F.pmod(F.xxhash64(row, rule), F.lit(MAP_BITS))


def bit_map(found: DataFrame) -> DataFrame:
    """One row, one array of MAP_BITS / 64 numbers: the bits of all (row, rule)."""
    at = _bit(F.col("row"), F.col("rule"))
    words = found.select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = found.sparkSession.range(MAP_BITS // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"]).alias("map"))


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start, kind, end>> of the rule's matches in ``text`` (end exclusive).

    The text is cut into pieces, each a match and what stands before it; lengths add up to offsets. A piece
    begins where the last one ended (\\G), so that the search behind the last match is given up at once.
    """
    own = ("(?i)" if rule.ignore_case else "") + rule.pattern
    pieces = F.regexp_extract_all(text, F.lit(("(?si)" if rule.ignore_case else "(?s)") + r"\G.*?" + rule.pattern), F.lit(0))
    sized = F.transform(pieces, lambda p: F.struct(F.length(p).cast("long").alias("all"), F.length(F.regexp_extract(p, own, 0)).cast("long").alias("match"), F.length(F.regexp_extract(p, own, rule.value)).alias("value")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,kind:int,end:long>>").alias("out"))
    return F.aggregate(
        sized,
        start,
        lambda acc, x: F.struct(
            (acc["at"] + x["all"]).alias("at"),
            F.when(x["value"] >= rule.least, F.concat(acc["out"], F.array(F.struct((acc["at"] + x["all"] - x["match"]).alias("start"), F.lit(_index(rule)).alias("kind"), (acc["at"] + x["all"]).alias("end"))))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def _index(rule: Rule) -> int:
    return next(k for k, r in enumerate(RULES) if r.kind == rule.kind)


def secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), a row for each row of ``df``."""
    index = postings(df, trigrams_of(), id_col, text_col) if index is None else index
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", row_of(F.col("id"), F.col("text")))
    bits = bit_map(candidates(index)).scalar()
    none = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    found = []
    for k, rule in enumerate(RULES):
        at = _bit(F.col("row"), F.lit(k))
        marked = F.getbit(F.element_at(bits, (F.shiftright(at, 6) + 1).cast("int")), (at % 64).cast("int")) == 1
        scan = marked if trigram_query(rule.pattern) is not None else F.col("text").rlike(rule.pattern)
        found.append(F.when(scan, spans_of(F.col("text"), rule)).otherwise(none).alias(rule.kind))
    cut = rows.select("id", *found)
    text = lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(r.kind) for r in RULES]), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    listed = lambda kinds: F.array_join(F.transform(F.array_sort(F.concat(*kinds)), text), ",")
    base, every = [r.kind for r in BASE], [r.kind for r in RULES]
    return cut.select(F.col("id").alias("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in base], F.sha2(listed(base), 256).alias("base_sha256"), listed(every).alias("spans"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
