"""Character ranges of sections, and joins of ranges with points and with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as t


def _later(key: str) -> Window:
    return Window.partitionBy(key).orderBy("char_start").rangeBetween(1, Window.unboundedFollowing)


def subtree_end(df: DataFrame, size: str, key: str = "doc_id", out: str = "subtree_end") -> DataFrame:
    """The next later start of a heading of the same or a smaller level; the text's size where none follows."""
    ends = [F.when(F.col("level") >= k, F.min(F.when(F.col("level") == k, F.col("char_start"))).over(_later(key))) for k in range(1, 9)]
    return df.withColumn(out, F.coalesce(F.least(*ends), F.col(size)))


def same_level_end(df: DataFrame, size: str, key: str = "doc_id", out: str = "same_level_end") -> DataFrame:
    """The next later start at the same level, whatever stands between."""
    w = Window.partitionBy(key, "level").orderBy("char_start").rangeBetween(1, Window.unboundedFollowing)
    return df.withColumn(out, F.coalesce(F.min("char_start").over(w), F.col(size)))


def own_body_end(df: DataFrame, closure: DataFrame, size: str, key: str = "doc_id", out: str = "own_end") -> DataFrame:
    """The first later start among the node's descendants, else of a node of the same or a smaller level, else the size.

    ``closure`` has key, ord and ancestors (ords up to the node itself).
    """
    below = closure.select(key, F.col("ord").alias("child"), F.explode("ancestors").alias("ord")).where("child <> ord")
    starts = df.select(key, F.col("ord").alias("child"), F.col("char_start").alias("child_start"))
    own = df.select(key, "ord", "char_start").join(below, [key, "ord"]).join(starts, [key, "child"]).where("child_start > char_start")
    first = own.groupBy(key, "ord").agg(F.min("child_start").alias("first_child"))
    return subtree_end(df.join(first, [key, "ord"], "left"), size, key, "beyond").withColumn(out, F.coalesce("first_child", "beyond")).drop("first_child", "beyond")


def node_at(points: DataFrame, nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, ord) for points (key, pos): the first node in outline order whose range holds the point; null before all.

    ``nodes`` has key, ord, char_start, subtree_end.
    """
    n = nodes.select(F.col(key).alias("k2"), "ord", "char_start", "subtree_end")
    hit = points.join(n, (F.col(key) == F.col("k2")) & (F.col("pos") >= F.col("char_start")) & (F.col("pos") < F.col("subtree_end")), "left")
    return hit.groupBy(key, "pos").agg(F.min("ord").alias("ord"))


def overlapping(slices: DataFrame, blocks: DataFrame, key: str = "doc_id", lookahead: int = 0) -> DataFrame:
    """Slices (key, slice_id, s, e) with the blocks (key, block_index, char_start, char_end, ...) that reach into them."""
    b = blocks.withColumnRenamed(key, "k2")
    return slices.join(b, (F.col(key) == F.col("k2")) & (F.col("char_end") > F.col("s")) & (F.col("char_start") < F.col("e") + lookahead)).drop("k2")


def substitute_tables(slices: DataFrame, tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, slice_id, text): slices (key, slice_id, s, e, content) in which each table that reaches in is replaced whole by its llm_text."""
    cut = overlapping(slices.select(key, "slice_id", "s", "e"), tables.select(key, "char_start", "char_end", "llm_text", F.lit(0).alias("block_index")), key)
    per = cut.groupBy(key, "slice_id").agg(F.array_sort(F.collect_list(F.struct("char_start", "char_end", "llm_text"))).alias("cuts"))
    start = F.struct(F.col("s").cast("long").alias("at"), F.lit("").alias("out"))
    piece = lambda a, b: F.substring(F.col("content"), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    folded = F.aggregate("cuts", start, lambda acc, x: F.struct(F.greatest(acc["at"], x["char_end"]).cast("long").alias("at"), F.concat(acc["out"], piece(acc["at"], x["char_start"]), x["llm_text"], F.lit("\n\n")).alias("out")))
    both = slices.join(per, [key, "slice_id"], "left").withColumn("f", folded)
    return both.select(key, "slice_id", F.when(F.col("cuts").isNull(), piece(F.col("s"), F.col("e"))).otherwise(F.concat(F.col("f.out"), piece(F.col("f.at"), F.col("e")))).alias("text"))


def excerpt_range(content, excerpt):
    """struct(char_start, char_end) of the excerpt in the content: exact, else its longest beginning of more than a third (8 at least) that occurs; else null."""
    own = t.strip(excerpt)
    exact = F.instr(content, excerpt)
    n = F.length(own)
    least = F.greatest(F.lit(8), F.floor(n / 3).cast("int"))
    # if a beginning occurs, so do shorter ones: halve what is between the longest known to occur and the longest that may
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)) + 1)).cast("int"))
    middle = lambda acc: F.floor((acc["low"] + acc["high"] + 1) / 2).cast("int")
    halved = lambda acc, _: F.when(acc["low"] >= acc["high"], acc).when(F.instr(content, F.left(own, middle(acc))) > 0, F.struct(middle(acc).alias("low"), acc["high"].alias("high"))).otherwise(F.struct(acc["low"].alias("low"), (middle(acc) - 1).alias("high")))
    longest = F.aggregate(steps, F.struct(least.alias("low"), F.greatest(n, least).alias("high")), halved, lambda acc: acc["low"])
    size = F.when(longest > least, longest)
    made = lambda at, k: F.struct(at.cast("long").alias("char_start"), (at + k).cast("long").alias("char_end"))
    return F.when(own == "", F.lit(None)).when(exact > 0, made(exact - 1, F.length(excerpt))).when(size.isNotNull(), made(F.instr(content, F.left(own, size)) - 1, size))


def located(content, part, hint):
    """struct(char_start, char_end) of a part's stripped text in the content at or behind ``hint``; else of its first 120 characters; else at the hint itself."""
    own = t.strip(part)
    at = F.call_function("locate", own, content, hint + 1)
    near = F.call_function("locate", F.left(own, F.lit(120)), content, hint + 1)
    start = F.when(at > 0, at - 1).when(near > 0, near - 1).otherwise(hint).cast("long")
    return F.struct(start.alias("char_start"), (start + F.length(own)).alias("char_end"))


def paragraph_excerpt(content, title, least: int = 200, most: int = 800):
    """From the first paragraph with the title: paragraphs until ``most`` characters, further ones while fewer than ``least``."""
    paragraphs = F.filter(F.transform(F.split(content, r"\n\s*\n"), t.strip), lambda p: p != "")
    at = F.coalesce(F.try_element_at(F.filter(F.sequence(F.lit(1), F.greatest(F.size(paragraphs), F.lit(1))), lambda i: F.contains(F.try_element_at(paragraphs, i), title)), F.lit(1)), F.lit(1))
    rest = F.slice(paragraphs, at, F.greatest(F.size(paragraphs), F.lit(1)))
    joined = lambda a, p: F.when(a == "", p).otherwise(F.concat(a, F.lit("\n\n"), p))
    packed = F.aggregate(rest, F.lit(""), lambda a, p: F.when((a == "") | (F.length(a) < least) | (F.length(joined(a, p)) <= most), joined(a, p)).otherwise(a))
    return F.left(packed, F.lit(most))
