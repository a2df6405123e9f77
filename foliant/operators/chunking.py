"""Chunks, segments and shards: ordered folds within one document's text or list of pieces.

A fold carries lengths, not strings, and its state is one document's, so documents are dealt freely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as t


def greedy_parts(text: Column, max_tokens: int) -> Column:
    """array<struct(text, start)>: whole lines packed until the next would pass ``max_tokens``; a long line is never cut."""
    lines = F.filter(F.split(text, r"(?<=\n)"), lambda x: x != "")
    # the lines go along in the state, so that they are cut once, not once a part
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("size"), F.array(F.lit(0)).alias("firsts"), F.lit(0).alias("at"), F.array(F.lit(0)).alias("starts"), lines.alias("lines"))

    def step(acc: Column, line: Column) -> Column:
        n = F.length(line)
        full = (acc["size"] > 0) & (F.floor((acc["size"] + n) / 4) > max_tokens)
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(full, n).otherwise(acc["size"] + n).alias("size"),
            F.when(full, F.concat(acc["firsts"], F.array(acc["i"]))).otherwise(acc["firsts"]).alias("firsts"),
            (acc["at"] + n).alias("at"),
            F.when(full, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts"),
            acc["lines"].alias("lines"),
        )

    def parts(acc: Column) -> Column:
        stop = lambda k: F.coalesce(F.try_element_at(acc["firsts"], k + 2), acc["i"])
        part = lambda first, k: F.struct(F.array_join(F.slice(acc["lines"], first + 1, stop(k) - first), "").alias("text"), F.element_at(acc["starts"], k + 1).alias("start"))
        return F.filter(F.transform(acc["firsts"], part), lambda p: p["text"] != "")

    return F.aggregate(lines, start, step, parts)


def chunks(df: DataFrame, key: str = "doc_id", order: str | None = None, text: str = "text", max_tokens: int = 500) -> DataFrame:
    """(key, ordinal, section, part, text, start, token_estimate): the non-blank sections' parts, numbered through the document."""
    section = F.col(order) if order else F.lit(0)
    rows = df.where(F.col(text).rlike(r"(?U)\S")).select(key, section.alias("section"), F.posexplode(greedy_parts(F.col(text), max_tokens)).alias("part", "p"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("section", "part"))
    return rows.select(key, number.alias("ordinal"), "section", "part", F.col("p.text").alias("text"), F.col("p.start").alias("start"), t.estimate_tokens(F.col("p.text")).alias("token_estimate"))


def chunk_id(ordinal: Column, prefix: str = "chunk-") -> Column:
    return F.concat(F.lit(prefix), F.lpad(ordinal.cast("string"), F.greatest(F.length(ordinal.cast("string")), F.lit(4)), F.lit("0")))


def linked(df: DataFrame, key: str = "doc_id", order: str = "ordinal") -> DataFrame:
    """Adds chunk_id and the ids before and behind it."""
    w = Window.partitionBy(key).orderBy(order)
    rows = df.withColumn("chunk_id", chunk_id(F.col(order)))
    return rows.withColumns({"previous_chunk_id": F.lag("chunk_id").over(w), "next_chunk_id": F.lead("chunk_id").over(w)})


def sections(df: DataFrame, nodes: DataFrame, key: str = "doc_id", text: str = "content_md", end: str = "own_end") -> DataFrame:
    """(key, ord, markdown): each node's slice of the text, and as ord -1 what stands before the first, if not blank."""
    body = df.select(F.col(key).alias("k2"), F.col(text).alias("content"))
    cut = nodes.join(body, F.col(key) == F.col("k2")).select(key, "ord", F.substring("content", (F.col("char_start") + 1).cast("int"), (F.col(end) - F.col("char_start")).cast("int")).alias("markdown"))
    first = nodes.groupBy(key).agg(F.min("char_start").alias("first"))
    preface = first.join(body, F.col(key) == F.col("k2")).select(key, F.lit(-1).alias("ord"), F.left("content", F.col("first").cast("int")).alias("markdown"))
    return cut.unionByName(preface.where(F.col("markdown").rlike(r"(?U)\S")))


def refined_slices(df: DataFrame, mapping: DataFrame, key: str = "doc_id", text: str = "content_md") -> DataFrame:
    """(key, ord, refined_node_id, markdown): the mapping's ranges, clamped to the text, in its order."""
    body = df.select(F.col(key).alias("k2"), F.col(text).alias("content"))
    both = mapping.join(body, F.col(key) == F.col("k2"))
    s = F.greatest(F.col("char_start"), F.lit(0))
    e = F.least(F.col("char_end"), F.length("content"))
    return both.select(key, "ord", "refined_node_id", F.substring("content", (s + 1).cast("int"), F.greatest(e - s, F.lit(0)).cast("int")).alias("markdown"))


def merge_small(df: DataFrame, least_tokens: int, key: str = "doc_id", order: str = "ord", text: str = "text") -> DataFrame:
    """(key, segment, first, last, text): pieces merged forward until each has ``least_tokens``; the last may have fewer."""
    lstrip = lambda c: F.regexp_replace(c, r"(?U)^\s+", "")
    piece = F.struct(F.col(order).cast("long").alias("o"), F.col(text).alias("t"), F.length(text).alias("n"), F.length(lstrip(F.col(text))).alias("left"), F.length(t.rstrip(F.col(text))).alias("right"), F.length(t.strip(F.col(text))).alias("own"))
    pieces = df.groupBy(key).agg(F.array_sort(F.collect_list(piece)).alias("p"))
    # the state: where the open segment began, its size without the white space at its end, and the segments as places in p
    none = F.array().cast("array<struct<from:int,to:int>>")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("from"), F.lit(0).alias("bare"), F.lit(False).alias("open"), none.alias("out"), F.col("p").alias("p"))

    def step(acc: Column, x: Column) -> Column:
        size = F.when(acc["open"], acc["bare"] + 2 + x["left"]).otherwise(x["n"])
        bare = F.when(~acc["open"], x["right"]).when(x["own"] > 0, acc["bare"] + 2 + x["own"]).otherwise(acc["bare"])
        first = F.when(acc["open"], acc["from"]).otherwise(acc["i"])
        small = F.floor(size / 4) < least_tokens
        closed = F.concat(acc["out"], F.array(F.struct(first.alias("from"), acc["i"].alias("to"))))
        return F.struct((acc["i"] + 1).alias("i"), first.alias("from"), bare.alias("bare"), small.alias("open"), F.when(small, acc["out"]).otherwise(closed).alias("out"), acc["p"].alias("p"))

    def segments(acc: Column) -> Column:
        last = F.array(F.struct(acc["from"].alias("from"), (acc["i"] - 1).alias("to")))
        at = lambda k: F.element_at(acc["p"], k + 1)

        def made(s: Column) -> Column:
            inner = F.filter(F.slice(acc["p"], s["from"] + 2, F.greatest(s["to"] - s["from"] - 1, F.lit(0))), lambda x: x["own"] > 0)
            texts = F.concat(F.array(t.rstrip(at(s["from"])["t"])), F.transform(inner, lambda x: t.strip(x["t"])), F.array(lstrip(at(s["to"])["t"])))
            whole = F.when(s["from"] == s["to"], at(s["from"])["t"]).otherwise(F.array_join(texts, "\n\n"))
            return F.struct(at(s["from"])["o"].alias("first"), at(s["to"])["o"].alias("last"), whole.alias("text"))

        return F.transform(F.when(acc["open"], F.concat(acc["out"], last)).otherwise(acc["out"]), made)

    folded = F.aggregate("p", start, step, segments)
    return pieces.select(key, F.posexplode(folded).alias("segment", "s")).select(key, "segment", "s.first", "s.last", "s.text")


def split_large(df: DataFrame, max_tokens: int, key: str = "doc_id", order: str = "segment", text: str = "text", start: str | None = None) -> DataFrame:
    """(key, segment, part, text, char_start): segments in parts, each with its own place in the document."""
    base = F.col(start) if start else F.lit(0)
    return df.select(key, F.col(order).alias("segment"), base.alias("base"), F.posexplode(greedy_parts(F.col(text), max_tokens)).alias("part", "p")).select(key, "segment", "part", F.col("p.text").alias("text"), (F.col("base") + F.col("p.start")).cast("long").alias("char_start"))


def windows(df: DataFrame, size: int, overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, shard, char_start, char_end, text): windows of ``size`` characters, each ``overlap`` into the one before; short texts whole."""
    n = F.length(text)
    step = size - overlap
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step)))
    rows = df.where(n > 0).select(key, F.col(text).alias("t"), F.posexplode(starts).alias("shard", "char_start"))
    return rows.select(key, "shard", "char_start", F.least(F.col("char_start") + size, F.length("t")).alias("char_end"), F.substring("t", F.col("char_start") + 1, F.lit(size)).alias("text"))


def shards(df: DataFrame, nodes: DataFrame, size: int = 6000, overlap: int = 500, key: str = "doc_id", text: str = "content_md") -> DataFrame:
    """(key, kind, ord, char_start, char_end): a short text whole; else the largest subtrees that fit, what stands
    before a too large subtree's first child as its own shard, and windows where a leaf or that part doesn't fit.

    ``nodes`` has key, ord, parent_ord, char_start, subtree_end and own_end. Text before the first node is a shard, too.
    """
    body = df.select(F.col(key).alias("k2"), F.length(text).alias("n"))
    rows = nodes.join(body, F.col(key) == F.col("k2")).drop("k2").withColumn("fits", F.col("subtree_end") - F.col("char_start") <= size)
    up = rows.select(F.col(key).alias("k2"), F.col("ord").alias("po"), F.col("fits").alias("parent_fits"))
    rows = rows.join(up, (F.col(key) == F.col("k2")) & (F.col("parent_ord") == F.col("po")), "left").where("n > " + str(size))
    whole = rows.where(F.col("fits") & ~F.coalesce("parent_fits", F.lit(False))).select(key, F.lit("section").alias("kind"), "ord", "char_start", F.col("subtree_end").alias("char_end"))
    own = rows.where(~F.col("fits")).select(key, F.lit("heading").alias("kind"), "ord", "char_start", F.col("own_end").alias("char_end"))
    first = nodes.groupBy(key).agg(F.min("char_start").alias("first")).join(body, F.col(key) == F.col("k2")).where(f"first > 0 and n > {size}").select(key, F.lit("preface").alias("kind"), F.lit(-1).alias("ord"), F.lit(0).cast("long").alias("char_start"), F.col("first").alias("char_end"))
    short = body.where(f"n <= {size} and n > 0").select(F.col("k2").alias(key), F.lit("document").alias("kind"), F.lit(-1).alias("ord"), F.lit(0).cast("long").alias("char_start"), F.col("n").cast("long").alias("char_end"))
    none = body.join(nodes.select(F.col(key).alias("k3")).distinct(), F.col("k2") == F.col("k3"), "left_anti").where(f"n > {size}").select(F.col("k2").alias(key), F.lit("window").alias("kind"), F.lit(-1).alias("ord"), F.lit(0).cast("long").alias("char_start"), F.col("n").cast("long").alias("char_end"))
    parts = whole.unionByName(own).unionByName(first).unionByName(short).unionByName(none)
    span = F.col("char_end") - F.col("char_start")
    starts = F.when(span <= size, F.array("char_start")).otherwise(F.sequence("char_start", F.greatest(F.col("char_end") - overlap - 1, F.col("char_start")), F.lit(size - overlap).cast("long")))
    cut = parts.select(key, F.when(span > size, F.lit("window")).otherwise(F.col("kind")).alias("kind"), "ord", F.col("char_end").alias("stop"), F.explode(starts).alias("char_start"))
    return cut.select(key, "kind", "ord", "char_start", F.least(F.col("char_start") + size, F.col("stop")).alias("char_end"))


def break_windows(df: DataFrame, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk, text): the stripped text in windows of at most ``most`` characters. A window that isn't the last ends at its
    last blank line, else its last line break, if that lies past its half; else where it is full. Windows are stripped; blank ones go.

    A fold over the line breaks: each is met once, when the window must reach beyond it. Until then the last blank
    line and the last break are known; when the window is full they end it, and what is still too long is cut by size.
    """
    half = most // 2
    body = F.col("_s")
    lengths = F.transform(F.split(body, "\n", -1), lambda x: F.length(x).cast("long"))
    zero, never = F.lit(0).cast("long"), F.lit(-1).cast("long")
    start = F.struct(zero.alias("at"), zero.alias("pos"), never.alias("blank"), never.alias("line"), F.array(zero).alias("starts"))

    def step(acc: Column, n: Column) -> Column:
        y = acc["pos"] + n  # the break behind this line, or the text's end
        past = lambda at: y >= at + most
        one = F.when(past(acc["at"]) & (acc["blank"] > acc["at"] + half), acc["blank"]).otherwise(acc["at"])
        two = lambda a: F.when(past(a) & (acc["line"] > a + half), acc["line"]).otherwise(a)
        at = F.struct(one.alias("one"), two(one).alias("two"))
        full = F.floor((y - at["two"]) / most)
        cuts = F.concat(
            F.when(at["one"] > acc["at"], F.array(at["one"])).otherwise(F.array().cast("array<bigint>")),
            F.when(at["two"] > at["one"], F.array(at["two"])).otherwise(F.array().cast("array<bigint>")),
            F.when(full > 0, F.transform(F.sequence(F.lit(1).cast("long"), full), lambda k: at["two"] + k * most)).otherwise(F.array().cast("array<bigint>")),
        )
        blank = F.when((n == 0) & (acc["line"] == y - 1) & (y > 0), y - 1).otherwise(acc["blank"])
        starts = F.when(past(acc["at"]), F.concat(acc["starts"], cuts)).otherwise(acc["starts"])
        return F.struct(F.when(past(acc["at"]), at["two"] + full * most).otherwise(acc["at"]).cast("long").alias("at"), (y + 1).alias("pos"), blank.alias("blank"), y.alias("line"), starts.alias("starts"))

    def pieces(acc: Column) -> Column:
        stop = lambda k: F.coalesce(F.try_element_at(acc["starts"], k + 2), acc["pos"])
        return F.transform(acc["starts"], lambda a, k: F.struct(a.alias("a"), (stop(k) - a).alias("n")))

    # the last line ends at the text's last letter, which a window must reach beyond as it must beyond a break
    ends = F.transform(lengths, lambda n, i: F.when(i == F.size(lengths) - 1, F.greatest(n - 1, zero)).otherwise(n))
    cut = F.transform(F.aggregate(ends, start, step, pieces), lambda p: t.strip(F.substring(body, (p["a"] + 1).cast("int"), p["n"].cast("int"))))
    rows = df.select(key, t.strip(F.coalesce(text, F.lit(""))).alias("_s"))
    return rows.select(key, F.posexplode(F.filter(cut, lambda x: x != "")).alias("chunk", "text"))


def scoring_lookahead(segments: DataFrame, tables: DataFrame, key: str = "doc_id", lookahead: int = 8000) -> DataFrame:
    """Segments (key, segment, s, e, text) with the text of scoring tables that reach into them, or begin soon behind."""
    from foliant.operators.ranges import overlapping

    near = overlapping(segments.select(key, F.col("segment").alias("slice_id"), "s", "e"), tables.where(t.is_scoring_text(F.col("llm_text"))).select(key, "char_start", "char_end", "llm_text"), key, lookahead)
    add = near.groupBy(key, F.col("slice_id").alias("segment")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("char_start", "llm_text"))), lambda x: x["llm_text"]), "\n\n").alias("more"))
    both = segments.join(add, [key, "segment"], "left")
    return both.withColumn("text", F.when(F.col("more").isNull(), F.col("text")).otherwise(F.concat(t.rstrip(F.col("text")), F.lit("\n\n"), F.col("more")))).drop("more")


def expand_short(segments: DataFrame, tables: DataFrame, df: DataFrame, key: str = "doc_id", text: str = "content_md", short: int = 200, lookahead: int = 12_000) -> DataFrame:
    """Segments (key, segment, s, e, section_path, text): a short one in a section that may hold scoring tables is sliced anew,
    ``lookahead`` further and with its tables' text, if that is longer."""
    from foliant.operators import classify
    from foliant.operators.ranges import substitute_tables

    few = segments.where((F.length(t.strip(F.col("text"))) < short) & classify.scoring_section(F.col("section_path"), hosts=True))
    body = df.select(F.col(key).alias("k2"), F.col(text).alias("content"))
    wide = few.join(body, F.col(key) == F.col("k2")).select(key, F.col("segment").alias("slice_id"), "s", F.least(F.col("e") + lookahead, F.length("content")).alias("e"), "content", F.col("e").alias("was")).where("e > was")
    more = substitute_tables(wide.drop("was"), tables, key).select(F.col(key).alias("k2"), F.col("slice_id").alias("s2"), F.col("text").alias("longer"))
    both = segments.join(more, (F.col(key) == F.col("k2")) & (F.col("segment") == F.col("s2")), "left")
    longer = F.length(t.strip(F.col("longer"))) > F.length(t.strip(F.col("text")))
    return both.withColumn("text", F.when(longer, F.col("longer")).otherwise(F.col("text"))).drop("k2", "s2", "longer")


def scoring_segments(tables: DataFrame, segments: DataFrame, key: str = "doc_id", most: int = 5) -> DataFrame:
    """(key, table_ref, text): a document's first scoring tables as segments of their own, but those a segment already equals."""
    rows = tables.where(t.is_scoring_text(F.col("llm_text"))).groupBy(key, "table_ref").agg(F.min("char_start").alias("char_start"), F.min_by("llm_text", "char_start").alias("text"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("char_start", "table_ref"))).where(F.col("k") <= most)
    return rows.join(segments.select(F.col(key).alias("k2"), F.col("text").alias("t2")), (F.col(key) == F.col("k2")) & (t.strip(F.col("text")) == t.strip(F.col("t2"))), "left_anti").select(key, "table_ref", "text")
