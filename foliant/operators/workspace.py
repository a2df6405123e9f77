"""Whole workspaces: merging, validating, comparing; sessions and jobs; batch states; assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as t


def merge_outlines(target: DataFrame, sources: list[tuple[DataFrame, DataFrame]], key: str = "doc_id", gap: str = "\n\n<!-- merged -->\n\n") -> tuple[DataFrame, DataFrame]:
    """(content, outline) of a workspace with others behind it: texts joined, ids prefixed m2:, m3:, ..., offsets and orders shifted.

    ``target`` is (content, outline) as a pair, too. Contents: key, content_md. Outlines: key, node_id, parent_id, ord, char_start, char_end.
    """
    content, outline = target
    for k, (more, nodes) in enumerate(sources, 2):
        size = content.select(F.col(key).alias("k2"), F.length("content_md").alias("base"))
        count = outline.groupBy(F.col(key).alias("k3")).agg((F.max("ord") + 1).alias("n"))
        moved = nodes.join(size, F.col(key) == F.col("k2"), "left").join(count, F.col(key) == F.col("k3"), "left")
        shift = F.when(F.col("base").isNull(), F.lit(0)).otherwise(F.col("base") + len(gap))
        named = lambda c, k=k: F.concat(F.lit(f"m{k}:"), F.col(c))
        moved = moved.select(key, named("node_id").alias("node_id"), named("parent_id").alias("parent_id"), (F.col("ord") + F.coalesce("n", F.lit(0))).alias("ord"), (F.col("char_start") + shift).alias("char_start"), (F.col("char_end") + shift).alias("char_end"))
        outline = outline.select(*moved.columns).unionByName(moved)
        both = content.withColumnRenamed("content_md", "a").join(more.withColumnRenamed("content_md", "b"), key, "full")
        content = both.select(key, F.concat_ws(gap, "a", "b").alias("content_md"))
    return content, outline


def invalid_nodes(content: DataFrame, outline: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, node_id, problem): parents that don't exist, and ranges that are empty or leave the text."""
    ids = outline.select(F.col(key).alias("k2"), F.col("node_id").alias("id2"))
    orphans = outline.where("parent_id is not null").join(ids, (F.col(key) == F.col("k2")) & (F.col("parent_id") == F.col("id2")), "left_anti").select(key, "node_id", F.lit("parent").alias("problem"))
    size = content.select(F.col(key).alias("k2"), F.length("content_md").alias("n"))
    out = outline.join(size, F.col(key) == F.col("k2"), "left").where("not (0 <= char_start and char_start < char_end and char_end <= coalesce(n, 0))").select(key, "node_id", F.lit("range").alias("problem"))
    return orphans.unionByName(out)


def title_diff(before: Column, after: Column) -> Column:
    """struct(removed, added) of two title lists; repeated titles and order stay."""
    lacks = lambda a, b: F.filter(a, lambda x: ~F.array_contains(b, x))
    return F.struct(lacks(before, after).alias("removed"), lacks(after, before).alias("added"))


def mapping_problems(mapping: DataFrame, key: str = "doc_id", strict: bool = True) -> DataFrame:
    """(key, refined_node_id, problem): ranges, in order of their start, that overlap the one before or leave a gap (half-open ranges)."""
    w = Window.partitionBy(key).orderBy("char_start", "char_end", "refined_node_id")
    rows = mapping.withColumn("before", F.lag("char_end").over(w))
    gap = "gap" if strict else "gap_warning"
    problem = F.when(F.col("char_start") < F.col("before"), F.lit("overlap")).when(F.col("char_start") > F.col("before"), F.lit(gap))
    return rows.withColumn("problem", problem).where("problem is not null").select(key, "refined_node_id", "problem")


def unknown_sources(mapping: DataFrame, outline: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, refined_node_id, source_node_id): sources that the outline lacks."""
    ids = outline.select(F.col(key).alias("k2"), F.col("node_id").alias("id2"))
    return mapping.select(key, "refined_node_id", F.explode("source_node_ids").alias("source_node_id")).join(ids, (F.col(key) == F.col("k2")) & (F.col("source_node_id") == F.col("id2")), "left_anti")


def merged_sessions(lists: list[DataFrame], id_col: str = "id", opened: str = "opened_at", most: int | None = 20) -> DataFrame:
    """Sessions of all lists, each id from the first list that has it, the last opened first, ``most`` at most."""
    rows = lists[0].withColumn("_p", F.lit(0))
    for k, more in enumerate(lists[1:], 1):
        rows = rows.unionByName(more.withColumn("_p", F.lit(k)))
    names = lists[0].columns
    best = rows.groupBy(id_col).agg(F.min_by(F.struct(*names), "_p").alias("s")).select("s.*").orderBy(F.desc(opened), id_col)
    return best.limit(most) if most else best


def latest(df: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """Each key's latest row; the largest ``tie`` of equals."""
    names = df.columns
    return df.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(order, tie)).alias("r")).select("r.*")


def batch_status(df: DataFrame, key: str, ok: Column) -> DataFrame:
    """(key, status): success, partial_success or failed, by how many parts are ok."""
    good, n = F.count_if(ok), F.count(F.lit(1))
    return df.groupBy(key).agg(F.when(good == n, F.lit("success")).when(good > 0, F.lit("partial_success")).otherwise(F.lit("failed")).alias("status"))


def progress(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100), F.floor(done * 100 / total))).otherwise(F.lit(0)).cast("int")


def next_pending(queue: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, node_id): the first in the queue that isn't done."""
    left = queue.join(done.select(F.col(key).alias("k2"), F.col("node_id").alias("id2")), (F.col(key) == F.col("k2")) & (F.col("node_id") == F.col("id2")), "left_anti")
    return left.groupBy(key).agg(F.min_by("node_id", "ord").alias("node_id"))


def outline_ids(df: DataFrame, key: str = "doc_id", order: str = "preorder", given: str = "given_id") -> DataFrame:
    """Adds node_id: a valid id (bid- and three digits) that no node before has given, else the next number not yet in use there.

    Sequential by nature, so one document's nodes at a time.
    """
    import re

    import pandas as pd

    schema = df.withColumn("node_id", F.lit(""))

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        used, number, out = set(), 1, []
        for x in rows[given]:
            if not (isinstance(x, str) and re.fullmatch(r"bid-\d{3}", x, re.A) and x not in used):
                while (x := f"bid-{number:03d}") in used:
                    number += 1
            used.add(x)
            out.append(x)
        return rows.assign(node_id=out)

    return df.groupBy(key).applyInPandas(each, schema.schema)


def assets(refs: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """References (key, ref, kind) with the range of the first block that has them, in order of place, unplaced last."""
    at = blocks.where("ref is not null").groupBy(key, "ref").agg(F.min_by(F.struct("block_index", "char_start", "char_end"), "block_index").alias("b"))
    rows = refs.join(at, [key, "ref"], "left").select(key, "ref", "kind", "b.block_index", "b.char_start", "b.char_end")
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last("char_start"), "ref")
    return rows.withColumn("place", F.row_number().over(w) - 1)


def images(embeds: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, paragraph, rid, file_name, alt_no): embedded images, an rid once per paragraph; one file per rid, numbered by first occurrence."""
    rows = embeds.groupBy(key, "paragraph", "rid").agg(F.min("pos").alias("pos"))
    first = rows.groupBy(key, "rid").agg(F.min(F.struct("paragraph", "pos")).alias("at"))
    first = first.withColumn("file_no", F.row_number().over(Window.partitionBy(key).orderBy("at")))
    both = rows.join(first.select(key, "rid", "file_no"), [key, "rid"])
    return both.select(key, "paragraph", "rid", F.format_string("docx-img-%03d", "file_no").alias("file_name"), F.row_number().over(Window.partitionBy(key).orderBy("paragraph", "pos")).alias("alt_no"))


def warnings_added(have: Column, more: Column) -> Column:
    """Each warning once, in the order they came."""
    return F.array_union(have, more)


def scoring_path(path: Column, words: list[str]) -> Column:
    return F.exists(path, lambda p: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(p, w)))


def with_ocr(df: DataFrame, cache: DataFrame, key: str = "doc_id", text: str = "content_md") -> DataFrame:
    """The texts with a block of recognised text behind every line whose first image has any.

    ``cache`` has image_ref, file_hash, text.
    """
    rows = df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("n", "line"))
    ref = F.nullif(F.regexp_extract("line", t.IMAGE, 1), F.lit(""))
    hit = rows.withColumn("image_ref", ref).join(cache.where(F.col("text").rlike(r"(?U)\S")).select("image_ref", F.col("file_hash"), F.col("text").alias("seen")), "image_ref", "left")
    line = F.when(F.col("seen").isNotNull(), F.concat("line", F.lit("\n<!-- ocr:"), "file_hash", F.lit(" -->\n"), "seen")).otherwise(F.col("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x["l"]), "\n")
    return hit.groupBy(key).agg(joined.alias(text))


def files_ready(files: DataFrame, needed: list[str], key: str = "doc_id") -> DataFrame:
    """(key, ready, missing): whether a workspace has all the files that a stage needs, and those it lacks, in the order asked.

    ``files`` has key and name.
    """
    have = files.groupBy(key).agg(F.collect_set(F.when(F.col("name").isin(needed), F.col("name"))).alias("have"))
    missing = F.array_except(F.array(*[F.lit(x) for x in needed]), "have")
    return have.select(key, (F.size(missing) == 0).alias("ready"), missing.alias("missing"))


def calls_of(log: DataFrame, prefix: str, kind: str = "call_type") -> DataFrame:
    """The rows of a call log whose kind begins with ``prefix``."""
    return log.where(F.startswith(kind, F.lit(prefix)))


def with_sidecars(blocks: DataFrame, sidecars: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, place, table_ref, char_start, char_end, model): a document's tables in order, with their sidecars' text (null if there is none)."""
    rows = blocks.where("table_ref is not null").select(key, "table_ref", "char_start", "char_end")
    number = F.row_number().over(Window.partitionBy(key).orderBy("char_start", "table_ref")) - 1
    return rows.withColumn("place", number).join(sidecars.select(key, "table_ref", "model"), [key, "table_ref"], "left").select(key, "place", "table_ref", "char_start", "char_end", "model")


def prerequisites(docs: DataFrame, needed: DataFrame, optional: dict[str, DataFrame], key: str = "doc_id", what: str = "directory", strict: bool = False) -> DataFrame:
    """``docs`` with ``has_<what>`` and ``has_<side>`` of each optional side; without what is needed a document goes, or, if strict, the query fails."""
    rows = docs.join(needed.select(key, F.lit(True).alias(f"has_{what}")).distinct(), key, "left" if strict else "inner")
    for name, side in optional.items():
        rows = rows.join(side.select(key, F.lit(True).alias(f"has_{name}")).distinct(), key, "left").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    if strict:
        lacks = F.raise_error(F.concat(F.lit(f"no {what}: "), F.col(key).cast("string"))).cast("boolean")
        rows = rows.withColumn(f"has_{what}", F.coalesce(F.col(f"has_{what}"), lacks))
    return rows
