"""Blocks of a document's text, with running character offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as t


def lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line): the text's lines, from 0."""
    return df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def offsets(df: DataFrame, key: str = "doc_id", order: str = "line_no", text: str = "line", gap: int = 2) -> DataFrame:
    """Adds char_start and char_end of each block in the document that all make up, ``gap`` characters behind each."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(text)
    start = F.coalesce(F.sum(size + gap).over(before), F.lit(0)).cast("long")
    return df.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + size)


def preview(c: Column) -> Column:
    """What is shown of a block."""
    return F.left(c, F.lit(120))


def content(df: DataFrame, key: str = "doc_id", order: str = "line_no", text: str = "line") -> DataFrame:
    """(key, content_md): the document's blocks in order, a blank line behind each, one line break at the end."""
    pieces = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: F.concat(x["t"], F.lit("\n\n")))
    return df.groupBy(key).agg(F.concat(t.rstrip(F.array_join(pieces, "")), F.lit("\n")).alias("content_md"))


def chunk_blocks(df: DataFrame, key: str = "doc_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """(key, block_no, type, text, image_ref, table_ref): paragraphs, pipe tables and images of line rows.

    Lines of one kind that follow each other are one block; a table reference holds for the next table.
    """
    s = t.strip(F.col(line))
    kind = F.when(t.table_ref(F.col(line)).isNotNull(), "ref").when(s.rlike("^" + t.IMAGE), "image").when(s.rlike(r"^\|.+\|$"), "table").when(s == "", "blank").otherwise("paragraph")
    w = Window.partitionBy(key).orderBy(order)
    rows = df.select(key, F.col(order).alias("o"), F.col(line).alias("line"), kind.alias("kind"), t.table_ref(F.col(line)).alias("ref"))
    new = (F.lag("kind").over(w.orderBy("o")).isNull()) | (F.lag("kind").over(w.orderBy("o")) != F.col("kind")) | F.col("kind").isin("ref", "image")
    rows = rows.withColumn("new", new.cast("int"))
    run = Window.partitionBy(key).orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"island": F.sum("new").over(run), "last_ref": F.last(F.when(F.col("kind") == "ref", F.struct(F.col("o").alias("at"), "ref")), ignorenulls=True).over(run), "opens": (F.col("new") == 1) & (F.col("kind") == "table")})
    earlier = Window.partitionBy(key).orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("last_table", F.max(F.when(F.col("opens"), F.col("o"))).over(earlier))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "\n")
    found = rows.where("kind not in ('ref', 'blank')").groupBy(key, "island", "kind").agg(joined.alias("text"), F.min("o").alias("o"), F.min_by("last_ref", "o").alias("last_ref"), F.min_by("last_table", "o").alias("last_table"))
    pending = F.when((F.col("kind") == "table") & F.col("last_ref").isNotNull() & (F.col("last_table").isNull() | (F.col("last_ref.at") > F.col("last_table"))), F.col("last_ref.ref"))
    body = F.when(F.col("kind") == "paragraph", t.truncate(t.strip(F.col("text")))).when(F.col("kind") == "table", t.truncate(F.col("text")))
    image = F.when(F.col("kind") == "image", F.regexp_extract(t.strip(F.col("text")), t.IMAGE, 1))
    return found.select(key, (F.row_number().over(w.orderBy("o")) - 1).alias("block_no"), F.col("kind").alias("type"), body.alias("text"), image.alias("image_ref"), pending.alias("table_ref"))
