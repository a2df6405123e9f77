"""Views over the driver's tables that the catalogue's queries share, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators import outline, ranges

#: Documents in a workspace at most, so that a source of any size is many workspaces.
WORKSPACE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ws, ord, doc_id, level, title, text, md, char_start, size): one section per document, workspaces by source and id range."""
    docs = table(spark, sf_dir, "documents")
    ws = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.floor(F.col("doc_id") / WORKSPACE).cast("string"))
    rows = docs.select(ws.alias("ws"), "doc_id", (1 + (F.col("doc_id") % 7) % 3).cast("int").alias("level"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("ord", (F.row_number().over(Window.partitionBy("ws").orderBy("doc_id")) - 1).cast("int"))
    rows = rows.withColumn("md", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "title", F.lit("\n\n"), "text", F.lit("\n\n")))
    w = Window.partitionBy("ws").orderBy("ord")
    n = F.length("md")
    return rows.withColumns({"char_start": (F.sum(n).over(w) - n).cast("long"), "size": F.sum(n).over(Window.partitionBy("ws")).cast("long")})


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book's outline with parents and subtree ends, without texts."""
    rows = book(spark, sf_dir).select("ws", "ord", "doc_id", "level", "title", "char_start", "size")
    return ranges.subtree_end(outline.with_parent(rows, "ws"), "size", "ws")


BOOK = """
book0 AS (SELECT coalesce(source, '') || '/' || CAST(doc_id // 1000 AS VARCHAR) AS ws, doc_id, CAST(1 + (doc_id % 7) % 3 AS INTEGER) AS level,
  'Document ' || CAST(doc_id AS VARCHAR) AS title, coalesce(text, '') AS text FROM documents),
book1 AS (SELECT *, CAST(row_number() OVER (PARTITION BY ws ORDER BY doc_id) - 1 AS INTEGER) AS ord,
  repeat('#', level) || ' ' || title || chr(10) || chr(10) || text || chr(10) || chr(10) AS md FROM book0),
book AS (SELECT *, CAST(sum(length(md)) OVER (PARTITION BY ws ORDER BY ord) - length(md) AS BIGINT) AS char_start,
  CAST(sum(length(md)) OVER (PARTITION BY ws) AS BIGINT) AS size FROM book1),
nodes AS (SELECT ws, ord, doc_id, level, title, char_start, size,
  (SELECT max(p.ord) FROM book p WHERE p.ws = b.ws AND p.ord < b.ord AND p.level < b.level) AS parent_ord,
  coalesce((SELECT min(p.char_start) FROM book p WHERE p.ws = b.ws AND p.char_start > b.char_start AND p.level <= b.level), size) AS subtree_end FROM book b)
"""

LINES = """
lines AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
"""


def greedy(source: str, key: str, text: str, tokens: int) -> str:
    """CTEs up to ``parts``(key, part, size, start): the greedy packing of lines, one line a step."""
    return f"""
cut AS (SELECT {key} AS k, generate_subscripts(string_split({text}, chr(10)), 1) AS i, unnest(string_split({text}, chr(10))) AS x, len(string_split({text}, chr(10))) AS n FROM {source} WHERE regexp_matches({text}, '\\S')),
sized AS (SELECT k, i, CAST(length(x) + CASE WHEN i < n THEN 1 ELSE 0 END AS BIGINT) AS len FROM cut WHERE i < n OR x <> ''),
packed AS (SELECT k, i, len AS size, len, CAST(0 AS BIGINT) AS part FROM sized WHERE i = 1
  UNION ALL SELECT s.k, s.i, CASE WHEN (p.size + s.len) // 4 > {tokens} THEN s.len ELSE p.size + s.len END, s.len,
  CASE WHEN (p.size + s.len) // 4 > {tokens} THEN p.part + 1 ELSE p.part END FROM packed p JOIN sized s ON s.k = p.k AND s.i = p.i + 1),
parts AS (SELECT k, part, CAST(sum(len) AS BIGINT) AS size, CAST(sum(sum(len)) OVER (PARTITION BY k ORDER BY part) - sum(len) AS BIGINT) AS start FROM packed GROUP BY k, part)
"""
