"""The queries over the driver's tables and the SQL that says the same.

Arrays are joined into strings, so that results compare as plain columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as t
from foliant.operators import blocks, chunking, classify, merge, model_calls, outline, ranges, render, tables, tree, workspace
from foliant.plans.views import BOOK, LINES, book, documents, greedy, nodes, table
from foliant.sources import html

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CHUNK = 500
MERGE = 200


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def joined(c: Column | str, mark: str = "|") -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), mark)


# -- blocks ---------------------------------------------------------------------------------------


@query(f"""WITH {LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 2 AS BIGINT) AS char_start,
  CAST(sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY line_no) - 2 AS BIGINT) AS char_end FROM lines""")
def block_offsets(spark, sf_dir):
    return blocks.offsets(blocks.lines(documents(spark, sf_dir))).select("doc_id", "line_no", "char_start", "char_end")


@query("SELECT doc_id, CAST(length(coalesce(text, '')) // 4 AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", t.estimate_tokens(F.col("text")).alias("tokens"))


MIXED = "text || chr(10) || '![x](images/' || CAST(doc_id AS VARCHAR) || '.png)' || chr(10) || '<!-- table-ref:tables/t0001.json -->' || chr(10) || '| a | b |' || chr(10) || '| c | d |' || chr(10) || chr(10) || '| e |' || chr(10) || 'end'"


def mixed(spark, sf_dir) -> DataFrame:
    tail = F.concat(F.lit("\n![x](images/"), F.col("doc_id").cast("string"), F.lit(".png)\n<!-- table-ref:tables/t0001.json -->\n| a | b |\n| c | d |\n\n| e |\nend"))
    return documents(spark, sf_dir).select("doc_id", F.concat("text", tail).alias("text"))


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS (SELECT doc_id, string_split({MIXED}, chr(10)) AS ls FROM d),
l AS (SELECT doc_id, generate_subscripts(ls, 1) AS o, unnest(ls) AS line FROM m),
c AS (SELECT *, CASE WHEN line LIKE '<!-- table-ref:%' THEN 'ref' WHEN line LIKE '![%](%' THEN 'image' WHEN regexp_matches(trim(line), '^\\|.+\\|$') THEN 'table' WHEN trim(line) = '' THEN 'blank' ELSE 'paragraph' END AS kind FROM l),
g AS (SELECT *, CASE WHEN lag(kind) OVER w IS DISTINCT FROM kind OR kind IN ('ref', 'image') THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY o)),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY o) AS island FROM g),
b AS (SELECT doc_id, island, kind, min(o) AS o, string_agg(line, chr(10) ORDER BY o) AS body FROM s WHERE kind NOT IN ('ref', 'blank') GROUP BY doc_id, island, kind)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INTEGER) AS block_no, kind AS type,
  CASE WHEN kind = 'image' THEN NULL WHEN kind = 'paragraph' THEN md5(left(trim(body), 32000)) ELSE md5(left(body, 32000)) END AS text_md5,
  CASE WHEN kind = 'image' THEN regexp_extract(body, '\\(([^)]+)\\)', 1) END AS image_ref,
  CASE WHEN kind = 'table' AND body LIKE '| a%' THEN 'tables/t0001.json' END AS table_ref FROM b""")
def chunk_blocks(spark, sf_dir):
    found = blocks.chunk_blocks(blocks.lines(mixed(spark, sf_dir)))
    return found.select("doc_id", F.col("block_no").cast("int").alias("block_no"), "type", F.md5("text").alias("text_md5"), "image_ref", "table_ref")


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS (SELECT doc_id, {MIXED} || ' ![y](b.png) ![z](b.png)' AS md FROM d)
SELECT doc_id, array_to_string(regexp_extract_all(md, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1), '|') AS refs, 'images/' || CAST(doc_id AS VARCHAR) || '.png|b.png' AS distinct_refs FROM m""")
def image_refs(spark, sf_dir):
    md = F.concat("text", F.lit(" ![y](b.png) ![z](b.png)"))
    return mixed(spark, sf_dir).select("doc_id", joined(t.image_refs(md)).alias("refs"), joined(t.distinct_image_refs(md)).alias("distinct_refs"))


# -- chunks, segments, shards ---------------------------------------------------------------------

DOC_CHUNKS = greedy("documents", "doc_id", "text", CHUNK)


@query(f"WITH RECURSIVE {DOC_CHUNKS} SELECT k AS doc_id, CAST(part AS INTEGER) AS part, size, start, size // 4 AS token_estimate FROM parts")
def chunk_greedy(spark, sf_dir):
    found = chunking.chunks(documents(spark, sf_dir), max_tokens=CHUNK)
    return found.select("doc_id", F.col("part").cast("int").alias("part"), F.length("text").cast("long").alias("size"), F.col("start").cast("long").alias("start"), "token_estimate")


@query(f"""WITH RECURSIVE {DOC_CHUNKS}, ids AS (SELECT k AS doc_id, part, size, 'chunk-' || lpad(CAST(part + 1 AS VARCHAR), 4, '0') AS chunk_id FROM parts)
SELECT doc_id, chunk_id, size // 4 AS token_estimate, lag(chunk_id) OVER w AS previous_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM ids WINDOW w AS (PARTITION BY doc_id ORDER BY part)""")
def chunk_links(spark, sf_dir):
    return chunking.linked(chunking.chunks(documents(spark, sf_dir), max_tokens=CHUNK)).select("doc_id", "chunk_id", "token_estimate", "previous_chunk_id", "next_chunk_id")


@query(f"""WITH {BOOK} SELECT ws, 'chunk-' || lpad(CAST(ord + 1 AS VARCHAR), 4, '0') AS chunk_id, title, level, CAST(length(md) // 4 AS BIGINT) AS token_estimate, char_start, CAST(char_start + length(md) AS BIGINT) AS char_end FROM book""")
def chunk_index(spark, sf_dir):
    return book(spark, sf_dir).select("ws", chunking.chunk_id(F.col("ord") + 1).alias("chunk_id"), "title", "level", t.estimate_tokens(F.col("md")).alias("token_estimate"), "char_start", (F.col("char_start") + F.length("md")).alias("char_end"))


def pieces(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text")).where(F.col("text").rlike(r"\S"))


MERGED = f"""
p AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i, line AS x FROM lines WHERE regexp_matches(line, '\\S')),
f AS (SELECT doc_id, i, line_no, CAST(line_no AS BIGINT) AS first, x AS acc, 0 AS segment FROM p WHERE i = 1
  UNION ALL SELECT p.doc_id, p.i, p.line_no, CASE WHEN length(f.acc) // 4 < {MERGE} THEN f.first ELSE p.line_no END, CASE WHEN length(f.acc) // 4 < {MERGE} THEN rtrim(f.acc) || chr(10) || chr(10) || ltrim(p.x) ELSE p.x END,
  CASE WHEN length(f.acc) // 4 < {MERGE} THEN f.segment ELSE f.segment + 1 END FROM f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i + 1)
"""


@query(f"""WITH RECURSIVE {LINES}, {MERGED} SELECT doc_id, segment, min(first) AS first, CAST(max(line_no) AS BIGINT) AS last, md5(arg_max(acc, i)) AS text_md5 FROM f GROUP BY doc_id, segment""")
def segments_merge_small(spark, sf_dir):
    return chunking.merge_small(pieces(spark, sf_dir), MERGE).select("doc_id", "segment", "first", "last", F.md5("text").alias("text_md5"))


@query(f"""WITH RECURSIVE {BOOK}, {greedy("book", "doc_id", "md", CHUNK)} SELECT b.ws, b.ord, CAST(p.part AS INTEGER) AS part, b.char_start + p.start AS char_start, p.size FROM parts p JOIN book b ON b.doc_id = p.k""")
def segments_split_large(spark, sf_dir):
    found = chunking.split_large(book(spark, sf_dir).select("ws", "ord", "md", "char_start"), CHUNK, "ws", "ord", "md", "char_start")
    return found.select("ws", F.col("segment").alias("ord"), F.col("part").cast("int").alias("part"), "char_start", F.length("text").cast("long").alias("size"))


@query("""WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
s AS (SELECT doc_id, text, n, unnest(CASE WHEN n <= 600 THEN [0] ELSE generate_series(0, n - 51, 550) END) AS char_start FROM d)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY char_start) - 1 AS INTEGER) AS shard, CAST(char_start AS INTEGER) AS char_start, CAST(least(char_start + 600, n) AS INTEGER) AS char_end, md5(substring(text, char_start + 1, 600)) AS text_md5 FROM s""")
def shards_char_windows(spark, sf_dir):
    return chunking.windows(documents(spark, sf_dir), 600, 50).select("doc_id", F.col("shard").cast("int").alias("shard"), "char_start", "char_end", F.md5("text").alias("text_md5"))


@query(f"""WITH {BOOK}, n AS MATERIALIZED (SELECT *, coalesce(lead(char_start) OVER (PARTITION BY ws ORDER BY ord), size) AS own_end, subtree_end - char_start <= 6000 AS fits FROM nodes),
r AS (SELECT n.*, coalesce(p.fits, false) AS parent_fits FROM n LEFT JOIN n p ON p.ws = n.ws AND p.ord = n.parent_ord),
parts AS (SELECT ws, 'section' AS kind, ord, char_start, subtree_end AS stop FROM r WHERE size > 6000 AND fits AND NOT parent_fits
  UNION ALL SELECT ws, 'heading', ord, char_start, own_end FROM r WHERE size > 6000 AND NOT fits
  UNION ALL SELECT ws, 'document', -1, 0, any_value(size) FROM r WHERE size <= 6000 GROUP BY ws),
cut AS (SELECT ws, CASE WHEN stop - char_start > 6000 THEN 'window' ELSE kind END AS kind, ord, stop, unnest(CASE WHEN stop - char_start <= 6000 THEN [char_start] ELSE generate_series(char_start, greatest(stop - 501, char_start), 5500) END) AS char_start FROM parts)
SELECT ws, kind, CAST(ord AS INTEGER) AS ord, CAST(char_start AS BIGINT) AS char_start, CAST(least(char_start + 6000, stop) AS BIGINT) AS char_end FROM cut""")
def shards_by_section(spark, sf_dir):
    rows = book(spark, sf_dir)
    body = rows.groupBy("ws").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "md"))), lambda x: x["md"]), "").alias("content_md"))
    own = nodes(spark, sf_dir).withColumn("own_end", F.coalesce(F.lead("char_start").over(Window.partitionBy("ws").orderBy("ord")), F.col("size")))
    return chunking.shards(body, own, 6000, 500, "ws")


@query(r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS s FROM documents),
w AS (SELECT doc_id, s, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS beg, CAST(0 AS BIGINT) AS stop FROM d
  UNION ALL SELECT doc_id, s, k + 1, stop, CASE WHEN stop + 2000 >= length(s) THEN length(s) WHEN blank > 0 AND 1999 - blank > 1000 THEN stop + 1999 - blank WHEN line > 0 AND 2000 - line > 1000 THEN stop + 2000 - line ELSE stop + 2000 END
  FROM (SELECT *, instr(reverse(substring(s, stop + 1, 2000)), chr(10) || chr(10)) AS blank, instr(reverse(substring(s, stop + 1, 2000)), chr(10)) AS line FROM w WHERE stop < length(s))),
p AS (SELECT doc_id, k, regexp_replace(substring(s, beg + 1, stop - beg), '^\s+|\s+$', '', 'g') AS x FROM w WHERE k > 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk, CAST(length(x) AS INTEGER) AS size, md5(x) AS text_md5 FROM p WHERE x <> ''""")
def brief_windows(spark, sf_dir):
    return chunking.break_windows(documents(spark, sf_dir), 2000).select("doc_id", "chunk", F.length("text").alias("size"), F.md5("text").alias("text_md5"))


# -- outlines and ranges --------------------------------------------------------------------------


@query(f"""WITH {BOOK}, l AS (SELECT doc_id, generate_subscripts(string_split(md, chr(10)), 1) AS n, unnest(string_split(md, chr(10))) AS line FROM book),
o AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(line) - 1 AS char_start FROM l)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS ord, CAST(length(regexp_extract(line, '^(#{{1,8}})[ \\t]', 1)) AS INTEGER) AS level,
  trim(regexp_extract(line, '^#{{1,8}}[ \\t]+(.+?)[ \\t#]*$', 1)) AS title, CAST(char_start AS BIGINT) AS char_start FROM o WHERE regexp_matches(line, '^#{{1,8}}[ \\t]+.+')""")
def heading_scan(spark, sf_dir):
    return outline.headings(book(spark, sf_dir), "doc_id", "md").select("doc_id", F.col("ord").cast("int").alias("ord"), "level", "title", "char_start")


@query(f"WITH {BOOK} SELECT ws, ord, level, parent_ord FROM nodes")
def outline_parent(spark, sf_dir):
    return nodes(spark, sf_dir).select("ws", "ord", "level", "parent_ord")


@query(f"""WITH RECURSIVE {BOOK}, n AS MATERIALIZED (SELECT * FROM nodes), r AS (SELECT ws, ord, title AS path FROM n WHERE parent_ord IS NULL UNION ALL SELECT n.ws, n.ord, r.path || ' / ' || n.title FROM n JOIN r ON r.ws = n.ws AND r.ord = n.parent_ord)
SELECT ws, ord, path FROM r""")
def outline_section_path(spark, sf_dir):
    return outline.section_paths(nodes(spark, sf_dir), "ws").select("ws", "ord", joined("path", " / ").alias("path"))


@query(f"""WITH {BOOK} SELECT ws, 'Part ' || CAST(ord % 7 AS VARCHAR) AS title, min(ord) AS ord FROM book GROUP BY ws, ord % 7""")
def path_by_title(spark, sf_dir):
    rows = book(spark, sf_dir).select("ws", F.concat(F.lit("Part "), (F.col("ord") % 7).cast("string")).alias("title"), "ord", F.col("ord").alias("path"))
    return outline.paths_by_title(rows, "ws").select("ws", "title", F.col("path").alias("ord"))


NUMBERED = """
kinds AS (SELECT doc_id, left(replace(coalesce(text, ''), chr(10), ' '), 20) AS x, doc_id % 10 AS k FROM documents),
plain AS (SELECT doc_id, CASE k WHEN 0 THEN '第一章 ' || x WHEN 1 THEN '1.2.3 ' || x WHEN 2 THEN '4. ' || x WHEN 3 THEN '三、' || x WHEN 4 THEN '二、' || x || '：' WHEN 5 THEN '7、' || x WHEN 6 THEN 'abc：' || x WHEN 7 THEN '9 ' || x || ': more' WHEN 8 THEN x ELSE '12 ' || x END AS line FROM kinds)
"""
PARSED = """
parsed AS (SELECT doc_id, line, trim(line) AS s, CASE
  WHEN trim(line) = '' OR length(trim(line)) > 120 OR regexp_matches(trim(line), '^[0-9]+、') OR (regexp_matches(trim(line), '^[^：:]{2,40}[：:].+') AND NOT regexp_matches(trim(line), '^[一二三四五六七八九十百零]+、.+')) THEN 'none'
  WHEN regexp_matches(trim(line), '^第[一二三四五六七八九十百千0-9]+[章节编部分卷篇]\\s+.+') THEN 'chapter'
  WHEN regexp_matches(trim(line), '^[一二三四五六七八九十百零]+、.+') THEN CASE WHEN right(trim(line), 1) IN ('：', ':') THEN 'none' ELSE 'enum' END
  WHEN regexp_matches(trim(line), '^[0-9]+(\\.[0-9]+)+[^0-9].+') THEN 'sectioned'
  WHEN regexp_matches(trim(line), '^[0-9]+\\.[ \\t]+.+') THEN 'dotted' WHEN regexp_matches(trim(line), '^[0-9]+[ \\t]+.+') THEN 'spaced' ELSE 'none' END AS kind FROM plain),
titled AS (SELECT doc_id, s, kind, CASE kind WHEN 'chapter' THEN trim(regexp_extract(s, '^第[^\\s]+\\s+(.+)$', 1)) WHEN 'enum' THEN s WHEN 'sectioned' THEN trim(regexp_extract(s, '^[0-9]+(?:\\.[0-9]+)+([^0-9].+)$', 1))
  WHEN 'dotted' THEN trim(regexp_extract(s, '^[0-9]+\\.[ \\t]+(.+)$', 1)) WHEN 'spaced' THEN trim(regexp_extract(s, '^[0-9]+[ \\t]+(.+)$', 1)) END AS title FROM parsed),
heads AS (SELECT doc_id, CASE WHEN kind = 'sectioned' THEN least(length(regexp_extract(s, '^[0-9.]+', 0)) - length(replace(regexp_extract(s, '^[0-9.]+', 0), '.', '')) + 1, 8) ELSE 1 END AS level, title FROM titled
  WHERE kind <> 'none' AND NOT (kind IN ('sectioned', 'dotted', 'spaced') AND (title = '' OR right(title, 1) IN ('：', ':'))) AND NOT (kind IN ('dotted', 'spaced') AND (length(title) > 50 OR contains(title, '：') OR contains(title, ':'))))
"""


def numbered(spark, sf_dir) -> DataFrame:
    x = F.left(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(20))
    made = [F.concat(F.lit("第一章 "), x), F.concat(F.lit("1.2.3 "), x), F.concat(F.lit("4. "), x), F.concat(F.lit("三、"), x), F.concat(F.lit("二、"), x, F.lit("：")), F.concat(F.lit("7、"), x), F.concat(F.lit("abc："), x), F.concat(F.lit("9 "), x, F.lit(": more")), x]
    line = F.concat(F.lit("12 "), x)
    for k, c in enumerate(made):
        line = F.when(F.col("doc_id") % 10 == k, c).otherwise(line)
    return documents(spark, sf_dir).select("doc_id", line.alias("line"))


@query(f"WITH {NUMBERED}, {PARSED} SELECT doc_id, CAST(level AS INTEGER) AS level, title FROM heads")
def content_heading_parse(spark, sf_dir):
    return numbered(spark, sf_dir).select("doc_id", t.heading_line(F.col("line")).alias("h")).where("h is not null").select("doc_id", "h.level", "h.title")


@query(f"""WITH {NUMBERED}, {PARSED}, l AS (SELECT p.doc_id // 50 AS grp, p.doc_id, p.line, h.level, h.title, regexp_matches(trim(line), '^[一二三四五六七八九十]+、.+[：:]\\s*$') AS opens, regexp_matches(trim(line), '^[一二三四五六七八九十百零]+、.+') AS enum
  FROM plain p LEFT JOIN heads h USING (doc_id)),
s AS (SELECT *, max(CASE WHEN opens THEN doc_id END) OVER w AS opened, max(CASE WHEN title IS NOT NULL AND NOT opens AND NOT enum THEN doc_id END) OVER w AS ended FROM l WINDOW w AS (PARTITION BY grp ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT grp, doc_id, CAST(level AS INTEGER) AS level, title FROM s WHERE title IS NOT NULL AND NOT opens AND NOT (coalesce(opened > coalesce(ended, -1), FALSE) AND enum)""")
def local_enum_state(spark, sf_dir):
    rows = numbered(spark, sf_dir).withColumn("grp", F.floor(F.col("doc_id") / 50))
    return outline.plain_headings(rows, "grp", "doc_id").select("grp", "doc_id", "level", "title")


@query(f"""WITH {BOOK}, {NUMBERED}, {PARSED}
SELECT doc_id, 0 AS ord, level, title, 'headings' AS strategy FROM book WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 0, CAST(level AS INTEGER), title, 'content' FROM heads WHERE doc_id % 2 = 1
UNION ALL SELECT doc_id, 0, 1, 'Document', 'flat' FROM documents WHERE doc_id % 2 = 1 AND doc_id NOT IN (SELECT doc_id FROM heads)""")
def outline_strategy(spark, sf_dir):
    docs = documents(spark, sf_dir)
    marked = book(spark, sf_dir).where("doc_id % 2 = 0").select("doc_id", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "title").alias("md"))
    by_line = outline.plain_headings(numbered(spark, sf_dir).withColumn("line_no", F.lit(0))).withColumn("ord", F.lit(0))
    found = outline.first_strategy([("headings", outline.headings(marked, "doc_id", "md")), ("content", by_line), ("flat", outline.flat(docs))])
    return found.select("doc_id", F.col("ord").cast("int").alias("ord"), "level", "title", "strategy")


@query(f"WITH {BOOK} SELECT ws, ord, coalesce((SELECT min(p.char_start) FROM book p WHERE p.ws = b.ws AND p.char_start > b.char_start), size) AS own_end FROM book b")
def range_own_body(spark, sf_dir):
    rows = nodes(spark, sf_dir)
    return ranges.own_body_end(rows, outline.section_paths(rows, "ws"), "size", "ws").select("ws", "ord", "own_end")


@query(f"WITH {BOOK} SELECT ws, ord, coalesce((SELECT min(p.char_start) FROM book p WHERE p.ws = b.ws AND p.level = b.level AND p.char_start > b.char_start), size) AS same_level_end FROM book b")
def range_same_level(spark, sf_dir):
    return ranges.same_level_end(nodes(spark, sf_dir), "size", "ws").select("ws", "ord", "same_level_end")


@query(f"WITH {BOOK} SELECT ws, ord, subtree_end FROM nodes")
def range_subtree(spark, sf_dir):
    return nodes(spark, sf_dir).select("ws", "ord", "subtree_end")


@query(f"""WITH {BOOK}, n AS MATERIALIZED (SELECT * FROM nodes), pts AS (SELECT ws, char_start + 7 AS pos FROM n)
SELECT p.ws, p.pos, (SELECT min(n.ord) FROM n WHERE n.ws = p.ws AND p.pos >= n.char_start AND p.pos < n.subtree_end) AS ord FROM pts p""")
def asset_locate(spark, sf_dir):
    rows = nodes(spark, sf_dir)
    return ranges.node_at(rows.select("ws", (F.col("char_start") + 7).alias("pos")), rows, "ws")


@query(f"""WITH {LINES}, t AS (SELECT doc_id, lower(trim(regexp_replace(trim(string_split(coalesce(text, ''), chr(10))[-1]), '^[0-9]+(\\.[0-9]+)*[\\s、.．]+', ''))) AS nt FROM documents),
b AS (SELECT doc_id, line_no, lower(trim(regexp_replace(trim(line), '^[0-9]+(\\.[0-9]+)*[\\s、.．]+', ''))) AS bt FROM lines)
SELECT t.doc_id, 0 AS ord, CAST(min(b.line_no) AS INTEGER) AS block_index FROM t JOIN b ON b.doc_id = t.doc_id AND (contains(bt, nt) OR contains(nt, bt)) WHERE nt <> '' AND bt <> '' GROUP BY t.doc_id""")
def title_block_match(spark, sf_dir):
    docs = documents(spark, sf_dir)
    title = docs.select("doc_id", F.lit(0).alias("ord"), F.element_at(F.split("text", "\n", -1), -1).alias("title"))
    found = blocks.lines(docs).select("doc_id", F.col("line_no").alias("block_index"), F.lit("paragraph").alias("block_type"), F.col("line").alias("text"))
    return outline.block_of_title(title, found).select("doc_id", "ord", F.col("block_index").cast("int").alias("block_index"))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, left(coalesce(text, ''), 40) || CASE WHEN doc_id % 2 = 0 THEN '@@ changed tail @@' ELSE '' END AS excerpt FROM documents),
e AS (SELECT doc_id, text, excerpt, trim(excerpt) AS own FROM d),
k AS (SELECT *, list_max(list_filter(generate_series(greatest(8, length(own) // 3) + 1, length(own)), lambda i: contains(text, left(own, i)))) AS size FROM e)
SELECT doc_id, CASE WHEN own = '' THEN NULL WHEN contains(text, excerpt) THEN CAST(strpos(text, excerpt) - 1 AS BIGINT) WHEN size IS NOT NULL THEN CAST(strpos(text, left(own, size)) - 1 AS BIGINT) END AS char_start,
  CASE WHEN own = '' THEN NULL WHEN contains(text, excerpt) THEN CAST(strpos(text, excerpt) - 1 + length(excerpt) AS BIGINT) WHEN size IS NOT NULL THEN CAST(strpos(text, left(own, size)) - 1 + size AS BIGINT) END AS char_end FROM k""")
def excerpt_anchor(spark, sf_dir):
    excerpt = F.concat(F.left("text", F.lit(40)), F.when(F.col("doc_id") % 2 == 0, F.lit("@@ changed tail @@")).otherwise(F.lit("")))
    return documents(spark, sf_dir).withColumn("r", ranges.excerpt_range(F.col("text"), excerpt)).select("doc_id", "r.char_start", "r.char_end")


# -- trees and links ------------------------------------------------------------------------------

TREE_SQL = f"""{BOOK}, starts AS (SELECT ws, ord, level, title, parent_ord, CASE WHEN ord % 5 = 4 THEN 2 * ord - 2 ELSE 2 * ord END AS block_start FROM nodes),
won AS (SELECT ws, block_start AS block_index, max(ord) AS ord FROM starts GROUP BY ws, block_start),
blks AS (SELECT ws, 2 * ord AS block_index, 'heading' AS bt FROM nodes UNION ALL SELECT ws, 2 * ord + 1, 'paragraph' FROM nodes),
made AS (SELECT b.ws, b.block_index, CASE WHEN w.ord IS NOT NULL THEN 0 ELSE 2 END AS class, w.ord AS outline_ord, CASE WHEN w.ord IS NOT NULL THEN 'heading' ELSE 'paragraph' END AS node_type FROM blks b LEFT JOIN won w USING (ws, block_index)
  UNION ALL SELECT s.ws, s.block_start, 1, s.ord, 'heading' FROM starts s WHERE NOT EXISTS (SELECT 1 FROM won w WHERE w.ws = s.ws AND w.ord = s.ord)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY block_index, class, coalesce(outline_ord, -1)) - 1 AS sort_order FROM made),
named AS (SELECT *, 't' || lpad(CAST(sort_order + 1 AS VARCHAR), 4, '0') AS node_id FROM numbered),
hung AS (SELECT *, last_value(CASE WHEN node_type = 'heading' THEN node_id END IGNORE NULLS) OVER (PARTITION BY ws ORDER BY sort_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS text_parent FROM named)"""


def tree_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two blocks per section; every fifth node starts at the node's before."""
    rows = nodes(spark, sf_dir).withColumn("block_start", F.when(F.col("ord") % 5 == 4, 2 * F.col("ord") - 2).otherwise(2 * F.col("ord")))
    made = rows.select("ws", F.explode(F.array(F.struct((2 * F.col("ord")).alias("block_index"), F.lit("heading").alias("block_type")), F.struct((2 * F.col("ord") + 1).alias("block_index"), F.lit("paragraph").alias("block_type")))).alias("b")).select("ws", "b.*")
    return made, rows.select("ws", "ord", "level", "title", "parent_ord", "block_start")


@query(f"""WITH {TREE_SQL} SELECT h.ws, CAST(h.sort_order AS INTEGER) AS sort_order, h.node_id, CASE WHEN h.node_type = 'heading' THEN p.node_id ELSE h.text_parent END AS parent_id, h.node_type, CAST(h.outline_ord AS INTEGER) AS outline_ord
FROM hung h LEFT JOIN starts s ON s.ws = h.ws AND s.ord = h.outline_ord LEFT JOIN hung p ON p.ws = h.ws AND p.outline_ord = s.parent_ord""")
def tree_nodes(spark, sf_dir):
    return tree.tree(*tree_inputs(spark, sf_dir), key="ws").select("ws", F.col("sort_order").cast("int").alias("sort_order"), "node_id", "parent_id", "node_type", F.col("outline_ord").cast("int").alias("outline_ord"))


@query(f"WITH {TREE_SQL} SELECT ws, node_id, CAST(outline_ord AS INTEGER) AS outline_ord FROM hung WHERE class = 1")
def tree_synth_headings(spark, sf_dir):
    return tree.tree(*tree_inputs(spark, sf_dir), key="ws").where("outline_ord is not null and block_index is null").select("ws", "node_id", F.col("outline_ord").cast("int").alias("outline_ord"))


@query(f"WITH {TREE_SQL} SELECT ws, CAST(block_start AS INTEGER) AS block_start, count(*) AS n FROM starts GROUP BY ws, block_start HAVING count(*) > 1")
def tree_dup_anchors(spark, sf_dir):
    return tree.duplicate_anchors(tree_inputs(spark, sf_dir)[1], "ws").select("ws", F.col("block_start").cast("int").alias("block_start"), "n")


LINK_SQL = f"""RECURSIVE {TREE_SQL}, {greedy("book", "doc_id", "md", CHUNK)},
chunked AS (SELECT b.ws, b.ord, p.part, row_number() OVER (PARTITION BY b.ws ORDER BY b.ord, p.part) AS ordinal FROM parts p JOIN book b ON b.doc_id = p.k),
ids AS (SELECT *, 'chunk-' || lpad(CAST(ordinal AS VARCHAR), 4, '0') AS chunk_id FROM chunked),
cs AS (SELECT ws, ord, string_agg(chunk_id, '|' ORDER BY ordinal) AS chunk_ids, min(CASE WHEN part = 0 THEN chunk_id END) AS primary_chunk_id FROM ids GROUP BY ws, ord),
ts AS (SELECT ws, outline_ord AS ord, string_agg(node_id, '|' ORDER BY sort_order) AS tree_ids, min(node_id) AS first_id FROM hung WHERE outline_ord IS NOT NULL GROUP BY ws, outline_ord)"""


def linked_chunks(spark, sf_dir) -> DataFrame:
    found = chunking.chunks(book(spark, sf_dir), "ws", "ord", "md", CHUNK).withColumn("chunk_id", chunking.chunk_id(F.col("ordinal")))
    return found.select("ws", "ordinal", "chunk_id", F.when(F.col("part") == 0, F.lit(1)).alias("heading_level"), F.col("section").alias("node_ord"))


def links(spark, sf_dir) -> DataFrame:
    made, rows = tree_inputs(spark, sf_dir)
    return tree.linkage(rows, tree.tree(made, rows, "ws"), linked_chunks(spark, sf_dir), "ws")


@query(f"WITH {LINK_SQL} SELECT n.ws, n.ord, coalesce(tree_ids, '') AS tree_ids, coalesce(chunk_ids, '') AS chunk_ids, primary_chunk_id FROM nodes n LEFT JOIN ts USING (ws, ord) LEFT JOIN cs USING (ws, ord)")
def linkage(spark, sf_dir):
    return links(spark, sf_dir).select("ws", "ord", joined("tree_ids").alias("tree_ids"), joined("chunk_ids").alias("chunk_ids"), "primary_chunk_id")


@query(f"WITH {LINK_SQL} SELECT i.ws, i.chunk_id, ts.first_id AS document_tree_node_id FROM ids i LEFT JOIN ts USING (ws, ord) WHERE i.part = 0")
def chunk_tree_ids(spark, sf_dir):
    return tree.chunk_tree_nodes(linked_chunks(spark, sf_dir), links(spark, sf_dir), "ws")


# -- labels and routes ----------------------------------------------------------------------------

LABELS = [("english", "English", ["the", "and", "with"]), ("german", "Deutsch", ["der", "und", "nicht"]), ("french", "Français", ["les", "une", "dans"]), ("other", "Other", []), ("ignore", "Ignored", ["copyright"])]
HINTS = [("greeting", ["this", "that"]), ("place", ["von", "dans"]), ("number", ["123", "una"])]
CANDIDATES = [(["place"], "product", "product"), (["greeting", "number"], "scheme", None)]


def _hits(words: list[str]) -> str:
    return "list_filter([" + ", ".join(f"'{w}'" for w in words) + "]::VARCHAR[], lambda w: contains(low, w))"


@query(f"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents), h AS ({" UNION ALL ".join(f"SELECT doc_id, {k} AS o, '{label}' AS label, len({_hits(words)}) AS n, array_to_string({_hits(words)}[1:3], '、') AS rationale FROM d" for k, (label, _, words) in enumerate(LABELS))}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, o) AS k FROM h)
SELECT doc_id, CASE WHEN n > 0 THEN label ELSE 'other' END AS label, CASE WHEN n > 0 THEN round(least(0.99, 0.55 + 0.1 * n), 4) ELSE 0.2 END::DOUBLE AS confidence, CASE WHEN n > 0 THEN rationale ELSE '' END AS rationale FROM r WHERE k = 1""")
def classify_rules(spark, sf_dir):
    return classify.classify(documents(spark, sf_dir), labels=LABELS, hint_table=HINTS, candidates=CANDIDATES).select("doc_id", "label", F.round("confidence", 4).alias("confidence"), "rationale")


_HINT_SQL = ", ".join(f"CASE WHEN {' OR '.join(f'contains(text, {chr(39)}{a}{chr(39)})' for a in aliases)} THEN '{h}' END" for h, aliases in HINTS)


@query(f"SELECT doc_id, concat_ws('|', {_HINT_SQL}) AS hints FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def hint_aliases(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", joined(classify.hints(F.col("text"), HINTS)).alias("hints"))


@query(f"""WITH h AS (SELECT doc_id, '|' || concat_ws('|', {_HINT_SQL}) || '|' AS hints FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))
SELECT doc_id, CASE WHEN contains(hints, '|place|') THEN 'product' WHEN contains(hints, '|greeting|') OR contains(hints, '|number|') THEN 'scheme' END AS candidate, CASE WHEN contains(hints, '|place|') THEN 'product' END AS knowledge FROM h""")
def candidate_types(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", classify.candidate_type(classify.hints(F.col("text"), HINTS), CANDIDATES).alias("c")).select("doc_id", "c.candidate", "c.knowledge")


@query("SELECT doc_id, string_split(text, chr(10))[1] AS title FROM documents WHERE contains(string_split(text, chr(10))[1], 'the') OR contains(string_split(text, chr(10))[1], 'der')")
def route_nodes(spark, sf_dir):
    return classify.route(documents(spark, sf_dir).select("doc_id", F.element_at(F.split("text", "\n", -1), 1).alias("title")), ["the", "der"])


# -- tables ---------------------------------------------------------------------------------------

TABLES_SQL = """
grids AS (SELECT 'r' || CAST(n_regionkey AS VARCHAR) AS id, [['key', 'name']] || list([CAST(n_nationkey AS VARCHAR), n_name] ORDER BY n_nationkey) AS rows FROM nation GROUP BY n_regionkey
  UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), [['姓名', s_name], ['key', CAST(s_suppkey AS VARCHAR)], ['姓名', 'again ' || s_name]] FROM supplier
  UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), [['姓名', '性别'], [c_name, 'x'], ['级别', '年龄'], [c_mktsegment, CAST(c_nationkey AS VARCHAR)]] FROM customer
  UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR), [[p_name, p_brand], [p_type]] FROM part)
"""


def grids(spark, sf_dir) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    row = lambda *c: F.array(*[F.lit(x) if isinstance(x, str) else x for x in c])
    named = lambda p, c: F.concat(F.lit(p), s(c)).alias("id")
    nation = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.array(row("key", "name")), F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))).alias("rows"))
    parts = [
        nation.select(named("r", "n_regionkey"), "rows"),
        table(spark, sf_dir, "supplier").select(named("s", "s_suppkey"), F.array(row("姓名", F.col("s_name")), row("key", s("s_suppkey")), row("姓名", F.concat(F.lit("again "), "s_name"))).alias("rows")),
        table(spark, sf_dir, "customer").select(named("c", "c_custkey"), F.array(row("姓名", "性别"), row(F.col("c_name"), "x"), row("级别", "年龄"), row(F.col("c_mktsegment"), s("c_nationkey"))).alias("rows")),
        table(spark, sf_dir, "part").select(named("p", "p_partkey"), F.array(row(F.col("p_name"), F.col("p_brand")), row(F.col("p_type"))).alias("rows")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


LAYOUT_SQL = "CASE left(id, 1) WHEN 'r' THEN 'simple' WHEN 's' THEN 'key_value' WHEN 'c' THEN 'personnel_dual_row' ELSE 'key_value' END"


@query(f"""WITH {TABLES_SQL}, h AS (SELECT id, rows, len(rows) AS n, len(rows[1]) AS w, len(list_filter(rows, lambda r: len(r) <> len(rows[1]))) = 0 AS even,
  len(list_filter(rows[1], lambda c: regexp_matches(c, '{tables.PERSON}'))) / len(rows[1]) AS p, len(list_filter(rows[1], lambda c: regexp_matches(c, '{tables.PERSON_MORE}'))) / len(rows[1]) AS m,
  len(list_filter(coalesce(rows[3], []), lambda c: regexp_matches(c, '{tables.PERSON_MORE}'))) / greatest(len(coalesce(rows[3], [])), 1) AS m3 FROM grids)
SELECT id, CASE WHEN n = 4 AND even AND p >= 0.5 AND m3 >= 0.5 THEN 'personnel_dual_row' WHEN n >= 2 AND even AND p < 0.5 AND m < 0.5 THEN 'simple' WHEN w = 2 AND n >= 2 THEN 'key_value' ELSE 'fallback' END AS layout FROM h""")
def table_layout(spark, sf_dir):
    return tables.models(grids(spark, sf_dir)).select("id", "layout")


@query("""SELECT 'r' || CAST(n_regionkey AS VARCHAR) AS id, string_agg('key=' || CAST(n_nationkey AS VARCHAR) || ',name=' || n_name, ';' ORDER BY n_nationkey) AS records FROM nation GROUP BY n_regionkey
UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), '姓名=again ' || s_name || ',key=' || CAST(s_suppkey AS VARCHAR) FROM supplier
UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), '姓名=' || c_name || ',性别=x,级别=' || c_mktsegment || ',年龄=' || CAST(c_nationkey AS VARCHAR) FROM customer
UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR), p_name || '=' || p_brand FROM part""")
def table_records(spark, sf_dir):
    text = F.array_join(F.transform("records", lambda r: F.array_join(F.transform(r, lambda p: F.concat(p["key"], F.lit("="), p["value"])), ",")), ";")
    return tables.models(grids(spark, sf_dir)).select("id", text.alias("records"))


@query(f"""WITH {TABLES_SQL}, f AS (SELECT id, list_transform(rows, lambda r: '| ' || array_to_string(CASE WHEN len(r) < 2 THEN r || [''] ELSE r END, ' | ') || ' |') AS l FROM grids)
SELECT id, l[1] || chr(10) || '| --- | --- |' || chr(10) || array_to_string(l[2:], chr(10)) AS markdown FROM f""")
def table_markdown(spark, sf_dir):
    return tables.models(grids(spark, sf_dir)).select("id", "markdown")


@query("""SELECT 'r' || CAST(n_regionkey AS VARCHAR) AS id, '【表格:列表】' || chr(10) || string_agg('--- 行 ' || CAST(k AS VARCHAR) || ' ---' || chr(10) || 'key: ' || CAST(n_nationkey AS VARCHAR) || chr(10) || 'name: ' || n_name, chr(10) ORDER BY n_nationkey) AS llm_text
  FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation) GROUP BY n_regionkey
UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), '【表格:键值】' || chr(10) || '姓名: again ' || s_name || chr(10) || 'key: ' || CAST(s_suppkey AS VARCHAR) FROM supplier
UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), '【表格:人员信息】' || chr(10) || '--- 记录 1 ---' || chr(10) || '姓名: ' || c_name || chr(10) || '性别: x' || chr(10) || '级别: ' || c_mktsegment || chr(10) || '年龄: ' || CAST(c_nationkey AS VARCHAR) FROM customer
UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR), '【表格:键值】' || chr(10) || p_name || ': ' || p_brand FROM part""")
def table_llm_text(spark, sf_dir):
    return tables.models(grids(spark, sf_dir)).select("id", "llm_text")


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS c FROM documents WHERE length(text) >= 300)
SELECT doc_id, 0 AS slice_id, md5(substring(c, 11, 40) || 'TABLE A' || chr(10) || chr(10) || substring(c, 81, 20) || 'TABLE B' || chr(10) || chr(10)) AS text_md5 FROM d""")
def table_substitute(spark, sf_dir):
    """Slices from 10 to 110 of texts with tables at 50..80 and 100..200; the second is cut by the slice's end and yet whole."""
    docs = documents(spark, sf_dir).where(F.length("text") >= 300)
    slices = docs.select("doc_id", F.lit(0).alias("slice_id"), F.lit(10).alias("s"), F.lit(110).alias("e"), F.col("text").alias("content"))
    spans = docs.select("doc_id", F.explode(F.array(F.struct(F.lit(50).alias("char_start"), F.lit(80).alias("char_end"), F.lit("TABLE A").alias("llm_text")), F.struct(F.lit(100).alias("char_start"), F.lit(200).alias("char_end"), F.lit("TABLE B").alias("llm_text")))).alias("x")).select("doc_id", "x.*")
    return ranges.substitute_tables(slices, spans).select("doc_id", "slice_id", F.md5("text").alias("text_md5"))


# -- merging --------------------------------------------------------------------------------------


@query("""WITH i AS (SELECT coalesce(d.source, '') || '/' || CAST(d.doc_id // 1000 AS VARCHAR) AS ws, d.doc_id, lower(trim(string_split(coalesce(d.text, ''), chr(10))[1])) AS g, coalesce(l.quality, 0) AS q, length(coalesce(d.text, '')) AS n FROM documents d LEFT JOIN labels l USING (doc_id)),
r AS (SELECT *, CASE WHEN g = '' THEN '?' || CAST(doc_id AS VARCHAR) ELSE g END AS k FROM i),
b AS (SELECT ws, doc_id, min(doc_id) OVER (PARTITION BY ws, k) AS first, row_number() OVER (PARTITION BY ws, k ORDER BY q DESC, n DESC, doc_id) AS rn FROM r)
SELECT ws, doc_id, CAST(row_number() OVER (PARTITION BY ws ORDER BY first) - 1 AS INTEGER) AS out_ord FROM b WHERE rn = 1""")
def dedupe_title(spark, sf_dir):
    ws = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.floor(F.col("doc_id") / 1000).cast("string"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(ws.alias("ws"), "doc_id", F.element_at(F.split(F.coalesce("text", F.lit("")), "\n", -1), 1).alias("title"), F.coalesce("quality", F.lit(0)).alias("q"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return merge.dedupe_by_title(rows, "ws", order="doc_id", score=[F.col("q"), F.col("n")]).select("ws", "doc_id", F.col("out_ord").cast("int").alias("out_ord"))


@query("""WITH i AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, lower(l_returnflag) AS k, l_discount AS c, l_shipmode FROM (SELECT *, '' AS l_shipmode FROM lineitem)),
b AS (SELECT doc_id, k, count(*) AS n, min(ord) AS first, max(c) AS confidence, arg_max(ord, struct_pack(c := c, o := -ord)) AS best FROM i GROUP BY doc_id, k)
SELECT doc_id, CAST(first AS INTEGER) AS first, CAST(best AS VARCHAR) AS summary, confidence FROM b""")
def merge_scoring(spark, sf_dir):
    """Line items as scoring items of their order: title by return flag, confidence by discount."""
    kid = F.struct(F.col("l_linestatus").alias("title"), F.col("l_returnflag").alias("criteria"), F.lit("").alias("source_excerpt"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.col("l_linenumber").cast("string").alias("id"), F.col("l_returnflag").alias("title"), F.lit(10.0).alias("max_score"), F.col("l_linenumber").cast("string").alias("summary"), F.lit("").alias("criteria"), F.lit("").alias("weight"), F.array("l_linestatus").alias("section_path"), F.lit("").alias("source_excerpt"), F.col("l_discount").alias("confidence"), F.array(kid).alias("children"))
    return merge.merge_scoring(rows).select("doc_id", F.col("ord").cast("int").alias("first"), "summary", "confidence")


@query("""WITH i AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, o_orderpriority AS title, o_orderstatus <> 'F' AS inferred, round((o_orderkey % 10) / 10.0, 1)::DOUBLE AS confidence FROM orders),
e AS (SELECT doc_id, bool_or(NOT inferred) AS explicit, max(confidence) AS sure FROM i GROUP BY doc_id),
x AS (SELECT i.doc_id, lower(title) AS k, min(ord) AS first, arg_max(title, struct_pack(c := confidence, o := -ord)) AS title, max(confidence) AS confidence FROM i JOIN e USING (doc_id) WHERE explicit AND NOT inferred GROUP BY i.doc_id, lower(title)),
f AS (SELECT doc_id, lower(title) AS k, min(ord) AS first, arg_min(title, ord) AS title FROM i GROUP BY doc_id, lower(title))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS INTEGER) AS out_ord, title, FALSE AS inferred, title AS sections, confidence FROM x
UNION ALL SELECT e.doc_id, 0, '推断投标文件组成', TRUE, string_agg(f.title, '|' ORDER BY f.first), least(max(e.sure), 0.65) FROM e JOIN f ON f.doc_id = e.doc_id WHERE NOT e.explicit GROUP BY e.doc_id""")
def directory_merge(spark, sf_dir):
    """Orders as a customer's directory requirements: finished ones explicit."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("title"), (F.col("o_orderstatus") != "F").alias("inferred"), F.array("o_orderpriority").alias("sections"), F.lit("").alias("source_excerpt"), F.round((F.col("o_orderkey") % 10) / 10.0, 1).cast("double").alias("confidence"))
    return merge.directory(rows).select("doc_id", F.col("out_ord").cast("int").alias("out_ord"), "title", "inferred", joined("sections").alias("sections"), "confidence")


@query()
def template_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 20).alias("grp"), F.col("doc_id").alias("ord"), F.element_at(F.split(F.coalesce("text", F.lit("")), "\n", -1), 1).alias("title"), F.col("text").alias("markdown"), F.lit("").alias("source_excerpt"), ((F.col("doc_id") % 10) / 10.0).cast("double").alias("confidence"))
    return merge.dedupe_templates(rows, "grp")


@query("""WITH d AS (SELECT doc_id, left(coalesce(text, ''), 300) AS x FROM documents), p AS (SELECT a.doc_id, a.x AS a, b.x AS b FROM d a JOIN d b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, round(CASE WHEN a = '' AND b = '' THEN 1.0 WHEN a = '' OR b = '' THEN 0.0 ELSE len(list_intersect(list_distinct(string_split(a, '')), list_distinct(string_split(b, '')))) / len(list_distinct(string_split(a, '') || string_split(b, ''))) END, 9)::DOUBLE AS jaccard FROM p""")
def char_jaccard_pairs(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", F.left("text", F.lit(300)).alias("x"))
    other = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y"))
    return d.join(other, "doc_id").select("doc_id", F.round(t.char_jaccard(F.col("x"), F.col("y")), 9).alias("jaccard"))


@query("""WITH e AS (SELECT user_id AS call_key, event_id AS ord, CASE event_type WHEN 'view' THEN 'prompt' WHEN 'click' THEN 'response' ELSE 'attempt' END AS event, CAST(event_id AS VARCHAR) AS body FROM events),
a AS (SELECT call_key, min(CASE WHEN event = 'prompt' THEN ord END) AS ord, max(CASE WHEN event = 'prompt' THEN ord END) AS asked, max(CASE WHEN event = 'response' THEN ord END) AS answered, count(CASE WHEN event = 'attempt' THEN 1 END) AS attempts FROM e GROUP BY call_key)
SELECT call_key, ord, CAST(asked AS VARCHAR) AS prompt, CASE WHEN answered > asked THEN CAST(answered AS VARCHAR) END AS response, attempts FROM a WHERE asked IS NOT NULL""")
def llm_call_merge(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", F.lit("prompt")).when(F.col("event_type") == "click", F.lit("response")).otherwise(F.lit("attempt"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("call_key"), F.col("event_id").alias("ord"), kind.alias("event"), F.col("event_id").cast("string").alias("body"))
    return merge.call_log(rows)


# -- workspaces and sessions ----------------------------------------------------------------------


@query("""WITH a AS (SELECT user_id AS id, max(event_id) AS opened_at, 'main' AS origin FROM events WHERE event_type = 'view' GROUP BY user_id),
b AS (SELECT user_id AS id, max(event_id) AS opened_at, 'twin' AS origin FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)) ORDER BY opened_at DESC, id LIMIT 20""")
def session_merge_topk(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    of = lambda kind, name: e.where(F.col("event_type") == kind).groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("opened_at")).withColumn("origin", F.lit(name))
    return workspace.merged_sessions([of("view", "main"), of("click", "twin")])


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_job(spark, sf_dir):
    return workspace.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT user_id, CASE WHEN count(CASE WHEN event_type <> 'error' THEN 1 END) = count(*) THEN 'success' WHEN count(CASE WHEN event_type <> 'error' THEN 1 END) > 0 THEN 'partial_success' ELSE 'failed' END AS status FROM events GROUP BY user_id")
def batch_status(spark, sf_dir):
    return workspace.batch_status(table(spark, sf_dir, "events"), "user_id", F.col("event_type") != "error")


_MAPPING = "CASE ord % 11 WHEN 3 THEN 5 WHEN 7 THEN -4 ELSE 0 END"


@query(f"""WITH {BOOK}, m AS (SELECT ws, 'r' || CAST(ord AS VARCHAR) AS refined_node_id, char_start + {_MAPPING} AS s, CAST(char_start + length(md) AS BIGINT) AS e FROM book),
l AS (SELECT *, lag(e) OVER (PARTITION BY ws ORDER BY s, e, refined_node_id) AS before FROM m)
SELECT ws, refined_node_id, CASE WHEN s < before THEN 'overlap' ELSE 'gap' END AS problem FROM l WHERE s <> before""")
def mapping_validate(spark, sf_dir):
    shift = F.when(F.col("ord") % 11 == 3, 5).when(F.col("ord") % 11 == 7, -4).otherwise(0)
    rows = book(spark, sf_dir).select("ws", F.concat(F.lit("r"), F.col("ord").cast("string")).alias("refined_node_id"), (F.col("char_start") + shift).alias("char_start"), (F.col("char_start") + F.length("md")).alias("char_end"))
    return workspace.mapping_problems(rows, "ws")


@query(f"""WITH {BOOK} SELECT ws, coalesce(string_agg(CASE WHEN ord % 3 = 0 THEN title END, '|' ORDER BY ord), '') AS removed, coalesce(string_agg(CASE WHEN ord % 3 = 0 THEN title || ' (new)' END, '|' ORDER BY ord), '') AS added FROM book GROUP BY ws""")
def title_diff(spark, sf_dir):
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ord", c.alias("x")))), lambda s: s["x"])
    renamed = F.when(F.col("ord") % 3 == 0, F.concat("title", F.lit(" (new)"))).otherwise(F.col("title"))
    rows = book(spark, sf_dir).groupBy("ws").agg(listed(F.col("title")).alias("a"), listed(renamed).alias("b")).withColumn("d", workspace.title_diff(F.col("a"), F.col("b")))
    return rows.select("ws", joined("d.removed").alias("removed"), joined("d.added").alias("added"))


GAP = "\n\n<!-- merged -->\n\n"


def workspaces(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents as workspaces of one section; each merged with the next document's."""
    docs = documents(spark, sf_dir)
    made = lambda d: (d.select("doc_id", F.col("text").alias("content_md")), d.select("doc_id", F.lit("n1").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("ord"), F.lit(0).cast("long").alias("char_start"), F.length("text").cast("long").alias("char_end")))
    return workspace.merge_outlines(made(docs), [made(docs.select((F.col("doc_id") - 1).alias("doc_id"), "text").where("doc_id >= 0"))], gap=GAP)


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), g AS (SELECT chr(10) || chr(10) || '<!-- merged -->' || chr(10) || chr(10) AS gap)
SELECT a.doc_id, 'n1' AS node_id, 0 AS ord, 0::BIGINT AS char_start, length(a.x)::BIGINT AS char_end FROM d a
UNION ALL SELECT b.doc_id - 1, 'm2:n1', CASE WHEN a.doc_id IS NULL THEN 0 ELSE 1 END, CASE WHEN a.doc_id IS NULL THEN 0 ELSE length(a.x) + length(gap) END, CASE WHEN a.doc_id IS NULL THEN 0 ELSE length(a.x) + length(gap) END + length(b.x) FROM d b LEFT JOIN d a ON a.doc_id = b.doc_id - 1, g WHERE b.doc_id >= 1""")
def workspace_merge(spark, sf_dir):
    return workspaces(spark, sf_dir)[1].select("doc_id", "node_id", F.col("ord").cast("int").alias("ord"), "char_start", "char_end")


@query("""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents),
o AS (SELECT doc_id, 'n1' AS node_id, CASE WHEN doc_id % 5 = 0 THEN 'gone' END AS parent_id, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE 0 END AS s, n + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS e, n FROM d)
SELECT doc_id, node_id, 'parent' AS problem FROM o WHERE parent_id IS NOT NULL UNION ALL SELECT doc_id, node_id, 'range' FROM o WHERE NOT (0 <= s AND s < e AND e <= n)""")
def workspace_validate(spark, sf_dir):
    docs, n = documents(spark, sf_dir), F.length("text").cast("long")
    wrong = lambda k, yes, no: F.when(F.col("doc_id") % k == 0, yes).otherwise(no)
    faulty = docs.select("doc_id", F.lit("n1").alias("node_id"), wrong(5, F.lit("gone"), F.lit(None)).alias("parent_id"), F.lit(0).alias("ord"), wrong(7, F.lit(-1), F.lit(0)).cast("long").alias("char_start"), (n + wrong(11, F.lit(1), F.lit(0))).alias("char_end"))
    return workspace.invalid_nodes(docs.select("doc_id", F.col("text").alias("content_md")), faulty)


@query("""WITH b AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), r AS (SELECT doc_id, unnest(['a.png', 'b.png', 'none.png']) AS ref FROM b)
SELECT doc_id, ref, CASE ref WHEN 'a.png' THEN 1 WHEN 'b.png' THEN 0 END AS block_index, CAST(CASE ref WHEN 'b.png' THEN 0 WHEN 'a.png' THEN 1 ELSE 2 END AS INTEGER) AS place FROM r""")
def asset_refs(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id")
    refs = docs.select("doc_id", F.explode(F.array(F.lit("a.png"), F.lit("b.png"), F.lit("none.png"))).alias("ref"), F.lit("image").alias("kind"))
    at = lambda k, ref: F.struct(F.lit(k).alias("block_index"), F.lit(ref).alias("ref"), F.lit(k * 10).alias("char_start"), F.lit(k * 10 + 9).alias("char_end"))
    placed = docs.select("doc_id", F.explode(F.array(at(0, "b.png"), at(1, "a.png"), at(2, "b.png"))).alias("b")).select("doc_id", "b.*")
    return workspace.assets(refs, placed).select("doc_id", "ref", "block_index", F.col("place").cast("int").alias("place"))


@query("""WITH n AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, 'n' || CAST(o_orderkey AS VARCHAR) AS node_id, o_orderstatus FROM orders)
SELECT doc_id, arg_min(node_id, ord) AS node_id FROM n WHERE o_orderstatus <> 'F' GROUP BY doc_id""")
def next_pending(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("node_id"), "o_orderstatus")
    return workspace.next_pending(rows, rows.where("o_orderstatus = 'F'"))


# -- numbers, sources, models, reports ------------------------------------------------------------


@query("""WITH n AS (SELECT p_partkey AS n, CAST(p_partkey % 1010 AS INTEGER) AS v FROM part), d AS (SELECT n, v, v // 100 AS h, v % 100 AS r, v % 10 AS o, v // 10 % 10 AS t, '零一二三四五六七八九' AS z FROM n)
SELECT n, CASE WHEN v <= 0 OR v >= 1000 THEN CAST(v AS VARCHAR) WHEN v < 10 THEN substring(z, v + 1, 1) ELSE
  CASE WHEN h > 0 THEN substring(z, h + 1, 1) || '百' ELSE '' END || CASE WHEN r = 0 THEN '' WHEN t = 0 THEN '零' || substring(z, o + 1, 1) ELSE CASE WHEN t = 1 THEN '' ELSE substring(z, t + 1, 1) END || '十' || CASE WHEN o = 0 THEN '' ELSE substring(z, o + 1, 1) END END END AS counting,
  CASE WHEN v <= 0 OR v >= 10 THEN CAST(v AS VARCHAR) ELSE substring('零壹贰叁肆伍陆柒捌玖', v + 1, 1) END AS legal FROM d""")
def numbering_format(spark, sf_dir):
    v = (F.col("p_partkey") % 1010).cast("int")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), t.format_number(v, F.lit("chineseCounting")).alias("counting"), t.format_number(v, F.lit("chineseLegalSimplified")).alias("legal"))


@query()
def html_to_blocks(spark, sf_dir):
    return html.blocks(table(spark, sf_dir, "pages"))


def scripted() -> model_calls.ScriptedClient:
    return model_calls.ScriptedClient({"the": '{"items": [{"title": "English"}, {"title": "Text"}]}', "der": ["not json", '{"items": [{"title": "German"}]}']}, '{"items": []}')


@query("""WITH d AS (SELECT doc_id, left(coalesce(text, ''), 12000) AS x FROM documents)
SELECT doc_id, 0 AS ord, CASE WHEN contains(x, 'the') THEN 'English' ELSE 'German' END AS title FROM d WHERE contains(x, 'the') OR contains(x, 'der') UNION ALL SELECT doc_id, 1, 'Text' FROM d WHERE contains(x, 'the')""")
def llm_extract_fake(spark, sf_dir):
    rows = documents(spark, sf_dir).withColumn("prompt", F.left("text", F.lit(12_000)))
    return model_calls.items(model_calls.call(rows, "prompt", scripted, "doc_id"), "items", "title: string")


@query(f"""WITH {BOOK}, l AS (SELECT ws, level, string_agg('- **' || title || '**: ' || left(replace(text, chr(10), ' '), 20), chr(10) ORDER BY ord) AS x FROM book WHERE text <> '' GROUP BY ws, level)
SELECT ws, md5('# Report' || chr(10) || chr(10) || string_agg('## Level ' || CAST(level AS VARCHAR) || chr(10) || chr(10) || x, chr(10) || chr(10) ORDER BY level) || chr(10)) AS markdown_md5 FROM l GROUP BY ws""")
def render_report(spark, sf_dir):
    rows = book(spark, sf_dir).where("text <> ''").select("ws", F.col("level").alias("section_ord"), F.concat(F.lit("Level "), F.col("level").cast("string")).alias("section"), "ord", "title", F.left(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(20)).alias("body"))
    return render.report(rows, "ws").select("ws", F.md5("markdown").alias("markdown_md5"))


@query(f"""WITH RECURSIVE {BOOK}, n AS MATERIALIZED (SELECT * FROM nodes), r AS (SELECT ws, ord, title, 0 AS depth FROM n WHERE parent_ord IS NULL UNION ALL SELECT n.ws, n.ord, n.title, r.depth + 1 FROM n JOIN r ON r.ws = n.ws AND r.ord = n.parent_ord)
SELECT ws, md5(string_agg(repeat('#', least(depth + 2, 6)) || ' ' || title, chr(10) || chr(10) ORDER BY ord) || chr(10)) AS markdown_md5 FROM r GROUP BY ws""")
def render_outline(spark, sf_dir):
    rows = nodes(spark, sf_dir)
    nested = tree.nested_order(outline.section_paths(rows, "ws").join(rows.select("ws", "ord", "title"), ["ws", "ord"]), "ws")
    return render.outline(nested, "ws").select("ws", F.md5("markdown").alias("markdown_md5"))
