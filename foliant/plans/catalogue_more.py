"""More queries with their SQL: text rules, coercions, anchors and slices, merged children, ids, scoring tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as t
from foliant.operators import chunking, classify, merge, outline, ranges, render, workspace
from foliant.plans.catalogue import query
from foliant.plans.views import BOOK, book, documents, table

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(r"""WITH p AS (SELECT doc_id, 'in/' || CAST(doc_id AS VARCHAR) || ['.DOCX', '.doc', '.pdf', '.Docm', '.txt', '', '.pdf/x'][1 + doc_id % 7] AS path FROM documents)
SELECT doc_id, CASE lower(regexp_extract(path, '(\.[^./\\]+)$', 1)) WHEN '.docx' THEN 'docx' WHEN '.doc' THEN 'doc' WHEN '.docm' THEN 'docm' WHEN '.pdf' THEN 'pdf' END AS file_type FROM p""")
def file_types(spark, sf_dir):
    ends = F.element_at(F.array(*[F.lit(x) for x in (".DOCX", ".doc", ".pdf", ".Docm", ".txt", "", ".pdf/x")]), (F.col("doc_id") % 7 + 1).cast("int"))
    return documents(spark, sf_dir).select("doc_id", t.file_type(F.concat(F.lit("in/"), F.col("doc_id").cast("string"), ends)).alias("file_type"))


_MARKED = "CASE doc_id % 3 WHEN 0 THEN replace(coalesce(text, ''), '.', '。') WHEN 1 THEN replace(coalesce(text, ''), ', ', '，') ELSE coalesce(text, '') END"


def _cut(mark: str) -> str:
    return f"WHEN instr(h, {mark}) > 0 AND length(h) - instr(reverse(h), {mark}) > 60 THEN {STRIP.format(f'left(h, length(h) - instr(reverse(h), {mark}) + 1)')}"


@query(f"""WITH d AS (SELECT doc_id, {_MARKED} AS x FROM documents), c AS (SELECT doc_id, x, left(x, 120) AS h FROM d)
SELECT doc_id, CASE WHEN length(x) <= 120 THEN x {_cut("'。'")} {_cut("'；'")} {_cut("chr(10)")} {_cut("'，'")} {_cut("' '")} ELSE {STRIP.format("h")} END AS summary FROM c""")
def summary_limit(spark, sf_dir):
    x = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("."), F.lit("。"))).when(F.col("doc_id") % 3 == 1, F.replace("text", F.lit(", "), F.lit("，"))).otherwise(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", t.limit_summary(x, 120).alias("summary"))


@query("""WITH p AS (SELECT p_partkey AS n, CASE p_partkey % 6 WHEN 0 THEN ' High' WHEN 1 THEN 'medium' WHEN 2 THEN 'LOW' WHEN 3 THEN CAST(p_size AS VARCHAR) || 'e-1' WHEN 4 THEN CAST(-p_size AS VARCHAR) ELSE p_brand END AS raw, CAST(p_size AS VARCHAR) || CASE p_partkey % 3 WHEN 0 THEN '.00' WHEN 1 THEN '.50' ELSE '' END AS w FROM part)
SELECT n, CASE lower(trim(raw)) WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.7 WHEN 'low' THEN 0.5 ELSE CASE WHEN try_cast(raw AS DOUBLE) IS NULL THEN 0.8 ELSE least(greatest(try_cast(raw AS DOUBLE), 0.0), 1.0) END END::DOUBLE AS confidence, regexp_replace(w, '\\.0+$', '') AS weight FROM p""")
def coercions(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    raw = F.when(k % 6 == 0, " High").when(k % 6 == 1, "medium").when(k % 6 == 2, "LOW").when(k % 6 == 3, F.concat(size, F.lit("e-1"))).when(k % 6 == 4, (-F.col("p_size")).cast("string")).otherwise(F.col("p_brand"))
    weight = F.concat(size, F.when(k % 3 == 0, ".00").when(k % 3 == 1, ".50").otherwise(""))
    return table(spark, sf_dir, "part").select(k.alias("n"), t.confidence(raw).cast("double").alias("confidence"), t.weight_text(weight).alias("weight"))


@query("""SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '  ' WHEN c_custkey % 3 = 1 THEN NULL ELSE ' ' || c_name END), ''), nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END), ''), '（未提供）') AS shown FROM customer""")
def fallback_text(spark, sf_dir):
    k = F.col("c_custkey")
    one = F.when(k % 3 == 0, F.lit("  ")).when(k % 3 == 2, F.concat(F.lit(" "), "c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", t.first_text(one, F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise("")).alias("shown"))


_PREFIXED = "['', '一、', '1.', '（二）'][1 + doc_id % 4]"


@query(f"""WITH d AS (SELECT doc_id, {_PREFIXED} AS p, {STRIP.format("CASE doc_id % 5 WHEN 0 THEN '三、' WHEN 1 THEN '（二）' ELSE '' END || regexp_extract(coalesce(text, ''), '^[^ ]*')")} AS s FROM documents)
SELECT doc_id, CASE WHEN s = '' OR p = '' OR regexp_matches(s, '^([一二三四五六七八九十百]+|[0-9]+)[、.．]') OR starts_with(s, p) THEN s ELSE p || s END AS line FROM d""")
def list_prefixes(spark, sf_dir):
    k = F.col("doc_id")
    own = F.concat(F.when(k % 5 == 0, "三、").when(k % 5 == 1, "（二）").otherwise(""), F.regexp_extract("text", "^[^ ]*", 0))
    prefix = F.element_at(F.array(*[F.lit(x) for x in ("", "一、", "1.", "（二）")]), (k % 4 + 1).cast("int"))
    return documents(spark, sf_dir).select("doc_id", t.merge_list_prefix(own, prefix).alias("line"))


@query(f"""WITH {BOOK}, m AS (SELECT ws, 'r' || CAST(ord AS VARCHAR) AS refined_node_id, unnest(['n' || CAST(ord AS VARCHAR), 'n' || CAST(ord + 3 AS VARCHAR)]) AS source_node_id FROM book),
o AS (SELECT ws, 'n' || CAST(ord AS VARCHAR) AS id FROM book WHERE ord % 5 <> 0)
SELECT ws, refined_node_id, source_node_id FROM m WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.ws = m.ws AND o.id = m.source_node_id)""")
def mapping_sources(spark, sf_dir):
    rows = book(spark, sf_dir).select("ws", "ord")
    name = lambda mark, c: F.concat(F.lit(mark), c.cast("string"))
    mapping = rows.select("ws", name("r", F.col("ord")).alias("refined_node_id"), F.array(name("n", F.col("ord")), name("n", F.col("ord") + 3)).alias("source_node_ids"))
    return workspace.unknown_sources(mapping, rows.where("ord % 5 <> 0").select("ws", name("n", F.col("ord")).alias("node_id")), "ws")


@query(f"""WITH {BOOK}, r AS (SELECT ws, ord, CASE ord % 3 WHEN 0 THEN 'form' WHEN 1 THEN 'letter' ELSE 'table' END AS type, CASE WHEN ord % 4 = 1 THEN ' ' ELSE text END AS markdown, printf('tpl-%03d', row_number() OVER (PARTITION BY ws ORDER BY ord)) AS template_id FROM book)
SELECT ws, CAST(ord AS INTEGER) AS ord, template_id, type || printf('-%03d', row_number() OVER (PARTITION BY ws, type ORDER BY ord)) AS type_id FROM r WHERE regexp_matches(markdown, '\\S')""")
def template_numbers(spark, sf_dir):
    k = F.col("ord")
    rows = book(spark, sf_dir).select("ws", "ord", F.when(k % 3 == 0, "form").when(k % 3 == 1, "letter").otherwise("table").alias("type"), F.when(k % 4 == 1, " ").otherwise(F.col("text")).alias("markdown"))
    return merge.template_ids(rows, "ws").select("ws", "ord", "template_id", "type_id")


_CHILD = "CASE WHEN doc_id % 6 = 5 THEN ' ' ELSE ['Price', 'price ', 'Term', 'Staff', 'TERM'][1 + doc_id % 5] END"


@query(f"""WITH c AS (SELECT doc_id // 20 AS grp, doc_id, {_CHILD} AS title, left(coalesce(text, ''), CAST(doc_id * 7 % 13 AS INTEGER)) AS criteria, left(coalesce(text, ''), CAST(doc_id * 5 % 4 AS INTEGER)) AS excerpt FROM documents),
n AS (SELECT *, lower(trim(title)) AS low, CASE WHEN trim(title) = '' THEN 1 ELSE 0 END AS blank FROM c),
b AS (SELECT *, min(doc_id) OVER (PARTITION BY grp, low) AS first, row_number() OVER (PARTITION BY grp, low ORDER BY length(criteria) DESC, length(excerpt) DESC, doc_id) AS k FROM n)
SELECT grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY blank, CASE WHEN blank = 1 THEN doc_id ELSE first END) - 1 AS INTEGER) AS place, title, criteria, excerpt FROM b WHERE blank = 1 OR k = 1""")
def children_merged(spark, sf_dir):
    k = F.col("doc_id")
    title = F.when(k % 6 == 5, F.lit(" ")).otherwise(F.element_at(F.array(*[F.lit(x) for x in ("Price", "price ", "Term", "Staff", "TERM")]), (k % 5 + 1).cast("int")))
    child = F.struct("doc_id", F.struct(title.alias("title"), F.left("text", (k * 7 % 13).cast("int")).alias("criteria"), F.left("text", (k * 5 % 4).cast("int")).alias("source_excerpt")).alias("c"))
    rows = documents(spark, sf_dir).groupBy(F.floor(k / 20).alias("grp")).agg(F.transform(F.array_sort(F.collect_list(child)), lambda x: x["c"]).alias("children"))
    return rows.select("grp", F.posexplode(merge.merge_children(F.col("children"))).alias("place", "c")).select("grp", "place", "c.title", "c.criteria", F.col("c.source_excerpt").alias("excerpt"))


@query("""WITH m AS (SELECT doc_id, coalesce(text, '') AS x, unnest(range(4)) AS ord FROM documents), r AS (SELECT *, greatest(ord * 300 - 20, 0) AS s, least(ord * 300 + 250, length(x)) AS e FROM m)
SELECT doc_id, CAST(ord AS INTEGER) AS ord, 'r' || CAST(ord AS VARCHAR) AS refined_node_id, md5(substring(x, s + 1, greatest(e - s, 0))) AS text_md5 FROM r""")
def refined_ranges(spark, sf_dir):
    docs = documents(spark, sf_dir)
    at = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ord"))
    mapping = at.select("doc_id", "ord", F.concat(F.lit("r"), F.col("ord").cast("string")).alias("refined_node_id"), (F.col("ord") * 300 - 20).alias("char_start"), (F.col("ord") * 300 + 250).alias("char_end"))
    found = chunking.refined_slices(docs.withColumnRenamed("text", "content_md").withColumnRenamed("doc_id", "doc_id"), mapping)
    return found.select("doc_id", "ord", "refined_node_id", F.md5("markdown").alias("text_md5"))


@query(f"""WITH {BOOK}, n AS (SELECT ws, ord, level, 'part ' || CAST(ord % 7 AS VARCHAR) AS title, char_start FROM book),
a AS (SELECT *, row_number() OVER (PARTITION BY ws, level, title ORDER BY ord) AS k FROM n),
h AS (SELECT ws, ord, CASE WHEN ord % 5 = 0 THEN 8 ELSE level END AS level, title, char_start FROM n WHERE ord % 7 < 5),
b AS (SELECT *, row_number() OVER (PARTITION BY ws, level, title ORDER BY ord) AS k FROM h),
f AS (SELECT ws, title, min(char_start) AS first FROM h GROUP BY ws, title)
SELECT a.ws, a.ord, coalesce(b.char_start, f.first, a.char_start + 3) AS char_start FROM a LEFT JOIN b ON b.ws = a.ws AND b.level = a.level AND b.title = a.title AND b.k = a.k LEFT JOIN f ON f.ws = a.ws AND f.title = a.title""")
def headings_matched(spark, sf_dir):
    rows = book(spark, sf_dir).select("ws", "ord", "level", F.concat(F.lit("3.1 Part "), (F.col("ord") % 7).cast("string")).alias("title"), "char_start")
    heads = rows.where("ord % 7 < 5").withColumn("level", F.when(F.col("ord") % 5 == 0, 8).otherwise(F.col("level")))
    return outline.match_headings(rows.withColumn("char_start", F.col("char_start") + 3), heads, "ws").select("ws", "ord", "char_start")


@query(r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS x, CAST(doc_id % 9 AS INTEGER) AS hint FROM documents),
p AS (SELECT *, regexp_replace(CASE doc_id % 3 WHEN 0 THEN substring(x, 21, 30) WHEN 1 THEN substring(x, 11, 130) || 'zzz' ELSE 'nowhere at all' END, '^\s+|\s+$', '', 'g') AS own FROM d),
f AS (SELECT *, instr(substring(x, hint + 1), own) AS a, instr(substring(x, hint + 1), left(own, 120)) AS b FROM p),
s AS (SELECT doc_id, own, CASE WHEN own = '' THEN hint WHEN a > 0 THEN hint + a - 1 WHEN b > 0 THEN hint + b - 1 ELSE hint END AS at0 FROM f)
SELECT doc_id, CAST(at0 AS BIGINT) AS char_start, CAST(at0 + length(own) AS BIGINT) AS char_end FROM s WHERE own <> ''""")
def parts_located(spark, sf_dir):
    k = F.col("doc_id")
    part = F.when(k % 3 == 0, F.substring("text", 21, 30)).when(k % 3 == 1, F.concat(F.substring("text", 11, 130), F.lit("zzz"))).otherwise("nowhere at all")
    rows = documents(spark, sf_dir).withColumn("part", part).where(t.strip(F.col("part")) != "")
    return rows.select("doc_id", ranges.located(F.col("text"), F.col("part"), (k % 9).cast("int")).alias("r")).select("doc_id", "r.char_start", "r.char_end")


_TABLES = "t AS (SELECT doc_id, unnest(range(8)) AS k, 'tables/t' || CAST(k AS VARCHAR) || '.json' AS table_ref, k * 400 AS s, k * 400 + 100 AS e, CASE WHEN (doc_id + k) % 3 = 0 THEN '分值 ' ELSE 'plain ' END || CAST(k AS VARCHAR) AS llm_text FROM documents)"


def _tables(spark, sf_dir):
    k = F.col("k")
    rows = documents(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    text = F.concat(F.when((F.col("doc_id") + k) % 3 == 0, "分值 ").otherwise("plain "), k.cast("string"))
    return rows.select("doc_id", F.concat(F.lit("tables/t"), k.cast("string"), F.lit(".json")).alias("table_ref"), (k * 400).alias("char_start"), (k * 400 + 100).alias("char_end"), text.alias("llm_text"))


@query(f"""WITH {_TABLES}, s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, table_ref) AS n FROM t WHERE contains(llm_text, '分值'))
SELECT doc_id, table_ref, llm_text AS text FROM s WHERE n <= 2 AND NOT (doc_id % 2 = 0 AND llm_text = '分值 3')""")
def scoring_tables(spark, sf_dir):
    segments = documents(spark, sf_dir).where("doc_id % 2 = 0").select("doc_id", F.lit(" 分值 3\n").alias("text"))
    return chunking.scoring_segments(_tables(spark, sf_dir), segments, most=2)


@query(f"""WITH {_TABLES}, g AS (SELECT doc_id, unnest(range(3)) AS segment, segment * 1000 AS s, segment * 1000 + 700 AS e FROM documents),
m AS (SELECT g.doc_id, g.segment, string_agg(t.llm_text, chr(10) || chr(10) ORDER BY t.s) AS more FROM g JOIN t ON t.doc_id = g.doc_id AND contains(t.llm_text, '分值') AND t.e > g.s AND t.s < g.e + 350 GROUP BY g.doc_id, g.segment)
SELECT g.doc_id, CAST(g.segment AS INTEGER) AS segment, CASE WHEN more IS NULL THEN 'body ' ELSE 'body' || chr(10) || chr(10) || more END AS text FROM g LEFT JOIN m ON m.doc_id = g.doc_id AND m.segment = g.segment""")
def scoring_reach(spark, sf_dir):
    k = F.col("segment")
    segments = documents(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("segment")).select("doc_id", "segment", (k * 1000).alias("s"), (k * 1000 + 700).alias("e"), F.lit("body ").alias("text"))
    return chunking.scoring_lookahead(segments, _tables(spark, sf_dir), lookahead=350).select("doc_id", "segment", "text")


@query("""SELECT user_id, CAST(least(100, count(CASE WHEN event_type <> 'error' THEN 1 END) * 100 // count(*)) AS INTEGER) AS percent FROM events GROUP BY user_id""")
def progress_percent(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("done"), F.count(F.lit(1)).alias("n"))
    return counts.select("user_id", workspace.progress(F.col("done"), F.col("n")).alias("percent"))


@query("SELECT p_partkey AS n, CAST(p_retailprice * 10 AS INTEGER) <= 10240 AND (p_size * 5 < 128 OR p_partkey % 300 < 128) AS small FROM part")
def small_images(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), t.is_small_image(F.round(F.col("p_retailprice") * 10).cast("int"), F.col("p_size") * 5, F.col("p_partkey") % 300).alias("small"))


@query(f"WITH {BOOK} SELECT ws, title, printf('dir-%03d', row_number() OVER (PARTITION BY ws ORDER BY ord)) AS dir_id FROM book")
def directory_ids(spark, sf_dir):
    return render.flat_directory(book(spark, sf_dir).select("ws", "title", F.col("ord").alias("preorder")), "ws").select("ws", "title", "dir_id")


_KINDS = [x[2][0] for x in classify.TEMPLATES]
_PICK = f"[{', '.join(repr(x) for x in (*_KINDS, 'nothing'))}][1 + doc_id % {len(_KINDS) + 1}]"
_ANY = lambda words: " OR ".join(f"contains(x, '{w}')" for w in words)


@query(f"""WITH d AS (SELECT doc_id, 'Form' || chr(10) || left(CASE WHEN doc_id % 2 = 0 THEN {_PICK} ELSE '' END || coalesce(text, '') || {_PICK}, 500) AS x FROM documents)
SELECT doc_id, CASE {" ".join(f"WHEN {_ANY(words)} THEN '{kind}'" for kind, _, words in classify.TEMPLATES)} ELSE 'other' END AS type, CASE WHEN {" OR ".join(_ANY(words) for _, _, words in classify.TEMPLATES)} THEN 0.95 ELSE 0.6 END::DOUBLE AS confidence FROM d""")
def template_kinds(spark, sf_dir):
    word = F.element_at(F.array(*[F.lit(x) for x in (*_KINDS, "nothing")]), (F.col("doc_id") % (len(_KINDS) + 1) + 1).cast("int"))
    body = F.concat(F.when(F.col("doc_id") % 2 == 0, word).otherwise(""), "text", word)
    return documents(spark, sf_dir).select("doc_id", classify.template_kind(F.lit("Form"), body).alias("k")).select("doc_id", "k.type", F.col("k.confidence").cast("double").alias("confidence"))


_FILES = "CASE event_type WHEN 'view' THEN 'content.md' WHEN 'click' THEN 'outline.json' WHEN 'purchase' THEN 'manifest.json' ELSE 'other.txt' END"


@query(f"""WITH f AS (SELECT user_id AS doc_id, {_FILES} AS name FROM events), h AS (SELECT doc_id, max(CASE WHEN name = 'content.md' THEN 1 ELSE 0 END) AS a, max(CASE WHEN name = 'outline.json' THEN 1 ELSE 0 END) AS b, max(CASE WHEN name = 'manifest.json' THEN 1 ELSE 0 END) AS c FROM f GROUP BY doc_id)
SELECT doc_id, a + b + c = 3 AS ready, concat_ws('|', CASE WHEN a = 0 THEN 'content.md' END, CASE WHEN b = 0 THEN 'outline.json' END, CASE WHEN c = 0 THEN 'manifest.json' END) AS missing FROM h""")
def workspace_ready(spark, sf_dir):
    name = F.when(F.col("event_type") == "view", "content.md").when(F.col("event_type") == "click", "outline.json").when(F.col("event_type") == "purchase", "manifest.json").otherwise("other.txt")
    files = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), name.alias("name"))
    return workspace.files_ready(files, ["content.md", "outline.json", "manifest.json"]).select("doc_id", "ready", F.array_join("missing", "|").alias("missing"))


@query("SELECT event_id, event_type FROM events WHERE starts_with(event_type, 'p') OR starts_with(event_type, 'pur')")
def calls_by_prefix(spark, sf_dir):
    return workspace.calls_of(table(spark, sf_dir, "events"), "p", "event_type").select("event_id", "event_type")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest, base64(encode(left(coalesce(text, ''), 90))) AS sent FROM documents")
def digests_and_base64(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", t.sha256_hex(F.col("text")).alias("digest"), t.base64_text(F.left("text", F.lit(90))).alias("sent"))


@query("""WITH e AS (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)
SELECT event_id, round(epoch_us(next) / 1000000.0::DOUBLE - epoch_us(ts) / 1000000.0::DOUBLE, 2)::DOUBLE AS seconds FROM e WHERE next IS NOT NULL""")
def call_durations(spark, sf_dir):
    from pyspark.sql import Window

    ahead = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("next", ahead).where("next is not null").select("event_id", t.seconds_between(F.col("ts"), F.col("next")).cast("double").alias("seconds"))


@query(f"""WITH {_TABLES} SELECT doc_id, CAST(k AS INTEGER) AS place, table_ref, CASE WHEN (doc_id + k) % 4 <> 0 THEN k * 2 END AS n_rows FROM t WHERE k < 5""")
def table_sidecars(spark, sf_dir):
    rows = _tables(spark, sf_dir).where("char_start < 2000")
    number = F.regexp_extract("table_ref", "t([0-9]+)", 1).cast("int")
    models = rows.where((F.col("doc_id") + number) % 4 != 0).select("doc_id", "table_ref", F.format_string('{"layout": "grid", "n_rows": %d}', number * 2).alias("model"))
    found = workspace.with_sidecars(rows, models).withColumn("m", F.from_json("model", "layout string, n_rows bigint"))
    return found.select("doc_id", F.col("place").cast("int").alias("place"), "table_ref", F.col("m.n_rows").alias("n_rows"))


@query("""WITH d AS (SELECT doc_id FROM documents)
SELECT doc_id, true AS has_directory, doc_id % 3 = 0 AS has_brief, doc_id % 4 = 1 AS has_templates FROM d WHERE doc_id % 5 <> 2""")
def catalogue_prerequisites(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id")
    twice = docs.where("doc_id % 3 = 0").unionByName(docs.where("doc_id % 6 = 0"))
    return workspace.prerequisites(docs, docs.where("doc_id % 5 <> 2"), {"brief": twice, "templates": docs.where("doc_id % 4 = 1")})


_HOST, _SHORT = "投标人须知", 40


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), s AS (SELECT doc_id, x, unnest(range(3)) AS segment, CAST(segment * 30 AS BIGINT) AS s, CAST(segment * 30 + CASE WHEN doc_id % 2 = 0 THEN 25 ELSE 45 END AS BIGINT) AS e FROM d),
c AS (SELECT *, substring(x, s + 1, e - s) AS own, substring(x, s + 1, least(e + 100, length(x)) - s) AS longer FROM s)
SELECT doc_id, CAST(segment AS INTEGER) AS segment, CASE WHEN doc_id % 3 = 0 AND least(e + 100, length(x)) > e AND length({STRIP.format("own")}) < {_SHORT} AND length({STRIP.format("longer")}) > length({STRIP.format("own")}) THEN longer ELSE own END AS text FROM c""")
def short_segments_expanded(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("segment")).withColumn("s", (F.col("segment") * 30).cast("long"))
    rows = rows.withColumn("e", F.col("s") + F.when(F.col("doc_id") % 2 == 0, 25).otherwise(45))
    path = F.array(F.lit("Document"), F.when(F.col("doc_id") % 3 == 0, F.lit(_HOST)).otherwise(F.lit("Other")))
    segments = rows.select("doc_id", "segment", "s", "e", path.alias("section_path"), F.substring("text", (F.col("s") + 1).cast("int"), (F.col("e") - F.col("s")).cast("int")).alias("text"))
    none = _tables(spark, sf_dir).where("false").select("doc_id", "char_start", "char_end", "llm_text")
    return chunking.expand_short(segments, none, docs.withColumnRenamed("text", "content_md"), short=_SHORT, lookahead=100).select("doc_id", "segment", "text")
