"""URL filters: a tree of path templates per host, judged by the purity of its labelled urls.

Segments that look variable (numbers, hashes, mixed names) become wildcards by their form. So do the children of a parent
whose urls spread over them like names do: the entropy of the children reaches VARIABLE of log(n + FEW), n being
the parent's urls. This goes from the root down. Then branches beside each other that go on alike are merged: in order of
their share of blocked labels, each is held against the next (a test of two proportions), and runs in which none differs
significantly become one wildcard (``*``, or ``*1``, ``*2``, ... where there are several runs). Branches without labels join where
there is one run only, of at least two branches. This goes from the deepest level up. Paths may have any depth.

Urls are labelled where a rule fits them. A template is rejected if its share of blocked labels, smoothed towards its host's
and that towards the corpus's, exceeds REJECT, whether it has labels of its own or not; of a host without any label nothing
is known, so the corpus's share counts as REJECT at most. A rule that fits decides first; the longest wins.

All statistics are aggregates over (host, shape) counts; all levels are counted at once, and a round changes each host's
highest (then deepest) level that asks for it, so rounds are few whatever the depth. What is
found meets shapes and urls over salted keys, so that a host with a third of all urls is dealt to many tasks; siblings meet
by their counts of labels, which are far fewer than siblings.

Null urls and urls without :// have empty host and path. Null ids and repeated rows keep their rows and count each.
An empty table gives an empty one. Ties of shares go by the counts. Only the id and url columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import checkpoint, table

#: (verdict, host/path)
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
VARIABLE = 0.7
FEW = 20
Z = 2.0
PRIOR_WEIGHT = 4.0
REJECT = 0.5
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule whose host is the url's or a domain above it and whose path the url's begins with; else null."""
    fits = []
    for _, rule in sorted(rules, key=lambda r: -len(r[1])):
        own, slash, rest = rule.partition("/")
        fits.append(F.when(((host == own) | host.endswith("." + own)) & path.startswith(slash + rest), F.lit(rule)))
    return F.coalesce(*fits)


def shape_of(path: Column) -> Column:
    """The path's segments, variable ones by their form."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    form = lambda s: (
        F.when(s.rlike(r"^[0-9]+(\.[A-Za-z]+)?$"), F.regexp_replace(s, "^[0-9]+", "<number>"))
        .when(s.rlike(r"^[0-9a-fA-F-]{16,}(\.[A-Za-z]+)?$"), F.regexp_replace(s, "^[0-9a-fA-F-]{16,}", "<hash>"))
        .when(s.rlike(r"[0-9]{4,}"), F.regexp_replace(s, "[0-9]+", "<number>"))
        .otherwise(s)
    )
    return F.transform(segments, form)


def _key(parts: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def _replaced(parts: Column, level: Column, by: Column) -> Column:
    return F.transform(parts, lambda s, i: F.when(i == level, by).otherwise(s))


def _levels(rows: DataFrame, parts: str) -> DataFrame:
    """A row for each literal segment: its level, the segment as child, the path before it as parent."""
    each = rows.select("*", F.posexplode(parts).alias("level", "child")).where(~F.col("child").startswith("<") & ~F.col("child").startswith("*"))
    return each.withColumn("parent", _key(F.slice(parts, 1, F.col("level"))))


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _generalised(shapes: DataFrame) -> DataFrame:
    """Adds ``template``: the shape with the children of parents that have them by the name as wildcards, from the root down."""
    found = shapes.withColumn("template", F.col("shape"))
    while True:
        at = _levels(found, "template")
        children = at.groupBy("host", "level", "parent", "child").agg(F.sum("n").cast("double").alias("n"))
        parents = children.groupBy("host", "level", "parent").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("s"))
        entropy = F.log("n") - F.col("s") / F.col("n")
        variable = checkpoint(parents.where(entropy >= VARIABLE * F.log(F.col("n") + FEW)).select("host", "level", "parent"))
        if variable.isEmpty():
            return found
        now = _salted(variable.join(variable.groupBy("host").agg(F.min("level").alias("level")), ["host", "level"]))
        keyed = at.select("host", "shape", "level", "parent", F.pmod(F.xxhash64("shape"), F.lit(SALTS)).cast("int").alias("salt"))
        hits = keyed.join(now, ["host", "level", "parent", "salt"]).select("host", "shape", F.col("level").alias("hit"))
        template = F.when(F.col("hit").isNotNull(), _replaced(F.col("template"), F.col("hit"), F.lit("*"))).otherwise(F.col("template"))
        found = checkpoint(found.join(hits, ["host", "shape"], "left").withColumn("template", template).drop("hit"))


def _merged(tree: DataFrame) -> DataFrame:
    """Adds ``final`` to ``tree`` (host, template, labelled, blocked): the template with branches that are alike as wildcards, from the deepest up."""
    tree = tree.withColumn("final", F.col("template"))
    pool = Window.partitionBy("host", "level", "pool")
    while True:
        sums = tree.groupBy("host", "final").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
        at = _levels(sums, "final").withColumn("pool", _key(_replaced(F.col("final"), F.col("level"), F.lit("*"))))
        stats = at.groupBy("host", "level", "pool", "labelled", "blocked").agg(F.count(F.lit(1)).alias("branches"))
        stats = stats.withColumn("has", F.col("labelled") > 0)
        order = Window.partitionBy("host", "level", "pool", "has").orderBy(F.try_divide("blocked", "labelled"), "labelled", "blocked")
        n, m = F.col("labelled"), F.lag("labelled").over(order)
        b, c = F.col("blocked"), F.lag("blocked").over(order)
        p = (b + c) / (n + m)
        apart = F.col("has") & m.isNotNull() & (F.abs(b * m - c * n) > Z * F.sqrt(p * (1 - p) * (n + m) * n * m))
        runs = stats.withColumn("apart", apart.cast("int")).withColumn("run", F.when(F.col("has"), F.sum("apart").over(order)).otherwise(-1))
        runs = runs.withColumns({"runs": F.max("run").over(pool) + 1, "known": F.sum(F.when(F.col("has"), F.col("branches"))).over(pool), "own": F.sum("branches").over(Window.partitionBy("host", "level", "pool", "run")), "all": F.sum("branches").over(pool)})
        one = (F.col("runs") == 1) & (F.col("known") >= 2)
        name = F.when(one, F.lit("*")).when(F.col("has") & (F.col("own") >= 2), F.concat(F.lit("*"), (F.col("run") + 1).cast("string")))
        told = checkpoint(runs.withColumn("name", name).where("name is not null").select("host", "level", "pool", "labelled", "blocked", "name"))
        if told.isEmpty():
            return tree
        now = _salted(told.join(told.groupBy("host").agg(F.max("level").alias("level")), ["host", "level"]))
        keyed = at.withColumn("salt", F.pmod(F.xxhash64("final"), F.lit(SALTS)).cast("int"))
        hits = keyed.join(now, ["host", "level", "pool", "labelled", "blocked", "salt"]).select("host", "final", F.col("level").alias("hit"), "name")
        final = F.when(F.col("hit").isNotNull(), _replaced(F.col("final"), F.col("hit"), F.col("name"))).otherwise(F.col("final"))
        tree = checkpoint(tree.join(hits, ["host", "final"], "left").withColumn("final", final).drop("hit", "name"))


def templates(urls: DataFrame) -> DataFrame:
    """(host, shape_key, template, purity, rejected) of each shape. ``urls`` has host, shape and label (1 block, 0 allow, null)."""
    shapes = urls.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked"))
    found = _generalised(checkpoint(shapes))
    tree = _merged(checkpoint(found.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))))
    total = tree.agg(F.sum("labelled"), F.sum("blocked")).first()
    prior = min(REJECT, (total[1] or 0) / total[0]) if total[0] else 0.0
    smooth = lambda bad, n, to: (bad + PRIOR_WEIGHT * to) / (n + PRIOR_WEIGHT)
    hosts = tree.groupBy("host").agg(smooth(F.sum("blocked"), F.sum("labelled"), F.lit(prior)).alias("host_purity"))
    finals = tree.groupBy("host", "final").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    finals = finals.join(hosts, "host").select("host", "final", smooth(F.col("blocked"), F.col("labelled"), F.col("host_purity")).alias("purity"))
    judged = tree.select("host", "template", "final").join(finals, ["host", "final"])
    return found.select("host", "shape", "template").join(judged, ["host", "template"]).select("host", _key(F.col("shape")).alias("shape_key"), _key(F.col("final")).alias("template"), "purity", (F.col("purity") > REJECT + 1e-9).alias("rejected"))


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity), a row for each row of ``df``."""
    url = F.col(url_col).cast("string")
    urls = df.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    urls = urls.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules), "shape": shape_of(F.col("path"))})
    says = F.coalesce(*[F.when(F.col("rule") == rule, F.lit(verdict)) for verdict, rule in rules]) if rules else F.lit(None).cast("string")
    urls = urls.withColumn("says", says)
    label = F.when(F.col("says") == "block", 1).when(F.col("says") == "allow", 0)
    known = checkpoint(templates(urls.select("host", "shape", label.alias("label"))))
    known = _salted(known)
    keyed = urls.withColumns({"shape_key": _key(F.col("shape")), "salt": F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")})
    both = keyed.join(known, ["host", "shape_key", "salt"], "left")
    verdict = F.coalesce("says", F.when(F.col("rejected"), F.lit("block")), F.lit("allow"))
    return both.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
