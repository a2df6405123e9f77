import math
import random
import re
from collections import Counter

from foliant.llm import url_filter


def plain(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    best = None
    for verdict, rule in [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]:
        own, _, rest = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_rules_like_plain_ones(spark):
    path = "/root/testdata/sf0.01"
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    got = url_filter.op6_url_filter(spark, path).collect()
    assert sorted(r["page_id"] for r in got) == sorted(urls)
    for r in got:
        host, p, best = plain(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, p, best and best[1])
        assert r["verdict"] in ("allow", "block") and (best is None or r["verdict"] == best[0])


def plain_tree(pages, rules):
    """(verdict, template) of each (url): the docstring's tree, with dictionaries, one url after the other."""
    shape = lambda path: tuple(form(x) for x in path.split("/") if x)

    def form(x):
        if re.fullmatch(r"[0-9]+(\.[A-Za-z]+)?", x):
            return re.sub("^[0-9]+", "<number>", x)
        if re.fullmatch(r"[0-9a-fA-F-]{16,}(\.[A-Za-z]+)?", x):
            return re.sub("^[0-9a-fA-F-]{16,}", "<hash>", x)
        return re.sub("[0-9]+", "<number>", x) if re.search("[0-9]{4,}", x) else x

    literal = lambda x: x[0] not in "<*"
    rows = []
    for url in pages:
        host, path, _ = plain(url)
        fits = [(len(r), v) for v, r in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        rows.append((host, shape(path), max(fits)[1] if fits else None))
    final = {}
    for host in {h for h, _, _ in rows}:
        own = [(s, says) for h, s, says in rows if h == host]
        to = {s: s for s, _ in own}
        for level in range(max(map(len, to))):  # from the root down
            children = {}
            for s, _ in own:
                t = to[s]
                if len(t) > level and literal(t[level]):
                    children.setdefault(t[:level], Counter())[t[level]] += 1
            for parent, kids in children.items():
                n = sum(kids.values())
                if math.log(n) - sum(c * math.log(c) for c in kids.values()) / n >= 0.7 * math.log(n + 20):
                    to = {s: (*t[:level], "*", *t[level + 1 :]) if len(t) > level and t[:level] == parent and literal(t[level]) else t for s, t in to.items()}
        level = max(map(len, to.values())) - 1
        while level >= 0:  # from the deepest up, and back to it where something changed
            counts = {}
            for s, says in own:
                c = counts.setdefault(to[s], [0, 0])
                c[0] += says is not None
                c[1] += says == "block"
            pools, renamed = {}, {}
            for t, (n, b) in counts.items():
                if len(t) > level and literal(t[level]):
                    pools.setdefault((*t[:level], "*", *t[level + 1 :]), []).append((n, b, t))
            for pool, branches in pools.items():
                known = sorted([x for x in branches if x[0]], key=lambda x: (x[1] / x[0], x[0], x[1]))
                runs = []
                for n, b, t in known:
                    if runs:
                        m, c, _ = runs[-1][-1]
                        p = (b + c) / (n + m)
                        if abs(b / n - c / m) <= 2 * math.sqrt(p * (1 - p) * (1 / n + 1 / m)) + 1e-12:
                            runs[-1].append((n, b, t))
                            continue
                    runs.append([(n, b, t)])
                new = {}
                if len(runs) == 1 and len(known) >= 2:
                    new = {t: pool for _, _, t in branches}
                elif len(runs) > 1:
                    new = {t: (*pool[:level], f"*{k}", *pool[level + 1 :]) for k, run in enumerate(runs, 1) if len(run) >= 2 for _, _, t in run}
                renamed |= new
            to = {s: renamed.get(t, t) for s, t in to.items()}
            level = max(map(len, to.values())) - 1 if renamed else level - 1
        for s, t in to.items():
            final[host, s] = t
    says = [x for _, _, x in rows if x]
    prior = min(0.5, says.count("block") / len(says)) if says else 0.0
    out = []
    for host, s, verdict in rows:
        of_host = [x for h, _, x in rows if h == host and x]
        of_template = [x for h, r, x in rows if h == host and final[h, r] == final[host, s] and x]
        purity = (of_template.count("block") + 4 * (of_host.count("block") + 4 * prior) / (len(of_host) + 4)) / (len(of_template) + 4)
        out.append((verdict or ("block" if purity > 0.5 + 1e-9 else "allow"), "/" + "/".join(final[host, s])))
    return out


def mixed_urls():
    """Names that spread, alike and unlike branches, deep paths."""
    rng = random.Random(3)
    urls = []
    for k in range(900):
        host = rng.choice(["a.zz", "b.zz", "c.zz"])
        first = rng.choice(["shop", "news", "spam", "junk", "blog", "old"])
        name = "".join(rng.choices("bcdfgh", k=4))
        urls.append(f"http://{host}/{first}/{rng.choice([name, 'list', 'list'])}/{rng.choice(['x', 'y', 'z'])}/{k}" + "/deep" * rng.choice([0, 0, 0, 9]))
    rules = (("block", "zz/spam/"), ("block", "zz/junk/list/x"), ("allow", "a.zz/news/"), ("allow", "zz/shop/list/"), ("block", "b.zz/blog/list/y"))
    return urls, rules


def test_tree_like_a_plain_one(spark):
    path = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{path}/pages.parquet")
    mixed, own = mixed_urls()
    for df, rules in ((pages, url_filter.RULES), (spark.createDataFrame(list(enumerate(mixed)), "page_id long, url string"), own)):
        urls = {r["page_id"]: r["url"] for r in df.collect()}
        want = dict(zip(urls, plain_tree(urls.values(), rules), strict=True))
        got = {r["page_id"]: r for r in url_filter.judge(df, rules=rules).collect()}
        assert {k: (r["verdict"], r["template"]) for k, r in got.items()} == want
        tree = [r["verdict"] for r in got.values() if r["rule"] is None]
        assert 0 < tree.count("block") < len(tree)


def test_odd_urls(spark):
    urls = [None, "", "nothing", "HTTP://WWW.Example.COM/en/7?x", "a://b://c/d", "http://com/en/", "http://xcom/en/1", "http://É.com#/en/", "://?x", "http://net/de", "http://a.example.net/de/81/", "x\n://h\n/p\nq?"]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(None, None, "z"), (0, None, "z")], "page_id long, url string, host string")
    got = url_filter.judge(df).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        if r["page_id"]:
            host, path, best = plain(urls[r["page_id"]])
            assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1]), urls[r["page_id"]]
    assert url_filter.judge(df.limit(0)).count() == 0


def test_shapes(spark):
    df = spark.createDataFrame([("/a/123/x.html",), ("/b/45.html",), ("/0123456789abcdef0123/",), ("",), ("/a/b/c/d/e/f",), ("/news-20240101",)], "path string")
    got = [tuple(r[0]) for r in df.select(url_filter.shape_of(df["path"])).collect()]
    assert got == [("a", "<number>", "x.html"), ("b", "<number>.html"), ("<hash>",), (), ("a", "b", "c", "d", "e", "f"), ("news-<number>",)]


def test_purity_and_merging(spark):
    rows = [(i, f"http://h.zz/spam/t{chr(97 + i % 5)}/{i}") for i in range(200)] + [(1000 + i, f"http://h.zz/good/{i}") for i in range(200)] + [(2000, "http://h.zz/spam/other/5"), (3000, "http://k.zz/spam/ta/9")]
    rules = (("block", "h.zz/spam/ta/"), ("block", "h.zz/spam/tb/"), ("block", "h.zz/spam/tc/"), ("allow", "h.zz/good/1"))
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()}
    assert got[3]["rule"] is None and got[3]["verdict"] == "block"  # /spam/td/: beside three branches that are blocked
    assert got[2000]["verdict"] == "block" and got[2000]["template"] == "/spam/*/<number>"
    assert got[1002]["rule"] is None and got[1002]["verdict"] == "allow"
    assert got[3000]["verdict"] == "allow"  # another host


def test_rare_children_become_a_wildcard(spark):
    rows = [(i, f"http://h.zz/u/name{chr(97 + i // 26)}{chr(97 + i % 26)}/page") for i in range(300)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert {r["template"] for r in got} == {"/u/*/page"}
