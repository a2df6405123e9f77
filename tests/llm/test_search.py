import math
from collections import Counter

import numpy as np
from foliant.llm import search


def plain(rows, queries, top=10):
    """BM25 over all documents, without an index."""
    docs = [(i, Counter(search.words_of(t))) for i, t in rows]
    n, mean = len(docs), sum(c.total() for _, c in docs) / len(docs)
    df = Counter(w for _, c in docs for w in c)
    out = {}
    for q, text in queries:
        asked = Counter(search.words_of(text))
        scored = []
        for i, c in docs:
            s = sum(m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for w, m in sorted(asked.items()) if c[w])
            if s > 0:
                scored.append((-round(s, 9), i is None, i or 0))
        out[q] = [(None if x[1] else x[2], -x[0]) for x in sorted(scored)[:top]]
    return out


def same(got, want):
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    assert set(found) == {q for q, x in want.items() if x}
    for q, rows in found.items():
        assert np.allclose([s for _, s in rows], [s for _, s in want[q]])
        assert [d for d, _ in rows] == [d for d, _ in want[q]] or sorted(round(s, 6) for _, s in rows) == sorted(round(s, 6) for _, s in want[q])


def test_query_like_all_pairs(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    same(search.op7_search(spark, path).collect(), plain(rows, [r for r in rows if r[0] % 100 == 0]))


def test_shards_blocks_and_pruning(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_DOCS", 90)
    monkeypatch.setattr(search, "BLOCK", 4)
    monkeypatch.setattr(search, "PAIRS", 900)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400").repartition(3)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    same(search.search(docs, docs.where("doc_id % 20 = 0"), top=5).collect(), plain(rows, [r for r in rows if r[0] % 20 == 0], 5))


def test_pruning_skips_blocks_and_is_exact():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    p = 1 / np.arange(1, 401)
    builder = search.Builder(None)
    texts = [" ".join(rng.choice(words, rng.integers(5, 60), p=p / p.sum())) for _ in range(3000)]
    for i, t in enumerate(texts):
        builder.add(i, t)
    shard = builder.shard()
    back = search.Shard.unpacked(shard.ids, shard.terms, shard.packed())
    assert (back.docs == shard.docs).all() and (back.counts == shard.counts).all() and (back.starts == shard.starts).all()
    scorer = search.Scorer(back, shard.terms, 30.0)
    queries = [np.unique(rng.integers(0, len(shard.terms), rng.integers(1, 6))) for _ in range(200)]
    starts, term_of = np.cumsum([0, *map(len, queries)]), np.concatenate(queries)
    weights, best = rng.random(len(term_of)) + 0.1, np.zeros((200, 10))
    q, d, scores = scorer.best(starts, term_of, weights, best)
    for i, terms in enumerate(queries):
        total = np.zeros(3000)
        for t, w in zip(terms, weights[starts[i] : starts[i + 1]], strict=True):
            cut = slice(scorer.starts[t], scorer.starts[t + 1])
            total[scorer.docs[cut]] += w * scorer.weight[cut]
        total = np.round(total, 9)
        least = np.sort(total)[-10]
        assert set(d[q == i].tolist()) == set(np.nonzero((total >= least) & (total > 0))[0].tolist())
        assert np.allclose(scores[q == i], total[d[q == i]])
        assert np.isclose(best[i, -1], least)
    assert scorer.met < 0.8 * 200 * 3000


def test_odd_rows(spark):
    df = spark.createDataFrame([(0, "a b"), (None, "a b"), (0, "a b"), (100, None), (200, ""), (3, "c"), (300, "zz b"), (300, "c")], "doc_id long, text string").selectExpr("*", "1 score")
    got = search.search(df, df.where("doc_id % 100 = 0")).collect()
    assert sorted(str(r["doc_id"]) for r in got if r["query_id"] == 0) == ["0", "0", "300", "None"]
    assert sorted((r["rank"], r["doc_id"]) for r in got if r["query_id"] == 300 and r["rank"] == 1) == [(1, 3), (1, 300)]
    assert search.search(df.limit(0), df.limit(0)).count() == 0 == search.search(df, df.limit(0)).count()


def test_few_pairs_are_scored():
    """On the documents of sf0.1, a hundredth of them as queries: block bounds and rare postings leave a fifth of all pairs at most."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"])
    ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
    asked = [c for i, t in zip(ids, texts, strict=True) if i % 100 == 0 and (c := Counter(search.words_of(t)))]
    terms = sorted({w for c in asked for w in c})
    shards, df, length = [], Counter(), 0
    for at in range(0, len(ids), search.SHARD_DOCS):
        builder = search.Builder(None)
        for i, t in zip(ids[at : at + search.SHARD_DOCS], texts[at : at + search.SHARD_DOCS], strict=True):
            builder.add(i, t)
        shards.append(builder.shard())
        df.update(dict(zip(shards[-1].terms, np.diff(shards[-1].starts).tolist(), strict=True)))
        length += int(shards[-1].lengths.sum())
    n, place = len(ids), {w: k for k, w in enumerate(terms)}
    starts, term_of = np.cumsum([0, *map(len, asked)]), np.array([place[w] for c in asked for w in sorted(c)])
    weights = np.array([c[w] * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for c in asked for w in sorted(c)])
    best, met = np.zeros((len(asked), 10)), 0
    for shard in shards:
        scorer = search.Scorer(shard, terms, length / n)
        for at in range(0, len(asked), search.QUERIES):
            own = starts[at : at + search.QUERIES + 1]
            scorer.best(own - own[0], term_of[own[0] : own[-1]], weights[own[0] : own[-1]], best[at : at + search.QUERIES])
        met += scorer.met
    assert met < 0.2 * len(asked) * n


def test_alike_queries_make_columns():
    """Queries dealt out one language after another come to stand together, so fewer terms of a batch are left to postings."""
    rng = np.random.default_rng(2)
    words = [[f"{kind}{i}" for i in range(300)] for kind in "abcd"]
    p = 1 / np.arange(1, 301)
    texts = [" ".join(rng.choice(words[i % 4], rng.integers(20, 80), p=p / p.sum())) for i in range(400)]
    asked = [Counter(search.words_of(t)) for t in texts]
    terms = sorted({w for c in asked for w in c})
    place = {w: i for i, w in enumerate(terms)}
    owner = np.repeat(np.arange(400), list(map(len, asked)))
    term = np.array([place[w] for c in asked for w in sorted(c)])
    weights = np.array([float(c[w]) for c in asked for w in sorted(c)])
    order = search.alike(owner, term, weights, np.array(list(map(len, asked))))
    assert sorted(order.tolist()) == list(range(400))
    kinds = [texts[i][0] for i in order]
    assert sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) == 3
    assert search.alike(owner[:0], term[:0], weights[:0], np.zeros(0, np.int64)).tolist() == []


def test_words_are_runs_of_letters_and_digits():
    for c in range(0x110000):
        t = f"A{chr(c)}b {chr(c)}Z_"
        assert search.words_of(t) == search.WORDS.findall(t.lower())
    assert search.words_of(None) == search.words_of("") == search.words_of(" _,") == []


def test_few_postings_are_read():
    """Of shards of sf0.1, postings are read for few pairs of queries and documents, and few are scored in full."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"])
    rows = list(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True))
    asked = [c for i, t in rows if i % 100 == 0 and (c := Counter(search.words_of(t)))]
    builder = search.Builder(None)
    for i, t in rows[: search.SHARD_DOCS]:
        builder.add(i, t)
    shard = builder.shard()
    df, n = dict(zip(shard.terms, np.diff(shard.starts).tolist(), strict=True)), len(shard.ids)
    place = {w: k for k, w in enumerate(shard.terms)}
    asked = [{w: m for w, m in sorted(c.items()) if w in place} for c in asked]
    starts, term_of = np.cumsum([0, *map(len, asked)]), np.array([place[w] for c in asked for w in c])
    weights = np.array([m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for c in asked for w, m in c.items()])
    scorer, best = search.Scorer(shard, shard.terms, shard.lengths.mean()), np.zeros((len(asked), 10))
    for _ in range(2):  # the second time with the thresholds of the first
        scorer.tested = scorer.met = 0
        for at in range(0, len(asked), search.QUERIES):
            own = starts[at : at + search.QUERIES + 1]
            scorer.best(own - own[0], term_of[own[0] : own[-1]], weights[own[0] : own[-1]], best[at : at + search.QUERIES])
        assert scorer.tested < 0.1 * len(asked) * n
        assert scorer.met < 0.01 * len(asked) * n
