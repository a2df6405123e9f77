import math
import zlib
from collections import Counter

import numpy as np
from foliant.llm import langid


def test_forward_sums_all_segmentations():
    vocab = {p: i for i, p in enumerate([langid.START, "a", "b", "ab", "ba", langid.START + "a", "aba"])}
    rng = np.random.default_rng(0)
    p = rng.random((len(vocab) + 2, 2))
    p[-1] = 0

    def total(word, lang):
        if not word:
            return 1.0
        out = 0.0
        for i in range(1, len(word) + 1):
            k = vocab.get(word[:i], len(vocab) if i == 1 else len(vocab) + 1)
            out += p[k, lang] * total(word[i:], lang)
        return out

    for word in ["▁aba", "▁abab", "▁xbab", "▁a", "▁" + "abxba" * 3]:
        lattice = langid.Lattice([word], langid.Pieces(vocab))
        want = [total(word, 0), total(word, 1)]
        assert np.allclose(lattice.forward(p)[0, -1], want)
        assert np.allclose(lattice.logs(p)[0], np.log(want))


def test_words_of_any_length():
    """Against the plain recursion in whole numbers of logarithms, with the whole vocabulary."""
    vocab = langid.vocabulary()
    rng = np.random.default_rng(1)
    p = rng.random((len(vocab) + 2, 2)) * 1e-4
    p[-1] = 0
    model = langid.Model(["a", "b"], vocab, p)
    words = ["internationalization" * k for k in (1, 3, 40)] + ["żółć" * 30, "日本語" * 50, "x", "q" * 300]
    model.learn(words)
    for word in words:
        text = langid.START + word
        logs = np.full((len(text) + 1, 2), -np.inf)
        logs[0] = 0
        for i in range(1, len(text) + 1):
            for j in range(i):
                k = vocab.get(text[j:i], len(vocab) if i - j == 1 else None)
                if k is not None:
                    logs[i] = np.logaddexp(logs[i], logs[j] + np.log(p[k]))
        assert np.allclose(model.logs[model.at[word]], logs[-1]), word[:30]


def test_expected_counts_are_gradients():
    """The expected number of a piece is the derivative of the log likelihood by the logarithm of its probability."""
    vocab = {p: i for i, p in enumerate([langid.START, "a", "b", "ab", "ba", langid.START + "a", "aba"])}
    pieces, rng = langid.Pieces(vocab), np.random.default_rng(2)
    p = rng.random((len(vocab) + 2, 2)) * 0.1
    p[-1] = 0
    for word in ["▁ababa", "▁xab", "▁" + "abb" * 20]:
        lattice = langid.Lattice([word], pieces)
        got = lattice.expected(p, np.ones((1, 2)))
        assert np.allclose(got, lattice.expected_long(p, np.ones((1, 2))))
        for k in range(len(vocab) + 1):
            more = p.copy()
            more[k] *= 1 + 1e-6
            assert np.allclose(got[k], (lattice.logs(more)[0] - lattice.logs(p)[0]) / 1e-6, atol=1e-3)


def test_rounds_raise_the_likelihood():
    words = ["▁the", "▁then", "▁thing", "▁ion", "▁station"]
    counts = np.array([[5.0], [3], [2], [1], [4]])
    vocab = langid.vocabulary()

    def fit(rounds):
        model = langid.Model.fit(words, counts, ["en"], vocab, rounds)
        model.learn([w.removeprefix(langid.START) for w in words])
        return float((model.logs[:, 0] * counts[:, 0]).sum())

    assert fit(1) > fit(0) and fit(3) > fit(1)


def test_query_like_a_plain_version(spark):
    """The query on a small table: counts from every labelled row, the plain recursion for every word, the product per text."""
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text", "lang").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    learned = [(t, x) for i, t, x in rows if not held(i) and t is not None and x is not None]
    langs = sorted({x for _, x in learned})
    counts = Counter((w, x) for t, x in learned for w in langid.words_of(t))
    words = sorted({w for w, _ in counts})
    model = langid.Model.fit(words, np.array([[counts[w, x] for x in langs] for w in words], float), langs, langid.vocabulary())
    logs, none = np.log(model.p[:-1]), len(model.vocab)
    known = {}

    def log_of(word):
        if word not in known:
            a = np.full((len(word) + 1, len(langs)), -np.inf)
            a[0] = 0
            for i in range(1, len(word) + 1):
                for j in range(i):
                    k = model.vocab.get(word[j:i], none if i - j == 1 else None)
                    if k is not None:
                        a[i] = np.logaddexp(a[i], a[j] + logs[k])
            known[word] = a[-1]
        return known[word]

    got = {r["doc_id"]: r for r in langid.op5_language_id(spark, path).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        own = langid.words_of(text or "")
        total = sum(map(log_of, own), np.zeros(len(langs)))
        want = langs[int(total.argmax())] if own else "und"
        assert (got[i]["lang_pred"], got[i]["held_out"]) == (want, held(i))
        assert abs(got[i]["score"] - (1 / np.exp(total - total.max()).sum() if own else 0)) < 1e-6


def test_ties_go_to_the_first_language():
    model = langid.Model(["aa", "bb"], {"a": 0}, np.array([[0.5, 0.5], [0.5, 0.5], [0, 0]]))
    assert model.scores(["a a", "ax"]) == (["aa", "aa"], [0.5, 0.5])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in langid.op5_language_id(spark, "/root/testdata/sf0.01").collect()}
    rows = docs.select("doc_id", "lang", "text").collect()
    assert len(got) == len(rows)
    right = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows if got[r["doc_id"]]["held_out"]]
    assert len(right) > 100 and sum(right) / len(right) > 0.97
    for r in rows:
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= got[r["doc_id"]]["score"] <= 1


def test_odd_texts(spark):
    rows = [(1, "le chat que nous avons", "fr"), (3, "the cat that we have", "en"), (4, None, "en"), (5, "123 !!", "fr"), (None, "chat", None), (6, "x" * 5000 + " the cat", "en"), (1, "le chat que nous avons", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1.5 score")
    model = langid.fit(df)
    got = langid.predict(df, model)
    found = [(r["doc_id"], r["lang_pred"]) for r in got.collect()]
    assert (4, "und") in found and (5, "und") in found and (1, "fr") in found and (3, "en") in found
    assert all(not math.isnan(r["score"]) for r in got.collect())
    none = langid.predict(df, langid.fit(df.where("false")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0
