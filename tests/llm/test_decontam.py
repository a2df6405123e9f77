import math
import random
import time

from foliant.llm import decontam


def plain(doc, item, similarity=decontam.SIMILARITY, weight=lambda s: 1.0):
    """The best share of the item's shingles in a window of its length, over all windows."""
    d, w = decontam.words_of(doc), decontam.words_of(item)
    if not d or not w:
        return 0.0
    size = min(5, len(w))
    cut = lambda x: {tuple(x[i : i + size]) for i in range(len(x) - size + 1)}
    want = cut(w)
    return max(len(want & cut(d[at : at + len(w)])) / len(want) for at in range(max(1, len(d) - len(w) + 1)))


def test_like_all_windows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, text(rng.randint(6, 50))) for i in range(60)]
    known = decontam.Items(items)
    hits = 0
    for _ in range(400):
        doc = text(rng.randint(0, 80)).split()
        i, passage = rng.choice(items)
        passage = passage.split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            passage[rng.randrange(len(passage))] = rng.choice(words)
        doc[len(doc) // 2 : len(doc) // 2] = passage
        doc = ", ".join(doc).upper()
        got = {known.ids[k]: s for k, s, _, _ in known.links(doc)}
        for k, t in items:
            best = plain(doc, t)
            if best >= 0.85:
                assert k in got, (best, t)
                hits += 1
            elif best < 0.72:
                assert k not in got
    assert hits > 150


def test_short_items_and_odd_texts():
    known = decontam.Items([(1, "only three words"), (2, ""), (3, None), (4, "the very same item here once"), (4, "the very same item here once")])
    assert known.links(None) == [] == known.links("!!") == known.links("nothing of it")
    assert [known.ids[x[0]] for x in known.links("Only THREE words")] == [1]
    assert [known.ids[x[0]] for x in known.links("so only three, words")] == [1]
    assert [known.ids[x[0]] for x in known.links("x the very same item here once y " * 2000)] == [4, 4]
    assert decontam.Items([]).links("a b c") == []


def test_query_finds_all_passages(spark):
    path = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()}
    found = {(r["doc_id"], r["item_id"]) for r in decontam.op10_decontamination(spark, path).collect()}
    whole = {(d, i) for d, t in docs.items() for i, p in items.items() if p in (t or "")}
    assert whole and whole <= found
    for d, i in found:
        assert plain(docs[d], items[i]) > 0.7
    clean = decontam.clean(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet"))
    assert {r["doc_id"] for r in clean.collect()} == set(docs) - {d for d, _ in found}


def alike_items():
    """Items with a beginning in common, and texts with one word of the rest changed: near the threshold, weights decide."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    items, texts = [], []
    for k in range(60):
        own = [*(f"same{k % 3}x{j}" for j in range(10)), *rng.choices(words, k=20)]
        items.append((f"item {k}", " ".join(own)))
        for _ in range(5):
            own = list(own)
            own[rng.randrange(10, 30)] = "changed"
            texts.append(" ".join([*rng.choices(words, k=5), *own, *rng.choices(words, k=5)]))
    return items, texts


def test_parts_change_nothing(spark):
    items, texts = alike_items()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id string, text string, doc_id int")
    rows = lambda chars: sorted(map(tuple, decontam.contaminated(docs, table, item_chars=chars).collect()))
    whole = rows(1_000_000)
    known = decontam.Items(items)
    assert [(d, known.ids[k], s, a, n) for d, t in enumerate(texts) for k, s, a, n in known.links(t)] and 0 < len({r[0] for r in whole}) < len(texts)
    assert whole == sorted((d, known.ids[k], s, a, n) for d, t in enumerate(texts) for k, s, a, n in known.links(t))
    assert rows(4000) == whole


def test_weighted_like_all_windows():
    items, texts = alike_items()
    known = decontam.Items(items)
    cut = lambda x: {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
    sets = [cut(t.split()) for _, t in items]
    rarity = {s: 1 + math.log(61 / (1 + sum(s in x for x in sets))) for s in set().union(*sets)}
    for text in texts[::3]:
        got = {k: s for k, s, _, _ in known.links(text)}
        doc = text.split()
        for k, own in enumerate(sets):
            n = len(items[k][1].split())
            best = max(sum(rarity[s] for s in own & cut(doc[at : at + n])) for at in range(len(doc) - n + 1)) / sum(rarity[s] for s in own)
            assert (k in got) == (best >= 0.8 - 1e-9)
            assert k not in got or abs(got[k] - best) < 1e-9


def test_long_repetitive_text_takes_linear_time():
    rng = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(base[k : k + 200])) for k in range(200)]
    known = decontam.Items(items)
    at = time.process_time()
    assert len(known.links(" ".join(base[100:300] * 50))) > 50
    assert time.process_time() - at < 2
    assert not known.links(" ".join(rng.choices(base, k=20_000)))


def test_items_in_turns_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (None, "h i j k l m"), (1, "a b c d e f g"), (2, None), (3, "")], "doc_id long, text string").selectExpr("*", "1 item_id")
    items = spark.createDataFrame([(7, "a b c d e f g"), (8, "h i j k l m"), (9, None)], "item_id long, text string")
    for chars in (10, 1000):
        got = sorted(((r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items, item_chars=chars).collect()), key=str)
        assert got == [(1, 7), (1, 7), (None, 8)]
        assert sorted(r["doc_id"] for r in decontam.clean(docs, items, item_chars=chars).collect()) == [2, 3]
    assert decontam.contaminated(docs, items.limit(0)).count() == 0 == decontam.contaminated(docs.limit(0), items).count()
    assert decontam.clean(docs, items.limit(0)).count() == 5
