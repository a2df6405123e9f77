import random

import numpy as np
import pytest
import xxhash
from foliant.llm import simhash


def plain(text):
    """The fingerprint by the contract's words."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, fps, radius=3):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    lowest = {}
    for i, d in enumerate(ids):
        if d is not None:
            lowest[root(i)] = min(d, lowest.get(root(i), d))
    return [lowest.get(root(i)) for i in range(len(ids))]


TEXTS = ["", None, "One", "one TWO", "a b c d e", "É a\x0bb É", "a b c", "x " * 500, "A B C D E"]


def test_fingerprint():
    for t in TEXTS:
        assert simhash.fingerprint_of(t) == plain(t), t


def test_linked_is_exact():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (400, 2), dtype=np.uint64)).astype(np.uint64)
    fps = np.unique(np.concatenate([base, base[rng.integers(0, 40, 400)] ^ flips[:, 0] ^ flips[:, 1]]))
    want = classes(list(range(len(fps))), fps.tolist())
    for cut in (None, 100):
        found = simhash.linked(fps, None, 3) if cut is None else simhash.linked(fps[:cut], None, 3) + simhash.linked(fps[cut:], None, 3) + simhash.linked(fps[:cut], fps[cut:], 3)
        parent = {f: f for f in fps.tolist()}

        def root(f, parent=parent):
            while parent[f] != f:
                f = parent[f]
            return f

        for u, v in found:
            parent[max(root(u), root(v))] = min(root(u), root(v))
        at = {f: i for i, f in enumerate(fps.tolist())}
        assert [at[root(f)] for f in fps.tolist()] == want
        assert len(found) <= 3 * len(fps)


@pytest.mark.parametrize(("parts", "tile"), [(1, 8192), (2, 7), (4, 3)])
def test_components_like_brute_force(spark, parts, tile, monkeypatch):
    monkeypatch.setattr(simhash, "parts_for", lambda n: parts)
    monkeypatch.setattr(simhash.links, "__defaults__", (3, None, tile))
    rng = random.Random(parts)
    fps = [rng.getrandbits(64) for _ in range(25)]
    fps += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in rng.choices(fps, k=60)] + [0, 0, 1, 7, 15, 255]
    chain = rng.getrandbits(64)
    fps += [chain := chain ^ (7 << rng.randrange(60)) for _ in range(12)]
    ids = list(range(100, 100 + len(fps)))
    rng.shuffle(ids)
    rows = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in zip(ids, fps, strict=True)], "id long, fp long")
    found = simhash.components(rows)
    got = {r["id"]: r["component_id"] for r in rows.join(found, "fp").collect()}
    assert got == dict(zip(ids, classes(ids, fps), strict=True))


def test_query_like_brute_force(spark):
    path = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    ids, fps = [r[0] for r in rows], [plain(r[1]) for r in rows]
    want = sorted((i, f"{f:016x}", c) for i, f, c in zip(ids, fps, classes(ids, fps), strict=True))
    assert sorted(map(tuple, simhash.op8_simhash(spark, path).collect())) == want


def test_odd_rows(spark):
    rows = [(3, "a b c d e f", 1.0), (1, "A b c d e f", 2.0), (None, None, 3.0), (7, "", 4.0), (7, "", 4.0), (9, "other words are here now", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint double")
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)
    assert [(r[0], r[2]) for r in got] == [(1, 1), (3, 1), (7, 7), (7, 7), (9, 9), (None, 7)]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 7, 9]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 == simhash.keep_one(df.limit(0)).count()
    nulls = spark.createDataFrame([(None, "x y z w"), (None, "x y z w")], "doc_id long, text string")
    assert simhash.keep_one(nulls).count() == 1
