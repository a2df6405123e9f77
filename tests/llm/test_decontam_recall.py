import random

import pytest
from foliant.llm import decontam


def best(doc, item, known, k):
    """The largest share, by weight, of the item's shingles in a window of its length: all windows of two lists of words."""
    cut = lambda x: {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
    codes = {s: int(decontam.codes(decontam.np.array([known.vocab[w] for w in s], decontam.np.uint64), 5)[0]) for s in cut(item)}
    table, weights, _, _ = known.index[5]
    weight = dict(zip(table.tolist(), weights.tolist(), strict=True))
    total = sum(weight[c] for c in codes.values())
    return max(sum(weight[codes[s]] for s in cut(doc[at : at + len(item)]) if s in codes) for at in range(len(doc) - len(item) + 1)) / total


@pytest.mark.parametrize(("length", "changed"), [(15, 0), (29, 1), (30, 1), (34, 1), (54, 2), (60, 2), (90, 3)])
def test_recall_is_whole_from_the_threshold_on(length, changed):
    rng = random.Random(length)
    words = [f"w{i}" for i in range(20_000)]
    items = [rng.choices(words, k=length) for _ in range(200)]
    known = decontam.Items([(k, " ".join(x)) for k, x in enumerate(items)])
    reached = 0
    for _ in range(300):
        k = rng.randrange(200)
        passage = list(items[k])
        for at in rng.sample(range(length), changed):
            passage[at] = "changed"
        doc = rng.choices(words, k=20) + passage + rng.choices(words, k=20)
        similarity = best(doc, items[k], known, k)
        got = {i: s for i, s, _, _ in known.links(" ".join(doc))}
        assert (k in got) == (similarity >= 0.8 - 1e-9), similarity
        assert k not in got or abs(got[k] - similarity) < 1e-9
        reached += k in got
    assert reached > 100
