"""Benchmark decontamination: item-sized windows of the documents, found by shared shingles, verified exactly.

Texts are lower-cased runs of letters and digits. An item of L words is held against document windows of L
words (the whole document where it is shorter). An index leads from each five-word shingle to the items that have
it. An item whose shingles in the whole document weigh too little for the threshold has no window that reaches it;
for any other, all windows are verified at once: the weight of the item's shingles that the window has, over the
weight of all the item's shingles, must be 0.8 or more. A shingle counts where it is the window's first of its
kind, so each occurrence adds its weight to one run of windows, and a running sum over the runs' ends gives every
window's weight in time linear in the text. A shingle's weight is its rarity among all items, counted over all of them before
any is sent, so that items sent in several parts have the same weights. Items of fewer than five words have their whole sequence as one shingle.

No fingerprint stands before the exact test: windows at a similarity of 0.8 have 64-bit fingerprints about 13 bits
apart, some more than 24, and blocks that guarantee such a radius let most unrelated pairs by (figures in the README).

Null texts, and texts or items without words, match nothing. Repeated items count each; repeated rows of documents
give repeated links. Of equally good windows the first is given. A null id stays null; ids may be of any type.
Only id and text columns are read. An empty table gives no links.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import Sent, checkpoint, held, map_arrow, table

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
#: Characters of items that are broadcast at once; more items are sent in parts, with the same results.
ITEM_CHARS = 16_000_000
WORDS = re.compile(r"[^\W_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def scrambled(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each 64-bit number."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), SEED) | 1  # never 0


def codes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit code of each run of ``size`` words, the same for all tables."""
    n = len(hashes) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = scrambled(out * MIX + hashes[k : k + n]) if n > 0 else out
    return out


def item_codes(words: list[str]) -> np.ndarray:
    """The item's shingles, each once, sorted."""
    return np.unique(codes(np.array([word_hash(w) for w in words], np.uint64), min(SHINGLE, len(words))))


class Items:
    """The items' shingles and their weights, and the items that have each shingle.

    ``total`` and ``counts`` are the number of items with words and of those with each shingle; by default, of ``rows``.
    """

    def __init__(self, rows: list[tuple], similarity: float = SIMILARITY, total: int | None = None, counts: dict[int, int] | None = None):
        self.similarity = similarity
        texts = [(i, w) for i, t in rows if (w := words_of(t))]
        self.vocab = {w: word_hash(w) for _, own in texts for w in own}
        self.ids = [i for i, _ in texts]
        self.lengths = [len(w) for _, w in texts]
        self.sizes = np.array([min(SHINGLE, n) for n in self.lengths], np.int64)
        sets = [item_codes(w) for _, w in texts]
        if counts is None:
            total, counts = len(texts), Counter(c for s in sets for c in s.tolist())
        #: By the shingles' size: the shingles, sorted; their weights; and the items of each, from starts[i] to starts[i + 1].
        self.index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.own: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        self.whole = np.zeros(len(texts))
        for size in np.unique(self.sizes).tolist():
            mine = np.nonzero(self.sizes == size)[0].tolist()
            known = np.unique(np.concatenate([sets[k] for k in mine]))
            weight = np.array([1.0 + math.log((1 + total) / (1 + counts[c])) for c in known.tolist()])
            for k in mine:
                self.own[k] = np.searchsorted(known, sets[k])
                self.whole[k] = weight[self.own[k]].sum()
            at, item = np.concatenate([self.own[k] for k in mine]), np.repeat(mine, [len(sets[k]) for k in mine])
            order = np.argsort(at, kind="stable")
            self.index[size] = known, weight, np.searchsorted(at[order], np.arange(len(known) + 1)), item[order]

    def best(self, k: int, place: np.ndarray, shingle: np.ndarray, weight: np.ndarray, shingles: int) -> tuple[float, int]:
        """The highest similarity of item ``k`` in a window, and the first such window, from the places of its shingles (sorted by shingle, then place)."""
        window = min(self.lengths[k] - int(self.sizes[k]) + 1, shingles)
        before = np.where(np.diff(shingle, prepend=-1) == 0, np.roll(place, 1), -1)
        first = np.maximum(np.maximum(before, place - window) + 1, 0)  # the windows from first to place count this one
        last = shingles - window
        here = first <= last
        ends = np.minimum(place[here], last) + 1
        gain = np.bincount(first[here], weight[shingle[here]], last + 2) - np.bincount(ends, weight[shingle[here]], last + 2)
        sums = np.cumsum(gain)[: last + 1]
        start = int(np.argmax(sums >= sums.max() - 1e-9))
        inside = np.unique(shingle[(place >= start) & (place < start + window)])
        return float(weight[inside].sum() / self.whole[k]), start

    def links(self, text: str | None) -> list[tuple]:
        """(item's number, similarity, first word, words) of each item that the text has, with its best window."""
        words = words_of(text)
        if not words or not self.ids:
            return []
        get = self.vocab.get
        ids = np.array([get(w, 0) for w in words], np.uint64)
        runs = np.diff(np.concatenate([[-1], np.nonzero(ids == 0)[0], [len(ids)]])) - 1
        if runs.max() < min(int(self.sizes.min()), len(words)):
            return []
        out = []
        for size, (known, weight, starts, items) in self.index.items():
            if len(ids) < size:
                continue
            s = codes(ids, size)
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            clean = np.convolve(ids == 0, np.ones(size, bool), "valid") == 0
            place = np.nonzero((known[at] == s) & clean)[0]
            if not len(place):
                continue
            order = np.lexsort((place, at[place]))
            place, shingle = place[order], at[place][order]
            got = np.unique(shingle)
            holders = items[_ranges(starts[got], starts[got + 1] - starts[got])]
            shared = np.bincount(holders, np.repeat(weight[got], starts[got + 1] - starts[got]), len(self.ids))
            for k in np.nonzero((shared >= self.similarity * self.whole - 1e-6) & (self.sizes == size))[0].tolist():
                mine = np.zeros(len(known), bool)
                mine[self.own[k]] = True
                mine = mine[shingle]
                similarity, first = self.best(k, place[mine], shingle[mine], weight, len(s))
                if similarity >= self.similarity - 1e-9:
                    out.append((k, min(1.0, similarity), first, min(self.lengths[k], len(ids))))
        return sorted(out)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], ..., first[0] + size[0] - 1, first[1], ..."""
    ends = np.cumsum(size)
    return np.arange(ends[-1]) + np.repeat(first - (ends - size), size)


def _received(sent: Sent) -> Items:
    """The items of a broadcast, kept by the worker."""
    return held(sent.key, lambda: Items(*sent.value))


def _parts(items: DataFrame, id_col: str, text_col: str, most: int):
    """The items in parts of bounded size, each a broadcast with the counts of its shingles among all items; one part while they fit."""
    spark = items.sparkSession
    rows = checkpoint(items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null"))

    def shingles(df: DataFrame) -> DataFrame:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = [item_codes(w) if (w := words_of(t)) else np.zeros(0, np.uint64) for t in batch.column(0).to_pylist()]
            # a row with words has a null shingle too, which counts it
            flat = [c for x in own if len(x) for c in (None, *x.view(np.int64).tolist())]
            return pa.RecordBatch.from_arrays([pa.array(flat, pa.int64())], ["code"])

        return map_arrow(df.select("text"), each, "code long")

    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = math.ceil(chars / most)
    counts = checkpoint(shingles(rows).groupBy("code").agg(F.count(F.lit(1)).alias("n"))) if n else None
    total = counts.where("code is null").first() if n else None
    if total is None:
        return
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("text", "id"), F.lit(n)) == k) if n > 1 else rows
        own = counts.where("code is not null")
        own = own.join(shingles(part).distinct(), "code", "left_semi") if n > 1 else own
        found = own.toArrow()
        known = dict(zip(found.column("code").to_numpy().view(np.uint64).tolist(), found.column("n").to_pylist(), strict=True))
        yield Sent(spark, ([tuple(r) for r in part.collect()], SIMILARITY, total["n"], known))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", item_chars: int = ITEM_CHARS) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): a row for each document and item that it contains."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).cast("string").alias("text"))
    key = rows.schema[0].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {key[0]}, item_id {key[1]}, similarity double, first_word long, n_words long"
    out = rows.sparkSession.createDataFrame([], schema)
    items_type = items.select(item_id).limit(0).toArrow().schema.types[0]
    for k, sent in enumerate(_parts(items, item_id, item_text, item_chars)):

        def each(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch | None:
            known, ids, found = _received(sent), [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                got = known.links(text)
                found += got
                ids += [at] * len(got)
            if not found:
                return None
            columns = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array([known.ids[i] for i in columns[0]], type=items_type), *(pa.array(c) for c in columns[1:])], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        part = map_arrow(rows, each, schema)
        out = part if k == 0 else out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", item_chars: int = ITEM_CHARS) -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns kept."""
    at = docs.columns.index(doc_text)
    for sent in _parts(items, item_id, item_text, item_chars):

        def each(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            known = _received(sent)
            return batch.filter(pa.array([not known.links(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = map_arrow(docs, each, docs.schema)
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
