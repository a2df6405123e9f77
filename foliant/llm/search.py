"""Exact top-k search with BM25 over an inverted index in shards, by block-max WAND.

A shard holds up to SHARD_DOCS documents: their postings, lengths and ids, one row of a table in the shared folder. Its documents are
ordered by the common term that they have most of, then by length, and cut into blocks; each term's postings are cut at the same
blocks, and each such cut has the term's largest weight there. For a query, the largest weights of its terms, rare ones and
common ones, bound every document of a block: a block whose bound can't reach the k-th best score so far is passed over before any of its
postings is looked at. In the blocks that are left, the postings of rare terms are added up, common terms by a float32 product with a bound for its
error, and a document that can't reach it either is left there; the others are scored in full. This pivot test is
taken for all blocks and many queries at once, alike queries side by side, so that few terms are rare among them and few blocks are left;
in a task's first shard the blocks with the largest bounds come first, and thresholds go on from shard to shard. Document counts, the number of documents and their mean length are taken over the whole corpus, so
scores are the same in any shard, and merging the tasks' best k is exact. Scores are rounded to nine digits before they are compared.

Queries are taken in blocks of bounded size, one after the other: each is sent, held against all shards and its results are written
before the next, so neither the driver nor a worker ever holds more than one. A task takes a bounded number of shards. Only documents that share a term with a query are
results; the query's own document is one. Equal scores go by the smaller id (null ids last). Null texts and texts without words
find nothing and are never found. Repeated query rows are one query; repeated documents are found each. Ids may be of any type
that can be ordered. An empty table finds nothing; texts of any length are taken whole. Only id and text columns are read.
"""

from __future__ import annotations

import math
import re
import struct
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import checkpoint, filter_bits, map_arrow, maybe_in, shared_dir, table, written

WORDS = re.compile(r"[^\W_]+")
#: ASCII bytes that are no letters and no digits become spaces; others stay.
SPACES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
K1, B = 1.2, 0.75
TOP = 10
SHARD_DOCS = 8192
SHARD_POSTINGS = 3_000_000
#: Words that are counted together, where a text hasn't more.
WORDS_AT_ONCE = 1 << 16
#: Documents in a block.
BLOCK = 2
#: Blocks of a query that are scored first, to raise its threshold.
FIRST = 32
#: Shards that a task goes through at least, where there are enough for all cores.
TOGETHER = 16
#: Terms by which a shard's documents are ordered.
LEADING = 64
#: A term is common if queries that have it times documents that have it reach this part of all pairs.
COMMON = 800
#: Terms whose counts a task adds up at once.
COUNTED = 500_000
#: Queries that are scored together at most, their (query, term) pairs (of several queries), queries whose rare terms are taken together,
#: and pairs of queries and documents scored at once.
QUERIES = 512
ASKED = 120_000
AT_ONCE = 16
SCORED = 1 << 13
#: (query, term) pairs that are broadcast at once.
PAIRS = 1_200_000


def words_of(text: str | None) -> list[str]:
    """The runs of letters and digits (WORDS) of the lower-cased text."""
    if not text:
        return []
    text = text.lower().encode("utf-8", "surrogatepass").translate(SPACES).decode("utf-8", "surrogatepass")
    found = text.split()
    if text.isascii() or all(map(str.isalnum, found)):
        return found
    return [w for t in found for w in ((t,) if t.isalnum() else WORDS.findall(t))]


class Shard:
    """Postings of some documents: sorted terms, and for each its documents (numbers in the shard) and counts."""

    def __init__(self, ids: list, lengths: np.ndarray, terms: list[str] | pa.Array, starts: np.ndarray, docs: np.ndarray, counts: np.ndarray):
        self.ids, self.lengths, self.terms, self.starts, self.docs, self.counts = ids, lengths, terms, starts, docs, counts

    def packed(self) -> bytes:
        parts = [self.lengths.astype("<u4"), self.starts.astype("<u4"), self.docs.astype("<u2"), self.counts.astype("<u4")]
        raw = b"".join(struct.pack("<Q", p.nbytes) + p.tobytes() for p in parts)
        return zstandard.ZstdCompressor(level=1).compress(raw)

    @classmethod
    def unpacked(cls, ids: list, terms: list[str] | pa.Array, data: bytes) -> Shard:
        raw, at, parts = zstandard.ZstdDecompressor().decompress(data), 0, []
        for kind in ("<u4", "<u4", "<u2", "<u4"):
            (size,) = struct.unpack_from("<Q", raw, at)
            parts.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at + 8).astype(np.int64))
            at += 8 + size
        return cls(ids, parts[0], terms, parts[1], parts[2], parts[3])


class Numbers(dict):
    """Words to their numbers in a shard, given as they are met; -1 for words that the filter doesn't let by."""

    def __init__(self, bits: bytes | None):
        self.bits, self.own = bits, []

    def __missing__(self, word: str) -> int:
        i = -1
        if self.bits is None or maybe_in(self.bits, word):
            i = len(self.own)
            self.own.append(word)
        self[word] = i
        return i


class Builder:
    """Takes documents; gives a shard when it is full."""

    def __init__(self, bits: bytes | None):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.ids, self.lengths, self.term_at, self.postings = [], [], Numbers(self.bits), 0
        #: Words whose documents, from the ``counted``-th on, aren't counted yet.
        self.words, self.counted = [], 0
        #: (document << 32 | term) in order, and the counts.
        self.keys, self.counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(self, doc_id, text: str | None) -> None:
        words = words_of(text)
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.words += words
        if len(self.words) >= WORDS_AT_ONCE:
            self.count()

    def count(self) -> None:
        terms = np.fromiter(map(self.term_at.__getitem__, self.words), np.int64, len(self.words))
        docs = np.repeat(np.arange(self.counted, len(self.ids)), self.lengths[self.counted :])
        keys = np.sort((docs << 32 | terms)[terms >= 0])
        first = np.nonzero(np.diff(keys, prepend=-1))[0]
        self.keys.append(keys[first])
        self.counts.append(np.diff(first, append=len(keys)))
        self.postings += len(first)
        self.words, self.counted = [], len(self.ids)

    def full(self) -> bool:
        if self.postings + len(self.words) >= SHARD_POSTINGS:
            self.count()
        return len(self.ids) >= SHARD_DOCS or self.postings >= SHARD_POSTINGS

    def shard(self) -> Shard:
        self.count()
        met, keys, counts = self.term_at.own, np.concatenate(self.keys), np.concatenate(self.counts)
        sorted_as = sorted(range(len(met)), key=met.__getitem__)
        own = [met[i] for i in sorted_as]
        place = np.zeros(len(met), np.int64)
        place[sorted_as] = np.arange(len(own))
        docs, terms = keys >> 32, place[keys & 0xFFFFFFFF]
        lengths, df = np.array(self.lengths, np.int64), np.bincount(terms, minlength=len(own))
        # documents that lead with the same common term, and are about as long, stand together: their largest weights say most
        leading = np.full(len(own) + 1, LEADING)
        leading[np.argsort(-df, kind="stable")[:LEADING]] = np.arange(min(LEADING, len(own)))
        some = np.nonzero(leading[terms] < LEADING)[0]
        first = np.nonzero(np.diff(docs[some], prepend=-1))[0]
        lead = np.full(len(self.ids), LEADING)
        if len(some):
            lead[docs[some[first]]] = LEADING - 1 - np.maximum.reduceat(counts[some] * LEADING + LEADING - 1 - leading[terms[some]], first) % LEADING
        order = np.lexsort((lengths, lead))
        docs = np.argsort(order)[docs]
        ids = [self.ids[k] for k in order.tolist()]
        at = np.argsort(terms * len(ids) + docs)
        made = Shard(ids, lengths[order], own, np.concatenate([[0], np.cumsum(df)]), docs[at], counts[at])
        self.clear()
        return made


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: np.ndarray | None = None) -> DataFrame:
    """The index of all rows of ``docs``: a row per shard, in the shared folder. With ``bits``, only of terms that the filter lets by."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast(None if bits is None else bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder, made, part = Builder(sent.value), 0, TaskContext.get().partitionId()
        id_type = None

        def row() -> pa.RecordBatch:
            s = builder.shard()
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{made:06d}"]), pa.array([len(s.ids)], pa.int64()), pa.array([int(s.lengths.sum())], pa.int64()), pa.array([s.ids], pa.list_(id_type)), pa.array([s.terms], pa.list_(pa.string())), pa.array([np.diff(s.starts)], pa.list_(pa.int64())), pa.array([s.packed()], pa.binary())], ["shard", "n_docs", "length", "ids", "terms", "dfs", "data"])

        for batch in batches:
            id_type = batch.schema.field("id").type
            for at in range(0, batch.num_rows, 512):
                cut = batch.slice(at, 512)
                for doc_id, text in zip(cut.column("id").to_pylist(), cut.column("text").to_pylist(), strict=True):
                    builder.add(doc_id, text)
                    if builder.full():
                        yield row()
                        made += 1
        if builder.ids:
            yield row()

    return written(rows.mapInArrow(run, f"shard string, n_docs long, length long, ids array<{kind}>, terms array<string>, dfs array<long>, data binary"), "index")


def document_counts(shards: DataFrame) -> DataFrame:
    """(term, df) over all shards (terms, dfs); a task adds up its shards' counts before any row is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "df"])
            counts.clear()
            return out

        for batch in batches:
            for r in range(batch.num_rows):
                for w, n in zip(batch.column("terms")[r].as_py(), batch.column("dfs")[r].as_py(), strict=True):
                    counts[w] = counts.get(w, 0) + n
                if len(counts) > COUNTED:
                    yield rows()
        yield rows()

    return shards.mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Scorer:
    """A shard made ready for some queries' terms under the corpus's statistics."""

    def __init__(self, shard: Shard, terms: list[str] | pa.Array, mean: float):
        own = pc.index_in(*(x if isinstance(x, pa.Array) else pa.array(x, pa.string()) for x in (terms, shard.terms))).to_numpy(zero_copy_only=False)
        kept = np.nonzero(own >= 0)[0]
        self.place = np.full(len(terms), -1, np.int64)
        self.place[kept] = np.arange(len(kept))
        own = own[kept].astype(np.int64)
        first, sizes = shard.starts[own], shard.starts[own + 1] - shard.starts[own]
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        take = ranges(first, sizes)
        self.docs = shard.docs[take]
        tf = shard.counts[take].astype(float)
        self.weight = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * shard.lengths / mean))[self.docs])
        self.n = len(shard.ids)
        self.blocks = -(-self.n // BLOCK)
        # a cut is a term's postings in a block: their weights by place in the block, and the largest
        block = self.docs // BLOCK
        begins = np.ones(len(block), bool)
        np.not_equal(block[1:], block[:-1], out=begins[1:])
        begins[self.starts[:-1]] = True
        self.cut_block = block[begins]
        cut_of = np.cumsum(begins) - 1
        self.cut_weights = np.zeros((BLOCK, len(self.cut_block)))
        self.cut_weights[self.docs % BLOCK, cut_of] = self.weight
        self.cut_most = self.cut_weights.max(0)
        self.term_cuts = np.append(cut_of[self.starts[:-1]], len(self.cut_block))
        #: Pairs of a query and a document whose postings were looked at, and those scored in full.
        self.tested = self.met = 0

    def best(self, starts: np.ndarray, term_of: np.ndarray, weights: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, score) of all documents that may be among the best of some queries.

        ``best`` holds each query's best scores so far, the least of them last, and is brought up to date. Terms that many of the queries and
        documents have are columns of a matrix; the others have postings.
        """
        n_q, k = len(starts) - 1, best.shape[1]
        owner, place = np.repeat(np.arange(n_q), np.diff(starts)), self.place[term_of]
        here = place >= 0
        owner, place, weights = owner[here], place[here], weights[here]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if not len(place):
            return found[0]
        used, local = np.unique(place, return_inverse=True)
        df = self.starts[used + 1] - self.starts[used]
        common = df * np.bincount(local) * COMMON >= n_q * self.n
        rare = ~common[local]
        columns = used[common]
        asked = np.zeros((n_q, len(columns)))
        asked[owner[~rare], (np.cumsum(common) - 1)[local[~rare]]] = weights[~rare]
        asked_32 = asked.astype(np.float32)
        #: No float32 sum of that many products, none negative, is farther off than this.
        slack = (len(columns) + 16) * 2.0**-23
        # the bounds of all blocks, from the largest weights of all terms
        n_cuts = self.term_cuts[columns + 1] - self.term_cuts[columns]
        cut = ranges(self.term_cuts[columns], n_cuts)
        most = np.zeros((len(columns), self.blocks), np.float32)
        most[np.repeat(np.arange(len(columns)), n_cuts), self.cut_block[cut]] = self.cut_most[cut]
        bound = asked_32 @ most
        del most
        # postings of rare terms: some queries at a time, so that they stay in the processor's cache
        owner, place, weights = owner[rare], place[rare], weights[rare]
        first_cut = self.term_cuts[place]
        n_cuts = self.term_cuts[place + 1] - first_cut
        parts, rest = [], np.empty(bound.shape)
        for x in range(0, n_q, AT_ONCE):
            own = slice(*np.searchsorted(owner, [x, x + AT_ONCE]))
            cut = ranges(first_cut[own], n_cuts[own])
            in_block = np.repeat((owner[own] - x) * self.blocks, n_cuts[own]) + self.cut_block[cut]
            part = rest[x : x + AT_ONCE]
            part[:] = np.bincount(in_block, np.repeat(weights[own], n_cuts[own]) * self.cut_most[cut], part.size).reshape(part.shape)
            parts.append((x, own, cut.astype(np.int32), in_block.astype(np.int32)))
        rest *= 1 + 1e-9
        rest += 1e-9
        bound = bound * (1 + slack) + rest
        turns = [np.ones((n_q, self.blocks), bool)]
        if not best.any() and self.blocks > FIRST:
            turns = [np.zeros((n_q, self.blocks), bool)]
            np.put_along_axis(turns[0], np.argpartition(-bound, FIRST, axis=1)[:, :FIRST], True, 1)
            turns.append(~turns[0])
        at = ranges(self.starts[columns], df[common])
        of, held, held_weight = np.repeat(np.arange(len(columns)), df[common]), self.docs[at], self.weight[at]
        for turn in turns:
            least = np.maximum(best[:, -1], 3e-9)
            todo = turn & (bound >= least[:, None])
            # the blocks that any query has to look into, side by side
            blocks = np.nonzero(todo.any(0))[0]
            if not len(blocks):
                continue
            slot = np.full(self.blocks, -1)
            slot[blocks] = np.arange(len(blocks))
            width = len(blocks) * BLOCK
            to = np.where(slot[:, None] >= 0, slot[:, None] * BLOCK + np.arange(BLOCK), -1).ravel()
            has = np.zeros((len(columns), width), np.float32)
            in_slot = to[held]
            in_any = in_slot >= 0
            has[of[in_any], in_slot[in_any]] = held_weight[in_any]
            # of these blocks, those that can reach it with their documents' own sums of common terms, in float32
            above = (asked_32 @ has).reshape(n_q, len(blocks), BLOCK)
            of_query, of_block = np.nonzero(todo)
            above = above[of_query, slot[of_block]]
            stay = above.max(1) * (1 + slack) + rest[of_query, of_block] >= least[of_query]
            of_query, of_block, above = of_query[stay], of_block[stay], above[stay]
            number = np.full(n_q * self.blocks, -1, np.int32)
            number[of_query * self.blocks + of_block] = np.arange(len(of_query))
            # the postings of rare terms there
            sums = np.empty((len(of_query), BLOCK))
            for x, pairs, cut, in_block in parts:
                own = slice(*np.searchsorted(of_query, [x, x + AT_ONCE]))
                at = number[x * self.blocks : (x + AT_ONCE) * self.blocks][in_block]
                mine = np.nonzero(at >= 0)[0]
                at, weight, mine = at[mine] - own.start, np.repeat(weights[pairs], n_cuts[pairs])[mine], cut[mine]
                for j in range(BLOCK):
                    sums[own, j] = np.bincount(at, weight * self.cut_weights[j][mine], own.stop - own.start)
            p, j = np.nonzero(above * (1 + slack) + sums >= least[of_query][:, None] - 1e-8)
            # the k-th best of what the documents reach at least is a threshold, too
            least = np.maximum(least, _merged(best, of_query[p], above[p, j] * (1 - slack) + sums[p, j], k)[:, -1] - 1e-8)
            stay = above[p, j] * (1 + slack) + sums[p, j] >= least[of_query[p]] - 1e-8
            p, j = p[stay], j[stay]
            q, d, scores = of_query[p], of_block[p] * BLOCK + j, sums[p, j]
            rows, row = np.unique(d, return_inverse=True)
            to = np.full(self.blocks * BLOCK, -1)
            to[rows] = np.arange(len(rows))
            in_row = to[held]
            mine = np.nonzero(in_row >= 0)[0]
            exact = np.zeros((len(rows), len(columns)))
            exact[in_row[mine], of[mine]] = held_weight[mine]
            for x in range(0, len(q), SCORED):
                scores[x : x + SCORED] += np.einsum("pc,pc->p", asked[q[x : x + SCORED]], exact[row[x : x + SCORED]])
            scores = np.round(scores, 9)
            self.met += len(q)
            self.tested += int(todo.sum()) * BLOCK
            best[:] = _merged(best, q, scores, k)
            stay = scores >= np.maximum(best[q, -1], 1e-9)
            found.append((q[stay], d[stay], scores[stay]))
        q, d, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        stay = scores >= best[q, -1]
        return q[stay], d[stay], scores[stay]


def _merged(best: np.ndarray, q: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Each query's k best of ``best`` and of the scores of ``q``, which is sorted; the largest first."""
    order = np.lexsort((-scores, q))
    place_in = np.arange(len(q)) - np.searchsorted(q, q)
    new, top = np.zeros_like(best), place_in < k
    new[q[top], place_in[top]] = scores[order][top]
    return -np.sort(-np.concatenate([best, new], 1), axis=1)[:, :k]


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], ..., first[0] + size[0] - 1, first[1], ..."""
    if not len(size):
        return np.zeros(0, np.int64)
    ends = np.cumsum(size)
    return np.arange(ends[-1]) + np.repeat(first - (ends - size), size)


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_id, query_hash, term, n) of the queries' words; equal rows are one query."""
    rows = queries.select(F.col(id_col).alias("query_id"), F.xxhash64(F.col(text_col).cast("string")).alias("query_hash"), F.col(text_col).cast("string").alias("text")).where("text is not null").dropDuplicates(["query_id", "query_hash"])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = [Counter(words_of(t)) for t in batch.column("text").to_pylist()]
        of = pa.array(np.repeat(np.arange(len(counts)), list(map(len, counts))))
        return pa.RecordBatch.from_arrays([batch.column("query_id").take(of), batch.column("query_hash").take(of), pa.array([w for c in counts for w in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())], ["query_id", "query_hash", "term", "n"])

    return map_arrow(rows, each, f"query_id {rows.schema['query_id'].dataType.simpleString()}, query_hash long, term string, n long")


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", query_id: str | None = None, query_text: str | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score): each query's best ``top`` documents."""
    spark = docs.sparkSession
    asked = checkpoint(query_terms(queries, query_id or id_col, query_text or text_col))
    bits = filter_bits(asked.select("term").distinct())
    index = build(docs, id_col, text_col, bits)
    n_docs, length = index.agg(F.sum("n_docs"), F.sum("length")).first()
    n_docs, mean = n_docs or 0, max((length or 0) / (n_docs or 1), 1e-9)
    tasks = max(spark.sparkContext.defaultParallelism, index.count() // TOGETHER)
    shards = index.select("ids", "terms", "data").coalesce(tasks)
    dfs = document_counts(index.select("terms", "dfs").coalesce(tasks))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = checkpoint(asked.join(dfs, "term").select("query_id", "query_hash", "term", (F.col("n") * idf).alias("weight")))
    n_blocks = max(1, math.ceil(weighted.count() / PAIRS))
    id_kind, q_kind = index.schema["ids"].dataType.elementType.simpleString(), weighted.schema["query_id"].dataType.simpleString()
    schema = f"query_id {q_kind}, query_hash long, doc_id {id_kind}, score double"
    folder = f"{shared_dir(spark).rstrip('/')}/search-{uuid.uuid4().hex}"
    for b in range(n_blocks):
        part = weighted.where(F.pmod(F.xxhash64("query_id", "query_hash"), F.lit(n_blocks)) == b).orderBy("query_id", "query_hash", "term").toArrow()
        sent = spark.sparkContext.broadcast(_block(part))
        shards.mapInArrow(_searcher(sent, top, mean), schema).write.parquet(f"{folder}/{b}")
        sent.destroy()
    out = spark.read.schema(schema).parquet(*[f"{folder}/{b}" for b in range(n_blocks)])
    w = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query_id", "rank", "doc_id", "score")


def _block(part: pa.Table) -> tuple:
    """Queries as (ids, hashes, first pair of each, term numbers, weights) and the terms, sorted. ``part`` is sorted by query; here, alike queries stand together."""
    part = part.combine_chunks()
    words = part.column("term").to_pylist()
    terms = sorted(set(words))
    at = {w: i for i, w in enumerate(terms)}
    ids, hashes = part.column("query_id").to_pylist(), part.column("query_hash").to_pylist()
    starts = [k for k in range(len(ids)) if k == 0 or (ids[k], hashes[k]) != (ids[k - 1], hashes[k - 1])]
    sizes, term_of = np.diff([*starts, len(ids)]), np.array([at[w] for w in words], np.int64)
    weights = part.column("weight").to_numpy()
    order = alike(np.repeat(np.arange(len(starts)), sizes), term_of, weights, sizes)
    starts, sizes = np.array(starts, np.int64)[order], sizes[order]
    take = ranges(starts, sizes)
    first = part.select(["query_id", "query_hash"]).take(pa.array(starts, pa.int64())).combine_chunks()
    owners = [pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in first.columns]
    return owners[0], owners[1], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), term_of[take], weights[take], pa.array(terms, pa.string())


def alike(owner: np.ndarray, term: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """An order in which queries with the same leading one of their common terms, and of similar size, stand together; leading terms
    that are often met in the same queries follow each other."""
    if not len(owner):
        return np.arange(len(sizes))
    leading = np.argsort(-np.bincount(term), kind="stable")[:LEADING]
    place = np.full(term.max() + 1, -1)
    place[leading] = np.arange(len(leading))
    some = place[term] >= 0
    # a word's weight over its least one, that of a query that has it once, is its count
    counts = np.zeros((len(sizes), len(leading)))
    counts[owner[some], place[term[some]]] = weights[some]
    counts /= np.where(counts > 0, counts, np.inf).min(0)
    together = (counts > 0).T.astype(float) @ (counts > 0)
    near = together / np.sqrt(np.outer(np.diag(together), np.diag(together)) + 1e-9)
    rank, at = np.full(len(leading), -1), 0
    for i in range(len(leading)):
        rank[at] = i
        at = np.where(rank < 0, near[at], -1).argmax()
    return np.lexsort((sizes, rank[counts.argmax(1)]))


def _searcher(sent, top: int, mean: float):
    """Finds the best of all shards that a task meets, for the block of queries that was sent; thresholds go on from shard to shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, hashes, starts, term_of, weights, terms = sent.value
        best = np.zeros((len(owners), top))
        kept: list[list[tuple]] = [[] for _ in range(len(owners))]
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for r in range(batch.num_rows):
                ids = batch.column("ids")[r].as_py()
                scorer = Scorer(Shard.unpacked(ids, batch.column("terms")[r].values, batch.column("data")[r].as_py()), terms, mean)
                at = 0
                while at < len(owners):
                    to = min(at + QUERIES, max(at + 1, int(np.searchsorted(starts, starts[at] + ASKED, "right")) - 1))
                    own = starts[at : to + 1]
                    q, d, scores = scorer.best(own - own[0], term_of[own[0] : own[-1]], weights[own[0] : own[-1]], best[at:to])
                    for i, j, x in zip((q + at).tolist(), d.tolist(), scores.tolist(), strict=True):
                        kept[i].append((-x, ids[j] is None, ids[j]))
                    at = to
                for i, (rows, least) in enumerate(zip(kept, best[:, -1].tolist(), strict=True)):
                    if len(rows) > 4 * top:
                        kept[i] = _best_of([x for x in rows if -x[0] >= least], top)
        if id_type is None:
            return
        found = [(i, row[2], -row[0]) for i, rows in enumerate(kept) for row in _best_of(rows, top)]
        columns = list(zip(*found, strict=True)) or [[], [], []]
        of = pa.array(columns[0], pa.int64())
        yield pa.RecordBatch.from_arrays([owners.take(of), hashes.take(of), pa.array(columns[1], id_type), pa.array(columns[2], pa.float64())], ["query_id", "query_hash", "doc_id", "score"])

    return run


def _best_of(rows: list[tuple], top: int) -> list[tuple]:
    """The best rows; equal scores by the smaller id, null ids last."""
    known, none = sorted(x for x in rows if not x[1]), sorted(x[:2] for x in rows if x[1])
    return sorted([*known[:top], *((*x, None) for x in none[:top])], key=lambda x: x[:2])[:top]


def op7_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search(docs, docs.where("doc_id % 100 = 0"))
