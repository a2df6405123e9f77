"""BPE encoding and decoding by speculation and verification.

A word's tokens are proposed by greedy longest match. A sequence of tokens is the word's BPE encoding
exactly if every token encodes to itself and every two neighbours stay apart when merged together, so
all neighbours of a batch of words are checked at once against a table of verdicts; only words with a
failing pair (or a token that merging can't reach) are merged exactly.

Which characters are letters, numbers and white space, and what they are in lower case, is what the installed
library says, asked once for each code point when a model is made. No word of the vocabularies holds white space,
so a text is cut there first, and each cut's ids and tokens are kept as text: a cut met before costs one look-up.
A vocabulary file whose normaliser, pre-tokeniser or decoder is of another kind is refused.

Null texts count as empty; an empty text has no tokens. Rows are independent, so ties and repeated
rows need nothing; only the id and text columns are read, so other columns can have any name. Null ids stay null,
an empty table gives an empty one, and a text of any length is taken whole.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import heapq
import itertools
import json
import re
import unicodedata
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import Lookup, Sent, held, map_arrow, table

#: Cuts met since the last change whose tokens a worker keeps; it keeps as many of those before that.
CACHE_WORDS = 250_000
NEVER = (1 << 31) - 1
#: Stands for the suffix that marks a word's end; no byte's letter. As bytes that UTF-8 never has: it, and nothing.
END = "\n"
END_BYTE, NO_BYTE = b"\xfe", b"\xff"
#: Words of at most so many bytes are taken side by side, in matrices of these widths; longer ones one by one.
WIDTHS = (6, 10, 16, 32, 64)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = itertools.count(0x100)
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _planes(*planes: int) -> str:
    return "".join(chr(c) for plane in planes for c in range(plane << 16, (plane + 1) << 16) if not 0xD800 <= c < 0xE000)


def _ranges(found: set[str]) -> str:
    """The characters as the inside of a class of Python's re."""
    codes = sorted(map(ord, found))
    runs = [[c for _, c in g] for _, g in itertools.groupby(enumerate(codes), key=lambda x: x[1] - x[0])]
    return "".join(rf"\U{r[0]:08x}-\U{r[-1]:08x}" for r in runs)


@functools.cache
def library_tables(pattern: str) -> dict[str, str]:
    """What the installed library takes the pattern's classes to hold, and its lower case where Python's differs.

    ``pattern`` is the same for Python's re; ``odd`` holds what Python cuts at though the library doesn't, or the
    other way round; ``other`` the characters whose lower case differs, and ``lower`` the library's, one a line;
    ``moves`` those that NFC may change or join to what stands before. Planes without any assigned letter aren't asked.
    """
    from tokenizers import Regex
    from tokenizers.normalizers import Lowercase
    from tokenizers.pre_tokenizers import Split

    every = _planes(0, 1, 2, 3, 14)
    classes = dict.fromkeys([*re.findall(r"\\p\{\w+\}", pattern), r"\s"])
    for c in classes:
        classes[c] = set("".join(x for x, _ in Split(Regex(f"[{c}]+"), "removed", invert=True).pre_tokenize_str(every)))
    own = re.sub(r"\\p\{\w+\}|\\s", lambda m: _ranges(classes[m[0]]), pattern)
    signs = every.replace("\n", "")
    low = Lowercase().normalize_str("\n".join(signs)).split("\n")
    other = [(c, x) for c, x in zip(signs, low, strict=True) if c.lower() != x or c == "Σ"]
    seconds = {chr(int(x.split()[1], 16)) for c in every if (x := unicodedata.decomposition(c)) and x[0] != "<" and " " in x}
    moves = {c for c in every if unicodedata.combining(c) or not unicodedata.is_normalized("NFC", c)} | seconds | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    return {"pattern": own, "odd": "".join(c for c in every if c.isspace() != (c in classes[r"\s"])), "other": "".join(c for c, _ in other), "lower": "\n".join(x for _, x in other), "moves": _ranges(moves)}


def split_pattern(spec: dict) -> str:
    """The pattern that cuts words out; raises ValueError for files of another kind than this module is for."""
    normal = spec["normalizer"] or {}
    steps = [x["type"] for x in normal.get("normalizers", [])]
    pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    fits = (
        steps == ["NFC", "Replace", "Lowercase"]
        and normal["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
        and [x["type"] for x in pre] == ["Split", "ByteLevel"]
        and (pre[0]["behavior"], pre[0]["invert"], pre[1]["add_prefix_space"], pre[1]["use_regex"]) == ("Removed", True, False, False)
        and spec["decoder"] is None
        and all(x["normalized"] is False and not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in spec["added_tokens"])
    )
    pattern = pre[0]["pattern"].get("Regex", "") if fits else ""
    inside = re.sub(r"\[[^\]]*\]", "", pattern)
    # white space never stands in a match, so texts may be cut there: \s only in classes of what isn't
    if not pattern or "\\" in inside or " " in pattern or re.search(r"\[(?!\^)[^\]]*\\s", pattern) or re.search(r"\[\^(?![^\]]*\\s)", pattern):
        raise ValueError("a vocabulary file of another kind")
    return pattern


class Bpe:
    """Encoder and decoder of one vocabulary file in the tokenizers library's JSON format."""

    def __init__(self, spec: str, tables: dict[str, str] | None = None):
        d = json.loads(spec)
        model = d["model"]
        tables = tables or library_tables(split_pattern(d))
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in d["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.numerals = {i: str(i) for i in self.tokens}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = re.compile(tables["pattern"]).findall
        self.odd = tables["odd"]
        self.other = re.compile(f"[{re.escape(tables['other'])}]")
        self.lower = dict(zip(tables["other"], tables["lower"].split("\n"), strict=True))
        self.moves = re.compile(f"[{tables['moves']}]").search
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        size = max(self.tokens) + 1
        pairs, made = [], []
        formed, left, right = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        twice = np.zeros(size, bool)
        for at, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i, j, to = self.vocab[a], self.vocab[b], self.vocab[a + b]
            pairs.append((i, j))
            made.append(to)
            twice[to] |= formed[to] >= 0
            if formed[to] < 0:
                formed[to], left[to], right[to] = at, i, j
        self.formed, self.left, self.right = formed, left, right
        self.rank = {p: (at, to) for at, (p, to) in enumerate(zip(pairs, made, strict=True))}
        both = np.array(pairs, np.int64).reshape(-1, 2)
        self.rank_of, self.made = Lookup(both[:, 0] << 32 | both[:, 1], np.arange(len(pairs))), np.array(made, np.int64)
        #: Tokens that greedy matching may propose: those that merging their own text yields.
        self.sound = ~twice
        whole = np.nonzero(formed >= 0)[0]
        self.sound[whole] &= self.apart(left[whole], right[whole], formed[whole])
        for t in sorted(whole.tolist(), key=formed.__getitem__):
            self.sound[t] &= self.sound[left[t]] and self.sound[right[t]]
        self._grow_tree()
        self.young: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}
        self.exact_words = self.greedy_words = 0

    def _grow_tree(self) -> None:
        """The tokens' beginnings: by their letters, and as a tree of bytes whose edges are looked up for many words at once."""
        byte_of = {c: b for b, c in self.letters.items()} | {END: END_BYTE[0]}
        #: Every beginning of a token, the suffix as one sign: the token that it is, or -1.
        self.begins: dict[str, int] = {}
        for t, i in self.vocab.items():
            t = t.removesuffix(self.suffix) + END if self.suffix and t.endswith(self.suffix) else t
            for end in range(1, len(t)):
                self.begins.setdefault(t[:end], -1)
            self.begins[t] = i
        node = {x: k for k, x in enumerate(self.begins, 1)} | {"": 0}
        edges = np.array([(node[x[:-1]] << 8 | byte_of[x[-1]], k) for x, k in node.items() if x], np.int64).reshape(-1, 2)
        self.child, self.token_at = Lookup(edges[:, 0], edges[:, 1]), np.array([-1, *self.begins.values()], np.int64)
        self.alone = np.array([self.vocab[self.letters[b]] for b in range(256)], np.int64)
        self.last = np.array([self.vocab[self.letters[b] + self.suffix] for b in range(256)], np.int64)

    def apart(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | int = NEVER) -> np.ndarray:
        """Of each pair of tokens side by side, whether they are never merged across their border before rank ``until``.

        Walks back through the merges that formed them, the latest first; of two merges of one
        rank, the left one comes first.
        """
        ok, rows = np.ones(len(a), bool), np.arange(len(a))
        until = np.broadcast_to(np.asarray(until, np.int64), a.shape)
        gone_a = gone_b = until
        while len(rows):
            across = self.rank_of(a.astype(np.int64) << 32 | b).astype(np.int64)
            met = (across >= 0) & (across < gone_a) & ((across < gone_b) | (across == gone_b) & (gone_b != until))
            ok[rows[met]] = False
            fa, fb = self.formed[a], self.formed[b]
            back_a = fa > fb
            on = ~met & (back_a | (fb >= 0))
            gone_a, gone_b = np.where(back_a, fa, gone_a), np.where(back_a, gone_b, fb)
            a, b = np.where(back_a, self.right[a], a), np.where(back_a, b, self.left[b])
            rows, a, b, gone_a, gone_b, until = rows[on], a[on], b[on], gone_a[on], gone_b[on], until[on]
        return ok

    def symbols(self, word: str) -> list[str]:
        s = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        s[-1] += self.suffix
        return s

    def merged(self, word: str) -> tuple[int, ...]:
        """The exact merge: the pair of lowest rank first, the leftmost of equals."""
        return tuple(self._merged_long([self.vocab[s] for s in self.symbols(word)]))

    def _merged_all(self, signs: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words side by side (bytes and numbers of bytes): (tokens, numbers of tokens)."""
        n, width = signs.shape
        ids = self.alone[signs]
        ids[np.arange(n), sizes - 1] = self.last[signs[np.arange(n), sizes - 1]]
        sizes, columns = sizes.copy(), np.arange(width)

        def ranks(left: np.ndarray, right: np.ndarray, there: np.ndarray) -> np.ndarray:
            found = self.rank_of(left << 32 | right)
            return np.where(there & (found >= 0), found, NEVER).astype(np.int32)

        rank = np.full((n, width), NEVER, np.int32)
        rank[:, :-1] = ranks(ids[:, :-1], ids[:, 1:], columns[1:] < sizes[:, None])
        out, counts, rows = np.zeros((n, width), np.int64), np.zeros(n, np.int64), np.arange(n)
        while len(rows):
            at = rank.argmin(1)
            best = rank[np.arange(len(rows)), at]
            on = best != NEVER
            if not on.all():
                out[rows[~on]], counts[rows[~on]] = ids[~on], sizes[~on]
                rows, ids, rank, sizes, at, best = rows[on], ids[on], rank[on], sizes[on], at[on], best[on]
                if not len(rows):
                    break
            every, sizes = np.arange(len(rows)), sizes - 1
            take = np.minimum(columns + (columns > at[:, None]), width - 1)
            ids, rank = np.take_along_axis(ids, take, 1), np.take_along_axis(rank, take, 1)
            rank[every, sizes - 1] = NEVER
            ids[every, at] = self.made[best]
            before, behind = np.maximum(at - 1, 0), np.minimum(at + 1, width - 1)
            rank[every, at] = ranks(ids[every, at], ids[every, behind], at + 1 < sizes)
            rank[every[at > 0], before[at > 0]] = ranks(ids[every, before], ids[every, at], at > 0)[at > 0]
        return out, counts

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a queue: n log n in the word's length."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := self.rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, made = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.rank.get((ids[x], ids[y]))):
                    heapq.heappush(queue, (r[0], x, ids[x], ids[y], r[1]))
        return [i for i in ids if i >= 0]

    def proposed(self, word: str) -> list[int]:
        """Greedy longest match over the word's letters; the word's end is part of its last token."""
        text = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        begins, n, at, out = self.begins.get, len(text), 0, []
        if self.suffix:
            text += END
        full = len(text)
        while at < full:
            found, stop = -1, at
            for end in range(at + 1, full + 1):
                t = begins(text[at:end])
                if t is None:
                    break
                if t >= 0 and (end != n or n == full):
                    found, stop = t, end
            if found < 0:
                return []
            out.append(found)
            at = stop
        return out

    def _proposed_all(self, signs: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words side by side: (tokens, numbers of tokens), none where no token fits."""
        n = len(signs)
        full = sizes + bool(self.suffix)
        out, counts, rows = np.zeros(signs.shape, np.int64), np.zeros(n, np.int64), np.arange(n)
        zero = np.zeros(n, np.int64)
        at, node, found, stop, made = zero, zero, zero - 1, zero, zero
        while len(rows):
            step = self.child(node << 8 | signs[rows, at])
            on = step >= 0
            at, node = at + on, np.where(on, step, 0)
            token = self.token_at[node]
            fits = on & (token >= 0) & ((at != sizes) | (sizes == full))
            found, stop = np.where(fits, token, found), np.where(fits, at, stop)
            ends = ~on & (found >= 0)
            lost = ~on & (found < 0)
            out[rows[ends], made[ends]] = found[ends]
            made = made + ends
            done = ends & (stop == full)
            counts[rows[done]] = made[done]
            at, found = np.where(ends, stop, at), np.where(ends, -1, found)
            stay = ~(done | lost)
            if not stay.all():
                rows, at, node, found, stop, made, sizes, full = (x[stay] for x in (rows, at, node, found, stop, made, sizes, full))
        return out, counts

    def encoded(self, words: list[str]) -> list[list[int]]:
        """The tokens of words: proposed, verified all at once, and merged exactly where that fails."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list = [None] * len(words)
        self.greedy_words += len(words)
        for least, most in itertools.pairwise((0, *WIDTHS)):
            rows = np.nonzero((lengths > least) & (lengths <= most))[0]
            for at in range(0, len(rows), 8192):
                own = rows[at : at + 8192]
                signs = np.frombuffer(b"".join([(raw[k] + END_BYTE * bool(self.suffix)).ljust(most + 2, NO_BYTE) for k in own.tolist()]), np.uint8).reshape(len(own), most + 2)
                tokens, counts = self._proposed_all(signs, lengths[own])
                bad = ~self._verified(tokens, counts)
                if bad.any():
                    merged, sizes = self._merged_all(signs[bad], lengths[own][bad])
                    tokens[bad], counts[bad] = merged, sizes
                self.exact_words += int(bad.sum())
                for k, ids, n in zip(own.tolist(), tokens.tolist(), counts.tolist(), strict=True):
                    out[k] = ids[:n]
        for k in np.nonzero(lengths > WIDTHS[-1])[0].tolist():
            guess = self.proposed(words[k])
            row = np.array([guess or [0]], np.int64)
            fits = bool(guess) and bool(self._verified(row, np.array([len(guess)]))[0])
            self.exact_words += not fits
            out[k] = guess if fits else list(self.merged(words[k]))
        return out

    def _verified(self, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of each row of proposed tokens, whether each is sound and no neighbours are merged across their border."""
        columns = np.arange(tokens.shape[1])
        ok = (counts > 0) & (self.sound[tokens] | (columns >= counts[:, None])).all(1)
        row, at = np.nonzero((columns[1:] < counts[:, None]) & ok[:, None])
        ok[row[~self.apart(tokens[row, at], tokens[row, at + 1])]] = False
        return ok

    def learn(self, cuts: list[str]) -> None:
        """The tokens of new cuts, and of the words that they have, into the memory.

        Nothing that is made here can hold itself, so the search for such cycles waits.
        """
        gc.disable()
        try:
            self._learn(cuts)
        finally:
            gc.enable()

    def _learn(self, cuts: list[str]) -> None:
        young, old, tokens, numerals = self.young, self.old, self.tokens, self.numerals
        split = [(c,) if c.isascii() and c.isalpha() else self.words(c) for c in cuts]
        words = [w for w in dict.fromkeys(itertools.chain.from_iterable(split)) if w not in young and not (w in old and young.setdefault(w, old[w]))]
        for w, ids in zip(words, self.encoded(words), strict=True):
            young[w] = (numerals[ids[0]], tokens[ids[0]]) if len(ids) == 1 else (" ".join([numerals[i] for i in ids]), " ".join([tokens[i] for i in ids]))
        for cut, own in zip(cuts, split, strict=True):
            if len(own) != 1 or own[0] != cut:
                parts = [young[w] for w in own]
                young[cut] = " ".join([p[0] for p in parts]), " ".join([p[1] for p in parts])

    def normal(self, text: str) -> str:
        """Normalised as the library does; white space stays as it is, as no word holds any."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.moves(text):
                from tokenizers.normalizers import NFC

                text = NFC().normalize_str(text)
            return self.other.sub(lambda m: self.lower[m[0]], text).lower() if self.other.search(text) else text.lower()
        return text.lower()

    def cuts(self, text: str) -> list[str]:
        """The text between white space, normalised; where Python's white space isn't the library's, its words."""
        text = self.normal(text)
        return self.words(text) if any(c in text for c in self.odd) else text.split()

    def pieces(self, text: str) -> list[str]:
        """The cuts of a text; special tokens stand for themselves, with a mark that no cut has."""
        if self.specials is None or not any(s in text for s in self.special):
            return self.cuts(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += self.cuts(text[at : m.start()])
            out.append(" " + m[0])
            at = m.end()
        return out + self.cuts(text[at:])

    def joined_batch(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """Of each text, its ids joined by spaces and its tokens joined by spaces, which is what it decodes to."""
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        split = [self.pieces(t) if t else [] for t in texts]
        found = [list(map(young.get, cuts)) for cuts in split]
        gaps = [[k for k, x in enumerate(own) if x is None] for own in found]
        missing = {cuts[k] for cuts, at in zip(split, gaps, strict=True) for k in at}
        again = {c: old[c] for c in missing if c in old}
        young.update(again)
        missing.difference_update(again)
        self.learn([c for c in missing if c[0] != " "])
        young.update((c, (str(self.special[c[1:]]), c[1:])) for c in missing if c[0] == " ")
        ids_of, tokens_of = itemgetter(0), itemgetter(1)
        out = []
        for cuts, own, at in zip(split, found, gaps, strict=True):
            for k in at:
                own[k] = young[cuts[k]]
            out.append((" ".join(map(ids_of, own)), " ".join(map(tokens_of, own))))
        return out

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        return [list(map(int, ids.split())) for ids, _ in self.joined_batch(texts)]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary has no decoder, so its tokens are joined with spaces; unknown ids are left out."""
        tokens = self.tokens
        try:
            return " ".join([tokens[i] for i in ids])
        except KeyError:
            return " ".join([tokens[i] for i in ids if i in tokens])


def _loaded(sent: Sent) -> Bpe:
    """The encoder of the vocabulary that was sent, kept by the worker."""
    return held(sent.key, lambda: Bpe(*sent.value))


def _shipped(spark: SparkSession, model: str | None):
    """The vocabulary file and the library's tables (a fixed few MB) to all executors, so that only the driver needs the path."""
    with open(model or default_model(), encoding="utf-8") as f:
        spec = f.read()
    return Sent(spark, (spec, library_tables(split_pattern(json.loads(spec)))))


def encode(df: DataFrame, text_col: str = "text", out_col: str = "token_ids", model: str | None = None) -> DataFrame:
    """``df`` with the token ids of ``text_col`` in ``out_col`` (replaced if there); null texts get an empty list."""
    spec = _shipped(df.sparkSession, model)
    rest = df.drop(out_col)
    at = rest.columns.index(text_col)
    schema = rest.select("*", F.lit(None).cast("array<int>").alias(out_col)).schema

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = _loaded(spec).encode_batch(batch.column(at).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, out_col])

    return map_arrow(rest, each, schema, 256)


def decode(df: DataFrame, ids_col: str = "token_ids", out_col: str = "decoded", model: str | None = None) -> DataFrame:
    """``df`` with the text of ``ids_col`` in ``out_col``; null lists give an empty text."""
    spec = _shipped(df.sparkSession, model)
    rest = df.drop(out_col)
    at = rest.columns.index(ids_col)
    schema = rest.select("*", F.lit(None).cast("string").alias(out_col)).schema

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = _loaded(spec)
        texts = [bpe.decode(ids or []) for ids in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out_col])

    return map_arrow(rest, each, schema, 256)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, with_ids: bool = False) -> DataFrame:
    """Each row's id, number of tokens, and the digests of its ids and of the text decoded from them.

    One pass that encodes and decodes a slice of rows at a time; with ``with_ids`` also the ids.
    """
    spec = _shipped(df.sparkSession, model)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        sha = hashlib.sha256
        encoded = _loaded(spec).joined_batch(batch.column(1).to_pylist())
        sizes = [ids.count(" ") + 1 if ids else 0 for ids, _ in encoded]
        digest = [pa.array([sha(x[k].encode()).hexdigest() for x in encoded], pa.string()) for k in (0, 1)]
        columns, names = [batch.column(0), pa.array(sizes, pa.int64()), *digest], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            flat = np.array(" ".join(ids for ids, _ in encoded if ids).split(), np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(flat, pa.int32())))
            names.append("token_ids")
        return pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(rows, each, schema, 256)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
