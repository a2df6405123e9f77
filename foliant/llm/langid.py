"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood is
the sum, by a forward algorithm, over all ways to cut it into pieces; a text's is the product over its
words. The probabilities are learned by expectation and maximisation over word counts of a bounded,
hash-chosen sample of the labelled documents; every text is then scored whole. Words have any length: the forward
sums go on in steps of one letter over as many sums as the longest piece has letters, rescaled on the way.

Learned from: text and lang of rows with both, whose crc32 of the id's decimal digits modulo 4 is not 2
(the held-out quarter). Null texts and texts without a letter are ``und`` with score 0. A null id is never held
out and never learned from. Equal likelihoods go to the first language in alphabetical order.
Without any labelled row every text is ``und``. Rows are independent: repeated rows and other columns
of any name need nothing.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import Lookup, Sent, held, map_arrow, table

#: Documented bound of the fit: about so many documents per language, chosen by a hash of text and id.
TRAIN_DOCS = 1000
ROUNDS = 2
#: Added to each piece's expected count.
SMOOTHING = 0.1
#: Words met since the last change whose likelihoods a worker keeps; it keeps as many of those before that.
CACHE_WORDS = 150_000
#: Numbers that a batch of words may take at a time.
NUMBERS = 4_000_000
#: Longer words are learned from one by one, in logarithms.
LONG = 40
#: Each letter's share of a piece's probability is raised by this, so that sums stay near one; it cancels out.
LIFT = 10.0
#: Taken off a text's distance from its language, over the root of its letters; and the least spread of a language.
SHORT, LEAST_SPREAD = 5.0, 0.02
START = "▁"
LETTERS = re.compile(r"[^\W\d_]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str | None = None) -> dict[str, int]:
    """The vocabulary's pieces that are lower-case letters, with or without the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or default_vocabulary())
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    kept = (p for p in pieces if (x := p.removeprefix(START)).lower() == x and (not x or LETTERS.fullmatch(x)))
    return {p: i for i, p in enumerate(dict.fromkeys(kept))}


def words_of(text: str) -> list[str]:
    """The runs of letters, lower-cased, with the mark of a word's start."""
    return [START + w for w in LETTERS.findall(text.lower())]


class Pieces:
    """The vocabulary's pieces by length, as 64-bit codes of their letters, so that all spans of many words are looked up at once."""

    STEP = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, vocab: dict[str, int]):
        self.size = len(vocab)
        self.longest = max(map(len, vocab), default=1)
        #: The letters of each piece, and of the rows after the vocabulary.
        self.letters = np.array([*map(len, vocab), 1, 0], float)
        self.by_length: dict[int, Lookup] = {}
        for n in {len(x) for x in vocab}:
            own = [x for x in vocab if len(x) == n]
            codes = np.zeros(len(own), np.uint64)
            for column in letters(own).T:
                codes = codes * self.STEP + column
            self.by_length[n] = Lookup(codes, np.array([vocab[x] for x in own]))

    def ids(self, codes: np.ndarray, length: int) -> np.ndarray:
        """The piece of each code; size + 1 where there is none."""
        if length not in self.by_length:
            return np.full(codes.shape, self.size + 1, np.int32)
        found = self.by_length[length](codes)
        return np.where(found >= 0, found, self.size + (length > 1))


def letters(words: list[str]) -> np.ndarray:
    """(words, letters): the code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1).astype(np.uint64)


class Lattice:
    """The pieces of words of one length: ids[word, i, k] is the piece that ends behind letter i and has longest - k letters, or none."""

    def __init__(self, words: list[str], pieces: Pieces):
        n, self.longest = len(words[0]), pieces.longest
        self.n = n
        self.ids = np.full((len(words), n, self.longest), pieces.size + 1, np.int32)
        signs = letters(words)
        codes = np.zeros_like(signs)
        for size in range(1, min(n, self.longest) + 1):
            codes = codes[:, : n - size + 1] * Pieces.STEP + signs[:, size - 1 :]
            self.ids[:, size - 1 :, self.longest - size] = pieces.ids(codes, size)

    def logs(self, p: np.ndarray) -> np.ndarray:
        """(words, languages): the logarithm of the sum over all segmentations."""
        n_words, k = len(self.ids), self.longest
        last = np.zeros((n_words, k, p.shape[1]))
        last[:, -1] = 1
        scale = np.zeros((n_words, p.shape[1]))
        for i in range(self.n):
            now = np.einsum("wkl,wkl->wl", last, p[self.ids[:, i]])
            last = np.concatenate([last[:, 1:], now[:, None]], 1)
            if i % 8 == 7:
                top = last.max(1)
                last /= top[:, None]
                scale += np.log(top)
        return scale + np.log(last[:, -1])

    def forward(self, p: np.ndarray) -> np.ndarray:
        """(words, longest + n, languages): the sum over all segmentations of the first letters, behind zeros."""
        a = np.zeros((len(self.ids), self.longest + self.n, p.shape[1]))
        a[:, self.longest - 1] = 1
        for i in range(self.n):
            a[:, self.longest + i] = np.einsum("wkl,wkl->wl", a[:, i : i + self.longest], p[self.ids[:, i]])
        return a

    def expected(self, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The expected number of each piece in ``n`` (words, languages) occurrences of the words."""
        got, a = np.zeros_like(p), self.forward(p)
        share = n / a[:, -1]
        b = np.zeros((len(self.ids), self.longest + self.n, p.shape[1]))
        b[:, -1] = 1
        for i in range(self.n - 1, -1, -1):  # from the last letter: what ends behind letter i passes its mass to where it begins
            mass = p[self.ids[:, i]] * b[:, self.longest + i, None]
            b[:, i : i + self.longest] += mass
            flat = self.ids[:, i].ravel()
            mass *= a[:, i : i + self.longest] * share[:, None]
            for c in range(p.shape[1]):
                got[:, c] += np.bincount(flat, mass[:, :, c].ravel(), len(p))
        return got

    def expected_long(self, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The same in logarithms, for one long word."""
        got, k, ids = np.zeros_like(p), self.longest, self.ids[0]
        with np.errstate(divide="ignore"):
            logs = np.log(p)
        a, b = np.full((2, k + self.n, p.shape[1]), -np.inf)
        a[k - 1] = b[-1] = 0
        for i in range(self.n):
            a[k + i] = np.logaddexp.reduce(a[i : i + k] + logs[ids[i]], 0)
        for i in range(self.n - 1, -1, -1):
            mass = logs[ids[i]] + b[k + i]
            b[i : i + k] = np.logaddexp(b[i : i + k], mass)
            np.add.at(got, ids[i], np.exp(mass + a[i : i + k] - a[-1]) * n[0])
        return got


def by_length(words: list[str], per_letter: int):
    """Positions of words of one length, as many at a time as NUMBERS allows for."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    for n, same in itertools.groupby(order, key=lambda k: len(words[k])):
        same, most = list(same), max(1, NUMBERS // (n * per_letter))
        for at in range(0, len(same), most):
            yield same[at : at + most]


class Model:
    """Piece probabilities per language. The rows after the vocabulary: an unknown letter, and no piece."""

    def __init__(self, langs: list[str], vocab: dict[str, int], p: np.ndarray):
        self.langs, self.vocab, self.p, self.pieces = langs, vocab, p, Pieces(vocab)
        self.at: dict[str, int] = {}
        self.logs = np.empty((0, len(langs)))
        self.old_at, self.old_logs = self.at, self.logs

    @classmethod
    def fit(cls, words: list[str], counts: np.ndarray, langs: list[str], vocab: dict[str, int], rounds: int = ROUNDS) -> Model:
        """counts: (words, languages)."""
        v = len(vocab)
        p = np.full((v + 2, len(langs)), 1.0 / (v + 1))
        p[-1] = 0
        pieces = Pieces(vocab)
        lift = (LIFT**pieces.letters)[:, None]
        for _ in range(rounds):
            got = np.zeros((v + 2, len(langs)))
            for at in by_length(words, pieces.longest * (1 + len(langs))):
                if len(words[at[0]]) <= LONG:
                    got += Lattice([words[k] for k in at], pieces).expected(p * lift, counts[at])
                else:
                    for k in at:
                        got += Lattice([words[k]], pieces).expected_long(p, counts[[k]])
            got[:-1] += SMOOTHING
            got[-1] = 0
            p = got / got.sum(0)
        return cls(langs, vocab, p)

    def learn(self, words: list[str]) -> None:
        """The log likelihoods of new words (as in a text, lower-cased), into the memory."""
        again = [w for w in words if w in self.old_at]
        new = [w for w in words if w not in self.old_at]
        logs = np.empty((len(new), len(self.langs)))
        marked = [START + w for w in new]
        for at in by_length(marked, self.pieces.longest + len(self.langs)):
            logs[at] = Lattice([marked[k] for k in at], self.pieces).logs(self.p)
        self.at.update(zip(again + new, range(len(self.logs), len(self.logs) + len(words)), strict=True))
        self.logs = np.concatenate([self.logs, self.old_logs[np.array([self.old_at[w] for w in again], np.int64)], logs])

    def scores(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores, _, _ = self.judged(texts)
        return langs, scores

    def judged(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float], list[int]]:
        """Of each text: its best language, that language's posterior, its log likelihood per letter, and the letters (word starts count)."""
        if len(self.at) > CACHE_WORDS:
            self.old_at, self.old_logs, self.at, self.logs = self.at, self.logs, {}, np.empty((0, len(self.langs)))
        split = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        missing = set().union(*split).difference(self.at)
        if missing:
            self.learn(list(missing))
        langs, scores, rates, sizes, get = [], [], [], [], self.at.__getitem__
        for words in split:
            if not words or not self.langs:
                for column, x in ((langs, "und"), (scores, 0.0), (rates, 0.0), (sizes, 0)):
                    column.append(x)
                continue
            total = self.logs[np.fromiter(map(get, words), np.int64, len(words))].sum(0)
            best = int(total.argmax())
            letters = len(words) + sum(map(len, words))
            langs.append(self.langs[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
            rates.append(float(total[best] / letters))
            sizes.append(letters)
        return langs, scores, rates, sizes


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train_docs: int) -> tuple[DataFrame, list[str]]:
    """(lang, text) of about ``train_docs`` labelled rows of each language, chosen by a hash, and the languages."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where("lang is not null and text is not null and id is not null").where(~held_out("id"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return rows.select("lang", "text").limit(0), []
    share = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(min(1.0, train_docs / n))) for k, n in sizes.items()))
    chosen = rows.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)
    return chosen.select("lang", "text"), sorted(sizes)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocab_path: str | None = None, train_docs: int = TRAIN_DOCS) -> Model:
    """The model learned from ``docs``. What reaches the driver is the counts of the words of about ``train_docs`` documents per language."""
    vocab = vocabulary(vocab_path)
    chosen, langs = _sample(docs, id_col, text_col, lang_col, train_docs)
    if not langs:
        return Model([], vocab, np.zeros((len(vocab) + 2, 0)))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        split = [words_of(t) for t in batch.column("text").to_pylist()]
        words = list(itertools.chain.from_iterable(split))
        of = np.repeat(np.arange(len(split)), list(map(len, split)))
        return pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(of)), pa.array(words, pa.string())], ["lang", "word"])

    words = map_arrow(chosen, each, "lang string, word string").groupBy("word").agg(*[F.count_if(F.col("lang") == x).alias(f"c{k}") for k, x in enumerate(langs)])
    top = words.orderBy("word").toArrow()
    counts = np.stack([top.column(f"c{k}").to_numpy() for k in range(len(langs))], 1).astype(float)
    return Model.fit(top.column("word").to_pylist(), counts, langs, vocab)


def _received(sent: Sent) -> Model:
    """The model of a broadcast; the worker keeps it with its word cache."""
    return held(sent.key, lambda: Model(*sent.value))


def predict(df: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``df`` with the predicted language and its posterior probability under equal priors."""
    sent = Sent(df.sparkSession, (model.langs, model.vocab, model.p))
    rest = df.drop(lang_out, score_out)
    at = rest.columns.index(text_col)
    schema = rest.select("*", F.lit(None).cast("string").alias(lang_out), F.lit(None).cast("double").alias(score_out)).schema

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = _received(sent).scores(batch.column(at).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, lang_out, score_out])

    return map_arrow(rest, each, schema, 512)


def usual_rates(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> dict[str, tuple[float, float]]:
    """Of each language, the mean and standard deviation of the log likelihood per letter over its sampled documents."""
    chosen, _ = _sample(docs, id_col, text_col, lang_col, train_docs)
    sent = Sent(docs.sparkSession, (model.langs, model.vocab, model.p))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, _, rates, sizes = _received(sent).judged(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rates, pa.float64()), pa.array(sizes, pa.int64())], ["lang", "rate", "letters"])

    rows = map_arrow(chosen, each, "lang string, rate double, letters long").where("letters > 0").groupBy("lang").agg(F.avg("rate").alias("mean"), F.stddev_pop("rate").alias("sd"))
    return {r["lang"]: (r["mean"], r["sd"]) for r in rows.collect()}


def with_oddness(df: DataFrame, model: Model, usual: dict[str, tuple[float, float]], text_col: str = "text", lang_out: str = "lang_pred", odd_out: str = "oddness") -> DataFrame:
    """``df`` with the predicted language, and how many standard deviations its log likelihood per letter lies below the language's usual.

    A posterior tells one learned language from another, but goes to one for any text; this tells a text of none of them. Few letters
    prove little: SHORT over their root is taken off first. Null and letterless texts are und, with oddness 0.
    """
    sent = Sent(df.sparkSession, (model.langs, model.vocab, model.p))
    rest = df.drop(lang_out, odd_out)
    at = rest.columns.index(text_col)
    schema = rest.select("*", F.lit(None).cast("string").alias(lang_out), F.lit(None).cast("double").alias(odd_out)).schema

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, _, rates, sizes = _received(sent).judged(batch.column(at).to_pylist())
        odd = [(usual[x][0] - r - SHORT / n**0.5) / max(usual[x][1], LEAST_SPREAD) if n and x in usual else 0.0 for x, r, n in zip(langs, rates, sizes, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(odd, pa.float64())], [*batch.schema.names, lang_out, odd_out])

    return map_arrow(rest, each, schema, 512)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
