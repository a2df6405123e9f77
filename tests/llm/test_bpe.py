import hashlib
import random

import numpy as np
import pytest
from foliant.llm import bpe

tokenizers = pytest.importorskip("tokenizers")

ODD = ["", " ", "Hello world", "it's we'll I'd", "ΑΣ ΣΑΣ", "İstanbul STRASSE ß", "1234 ½ ² Ⅷ", "a<|endoftext|>b <|startoftext|>", "<|endoftext", "é é", "x" * 3000, "aaaa" * 50, "日本語 テキスト", "😀😀 👩‍👩‍👧", "\x1c\x1d a b\x85c", "mother's day!!! ...!?", "naïve café über straße", "\0a \0", "a​b", "한국어 ১২৩", "'s 'S '", "#" * 700]


@pytest.fixture(scope="module")
def pair():
    return bpe.Bpe(open(bpe.default_model(), encoding="utf-8").read()), tokenizers.Tokenizer.from_file(bpe.default_model())


def same(ours, theirs, texts):
    got = ours.encode_batch(texts)
    for text, ids in zip(texts, got, strict=True):
        want = theirs.encode(text, add_special_tokens=False).ids
        assert ids == want, text[:80]
        assert ours.decode(ids) == theirs.decode(want, skip_special_tokens=False), text[:80]


def test_like_the_library(pair):
    same(*pair, ODD)


def test_every_code_point(pair):
    signs = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0200))]
    ours, theirs = pair
    for at in range(0, len(signs), 4096):
        texts = [f"a{c}b" for c in signs[at : at + 4096]]
        assert ours.encode_batch(texts) == [x.ids for x in theirs.encode_batch(texts, add_special_tokens=False)]


def test_random_letters_and_marks(pair):
    rng = random.Random(3)
    pool = [c for c in map(chr, (*range(0xD800), *range(0xE000, 0x20000))) if c.isalpha() or pair[0].moves(c)]
    texts = ["".join(rng.choices(pool, k=rng.randint(1, 9))) for _ in range(6000)]
    assert pair[0].encode_batch(texts) == [x.ids for x in pair[1].encode_batch(texts, add_special_tokens=False)]


def test_long_words(pair):
    rng = random.Random(4)
    same(*pair, ["".join(rng.choices("abcdeé", k=n)) for n in (5, 6, 7, 9, 10, 11, 31, 32, 33, 63, 64, 65, 200, 5000)])


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="another kind"):
        bpe.split_pattern({"normalizer": None, "pre_tokenizer": None, "decoder": None, "added_tokens": []})


def test_random_words(pair):
    rng = random.Random(5)
    parts = ["th", "er", "ing", "the", "an", "é", "ß", "ción", "'", "s", "t", "a", "e", "0", "9", " ", ".", "un", "qu", "lich", "sch"]
    same(*pair, ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(1500)])
    ours = pair[0]
    assert 0 < ours.exact_words < ours.greedy_words  # both ways are used


def test_every_token_alone_is_judged_as_merging_does(pair):
    ours = pair[0]
    rng = random.Random(1)
    for a, b in ((rng.randrange(40000), rng.randrange(40000)) for _ in range(3000)):
        if ours.suffix in ours.tokens[a] or not (ours.sound[a] and ours.sound[b]):
            continue
        text = ours.tokens[a] + ours.tokens[b]
        end = text.endswith(ours.suffix)
        if not end:
            continue
        back = {c: k for k, c in ours.letters.items()}
        raw = bytes(back[c] for c in text.removesuffix(ours.suffix))
        try:
            word = raw.decode()
        except UnicodeDecodeError:
            continue
        assert (ours.merged(word) == (a, b)) == ours.apart(np.array([a]), np.array([b]))[0], text


def test_cache_is_bounded(pair, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    ours = bpe.Bpe(open(bpe.default_model(), encoding="utf-8").read())
    same(ours, pair[1], [" ".join(f"w{i}x{j}" for i in range(40)) for j in range(5)])
    assert len(ours.young) + len(ours.old) <= 600


def test_query_and_columns(spark, tmp_path):
    rows = [(1, "Hello hello", "x"), (2, None, "y"), (None, "", "z"), (1, "Hello hello", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, bpe.op1_bpe(spark, str(tmp_path)).collect()), key=str)
    empty = hashlib.sha256(b"").hexdigest()
    assert [r[:2] for r in got] == [(1, 2), (1, 2), (2, 0), (None, 0)] and got[2][2:] == (empty, empty)
    back = bpe.decode(bpe.encode(df)).where("doc_id = 1").first()
    assert back["token_ids"] and back["decoded"] == "hello</w> hello</w>" and back["n_tokens"] == "x"
    assert bpe.digests(df.limit(0)).count() == 0
