import hashlib
import math
import random
import re
import zlib

import pytest
from foliant.llm import pii

LUHN = lambda d: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    """The base spans by the contract's words, with plain regular expressions."""
    out = []
    for k, p in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 12 <= len(digits) <= 19 and LUHN(digits) or k == 3 and 9 <= len(digits) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_patterns_like_plain_ones():
    rng = random.Random(2)
    parts = ["a.b", "@", "mail", ".com", ".", "-", " ", "1", "255", "256", "0", "4111 1111 1111 1111", "4111-1111", "+1 (555) 010-", "+", "(", ")", "é", "😀", "x@y.z", "10.0.0.1", "00000000001", "\n"]
    for _ in range(6000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        assert [s for s in pii.pattern_spans(text) if s[1] < 4] == plain(text), text


def test_parts_of_runs():
    text = "call +1 (269) 555-3296 4524132264652876 now"
    found = {(pii.KINDS[k], text[s:e]) for s, k, e in pii.pattern_spans(text)}
    assert ("phone_part", "+1 (269) 555-3296") in found and pii.luhn("4524132264652876") == (("card_part", "4524132264652876") in found)
    assert ("card_part", "4111111111111111") in {(pii.KINDS[k], "x 555-12 4111111111111111 y 555"[s:e]) for s, k, e in pii.pattern_spans("x 555-12 4111111111111111 y 555")}


def test_long_texts_take_linear_time():
    for text in ["a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "a@" * 100_000, "@a" * 100_000]:
        pii.pattern_spans(text)


def corpus(spark):
    rows = [(i, f"plain words about nothing number{'abcdefgh'[i % 8]} here and there") for i in range(300)]
    rows += [(1100 + i, f"{w} asked Zanzibarian office at john.doe@example.com {v} today") for i, (w, v) in enumerate([("someone", "once"), ("nobody", "twice"), ("everybody", "again"), ("anyone", "later")])]
    rows += [(1200, "the zanzibarian was seen"), (None, None), (1201, ""), (1200, "the zanzibarian was seen")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' terms")


@pytest.mark.parametrize("sent", [pii.SENT_TERMS, 0])
def test_disclosing_terms(spark, sent):
    df = corpus(spark)
    got = {r["doc_id"]: r for r in pii.personal_data(df, sent_terms=sent).collect()}
    assert pii.personal_data(df, sent_terms=sent).count() == df.count()
    assert re.fullmatch(r"(term|revealing):4:15", got[1200]["spans"])
    assert "email:" in got[1100]["spans"] and got[1100]["n_email"] == 1
    assert got[0]["spans"] == "" and got[None]["spans"] == ""
    text = df.where("doc_id = 1101").first()["text"]
    assert got[1101]["base_sha256"] == hashlib.sha256(pii.joined(plain(text)).encode()).hexdigest()
    clean = pii.sanitise(df, sent_terms=sent)
    assert clean.columns == df.columns and clean.count() == df.count()
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert "zanzibarian" not in texts[1200] and "<EMAIL>" in texts[1100] and texts[None] is None and texts[1201] == ""
    assert texts[0] == df.where("doc_id = 0").first()["text"]


def near_words(text, s, spans):
    """The five words on each side of the span that touch no span, from the list of all words."""
    words = [m for m in pii.WORD.finditer(text) if not any(a < m.end() and m.start() < b for a, _, b in spans)]
    return [m[0].lower() for m in [m for m in words if m.end() <= s[0]][-5:] + [m for m in words if m.start() >= s[2]][:5]]


def told(texts):
    """The terms by the docstring's formula: sets of documents, counted one by one."""
    n, with_e, near, around = len(texts), {}, {}, {}
    for d, t in enumerate(texts):
        spans = plain(t)
        for s in spans:
            e = pii.entity_of(t, s)
            words = near_words(t, s, spans)
            with_e.setdefault(e, set()).add(d)
            for w in words:
                near.setdefault((e, w), set()).add(d)
                around.setdefault((e, w), {}).setdefault(d, set()).add(zlib.crc32(" ".join(words).encode()))
    out = {}
    for (e, w), docs in near.items():
        n_t = sum(w in set(pii.WORD.findall(t.lower())) for t in texts)
        share = math.log(len(docs) * n / (n_t * len(with_e[e]))) / math.log(n / len(with_e[e]))
        c = len({min(x) for x in around[e, w].values()})
        if share * c / (c + 0.5) >= 0.8 - 1e-9:
            out[w] = out.get(w, False) or share >= 0.999
    return out


def test_share_like_brute_force(spark):
    rng = random.Random(8)
    names, words = ["Quentin", "Rosalind", "Ulrike"], ["plain", "words", "here", "about", "office", "letter", "nothing", "today"]
    rows = [f"{' '.join(rng.choices(words, k=8))} {rng.choice(names)} {' '.join(rng.choices(words, k=rng.randint(0, 7)))}" for _ in range(9)]
    for k, name in enumerate(names):
        for _ in range(8):
            some = [*rng.choices(words, k=6), name, f"mail{k}@example.org", *rng.choices(words, k=2)]
            rows.append(" ".join([*some, *rng.choices([*words, f"mail{k}@example.org", name], k=6)]))
    rows += [""] * 300
    for texts in ([r["text"] or "" for r in corpus(spark).collect()], rows):
        got = pii.disclosing_terms(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string"))
        assert {r["term"]: r["revealing"] for r in got.collect()} == told(texts) and told(texts)


def test_one_document_proves_nothing(spark):
    rows = ["ask Zebedee now at a@b.cd first, then Zebedee again or a@b.cd please, last Zebedee called from a@b.cd there"] + ["other words"] * 60
    assert pii.disclosing_terms(spark.createDataFrame(list(enumerate(rows)), "id long, text string")) is None
    assert sum(w == "zebedee" for e, w, _ in pii.contexts(rows[0]) if e) == 1


def test_words_far_away_stay_whole():
    text = "Zanzibarian" + " " * 195 + "a@b.cd" + " " * 900 + "Otherland"
    assert {w for _, w, _ in pii.contexts(text)} == {"", "zanzibarian", "otherland"}


def test_copies_are_one_context(spark):
    df = spark.createDataFrame([(i, "meet Quibbler at a@b.cd soon") for i in range(9)] + [(i, "other words") for i in range(20, 60)], "id long, text string")
    assert pii.disclosing_terms(df) is None


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.personal_data(df).count() == 0 == pii.sanitise(df).count()
