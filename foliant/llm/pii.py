"""Personal data: pattern spans, and terms that disclose whom a text is about.

Patterns find protected entities (e-mail and IP addresses, card and phone numbers). The WINDOW words on each side of an
entity's mentions are then weighed over the whole corpus: a term t discloses an entity e to the share

    log(n(t, e) N / (n(t) n(e))) / log(N / n(e))

of e's information, n counting documents that have the term, the entity, or the term near the entity. As little
evidence proves little, the share is smoothed: it counts c / (c + DOUBT) of itself, c being the number of documents
with different surroundings (copies of a text share theirs, and a document counts once). A term whose smoothed share reaches GENERALISE
is a span of kind ``term``, wherever it stands in the corpus; one whose share tells
all (REMOVE) is of kind ``revealing``. sanitise() replaces the former and takes out the latter. A single document can't tell
a term that discloses from one that is merely rare, so nothing is marked on the word of one.

Where two pieces of personal data run together, a pattern's match fails its check; the parts that pass
on their own are spans of kinds ``card_part`` and ``phone_part``.

Null texts count as empty. Repeated rows get the same spans; a null id keeps its rows. Spans are in code
points, end exclusive. Ties in order go by start, kind, end. Only the id and text columns are read. An empty table
gives an empty one; time is linear in a text's length.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import Sent, checkpoint, filter_bits, map_arrow, maybe_in, table

KINDS = ("email", "ip", "card", "phone", "card_part", "phone_part", "term", "revealing")
BASE = KINDS[:4]
WINDOW = 5
DOUBT = 0.5
GENERALISE = 0.8
REMOVE = 0.999
#: Up to so many disclosing terms are sent to all workers as they are; more are met by a join.
SENT_TERMS = 100_000
#: Terms whose counts a task adds up at once.
COUNTED = 500_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
GROUP = re.compile(r"[0-9]+")
WORD = re.compile(r"[^\W\d_]{3,}")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: from each @ back over the local part, so that time is linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((start, m.end()))
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def card_parts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Of a run of digit groups that is no card as a whole: consecutive whole groups that are one, the longest first."""
    groups = [m.span() for m in GROUP.finditer(text, start, end)]
    out, at = [], 0
    while at < len(groups):
        found, digits = None, ""
        for k in range(at, len(groups)):
            digits += text[groups[k][0] : groups[k][1]]
            if len(digits) > 19:
                break
            if len(digits) >= 13 and luhn(digits):
                found = k
        if found is not None:
            out.append((groups[at][0], groups[found][1]))
            at = found
        at += 1
    return out


def phone_part(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The longest beginning of whole groups with 9 to 15 digits."""
    digits, last = 0, None
    for m in GROUP.finditer(text, start, end):
        digits += m.end() - m.start()
        if digits > 15:
            break
        if digits >= 9:
            last = m.end()
    return [(start, last)] if last else []


def pattern_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end), sorted."""
    out: list[tuple[int, int, int]] = []
    if not text:
        return out
    if "@" in text:
        out += [(s, 0, e) for s, e in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() < 12:
                continue
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
            else:
                out += [(s, 4, e) for s, e in card_parts(text, *m.span())]
        if "+" in text:
            for m in PHONE.finditer(text):
                n = sum(c.isdigit() for c in m[0])
                if 9 <= n <= 15:
                    out.append((m.start(), 3, m.end()))
                elif n > 15:
                    out += [(s, 5, e) for s, e in phone_part(text, *m.span())]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def entity_of(text: str, span: tuple[int, int, int]) -> str:
    s, k, e = span
    return f"{KINDS[k]}:" + (text[s:e].lower() if k == 0 else text[s:e] if k == 1 else "".join(GROUP.findall(text[s:e])))


def contexts(text: str | None) -> list[tuple[str, str, int]]:
    """(entity, term, context) for each base entity and word near it, once for a text; also (entity, "", 0) for each entity and ("", term, 0) for each word."""
    spans = [s for s in pattern_spans(text) if s[1] < len(BASE)]
    if not spans:
        return []
    words: list[tuple[int, int]] = []
    at = furthest = 0
    for m in WORD.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            furthest = max(furthest, spans[at][2])
            at += 1
        if furthest <= m.start():
            words.append(m.span())
    starts, found = [w[0] for w in words], {}
    for s in spans:
        entity = entity_of(text, s)
        found[entity, ""] = 0
        k = bisect.bisect_left(starts, s[0])
        near = [text[a:b].lower() for a, b in words[max(0, k - WINDOW) : k + WINDOW]]
        context = zlib.crc32(" ".join(near).encode("utf-8", "surrogatepass"))
        for w in near:
            found[entity, w] = min(context, found.get((entity, w), context))
            found["", w] = 0
    return sorted((e, w, c) for (e, w), c in found.items())


def disclosing_terms(rows: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, doubt: float = DOUBT) -> DataFrame | None:
    """(term, revealing) of the terms that disclose an entity, from all of ``rows`` (id, text); None if there is none.

    Candidates come from the entities' surroundings: those that could reach the bound even if they stood nowhere else. Document
    counts are taken over all documents, in a pass that emits only words that a filter of fixed size lets by, added up by each task.
    """

    def near(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = [x for t in batch.column("text").to_pylist() for x in contexts(t)]
        if not found:
            return None
        columns = list(zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.int64())], ["entity", "term", "context"])

    seen = map_arrow(rows.select("text"), near, "entity string, term string, context long")
    seen = seen.groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("n"))
    seen = checkpoint(seen.groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.count(F.lit(1)).alias("n_contexts")))
    total = float(rows.count())
    trust = F.col("n_contexts") / (F.col("n_contexts") + doubt)
    share = lambda n_t: F.log(F.col("n_te") * total / (F.col(n_t) * F.col("n_e"))) / F.log(total / F.col("n_e"))
    pairs = seen.where((F.col("entity") != "") & (F.col("term") != "") & (trust >= generalise - 1e-9))  # no share is above 1
    n_e = seen.where("term = ''").select("entity", F.col("n_te").alias("n_e")).where(F.col("n_e") < total)
    n_near = seen.where("entity = ''").select("term", F.col("n_te").alias("n_near"))
    pairs = pairs.join(n_e, "entity").join(n_near, "term").where(share("n_near") * trust >= generalise - 1e-9)
    pairs = checkpoint(pairs.select("entity", "term", "n_te", "n_e", "n_contexts"))
    terms = pairs.select("term").distinct()
    bits = filter_bits(terms)
    if not bits.any():
        return None
    sent = rows.sparkSession.sparkContext.broadcast(bits.tobytes())

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, counts = sent.value, {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])
            counts.clear()
            return made

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for text in batch.column(0).slice(at, 512).to_pylist():
                    for w in set(WORD.findall(text.lower())) if text else ():
                        if maybe_in(bits, w):
                            counts[w] = counts.get(w, 0) + 1
                if len(counts) > COUNTED:
                    yield out()
        yield out()

    n_t = rows.select("text").mapInArrow(words, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    found = pairs.join(n_t, "term").withColumn("share", share("n_t")).where(F.col("share") * trust >= generalise - 1e-9)
    told = checkpoint(found.groupBy("term").agg((F.max("share") >= remove - 1e-9).alias("revealing")))
    return None if told.isEmpty() else told


def word_spans(text: str | None, kind_of: Callable[[str], int | None]) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the words that ``kind_of`` gives one."""
    out, known = [], {}
    for m in WORD.finditer(text) if text else ():
        w = m[0].lower()
        if w not in known:
            known[w] = kind_of(w)
        if known[w] is not None:
            out.append((m.start(), known[w], m.end()))
    return out


def _sent_terms(terms: DataFrame | None, most: int) -> Sent | None:
    """The kind of each term for all workers, if they are few; else None."""
    if terms is None or terms.count() > most:
        return None
    kinds = {r["term"]: KINDS.index("revealing" if r["revealing"] else "term") for r in terms.collect()}
    return Sent(terms.sparkSession, kinds)


def term_spans(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, th, terms): the terms' spans, (start, kind, end), in each text that has any; th is the text's xxhash64."""
    sent = rows.sparkSession.sparkContext.broadcast(filter_bits(terms).tobytes())

    def hits(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits, at, out = sent.value, [], []
        for k, text in enumerate(batch.column("text").to_pylist()):
            for start, _, end in word_spans(text, lambda w: 0 if maybe_in(bits, w) else None):
                at.append(k)
                out.append((text[start:end].lower(), start, end))
        columns = list(zip(*out, strict=True)) or [[], [], []]
        of = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("id").take(of), batch.column("th").take(of), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["id", "th", "term", "start", "end"])

    keyed = rows.select("id", F.xxhash64("text").alias("th"), "text")
    found = map_arrow(keyed, hits, f"id {rows.schema['id'].dataType.simpleString()}, th long, term string, start long, end long")
    kind = F.when(F.col("revealing"), KINDS.index("revealing")).otherwise(KINDS.index("term")).cast("long")
    return found.join(terms, "term").groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct("start", kind.alias("kind"), "end"))).alias("terms"))


def _with_terms(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` (id, th, ...) with the column terms; null where a text has none."""
    spans = spans.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "terms")
    return rows.join(spans, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left").drop("_id", "_th")


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sent_terms: int = SENT_TERMS) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), a row for each row of ``df``."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    terms = disclosing_terms(rows)
    few = _sent_terms(terms, sent_terms)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        kind_of = few.value.get if few else None
        added = batch.column("terms").to_pylist() if "terms" in batch.schema.names else [None] * len(texts)
        counts, digests, spans = [[] for _ in BASE], [], []
        for text, more in zip(texts, added, strict=True):
            found = pattern_spans(text)
            base = [s for s in found if s[1] < len(BASE)]
            for k, column in enumerate(counts):
                column.append(sum(s[1] == k for s in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            told = word_spans(text, kind_of) if kind_of else [(x["start"], x["kind"], x["end"]) for x in more or ()]
            spans.append(joined(sorted(found + told)))
        return pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(spans)], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    schema = f"doc_id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    if terms is not None and not few:
        rows = _with_terms(rows.withColumn("th", F.xxhash64("text")), term_spans(rows, terms))
    return map_arrow(rows, each, schema)


def cleaned(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with its spans replaced; spans that overlap become one, named after the first; revealing terms go."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s, k, e in spans:
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(e, merged[-1][2])
        else:
            merged.append([s, k, e])
    for s, k, e in merged:
        out += [text[at:s], "" if KINDS[k] == "revealing" else f"<{KINDS[k].removesuffix('_part').upper()}>"]
        at = e
    return "".join([*out, text[at:]])


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sent_terms: int = SENT_TERMS) -> DataFrame:
    """``df`` with personal data replaced in ``text_col``; null texts stay null."""
    names, schema = df.columns, df.schema
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    terms = disclosing_terms(rows)
    few = _sent_terms(terms, sent_terms)
    at = names.index(text_col)

    def text_without(text: str | None, told: list[tuple[int, int, int]]) -> str | None:
        found = sorted(pattern_spans(text) + told)
        return cleaned(text, found) if found else text

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        kind_of = few.value.get if few else None
        texts = [text_without(t, word_spans(t, kind_of) if kind_of else []) for t in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, batch.column(at).type), *batch.columns[at + 1 :]], names)

    if terms is None or few:
        return map_arrow(df, each, schema)
    full = df.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"))
    full = _with_terms(full, term_spans(rows.where("text is not null"), terms))

    def each_told(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = batch.column("row").flatten()
        told = [[(x["start"], x["kind"], x["end"]) for x in more or ()] for more in batch.column("terms").to_pylist()]
        texts = [text_without(t, x) for t, x in zip(columns[at].to_pylist(), told, strict=True)]
        return pa.RecordBatch.from_arrays([*columns[:at], pa.array(texts, columns[at].type), *columns[at + 1 :]], names)

    return map_arrow(full.select("row", "terms"), each_told, schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
