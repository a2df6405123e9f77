import pytest
from foliant.llm import bpe, decontam, langid, pii

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_like_a_plain_version(spark):
    from test_near_sets import kept as one_of_each

    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    model = langid.fit(docs)
    usual = langid.usual_rates(docs, model)
    kept = [r for r, lang, rate, n in zip(rows, *[x for k, x in enumerate(model.judged([r["text"] for r in rows])) if k != 1], strict=True) if lang != "und" and (usual[lang][0] - rate - 5 / n**0.5) / max(usual[lang][1], 0.02) <= 16]
    stay = set(one_of_each([(r["doc_id"], r["text"]) for r in kept]))
    kept = [r for r in kept if r["doc_id"] in stay]
    items = decontam.Items([tuple(r) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()])
    kept = [r for r in kept if not items.links(r["text"])]
    frame = spark.createDataFrame([(r["doc_id"], r["text"]) for r in kept], "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in pii.sanitise(frame).collect()}
    encoder = bpe.Bpe(open(bpe.default_model(), encoding="utf-8").read())
    want = {d: encoder.encode_batch([t])[0] for d, t in texts.items()}
    assert {r["doc_id"]: r["token_ids"] for r in corpus_pipeline.run(spark, path).collect()} == want
    assert 0 < len(want) < len(rows)
    for t in texts.values():
        assert not [s for s in pii.pattern_spans(t) if s[1] < 4]


def test_stages(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "the cat and the dog", "en", "s", 19)], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "7 extra", "8 _fp", "9 _key", "1.5 _score", "'x' _lang_pred", "'y' terms")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        assert all(r["_fp"] == 8 and r["_key"] == 9 and r["_lang_pred"] == "x" for r in out.collect()), name
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0, name


def test_texts_of_no_learned_language_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    italian = "nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita ahi quanto a dir qual era e cosa dura " * 3
    junk = "xkqzj wvvkq zzxqj kkwjx qqzvx jjkwz vxqkz " * 12
    more = spark.createDataFrame([(-1, italian, "en", "s", 0), (-2, junk, "en", "s", 0), (-3, "the", "en", "s", 0), (-4, "при свете " * 30, None, "s", 0)], docs.schema)
    gone = {r["doc_id"] for r in docs.unionByName(more).join(corpus_pipeline.language(spark, docs.unionByName(more), "").select("doc_id"), "doc_id", "left_anti").collect()}
    assert {-1, -2, -4} <= gone and -3 not in gone
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(not texts[d] or not any(c.isalpha() for c in texts[d]) for d in gone - {-1, -2, -4})
