import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import test_neardup
import test_secrets
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from simloom.llm import langid, registry, secrets, store

PLANTED = [
    (900001, None, "en", "s", 0),
    (900002, "12 34 !!", "en", "s", 8),
    (900003, "the words of a clean text about rivers and hills that nothing else repeats at all", "en", "s", 80),
    (900004, "the words of a clean text  about rivers and hills\nthat nothing else repeats at all", "en", None, 80),
    (900005, "a note with password=abcdef123 in it", None, "s", 36),
    (900005, "a note with password=abcdef123 in it", None, "s", 36),
    (None, "a text without id", "en", "s", 17),
]


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    docs = store.save(docs.unionByName(spark.createDataFrame(PLANTED, docs.schema)), "in")
    was = docs.collect()

    out = store.save(corpus_pipeline.language(spark, docs, sf_dir), "a")
    assert out.columns == list(corpus_pipeline.COLUMNS)
    rows = out.collect()
    parser = langid.CrossParser(registry.learnt(docs))
    named = lambda r: r.lang or parser.predict([r.text])[0][0]
    assert sorted(map(repr, rows)) == sorted(repr(type(r)(**(r.asDict() | {"lang": named(r)}))) for r in was if r.text and any(c.isalpha() for c in r.text))
    assert all(r.lang for r in rows) and not all(r.lang for r in was)
    plan = corpus_pipeline.language(spark, docs, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1

    was, docs = rows, out
    out = store.save(corpus_pipeline.exact(spark, docs, sf_dir), "b")
    rows = out.collect()
    best = {}
    for r in was:
        k = "".join(c for c in r.text if c not in " \t\n\v\f\r")
        if k not in best or (-len(r.text), r.doc_id is None, r.doc_id or 0) < best[k][0]:
            best[k] = ((-len(r.text), r.doc_id is None, r.doc_id or 0), r)
    assert sorted(map(repr, rows)) == sorted(repr(r) for _, r in best.values())
    assert {900004} == {r.doc_id for r in rows} & {900003, 900004}

    was, docs = rows, out
    out = store.save(corpus_pipeline.near(spark, docs, sf_dir), "c")
    rows = out.collect()
    kept = {d for d, *_, k in test_neardup.brute([(r.doc_id, r.text) for r in was if r.doc_id is not None]) if k}
    assert sorted(map(repr, rows)) == sorted(repr(r) for r in was if r.doc_id is None or r.doc_id in kept)

    was, docs = rows, out
    out = store.save(corpus_pipeline.redact(spark, docs, sf_dir), "d")
    rows = out.collect()

    def clean(text):
        parts, at = [], 0
        for a, _, b, _ in test_secrets.brute(text):
            if a >= at:
                parts.append(text[at:a] + "[secret]")
            at = max(at, b)
        return "".join(parts) + text[at:] if parts else text

    assert sorted(repr((r.doc_id, r.text, r.lang, r.source)) for r in rows) == sorted(repr((r.doc_id, clean(r.text), r.lang, r.source)) for r in was)
    assert secrets.scan(out).where(F.exists("spans", lambda s: s["kind"] == "assign")).count() == 0

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = corpus_pipeline.pack(spark, out, sf_dir).collect()
    ids = {}
    for p in sorted(pieces, key=lambda p: p.start):
        ids.setdefault(p.doc_id, []).extend(memoryview(bytes(p.ids)).cast("I").tolist())
    assert ids == {r.doc_id: t.encode(r.text, add_special_tokens=False).ids + [1] for r in rows}


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_batches_are_bounded_by_bytes(spark, monkeypatch):
    """What near and exact duplicates hand to Python is a few MB at once, however long the texts are; a lower limit is kept."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    docs = spark.range(0, 3000, 1, 1).selectExpr("id doc_id", "repeat(concat('word', id, ' '), 1000) text", "'en' lang", "'s' source", "0L n_chars")
    probe = docs.select("text").mapInArrow(sizes, "n long")
    found = [r.n for r in store.save(probe, "probe", small_batches=True).collect()]
    assert sum(found) > 20_000_000 and max(found) < 2 * store.BATCH_BYTES

    was, save = spark.conf.get(store.BATCH), store.save
    asked = []

    def noted(df, what, small_batches=False):
        if "MapInArrow" in df._jdf.queryExecution().optimizedPlan().toString():
            asked.append((what, small_batches))
        return save(df, what, small_batches)

    monkeypatch.setattr(store, "save", noted)
    corpus_pipeline.exact(spark, docs.limit(20), "")
    corpus_pipeline.near(spark, docs.limit(20), "")
    assert {"content-sort", "sketches", "sets", "links"} == {what for what, _ in asked} and all(small for _, small in asked)
    assert spark.conf.get(store.BATCH) == was
    try:
        spark.conf.set(store.BATCH, "1m")
        found = [r.n for r in save(probe, "probe", small_batches=True).collect()]
        assert max(found) < 2 << 20 and spark.conf.get(store.BATCH) == "1m"
    finally:
        spark.conf.set(store.BATCH, was)
