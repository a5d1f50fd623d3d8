import math
import random
import zlib

from pyspark.sql import functions as F

from simloom.llm import langid, registry


def naive(text, samples):
    """Cross-parsing by plain substring search: phrases of each language."""
    t = langid.plain(text)
    out = {}
    for lang, s in samples.items():
        n = k = 0
        while k < len(t):
            end = k + 1
            while end <= len(t) and t[k:end] in s:
                end += 1
            k = max(k + 1, end - 1)
            n += 1
        out[lang] = n
    return t, out


def test_against_substring_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    samples = registry.learnt(docs)
    small = {k: v[:3000] for k, v in samples.items()}
    parser = langid.CrossParser(small)
    texts = [r.text for r in docs.where("length(text) < 3000").limit(60).collect()] + ["日本 x", "a", "123", "ß É", "the " * 700]
    for text, (lang, score) in zip(texts, parser.predict(texts), strict=True):
        if not langid.plain(text):
            assert (lang, score) == ("und", 0)
            continue
        t, phrases = naive(text, small)
        bits = {k: n * math.log2(len(small[k])) / len(t) for k, n in phrases.items()}
        best, other = sorted(bits.values())[:2]
        assert abs(score - other / (best + other)) < 1e-9
        assert bits[lang] == best


def test_blocks_leave_no_mark(monkeypatch):
    rng = random.Random(3)
    samples = {"x": "".join(rng.choice("ab ") for _ in range(400)), "y": "a" * 50 + " b" * 60, "z": "".join(rng.choice("abcd") for _ in range(900))}
    # Texts whose blocks never meet the walk that goes on into them: runs of one letter, and parts of a sample.
    texts = ["a" * 700, "b a" * 300, samples["z"][100:800], samples["z"][5:600] + "é" + samples["x"], "".join(rng.choice("abcdé ") for _ in range(2000)), "q", "aab", " "]
    for block in (1, 7, 64):
        monkeypatch.setattr(langid.CrossParser, "BLOCK", block)
        parser = langid.CrossParser(samples)
        got, size = parser.phrases(texts)
        for text, row, n in zip(texts, got, size, strict=True):
            t, phrases = naive(text, samples)
            assert n == len(t) and row.tolist() == [phrases[k] for k in parser.langs], (block, text[:20])


def test_many_languages_and_large_scripts():
    rng = random.Random(5)
    words = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(60)] for k in range(50)}
    han, kana = [chr(0x4E00 + k) for k in range(4000)], [chr(0x5E00 + k) for k in range(4000)]
    words |= {"han": han, "kana": kana}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    parser = langid.CrossParser({k: text(k, 2000) for k in words})
    asked = [(k, text(k, 40)) for k in words for _ in range(3)]
    got = parser.predict([t for _, t in asked])
    assert sum(k == g[0] for (k, _), g in zip(asked, got, strict=True)) >= 0.99 * len(asked)
    assert sum(len(a.keys) * 12 for a in parser.automata) < 52 * 3_000_000


def test_held_out_accuracy(spark, sf_dir):
    got = registry.op10_language_id(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    rows = got.join(docs, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert got.count() == docs.count()


def test_edges(spark):
    rows = [(1, "the cat sat on the mat " * 20, "en"), (2, "der hund und die katze " * 20, "de"), (3, None, "en"), (4, "", "de"), (5, "12 !!", None), (None, "the cat", None), (1, "the cat sat on the mat " * 20, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = langid.sample(df)
    assert set(samples) == {"en", "de"}
    got = df.select(langid.identify(F.col("text"), samples).alias("x")).select("x.*").collect()
    assert [r.lang for r in got] == ["en", "de", "und", "und", "und", "en", "en"] and all(0 <= r.score <= 1 for r in got)
    assert langid.sample(df.limit(0)) == {}
    assert [r.x.lang for r in df.select(langid.identify(F.col("text"), {}).alias("x")).collect()] == ["und"] * 7
    assert df.limit(0).select(langid.identify(F.col("text"), samples).alias("x")).count() == 0
