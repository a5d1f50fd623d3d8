import random

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from simloom.llm import pieces, registry

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  a", "Hello  world\n\n x\ty ", "é 😀 日本語 ▁literal▁ ﬁ", "\x00\x01 end", "<s> </s> <unk> <0x41>", "a" * 300 + " " + "b" * 20, " " * 70 + "x", "naïve façade, don't: (x+y)!=z.com/path_name"]


def test_without_dropout_equals_sentencepiece():
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    coder = pieces.PieceCoder(PATH, pieces.Dropout(0.0))
    for t in TEXTS:
        if "▁" not in t and "<" not in t:
            assert np.frombuffer(coder.encode([(1, t)])[0], dtype="<u4").tolist() == sp.encode(t), t


def test_lockstep_equals_heap():
    rng = random.Random(6)
    coder = pieces.PieceCoder(PATH, pieces.Dropout(0.3, seed=9))
    words = [(" " * rng.randint(0, 2) + "".join(rng.choice("etaoinshrdlu.,é日▁") for _ in range(rng.randint(1, 14))), rng.randint(0, 7)) for _ in range(800)]
    for k in range(0, 800, 50):
        some = sorted(words[k : k + 50], key=lambda w: len(w[0]))
        assert coder.lockstep(some) == [coder.heap_word(*w) for w in some]


def test_dropout_varies_and_decodes():
    texts = [*TEXTS, "the representation of international information " * 20]
    seen = set()
    for seed in range(4):
        coder = pieces.PieceCoder(PATH, pieces.Dropout(0.2, seed=seed), keep=10)
        ids = coder.encode([(5, t) for t in texts])
        assert ids == coder.encode([(5, t) for t in texts])
        assert [coder.decode(x) for x in ids] == texts
        seen.add(ids[-1])
    assert len(seen) == 4
    coder = pieces.PieceCoder(PATH, pieces.Dropout(0.2))
    some = {coder.encode([(k, " international")])[0] for k in range(60)}
    assert len(some) > 2
    assert len(coder.encode([(1, texts[-1])])[0]) > len(pieces.PieceCoder(PATH, pieces.Dropout(0.0)).encode([(1, texts[-1])])[0])
    everything = pieces.PieceCoder(PATH, pieces.Dropout(1.0)).encode([(1, "ab c")])[0]
    assert len(everything) == 4 * 5


def test_query(spark, sf_dir):
    got = registry.op6_sentencepiece(spark, sf_dir)
    assert got.where("not lossless").count() == 0
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    df = spark.createDataFrame([(1, None), (None, "a b"), (None, "a b"), (2, ""), (3, "x" * 100_000)], "doc_id long, text string")
    rows = df.select("text", pieces.encoded(F.col("text"), F.col("doc_id"), PATH).alias("ids")).withColumn("back", pieces.decoded(F.col("ids"), PATH)).collect()
    assert all(r.back == r.text for r in rows) and rows[1].ids == rows[2].ids and rows[0].ids is None
    assert df.limit(0).select(pieces.encoded(F.col("text"), F.col("doc_id"), PATH)).count() == 0


def test_every_occurrence_has_its_own_skips():
    word = " international"
    coder = pieces.PieceCoder(PATH, pieces.Dropout(0.1))
    plain = pieces.PieceCoder(PATH, pieces.Dropout(0.0))
    places = 20_000
    ids = coder.lockstep([(word, n) for n in range(places)])
    steps = int(plain.tree.steps[plain._reached([word], np.zeros(1, dtype=np.uint64))[0]])
    same = ids.count(plain.lockstep([(word, 0)])[0])
    # The agenda without a skip has ``steps`` steps, and some with skips end in the same pieces.
    assert 0.9**steps * 0.95 < same / places < 0.9**steps + 0.5 * (1 - 0.9**steps)
    assert len(set(ids)) > 20
    assert ids[:200] == [coder.heap_word(word, n) for n in range(200)]
    # The word at any place of one row, and the same row again in another batch.
    row = coder.encode([(7, word * 500)])[0]
    assert len({x for x in (coder.encode([(k, word)])[0] for k in range(300))}) > 8
    assert row == pieces.PieceCoder(PATH, pieces.Dropout(0.1), keep=3).encode([(3, "x y"), (7, word * 500)])[1]


def test_long_words_skip_by_place():
    coder = pieces.PieceCoder(PATH, pieces.Dropout(0.1))
    word = "representation" * 30
    ids = [coder.encode([(k, word)])[0] for k in range(20)]
    assert len(set(ids)) == 20 and all(coder.decode(x) == word for x in ids)
