import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from simloom.llm import packing, registry
from simloom.llm.wordtokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, ids, tokens=2048, slack=8):
    """Each id in exactly one piece, no gap in a sequence, little padding."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for k, mine in by_doc.items():
        at = 0
        for r in sorted(mine, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[k])
            at += r.length
        assert at == len(ids[k])
    for mine in by_seq.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= tokens and (at & (at - 1) == 0 or tokens - at < slack)


def test_word_cache_equals_encoder():
    t = Tokenizer.from_file(PATH)
    texts = ["", " ", "Héllo  WORLD\n\n\tit's 42!!", "a\x1cb \x01 c\x01d", "ΟΔΥΣΣΕΎΣ İstanbul é é", "<|endoftext|> x<|endoftext|>Y <|ENDOFTEXT|>", "日本語 テキスト x y\r\nz", "😀😀 ́ a", "K ſ ﬁ"]
    w = WordTokenizer(PATH, keep=3)
    for _ in range(3):
        for some in (texts, texts[::-1]):
            assert [x.tolist() for x in w.encode(some)] == [t.encode(x, add_special_tokens=False).ids for x in some]


def test_query_against_brute_force(spark, sf_dir):
    t = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    ids = {r.doc_id: np.array(t.encode(r.text or "", add_special_tokens=False).ids + [1], dtype="<u4") for r in docs}
    rows = registry.op1_packing(spark, sf_dir).collect()
    check(rows, ids)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())


def test_limits_hold_in_every_dimension():
    lim = packing.Limits(tokens=64, segments=4, loss_tokens=20, pool=16, least_cut=4)
    rng = np.random.default_rng(7)
    p = packing.Packer(lim)
    items = {}
    for k in range(300):
        n = int(rng.integers(1, 150))
        items[k] = (np.arange(n, dtype="<u4"), int(rng.integers(0, n + 1)))
        p.add(packing.Item(k, *items[k]))
    p.finish()
    seqs, docs = {}, {}
    for d, start, length, _, _, s, _, loss in p.rows:
        q = seqs.setdefault(s, [0, 0, 0])
        q[0] += length
        q[1] += 1
        q[2] += loss
        docs.setdefault(d, []).append((start, length))
    assert all(a <= 64 and b <= 4 and c <= 20 for a, b, c in seqs.values())
    for k, (ids, _) in items.items():
        at = 0
        for start, length in sorted(docs[k]):
            assert start == at
            at += length
        assert at == len(ids)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "some text", "z"), (4, "a", "a"), (4, "a", "a"), (5, "word " * 30000, "q")], "doc_id long, text string, length string")
    rows = packing.pack_texts(df, PATH).collect()
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {1: 1, 2: 1, None: 3, 4: 4, 5: 30001}
    assert packing.pack_texts(df.limit(0), PATH).count() == 0
    items = spark.createDataFrame([(1, None, 0), (2, bytearray(b""), None), (3, bytearray(b"\1\0\0\0"), None)], "doc_id long, ids binary, loss_from long")
    assert [(r.doc_id, r.length, r.loss_tokens) for r in packing.pack(items).collect()] == [(3, 1, 1)]
