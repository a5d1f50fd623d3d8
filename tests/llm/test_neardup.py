import random

import numpy as np

from simloom.llm import neardup, registry, shingles


def words(text):
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]


def brute(rows):
    """Sets of shingle strings, every pair compared."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    first = {}
    for (d, _), s in zip(rows, sets, strict=True):
        if s:
            first.setdefault(frozenset(s), d)
            first[frozenset(s)] = min(first[frozenset(s)], d)
    keys = list(first)
    label = {k: first[k] for k in keys}
    edges = []
    post = {}
    for k, s in enumerate(keys):
        common = {}
        for x in s:
            for j in post.get(x, ()):
                common[j] = common.get(j, 0) + 1
            post.setdefault(x, []).append(k)
        edges += [(k, j) for j, c in common.items() if 100 * c >= 75 * (len(s) + len(keys[j]) - c)]
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[keys[a]], label[keys[b]])
            changed |= label[keys[a]] != m or label[keys[b]] != m
            label[keys[a]] = label[keys[b]] = m
    out = []
    for (d, _), s in zip(rows, sets, strict=True):
        c = label[frozenset(s)] if s else d
        out.append((d, len(s), c, d == c))
    return sorted(out)


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got(registry.op7_minhash_near_dedup(spark, sf_dir)) == brute(rows)


def test_dense_group_with_small_blocks(spark):
    rng = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for d in range(400):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((d * 3 + 1, " ".join(w)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(neardup.near_duplicates(df, block=16)) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one\ttwo"), (6, "a b c d e f"), (7, "A B C D E F"), (7, "A B C D E F"), (8, "z " * 40_000), (9, "z " * 30_000), (10, "É b c d e"), (11, "é b c d e"), (12, "a b c d e")]
    df = spark.createDataFrame([(*r, 0, "k") for r in rows] + [(None, "a b c d e f", 1, "k"), (None, None, 1, "k")], "doc_id long, text string, n int, key string")
    out = neardup.near_duplicates(df)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.where("doc_id is not null").collect()) == brute(rows)
    assert [(r.component_id, r.kept) for r in out.where("doc_id is null").collect()] == [(None, True)] * 2
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = np.unique(pool[:3000]), np.unique(pool[600:3600])
    s = shingles.sketches([a, b, pool[:1], np.unique(pool[:40])], 300)
    assert (s != np.iinfo(np.uint64).max).all()
    assert abs((s[0] == s[1]).mean() - 2400 / 3600) < 0.1
    assert len(set(s[2].tolist())) == 300
    one = shingles.sketches([b], 300)
    assert (one[0] == s[1]).all()
