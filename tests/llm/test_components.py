import random

from simloom.llm.components import components


def brute(edges):
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def test_random_paths_and_stars(spark):
    rng = random.Random(5)
    path = [(k, k + 1) for k in range(1000, 1100)]
    rng.shuffle(path)
    edges = path + [(2000, 2000 + k) for k in range(1, 300)] + [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(180)]
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges]
    df = spark.createDataFrame(edges + edges[:20] + [(1, None), (None, None), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    want = {k: v for k, v in brute([e for e in edges if e[0] != e[1]]).items()}
    assert got == want


def test_none(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert components(df).count() == 0
