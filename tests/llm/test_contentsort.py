import random

from helpers_llm import same

from simloom.llm import contentsort, registry


def brute(rows):
    groups = {}
    for k, (doc_id, text) in enumerate(rows):
        t = text or ""
        groups.setdefault("".join(c for c in t if c not in " \t\n\v\f\r"), []).append((-len(t), doc_id is None, doc_id or 0, k))
    out = [None] * len(rows)
    for g in groups.values():
        g.sort()
        for at, (_, _, _, k) in enumerate(g):
            out[k] = (rows[k][0], rows[g[0][3]][0], len(g), at == 0)
    return sorted(out, key=repr)


def test_oracle(spark, sf_dir):
    same(registry.op4_exact_dedup(spark, sf_dir), registry.ORACLES["op4_exact_dedup"], sf_dir)


def test_hot_group_spans_partitions(spark):
    rng = random.Random(3)
    rows = [(k, "a common text\n of some length" + " " * rng.randint(0, 2) if rng.random() < 0.6 else f"text {rng.randint(0, 300)}") for k in range(4000)]
    rows += [(None, "same"), (None, "same"), (7, "same"), (7, "same"), (8, None), (9, ""), (10, " \t\v\f\r\n"), (11, "x" * 200_000), (12, "x" * 200_000 + " "), (13, "nbsp "), (14, "nbsp")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kept", "2 as n", "'p' as part").repartition(5)
    got = contentsort.dedup(df).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=repr) == brute(rows)
    stay = contentsort.keep_first(df)
    assert stay.columns == df.columns and stay.count() == sum(r.kept for r in got)
    assert contentsort.dedup(df.limit(0)).count() == 0


def test_chains():
    fact = lambda part, edge, n: {"part": part, "edge": edge, "keep_id": part * 10, "n": n}
    facts = {(0, "f"): fact(0, "f", 1), (0, "l"): fact(0, "l", 2), (2, "f"): fact(2, "fl", 3), (2, "l"): fact(2, "fl", 3), (3, "f"): fact(3, "f", 4), (3, "l"): fact(3, "l", 5), (4, "f"): fact(4, "fl", 6), (4, "l"): fact(4, "fl", 6)}
    assert contentsort._chains([0, 2, 3, 4], facts, {2, 3}) == [(0, "l", 0, 9, True), (2, "fl", 0, 9, False), (3, "f", 0, 9, False)]
    assert contentsort._chains([0, 2, 3, 4], facts, set()) == []


def test_keep_first_takes_the_longest_and_all_columns(spark):
    """Rows of one id and normalised text: the most code points stay, in any order of rows and over many partitions."""
    rows = [(1, "a b", {"x": 1}, "p"), (1, "a    b", {"x": 2}, "q"), (2, "ab", None, "r"), (3, None, None, "s"), (4, " \t", {}, None), (None, "c", None, "t"), (5, "c", None, "u"), (6, "c", None, "v")]
    rows += [(10 + k, "same text", None, "w") for k in range(3000)] + [(5000 + k, f"text {k % 700}", None, "x") for k in range(2000)]
    wanted = None
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, digest map<string,int>, part string").repartition(7)
        got = contentsort.keep_first(df)
        assert got.columns == df.columns and got.schema["digest"].dataType == df.schema["digest"].dataType
        kept = sorted((repr(tuple(r)) for r in got.collect()))
        assert wanted in (None, kept)
        wanted = kept
    ids = {r.doc_id: r for r in got.collect()}
    assert len(kept) == 4 + 700 and ids[1].text == "a    b" and ids[1].digest == {"x": 2} and ids[4].text == " \t" and 5 in ids and None not in ids and 10 in ids
    want = {r.doc_id for r in contentsort.dedup(df).where("kept").collect()}
    assert set(ids) == want
    assert contentsort.keep_first(df.limit(0)).count() == 0
