import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from simloom.config import MergeOptions, Options
from simloom.functions import numbers as N
from simloom.functions import text as T
from simloom.operators import frequency, matching, normalization, pairing, report, results, tokens
from simloom.sources import stored


def seqs(spark, *rows):
    return spark.createDataFrame([(k, list(w)) for k, w in enumerate(rows)], "sub long, words array<string>")


def scan_tiles(x, y, least):
    """Greedy tiling by repeated scans, straight from its definition."""
    marked_x, marked_y, out = [False] * len(x), [False] * len(y), []
    while True:
        best, found = least, []
        for i in range(len(x)):
            for j in range(len(y)):
                n = 0
                while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n] and not marked_x[i + n] and not marked_y[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j, n)]
                elif n == best:
                    found.append((i, j, n))
        done = True
        for i, j, n in found:
            if not any(marked_x[i : i + n]) and not any(marked_y[j : j + n]):
                out.append((i, j, n))
                marked_x[i : i + n] = marked_y[j : j + n] = [True] * n
                done = False
        if done:
            return sorted(out)


def test_tiles_equal_scans(spark):
    rng = random.Random(8)
    rows = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 30))) for _ in range(24)]
    df = seqs(spark, *rows)
    for k in (2, 4):
        got = {}
        for r in matching.tiles(matching.maximal_runs(df, k), k).collect():
            got.setdefault((r.a, r.b), []).append((r.s1, r.s2, r.len))
        for a in range(24):
            for b in range(a + 1, 24):
                assert sorted(got.get((a, b), [])) == scan_tiles(rows[a], rows[b], k), (rows[a], rows[b], k)


def test_runs_new_and_within(spark):
    df = seqs(spark, "abcabc", "xabcx", "abc")
    new = df.where("sub = 2")
    assert sorted((r.a, r.b, r.s1, r.s2, r.len) for r in matching.maximal_runs(df, 3, left=new).collect()) == [(0, 2, 0, 0, 3), (0, 2, 3, 0, 3), (1, 2, 1, 0, 3)]
    assert (0, 0, 0, 3, 3) in [tuple(r) for r in matching.maximal_runs(df, 3, within=True).collect()]


MATCHES = [(5, 3, 6), (11, 12, 6), (0, 0, 3), (3, 18, 2), (17, 20, 2)]


def test_runs_in_rounds_of_windows_that_end_runs(spark, monkeypatch):
    rng = random.Random(3)
    texts = [[rng.choice("ab") for _ in range(rng.randrange(2, 30))] for _ in range(12)]
    texts += [texts[0], texts[1], list("abab" * 8), list("xabab" * 5)]
    df = seqs(spark, *texts)

    def brute(within):
        for a, x in enumerate(texts):
            for b, y in enumerate(texts):
                for i in range(len(x)):
                    for j in range(len(y)):
                        if (a < b or (within and a == b and i < j)) and (not i or not j or x[i - 1] != y[j - 1]):
                            n = next((n for n in range(len(x)) if i + n >= len(x) or j + n >= len(y) or x[i + n] != y[j + n]), len(x))
                            if n >= 3:
                                yield a, b, i, j, n

    monkeypatch.setattr(matching, "WINDOWS", 60)
    monkeypatch.setattr(matching, "EDGES", 900)
    assert matching.edge_windows(df, 3)[1] > 1
    for within in (False, True):
        assert sorted(tuple(r) for r in matching.maximal_runs(df, 3, within=within).collect()) == sorted(brute(within))
    # Of two copies only the ends are paired, and of words of one text none.
    windows, _ = matching.edge_windows(seqs(spark, map(str, range(300)), map(str, range(300)), map(str, range(500, 900))), 3)
    assert sorted((r["sub"], r["pos"]) for r in windows.collect()) == [(0, 0), (0, 297), (1, 0), (1, 297)]


def test_merging_golden(spark):
    df = spark.createDataFrame([(1, 2, *m) for m in MATCHES], "a long, b long, s1 int, s2 int, len int")
    got = matching.merged(df, 9, 10, 0).collect()
    assert [(r.s1, r.s2, r.l1, r.l2) for r in got] == [(5, 3, 12, 15)]
    assert matching.merged(df, 9, 10, 6).count() == 0
    ends = spark.createDataFrame([(2, 10)], "sub long, pos int")
    assert matching.merged(df, 9, 10, 0, ends).count() == 0


def test_base_code_is_not_matched(spark):
    df, base = seqs(spark, "abcdefxyz", "qqabcdefr"), seqs(spark, "zabcdz")
    marks = tokens.base_marking(df, base, 3)
    assert sorted(tuple(r) for r in marks.collect()) == [(0, 0, 4), (1, 2, 6)]
    assert matching.maximal_runs(tokens.masked(df, marks), 3).count() == 0
    assert [(r.n_tokens, r.n_excluded) for r in tokens.exclusion_mask(df, marks).orderBy("sub").collect()] == [(10, 5), (10, 5)]


def test_frequency_against_lists(spark):
    rng = random.Random(4)
    rows = [[rng.randint(0, 2) for _ in range(rng.randint(2, 9))] for _ in range(30)]
    df = spark.createDataFrame([(1, 2, r) for r in rows], "a long, b long, seq array<bigint>")
    least = 3
    parts = lambda s: [tuple(s[i : i + n]) for n in range(least, len(s) + 1) for i in range(len(s) - n + 1)] or [tuple(s)]
    wins = lambda s: [tuple(s[i : i + least]) for i in range(len(s) - least + 1)]
    mean = lambda x: sum(x) / len(x) if x else 0.0
    whole, every, by_window = {}, {}, {}
    for s in rows:
        whole[tuple(s)] = whole.get(tuple(s), 0) + 1
        for p in parts(s):
            every[p] = every.get(p, 0) + 1
        for p in wins(s):
            by_window[p] = by_window.get(p, 0) + 1
    long_whole = {k: v for k, v in whole.items() if len(k) >= least}
    want = {
        "complete": lambda s: whole[s],
        "contained": lambda s: mean([long_whole[p] for p in parts(s) if p in long_whole]),
        "submatches": lambda s: mean([every[p] for p in parts(s)]),
        "windows": lambda s: mean([by_window[p] for p in wins(s)]),
    }
    for name, f in frequency.STRATEGIES.items():
        got = {tuple(r.seq): r.weight for r in f(df, least).collect()}
        assert set(got) == set(whole)
        assert all(abs(got[s] - want[name](s)) < 1e-9 for s in got), name


def test_weightings(spark):
    row = spark.range(1).select(*(f(F.lit(r)).alias(f"{n}{r}") for n, f in frequency.WEIGHTINGS.items() for r in (0.0, 1.0))).first()
    assert [round(x, 9) for x in row] == [1, 2, 0, 2, 1, 2, 1, 2]


def test_distribution_and_search(spark):
    df = spark.createDataFrame([(1, 2, 0.29, 0.5, 9, 30, "ab", "cd"), (3, 4, 1.7, 0.9, 23, 202, "ef", "gh")], "a long, b long, avg_sim double, max_sim double, longest long, max_len long, name_a string, name_b string")
    hist = {r.bucket: r.n for r in results.distribution(df, "avg_sim").collect() if r.n}
    assert hist == {28: 1, 99: 1} or hist == {29: 1, 99: 1}
    find = lambda q: [r.a for r in results.search(df, q).collect()]
    assert find("") == [3, 1] and find("CD") == [1] and find("index:1") == [3] and find("long:>10") == [3] and find("max:<=50%") == [1] and find("zz <30%") == [1] and find("len:>=202 ab") == [3, 1]


def test_small_functions(spark):
    row = spark.range(1).select(T.all_caps(F.lit("SimpleClassName")).alias("a"), T.csv_cell(F.lit('test2,"x"')).alias("b"), T.csv_cell(F.lit("a,b")).alias("c"), T.common_prefix(F.array(F.lit("src/a/x"), F.lit("src/b"))).alias("d"), (T.version(F.lit("v6.10.0-SNAPSHOT")) > T.version(F.lit("6.9.3"))).alias("e"), T.common_prefix(F.array(F.lit(""), F.lit("b"))).alias("f")).first()
    assert tuple(row) == ("SIMPLE_CLASS_NAME", '"test2,""x"""', "a,b", "src/", True, "")


def test_options_are_clamped():
    o = Options(min_match=0, shown=-1, threshold=3)
    assert (o.min_match, o.shown, o.threshold) == (1, 0, 1.0)
    assert Options(min_match=9, merging=MergeOptions(True, 2)).tile_length == 2


def test_normalization_removes_dead_and_reorders():
    s = lambda line, n, kind, critical, reads, writes, position=0, depth=0: normalization.Statement(line, n, kind, critical, position, depth, frozenset(reads), frozenset(writes))
    one = [s(1, 1, "V", False, "", "a"), s(2, 2, "V", False, "", "b"), s(3, 1, "D", False, "", "z"), s(4, 1, "P", True, "ab", "", 2)]
    two = [one[1], one[0], one[3]]
    kinds = lambda x: [(x[k].n_tokens, x[k].kind) for k in normalization.emitted(x)]
    assert kinds(one) == kinds(two) == [(2, "V"), (1, "V"), (1, "P")]
    loop = [s(1, 1, "L", True, "", "", 0, 1), s(2, 1, "R", True, "a", ""), s(3, 1, "W", False, "", "a"), s(4, 1, "E", True, "", "", 0, -1)]
    assert 2 in normalization.emitted(loop)


def edges_by_definition(rows):
    """Kinds of each pair of statements, each pair judged by itself."""
    depth = [sum(r.depth for r in rows[: k + 1]) for k in range(len(rows))]
    out = {}
    for k, y in enumerate(rows):
        for j, x in enumerate(rows[:k]):
            between = [r.position for r in rows[j + 1 : k]]
            one_loop = all(d > 0 for d in depth[j : k + 1])
            kinds = set()
            if x.writes & y.reads:
                kinds.add(normalization.FLOW)
            if x.writes & y.writes or (x.reads & y.writes and not one_loop):
                kinds.add(normalization.ORDER)
            if x.reads & y.writes and one_loop:
                kinds.add(normalization.REVERSE)
            if 2 in (x.position, y.position) and 2 not in between:
                kinds.add(normalization.FULL)
            if x.position == y.position == 1 and 1 not in between:
                kinds.add(normalization.PARTIAL)
            if kinds:
                out[j, k] = kinds
    return out


def order_by_definition(rows):
    """Living statements by the longest path to them, found by sweeps over all edges until nothing changes."""
    edges, layer, alive = edges_by_definition(rows), [0] * len(rows), {k for k, r in enumerate(rows) if r.critical}
    while True:
        was = (list(layer), set(alive))
        for (j, k), kinds in edges.items():
            layer[k] = max(layer[k], layer[j] + 1)
            if normalization.FLOW in kinds and k in alive:
                alive.add(j)
            if normalization.REVERSE in kinds and j in alive:
                alive.add(k)
        if was == (layer, alive):
            return sorted(alive, key=lambda k: (layer[k], -rows[k].n_tokens, rows[k].kind, k))


def test_normalization_by_brute_force(spark):
    import random

    rng = random.Random(3)
    some = lambda: frozenset(x for x in "abc" if rng.random() < 0.3)
    subs = []
    for n in [0, 1, 2] + [rng.randrange(3, 14) for _ in range(60)]:
        subs.append([normalization.Statement(k + 1, rng.randrange(1, 4), rng.choice("VP"), rng.random() < 0.25, rng.choice([0, 0, 0, 1, 2]), rng.choice([0, 0, 1, -1]), some(), some()) for k in range(n)])
    for rows in subs:
        assert normalization.emitted(rows) == order_by_definition(rows)
    df = spark.createDataFrame([(i, *r[:6], sorted(r.reads), sorted(r.writes)) for i, rows in enumerate(subs) for r in rows], normalization.STATEMENTS)
    want = {(i, rows[j].line, rows[k].line, ",".join(sorted(kinds))) for i, rows in enumerate(subs) for (j, k), kinds in edges_by_definition(rows).items()}
    got = normalization.edges(df).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    places = {(i, p, rows[k].line) for i, rows in enumerate(subs) for p, k in enumerate(order_by_definition(rows))}
    assert {(r["sub"], r["place"], r["line"]) for r in normalization.normalized(df).collect()} == places
    assert normalization.edges(df.limit(0)).count() == normalization.normalized(df.limit(0)).count() == 0



def test_report_round_trip(spark, tmp_path):
    o = Options(shown=1)
    c = spark.createDataFrame([(1, 2, 0.5, 0.6, 9, 30), (1, 3, 0.4, 0.6, 9, 30)], "a long, b long, avg_sim double, max_sim double, longest long, max_len long")
    m = spark.createDataFrame([(1, 2, 0, 0, 9, 9), (1, 3, 0, 0, 9, 9)], "a long, b long, s1 int, s2 int, l1 int, l2 int")
    states = spark.createDataFrame([(9, "TOO_SMALL"), (1, "VALID")], "sub long, state string")
    parts = report.tables(spark, o, c, m, results.distribution(c, "avg_sim"), states, None)
    report.write(parts, str(tmp_path / "r"))
    path = report.archive(str(tmp_path / "r"), str(tmp_path / "r.zip"))
    back = report.read_archive(path)
    assert [x["b"] for x in back["topComparisons"]] == [2] and len(back["comparisons"]) == 1 and back["failed"] == [{"sub": 9, "state": "TOO_SMALL"}]
    assert report.archive(str(tmp_path / "r"), path).endswith("r(1).zip")
    with pytest.raises(ValueError):
        report.read_archive(path, (2, 0, 0))
    results.write_csv(c.selectExpr("*", "'x' as name_a", "'y\"' as name_b"), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_bytes()
    assert text.startswith(b"submissionName1,") and text.endswith(b"\r\n") and b'x,"y""",0.500000' in text


def test_colors_differ(spark):
    df = spark.createDataFrame([(1, 2, k * 5, (k * 35) % 50, 4) for k in range(10)], "a long, b long, s1 int, s2 int, len int")
    rows = report.colors(df).orderBy("s1").collect()
    assert all(x.color != y.color for x, y in zip(rows, rows[1:], strict=False))


def test_pairs_of_blocks_equal_scans(spark, monkeypatch):
    """Tiles by blocks, with splits and with more blocks than groups, are those of scans; no pair is shuffled."""
    rng = random.Random(11)
    rows = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 24))) for _ in range(16)] + ["a" * 20, "b" + "a" * 13, "c" * 3 + "a" * 9]
    df = seqs(spark, *rows)
    about = df.select("sub", (F.size("words") + 1).cast("long").alias("n_tokens"), F.concat(F.lit("s"), "sub").alias("name"))
    want = sorted((a, b, *t) for a in range(len(rows)) for b in range(a + 1, len(rows)) for t in ([(i, j, n) for i, j, n in scan_tiles(rows[a], rows[b], 3)] if (len(rows[a]), a) <= (len(rows[b]), b) else [(j, i, n) for i, j, n in scan_tiles(rows[b], rows[a], 3)]))
    for edges, groups, blocks in ((1_500_000, 63, 5), (20, 63, 5), (20, 2, 3)):
        monkeypatch.setattr(pairing, "EDGES", edges)
        monkeypatch.setattr(pairing, "GROUPS", groups)
        monkeypatch.setattr(pairing, "BLOCKS", blocks)
        windows, _ = matching.edge_windows(df, 3)
        assert sorted(tuple(r) for r in pairing.paired(windows, 10, 3, about, "tiles").collect()) == want
    pairs = pairing.paired(windows, 10, 3, about, "pairs", ("name",))
    assert "hashpartitioning(key" in pairs._jdf.queryExecution().toString() and "hashpartitioning(a#" not in pairs._jdf.queryExecution().toString()
    got = {(r.a, r.b): (r.n_matches, r.matched, r.longest, r.name_a, r.name_b) for r in pairs.collect()}
    assert len(got) == len({w[:2] for w in want})
    for (a, b), found in got.items():
        n = [w[4] for w in want if w[:2] == (a, b)]
        assert found == (len(n), sum(n), max(n), f"s{a}", f"s{b}")
    spans = {(r.a, r.s1, r.len): 0 for r in pairing.paired(windows, 10, 3, about, "spans").collect()}
    assert set(spans) == {(a, s1, n) for a, _, s1, _, n in want}


def test_anonymous_ids_need_no_order_of_all_pairs(spark):
    """Numbers follow first appearances in the sorted list, and only submissions are ordered."""
    rows = [(1, 5, 0.5, 0.6, 20, 40), (2, 3, 0.9, 0.9, 30, 40), (1, 3, 0.5, 0.7, 20, 40), (4, 6, 0.1, 0.1, 12, 50)]
    df = spark.createDataFrame(rows, "a long, b long, avg_sim double, max_sim double, longest long, max_len long")
    got = results.anonymous_ids(df)
    assert {r.sub: r.anon for r in got.collect()} == {2: 0, 3: 1, 1: 2, 5: 3, 4: 4, 6: 5}
    assert got._jdf.queryExecution().toString().count("row_number") and "posexplode" not in got._jdf.queryExecution().toString()


def test_files_are_ranked_where_their_pairs_are_made(spark, monkeypatch):
    """Places of either side among those of the other are those of a plain sort, however blocks, chunks and edges are cut; no pair is shuffled."""
    rng = random.Random(5)
    rows = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 24))) for _ in range(18)] + ["a" * 20, "b" + "a" * 13]
    df = seqs(spark, *rows)
    about = df.select("sub", (F.size("words") + 1).cast("long").alias("n_tokens"), F.size("words").cast("long").alias("divisor"))
    files = {}
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            small, large = (a, b) if (len(rows[a]), a) <= (len(rows[b]), b) else (b, a)
            if n := [t[2] for t in scan_tiles(rows[small], rows[large], 3)]:
                files[a, b] = files[b, a] = (max(n), len(n), sum(n))
    want = set()
    for (sub, other), (longest, n, matched) in files.items():
        rest = [(s, f) for (s, o), f in files.items() if o == other]
        place = lambda key: 1 + [s for s, _ in sorted(rest, key=lambda x: (key(*x), x[0]))].index(sub)  # noqa: B023, E731
        want.add((sub, other, longest, n, matched, len(rows[sub]), place(lambda s, f: 0), place(lambda s, f: -f[0]), place(lambda s, f: -f[1]), place(lambda s, f: -f[2] / len(rows[s]))))
    for edges, pairs, groups, strips in ((400_000, 1_000_000, 63, 12), (20, 5, 63, 3), (20, 1, 2, 5)):
        for name, value in (("EDGES", edges), ("PAIRS", pairs), ("GROUPS", groups), ("STRIPS", strips)):
            monkeypatch.setattr(pairing, name, value)
        windows, _ = matching.edge_windows(df, 3)
        got = pairing.filed(windows, 10, 3, about, ("name", "longest", "count", "coverage"))
        found = [tuple(r) for r in got.collect()]
        assert len(found) == len(want) and set(found) == want
    assert "hashpartitioning(other" not in got._jdf.queryExecution().toString()


def test_similarities_are_rounded_as_in_sql(spark):
    """Shares that lie on a half of the last decimal: the nearest double may be below it, and SQL's round then goes down."""
    rows = [(m, d) for d in (128, 640, 3200, 16000) for m in range(1, d + 1, 2)]
    shares = spark.createDataFrame(rows, "m long, d long")
    got = {(r.m, r.d): r.x for r in shares.select("m", "d", N.rounded(F.col("m") / F.col("d")).alias("x")).collect()}
    con = duckdb.connect()
    con.register("t", pa.table({"m": [m for m, _ in rows], "d": [d for _, d in rows]}))
    assert got == {(m, d): x for m, d, x in con.execute("SELECT m, d, round(m / d, 6) FROM t").fetchall()}
    sizes = spark.createDataFrame([(0, 328, 329), (1, 952, 953)], "sub long, divisor long, n_tokens long")
    matches = spark.createDataFrame([(0, 1, 41, 41)], "a long, b long, l1 long, l2 long")
    assert matching.metrics(matches, sizes).first().avg_sim == 0.064062


def test_equals_are_looked_up_once(spark, monkeypatch):
    """However few edges a task holds, its windows are looked up once for the pairs of two blocks, and tiles stay the same."""
    rng = random.Random(5)
    some = ["".join(rng.choice("ab") for _ in range(30)) for _ in range(16)]
    batch = pa.RecordBatch.from_pydict({"sub": pa.array(range(16), pa.int64()), "group": pa.array([0] * 16, pa.int32()), "words": [list(w) for w in some]})
    dealt = pa.Table.from_batches(list(pairing._windows(batch, 4, (0, 1), 1)))
    kept = pa.Table.from_batches(list(pairing._kept(dealt["rows"].to_pylist(), False, 0)))
    rows = {}
    for r in kept.to_pylist():
        rows.setdefault(r.pop("sub"), []).append(r)
    table = pa.table({"sub": list(rows), "n_tokens": [31] * len(rows), "block": [k % 2 for k in rows], "windows": list(rows.values())})
    calls = []
    looked = pairing._unlike
    monkeypatch.setattr(pairing, "_unlike", lambda *args: calls.append(1) or looked(*args))
    found = []
    for two in (True, False):
        for most in (3, 2000, 100_000):
            calls.clear()
            found.append(sorted(tuple(r.values()) for b in pairing._block(table, two, 4, "tiles", [], most) for r in b.to_pylist()))
            assert len(calls) == 2 or most == 3  # which one document alone exceeds
    assert found[0] == found[1] == found[2] and found[3] == found[4] == found[5] and set(found[0]) < set(found[3])
    one = {(a, b): [] for a in range(16) for b in range(a + 1, 16)}
    for a, b, *tile in found[3]:
        one[a, b].append(tuple(tile))
    assert all(sorted(t) == scan_tiles(some[a], some[b], 4) for (a, b), t in one.items())


def test_all_runs_of_blocks(spark, monkeypatch):
    """All runs of all pairs of two documents, overlapping ones too, none that a document repeats, however few edges a task holds."""
    rng = random.Random(6)
    some = ["".join(rng.choice("ab") for _ in range(24)) for _ in range(9)] + ["abab" * 5] * 2
    df = seqs(spark, *some)
    at = lambda x, i: x[i] if 0 <= i < len(x) else None

    def length(x, y, i, j):
        if at(x, i - 1) is not None and at(x, i - 1) == at(y, j - 1):
            return 0
        return next(n for n in range(len(x) + 1) if at(x, i + n) is None or at(x, i + n) != at(y, j + n))

    wanted = [(a, b, i, j, n) for a, x in enumerate(some) for b, y in enumerate(some) if a < b for i in range(len(x)) for j in range(len(y)) if (n := length(x, y, i, j)) >= 4]
    for most in (3, 100_000):
        monkeypatch.setattr(pairing, "EDGES", most)
        w = stored.saved_parts(pairing.windows(df, 4, 200), "windows")
        found = pairing.paired(w, w.count(), 4, None, "runs")
        assert sorted(tuple(r) for r in found.collect()) == sorted(wanted)


def test_windows_of_numbers_equal_those_of_words(spark):
    """Numbers in place of words give the same windows, whatever their hashes are."""
    words = seqs(spark, "abcdefabc", "xabcdef", "zabcq")
    numbers = words.select("sub", F.transform("words", lambda w: F.xxhash64(w)).alias("words"))
    places = [sorted((r.sub, r.pos) for w in pairing.windows(seq, 3, 20) for r in w.collect()) for seq in (words, numbers)]
    assert places[0] == places[1] != []
