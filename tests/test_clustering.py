import numpy as np
import pytest

from simloom.operators import clustering as C

FOUR = [(0, 1, 0.5), (2, 3, 0.5), (0, 2, 0.1), (0, 3, 0.1), (1, 2, 0.1), (1, 3, 0.1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "i long, j long, w double")


def test_both_algorithms_find_the_two_pairs(spark):
    e = frame(spark, FOUR)
    for algorithm in ("agglomerative", "spectral"):
        got = {}
        for r in C.clusters(e, algorithm, 0.4).collect():
            got.setdefault(r.cluster_id, set()).add(r.member)
        assert sorted(map(sorted, got.values())) == [[0, 1], [2, 3]]
    for linkage in ("min", "max", "average"):
        _, w = C.matrix(e)
        assert sorted(C.agglomerative(w, 0.4, linkage)) == [[0, 1], [2, 3]]
    assert C.clusters(frame(spark, FOUR[:1]), "spectral").count() == 0


def test_quality(spark):
    members = spark.createDataFrame([(0, 0), (0, 1), (1, 2), (1, 3)], "cluster_id int, member long")
    perfect = C.quality(frame(spark, [(0, 1, 1.0), (2, 3, 1.0)]), members).collect()
    assert sum(r.strength for r in perfect) == 0.5 and all(r.avg_similarity == 1 for r in perfect)
    uniform = C.quality(frame(spark, [(0, 1, 0.1), (2, 3, 0.1), (0, 2, 0.05), (0, 3, 0.05), (1, 2, 0.05), (1, 3, 0.05)]), members).collect()
    assert abs(sum(r.strength for r in uniform)) < 1e-5
    one = spark.createDataFrame([(0, k) for k in range(4)], "cluster_id int, member long")
    row = C.quality(frame(spark, [(0, 1, 0.5), (0, 2, 0.3), (0, 3, 0.4), (1, 2, 0.1), (1, 3, 0.1), (2, 3, 0.7)]), one).first()
    assert row.avg_similarity == 0.35
    assert C.worth(C.quality(frame(spark, FOUR), members)).where("normalized = 1").count() == 2


def test_preprocessing(spark):
    e = frame(spark, FOUR)
    assert C.by_threshold(e, 0.2).count() == 2
    assert C.percentile_type2(e, 50.0).first()[0] == pytest.approx(0.1)
    assert C.percentile_type2(e, 100.0).first()[0] == 0.5
    assert C.percentile_type2(e, 50.0, n_pairs=100).first()[0] == 0.0
    assert all(r.w <= 0.5 for r in C.by_cumulative(e).collect())
    assert {r.node for r in C.connected(frame(spark, [*FOUR, (3, 4, 0.0)])).collect()} == {0, 1, 2, 3}


def test_single_linkage(spark):
    got = {r.node: r.component for r in C.single_linkage(frame(spark, [(k, k + 1, 0.5) for k in range(40)] + [(50, 51, 0.1), (60, 61, 0.9)]), 0.4).collect()}
    assert got == {k: 0 for k in range(41)} | {60: 60, 61: 60}


def test_search_and_process():
    assert C.maximize(lambda k: -((k - 17) ** 2), 2, 60) in range(15, 20)
    x = np.arange(10.0)
    mean, dev = C.gaussian_process(x, x * 2, np.array([4.5]), 3.0)
    assert abs(mean[0] - 9) < 0.2 and dev[0] < 1


def test_quality_reads_edges_once(spark):
    """Edges that know their clusters are not joined; one without a cluster counts in the total."""
    members = spark.createDataFrame([(0, 0), (0, 1)], "cluster_id long, member long")
    sides = spark.createDataFrame([(0.5, 0, 0), (0.25, 0, None), (0.25, None, None)], "w double, ci long, cj long")
    row = C.quality_of(sides, members).first()
    assert (row.size, row.strength, row.avg_similarity) == (2, round(0.5 - (1.25 / 2) ** 2, 6), 0.5)
