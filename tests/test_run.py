from datetime import datetime

import pytest
from pyspark.sql import functions as F

from simloom.config import ClusterOptions, FrequencyOptions, MergeOptions, Options
from simloom.operators import report
from simloom.plans import run
from simloom.sources import submissions
from simloom.streaming import incremental

A = "class A { void f() { if (x) { g(); } for (;;) { h(); y = 1; } while (z) { return; } } }"
B = A.replace("A", "Other").replace("g(", "renamed(")


def write(root, **files):
    for name, text in files.items():
        p = root / name.replace("__", "/").replace("_java", ".java")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_folders_to_result(spark, tmp_path):
    write(tmp_path / "new", one__src__A_java=A, two__src__B_java=b"\xef\xbb\xbf" + B.encode(), three__C_java="class C { }", bad__D_java="class {", four__x="no suffix")
    write(tmp_path / "old", past__src__A_java=A, past2__src__A_java=A)
    o = Options(language="java", min_match=9, suffixes=(".JAVA",), clustering=ClusterOptions(algorithm="agglomerative"))
    files = submissions.read(spark, [str(tmp_path / "new")], [str(tmp_path / "old")], o)
    r = run.run(files, o)
    assert {x.sub: x.state for x in r.states.collect()} == {"new/one": "VALID", "new/two": "VALID", "new/three": "TOO_SMALL", "new/bad": "CANNOT_PARSE", "old/past": "VALID", "old/past2": "VALID"}
    pairs = {(x.a, x.b): x.avg_sim for x in r.comparisons.collect()}
    assert ("old/past", "old/past2") not in pairs and len(pairs) == 5 and set(pairs.values()) == {1.0}
    assert {x.bucket: x.n for x in r.distribution.collect() if x.n} == {99: 5}
    assert {x.member for x in r.clusters.collect()} <= {"new/one", "new/two", "old/past", "old/past2"}
    only = submissions.read(spark, [str(tmp_path / "new")], (), Options(suffixes=(".java",), subdirectory="src"))
    assert {x.sub for x in only.collect()} == {"one", "two"}
    with pytest.raises(ValueError):
        submissions.read(spark, [str(tmp_path / "none")])


def test_base_code_merging_and_frequency(spark, tmp_path):
    write(tmp_path / "new", one__A_java=A + A, two__B_java=B + "class Q { int q() { s(); t(); u = 1; v = 2; } }", base__T_java=A)
    o = Options(language="java", min_match=5, suffixes=(".java",), clustering=ClusterOptions(enabled=False))
    files = submissions.read(spark, [str(tmp_path / "new")], (), o, base=str(tmp_path / "new" / "base"))
    assert {x.sub for x in files.where("not is_base").collect()} == {"one", "two"}
    assert run.run(files, o).comparisons.count() == 0
    plain = run.run(files.where("not is_base"), o).comparisons.first()
    merged = run.run(files.where("not is_base"), Options(language="java", min_match=5, suffixes=(".java",), merging=MergeOptions(True, required=0), clustering=ClusterOptions(enabled=False))).comparisons.first()
    assert merged.avg_sim >= plain.avg_sim
    for strategy in ("complete", "contained", "submatches", "windows"):
        f = Options(language="java", min_match=5, suffixes=(".java",), frequency=FrequencyOptions(True, strategy, "proportional", 0.0, 5), clustering=ClusterOptions(enabled=False))
        assert run.run(files.where("not is_base"), f).comparisons.first().avg_sim == plain.avg_sim


def test_charsets(spark):
    assert submissions.decode("é".encode("latin-1")) == "é" and submissions.decode("é".encode()) == "é" and submissions.decode(b"\xff\xfeA\0") == "A"
    df = spark.createDataFrame([(1, "a", 0.9), (2, "a", 0.0), (1, "b", 0.3), (2, "b", 0.4)], "file long, charset string, confidence double")
    assert submissions.joint_charset(df).first()[0] == "b"
    assert submissions.joint_charset(df.limit(0)).first()[0] == "UTF-8"
    assert submissions.excluded_names(spark, "/none/there") == ()


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from simloom.plans import views

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for k in range(3):
        docs.where(F.col("doc_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.compare_stream(stream, str(tmp_path / "index"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, views.tiles(spark, sf_dir).collect()))


def test_base_code_with_merging(spark, tmp_path):
    """Base code is marked by whole matches whatever merging takes, and no similarity exceeds 1."""
    write(tmp_path / "new", one__A_java=A + A, two__B_java=B + "class Q { int q() { s(); t(); u = 1; v = 2; } }", base__T_java="class T { int t() { p(); } }")
    java = {"language": "java", "suffixes": (".java",), "clustering": ClusterOptions(enabled=False)}
    files = submissions.read(spark, [str(tmp_path / "new")], (), Options(**java, min_match=9), base=str(tmp_path / "new" / "base"))
    plain = run.run(files, Options(**java, min_match=5)).comparisons.first()
    for required in (0, 6):
        merged = run.run(files, Options(**java, min_match=5, merging=MergeOptions(True, required=required))).comparisons.first()
        assert merged.max_sim <= 1 and merged.avg_sim >= plain.avg_sim


def test_errors_of_runs(spark, tmp_path, monkeypatch):
    write(tmp_path / "new", one__A_java=A, two__B_java="class B { }", base__T_java="x")
    o = Options(language="java", min_match=9, suffixes=(".java",))
    files = submissions.read(spark, [str(tmp_path / "new")], (), o, base=str(tmp_path / "new" / "base"))
    with pytest.raises(run.RunError, match="base code"):
        run.run(files, o)
    with pytest.raises(run.RunError, match="fewer than two"):
        run.run(files.where("not is_base"), o)
    # A tokeniser that fails in any way makes one submission unparsable.
    deep = "public class X { void f() { " + "(" * 5 + " } }"
    bad = spark.createDataFrame([("a", "A.java", A, True, False), ("b", "B.java", A, True, False), ("c", "C.java", deep, True, False), ("d", "d.xmi", "<", True, False)], "sub string, path string, text string, is_new boolean, is_base boolean")
    r = run.run(bad, Options(language="multi", min_match=9))
    assert {x.sub: x.state for x in r.states.collect()}["d"] == "CANNOT_PARSE"


def test_positions_of_both_sides(spark, tmp_path):
    write(tmp_path / "new", one__A_java="// head\n" + A.replace("{ ", "{\n  "), two__B_java=B, base__T_java=A)
    o = Options(language="java", min_match=9, suffixes=(".java",), clustering=ClusterOptions(enabled=False))
    r = run.run(submissions.read(spark, [str(tmp_path / "new")], (), o).where("sub <> 'base'"), o)
    m = report.positions(r.matches, r.places).collect()
    assert len(m) == 1 and m[0].first.file.endswith("one/A.java") and m[0].second.file.endswith("two/B.java")
    assert (m[0].first.start.line, m[0].first.start.column, m[0].first.start.token) == (2, 0, 0) and m[0].first.end.line > 4
    assert m[0].second.start.line == m[0].second.end.line == 1 and m[0].second.end.token == m[0].l2 - 1
    info = report.run_information(r.states, 1, datetime(2024, 3, 9), 3_723_004).first()
    assert (info.date, info.duration, info.comparisons, info.failed) == ("09/03/24", "1h 02min 03s 004ms", 1, [])
    based = run.run(submissions.read(spark, [str(tmp_path / "new")], (), o, base=str(tmp_path / "new" / "base")), o)
    found = report.base_code(based.base, based.places, based.states).collect()
    assert {x.sub: len(x.matches) for x in found} == {"one": 1, "two": 1}
    assert report.base_code(r.base, r.places, r.states).where("size(matches) = 0").count() == 2
