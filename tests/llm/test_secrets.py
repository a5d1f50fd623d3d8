import hashlib
import re
import time

from helpers_llm import same
from pyspark.sql import functions as F

from simloom.llm import registry, secrets


def test_oracle(spark, sf_dir):
    same(registry.op5_secret_scans(spark, sf_dir), registry.ORACLES["op5_secret_scans"], sf_dir)


def test_queries():
    q = secrets.trigram_query
    assert q("[0-9a-f]{24,}") is True and q("a?b*c") is True and q("ab") is True
    assert q("AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))
    assert q("(abc|xyz)+d") == ("or", ("abc", "xyz"))
    assert q("ab?cd") == ("or", ("acd", ("and", ("abc", "bcd"))))
    assert q("abc|..") is True
    assert q(r"\x41\.bc.+d\d") == ("and", ("a.b", ".bc"))
    assert q(secrets.RULES[0].pattern)[0] == "or"


def holds(query, text):
    if query is True or isinstance(query, str):
        return query is True or query in text
    return (all if query[0] == "and" else any)(holds(p, text) for p in query[1])


TEXTS = ["", None, "password=abcdef", "PassWord = 'abc'", "token=token: abcdefgh", "x token=secret=abcdef y", "é😀 api_key: \"a/b+c=d-e_f.g\" apikey=123456", "AKIA" + "A" * 16, "AKIA" + "A" * 15 + " AKIAAKIA" + "0" * 20, "f" * 23 + "g" + "0a" * 30, "-----BEGIN RSA PRIVATE KEY-----", "K token\n=12345678", "secret\"  =  \"xyzxyz\"", "token=" + "ab12" * 20_000, "pass word=abcdef passwd:=abcdef", "ſecret=abcdef toKen=abcdef"]


def brute(text):
    out = []
    for k, r in enumerate(secrets.RULES):
        for m in re.finditer(r.pattern, text or ""):
            if len(m[r.group]) >= r.least:
                assert holds(secrets.trigram_query(r.pattern), text.lower())
                out.append((m.start(), k, m.end(), r.kind))
    return sorted(out)


def test_against_python_and_edges(spark):
    rows = [(k, t, "old") for k, t in enumerate(TEXTS)] + [(None, "password=abcdef", "old"), (2, "password=abcdef", "old")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = secrets.scan(df)
    assert got.columns == ["doc_id", "text", "spans"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        assert [tuple(s) for s in r.spans] == brute(r.text)
    assert secrets.scan(df.limit(0)).count() == 0
    clean = got.select("text", secrets.redacted(F.col("text"), F.col("spans")).alias("clean")).collect()
    by = {r.text: r.clean for r in clean}
    assert by["password=abcdef"] == "[secret]" and by["é😀 api_key: \"a/b+c=d-e_f.g\" apikey=123456"] == "é😀 [secret]\" [secret]" and by[None] is None and by["PassWord = 'abc'"] == "PassWord = 'abc'"


def test_base_patterns_as_given(spark):
    """Bounds inside the expressions find what matches of one character and more, filtered by length, do."""
    given = {"assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24)}
    for t in TEXTS[2:]:
        if "ſ" in t or "K" in t:
            continue
        want = sorted((m.start(), k, m.end(), n) for k, (n, (p, g, least)) in enumerate(given.items()) for m in re.finditer(p, t, re.I if n == "assign" else 0) if len(m[g]) >= least)
        assert [s for s in brute(t) if s[3] != "pem"] == want
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


PEM = "-----BEGIN RSA PRIVATE KEY-----\nMIIEow0aaAB+/=\nabcd==\n-----END RSA PRIVATE KEY-----"


def redacted(text):
    out, at = [], 0
    for a, _, b, _ in brute(text):
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_redaction_against_python(spark):
    """Whole key blocks go, overlapping spans make one stretch, and blocks of the text leave no mark."""
    long = "".join(f"é{'x' * (k % 50)} token=abcdef{k} " + ("0a" * 3000 if k % 100 == 0 else "") for k in range(1500))
    texts = [*TEXTS[2:], f"a {PEM} b", PEM + "token=" + "ab12" * 10, f"-----BEGIN PRIVATE KEY----- no key, but prose. {PEM}", long, "😀" * 9000 + " password=abcdef " + "é" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = secrets.scan(df).select("text", secrets.redacted(F.col("text"), F.col("spans")).alias("clean")).collect()
    for r in got:
        assert r.clean == redacted(r.text), r.text[:60]
    assert next(r.clean for r in got if r.text == f"a {PEM} b") == "a [secret] b"


def test_very_many_matches_in_one_text(spark):
    text = "token=abcdef " * 64_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").cache()
    df.count()
    began = time.time()
    row = secrets.scan(df).select(F.size("spans").alias("n"), F.element_at("spans", -1)["end"].alias("end"), F.length(secrets.redacted(F.col("text"), F.col("spans"))).alias("size")).first()
    assert tuple(row) == (64_000, len(text) - 1, 64_000 * len("[secret] "))
    assert time.time() - began < 30
    df.unpersist()


def test_many_candidates_are_joined_by_shuffle(spark, monkeypatch, sf_dir):
    monkeypatch.setattr(secrets, "FEW", 0)
    same(registry.op5_secret_scans(spark, sf_dir), registry.ORACLES["op5_secret_scans"], sf_dir)
