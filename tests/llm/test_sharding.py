import hashlib

from helpers_llm import same
from pyspark.sql import functions as F

from simloom.llm import registry, sharding


def test_oracle(spark, sf_dir):
    same(registry.op9_sharding(spark, sf_dir), registry.ORACLES["op9_sharding"], sf_dir)
    same(registry.sharding_small(spark, sf_dir), registry.ORACLES["sharding_small"], sf_dir)
    assert registry.sharding_small(spark, sf_dir).select("shard").distinct().count() > 1


def brute(rows, limit):
    """Split buckets of (bits, size) one bit at a time."""
    out, todo = {}, [("", rows)]
    while todo:
        prefix, some = todo.pop()
        if sum(s for _, s in some) <= limit or len(prefix) == 128:
            out[prefix] = sum(s for _, s in some)
        else:
            todo += [(prefix + b, part) for b in "01" if (part := [r for r in some if r[0][len(prefix)] == b])]
    return out


def test_small_limit_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.octet_length("text").alias("size"))
    for limit in (300_000, 9_000):
        got = sharding.shards(rows, "doc_id", F.col("size"), limit).collect()
        bits = [(bin(int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:16], 16))[2:].zfill(64) + bin(int(hashlib.md5(f'{{"doc_id":{r.doc_id},"size":{r["size"]}}}'.encode()).hexdigest()[:16], 16))[2:].zfill(64), r["size"]) for r in rows.collect()]
        want = brute(bits, limit)
        assert {r.shard: r.shard_bytes for r in got} == want
        assert len(got) == len(bits) and all(any(b.startswith(r.shard) for b, _ in bits) for r in got)
        assert all(v <= limit for v in want.values() if v <= limit) and limit > 100_000 or max(want.values()) > limit


def test_hot_key_and_edges(spark):
    rows = [("hot", f"row {k}", 100) for k in range(500)] + [(None, "n", None), ("a", None, 5), ("a", None, 5), ("big", "x" * 50_000, 50_000)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "key string, text string, size long, shard string")
    got = sharding.shards(df, "key", F.col("size"), 1000).collect()
    assert len(got) == len(rows)
    total = {}
    for r in got:
        total[r.shard] = total.get(r.shard, 0) + (r["size"] or 0)
    assert all(r.shard_bytes == total[r.shard] for r in got)
    assert sorted(total.values())[-1] == 50_000 and sorted(total.values())[-2] <= 1000
    names = sorted(total)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    assert len({r.shard for r in got if r.key == "a"}) == 1
    assert sharding.shards(df.limit(0), "key", F.col("size"), 10).count() == 0
