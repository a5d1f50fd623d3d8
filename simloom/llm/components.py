"""Connected components of an edge list by alternating large and small stars.

A large star links each node's larger neighbours to the least node it knows, a small star does so for the
smaller ones; both keep the components. Rounds end when the edges no longer change; each round's edges are
written to the shared folder. Minima are taken with partial aggregation and joined back, so a node with very
many edges is dealt to several tasks by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm import store


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``edges(a, b)``: the least node that can be reached.

    Null ends and loops are ignored, repeated edges count once; no edges give no rows.
    """
    now = store.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u > v").distinct(), "edges")
    was = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == was:
            break
        was = state
        large = _star(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "v > u")
        small = _star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "true")
        new = store.save(small, "edges")
        store.drop(now)
        now = new
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _star(pairs: DataFrame, which: str) -> DataFrame:
    """Link the neighbours ``v`` of each ``u`` that satisfy ``which``, and ``u`` itself, to the least of them all."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("c"), F.least("u", "least").alias("m"))
    joined = pairs.join(least, pairs["u"] == least["c"])
    out = joined.where(which).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if which == "true":
        out = out.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.where("u > v").distinct()
