"""Extendible hashing of rows into shards of a byte limit.

The directory is indexed by leading bits of a key's hash. A bucket over its limit splits on one more bit, others
stay as they are, so a shard is a prefix of the least depth at which its bytes fit. Sums of all prefixes of a
round's bits come from one aggregate of its finest cells; only rows of cells that are still too large enter the
next round with further bits. The hash continues with bits of the row itself after those of the key, so that
even one key with a large share of the rows splits, by rows.

All of it is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.llm import store

#: Bits of the key's hash, and those of a round.
KEY_BITS, ROUND = 64, 16
#: Bits in all: a round of one more hash for rows of the same key.
MOST_BITS = 128


def bits_of(digest_hex: Column) -> Column:
    """The first 64 bits of a hexadecimal digest as a string of 0 and 1."""
    return F.lpad(F.conv(F.substring(digest_hex, 1, 16), 16, 2), 64, "0")


def shards(rows: DataFrame, key: str, size: Column, limit: int) -> DataFrame:
    """``rows`` with ``shard`` (a prefix of bits, empty for a single shard) and ``shard_bytes``.

    ``size`` gives a row's bytes; null counts as 0. Rows of one key share a shard unless they exceed the limit
    alone. A shard exceeds ``limit`` only if it is one row, or rows that are equal in every column. A null key
    is a key. Columns named like the result's are replaced; an empty table gives no rows.
    """
    own = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    again = F.md5(F.to_json(F.struct(*rows.columns)).cast("binary"))
    held = [c for c in rows.columns if c not in ("shard", "shard_bytes")]
    bits = rows.select(*held, F.concat(bits_of(own), bits_of(again)).alias("__bits"), F.coalesce(size.cast("long"), F.lit(0)).cast("long").alias("__size"))
    cells = store.save(bits.groupBy("__bits").agg(F.sum("__size").alias("bytes")), "cells")

    # Round by round: the least depth at which each cell's prefix fits.
    decided = None
    left, depth = cells.select(F.col("__bits").alias("bits"), "bytes"), 0
    while True:
        top = min(depth + ROUND, MOST_BITS)
        first = 0 if depth == 0 else depth + 1
        fine = left.groupBy(F.substring("bits", 1, top).alias("cell")).agg(F.sum("bytes").alias("bytes"))
        prefixes = fine.select("cell", "bytes", F.explode(F.sequence(F.lit(first), F.lit(top))).alias("depth")).select("cell", "bytes", "depth", F.expr("substring(cell, 1, depth)").alias("prefix"))
        sums = prefixes.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"))
        fits = sums.where((F.col("bytes") <= limit) | (F.col("depth") == MOST_BITS))
        # A prefix that fits, whose parent of one bit less does not, is a shard.
        parent = sums.where(F.col("bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        split = fits.withColumn("parent", F.expr("substring(prefix, 1, depth - 1)"))
        made = split.where("depth = 0") if depth == 0 else split.limit(0)
        inner = split.where(F.col("depth") > first).join(parent, ["depth", "parent"], "left_semi")
        edge = split.where((F.col("depth") == first) & (F.col("depth") > 0))
        made = made.unionByName(inner).unionByName(edge).select(F.col("prefix").alias("shard"), F.col("bytes").alias("shard_bytes"), "depth")
        made = store.save(made, "directory")
        decided = made if decided is None else decided.unionByName(made)
        if top == MOST_BITS:
            break
        large = sums.where((F.col("depth") == top) & (F.col("bytes") > limit)).select("prefix")
        large = store.save(large, "oversized")
        if large.isEmpty():
            break
        left = left.join(large, F.substring("bits", 1, top) == F.col("prefix"), "left_semi")
        depth = top

    # Each row's shard is the one prefix of its bits in the directory; only depths that occur are tried.
    depths = [r[0] for r in decided.select("depth").distinct().collect()]  # as many as bits at most
    if not depths:
        return rows.select(*held, F.lit("").alias("shard"), F.lit(0).cast("long").alias("shard_bytes")).limit(0)
    tries = cells.select("__bits", F.explode(F.array(*map(F.lit, sorted(depths)))).alias("depth")).select("__bits", F.expr("substring(__bits, 1, depth)").alias("shard"), "depth")
    found = tries.join(decided, ["depth", "shard"]).select("__bits", "shard", "shard_bytes")
    return bits.join(found, "__bits").select(*held, "shard", "shard_bytes")
