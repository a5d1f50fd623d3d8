"""Common runs of pairs, greedy tiles and merged matches."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from simloom.functions import numbers as N
from simloom.operators import pairing, tokens
from simloom.sources import stored


#: Windows are shuffled in up to ``ROUNDS`` rounds of ``WINDOWS`` or more; pairs of windows in rounds of a fifth as many
#: as there are windows, or ``EDGES``. Each round's shuffle files are gone before the next.
ROUNDS, WINDOWS, EDGES = 8, 4_000_000, 4_000_000


def edge_windows(seq: DataFrame, k: int, within: bool = False) -> tuple[DataFrame, int]:
    """Those ``tokens.grams`` that may begin or end a common run, saved, and the number of rounds for their pairs.

    A run begins or ends only at windows that two submissions share (``within``: that occur twice) and whose words
    before or after are not all the same. All others drop out before they are paired.
    """
    n = pairing.size(seq, k)
    rounds = max(1, min(ROUNDS, math.ceil(n / WINDOWS)))
    if isinstance(seq.schema["sub"].dataType, LongType):
        kept = stored.saved_parts(pairing.windows(seq, k, n, within), "windows")
        return kept, _rounds(kept, n)
    same = Window.partitionBy("gram", "check")
    unlike = lambda c: (F.count(c).over(same) < F.count("*").over(same)) | (F.min(c).over(same) != F.max(c).over(same))
    shared = F.count("*").over(same) > 1 if within else F.min("sub").over(same) != F.max("sub").over(same)
    keep = shared & (unlike("before") | unlike("after"))
    parts = (tokens.grams(seq, k, (r, rounds)).withColumn("keep", keep).where("keep").drop("keep") for r in range(rounds))
    windows = stored.saved_parts(parts, "windows")
    return windows, _rounds(windows, n)


def _rounds(windows: DataFrame, n: int) -> int:
    """Rounds for the pairs of windows."""
    kinds = windows.groupBy("gram", "check", "before", "after").agg(F.count("*").alias("m")).groupBy("gram", "check")
    kinds = kinds.agg(F.sum("m").cast("double").alias("n"), F.sum(F.col("m").cast("double") * F.col("m")).alias("equal"))
    edges = kinds.agg(F.coalesce(F.sum(F.col("n") * F.col("n") - F.col("equal")), F.lit(0.0)) / 2).first()[0]
    return max(1, math.ceil(edges / max(EDGES, n / 5)))


def _joined(windows: DataFrame, k: int, left: DataFrame | None, within: bool, part: tuple[int, int]) -> DataFrame:
    """The runs whose ``a`` is in one part of the submissions."""
    g = windows
    if left is not None:
        g = g.join(left.select("sub").distinct().withColumn("new", F.lit(True)), "sub", "left")
    a, b = g.alias("a"), g.alias("b")
    if part[1] > 1:
        a = g.where(F.pmod(F.xxhash64("sub"), F.lit(part[1])) == part[0]).alias("a")
    before = F.col("a.sub") < F.col("b.sub")
    if within:
        before = before | ((F.col("a.sub") == F.col("b.sub")) & (F.col("a.pos") < F.col("b.pos")))
    if left is not None:
        before = before & (F.coalesce("a.new", F.lit(False)) | F.coalesce("b.new", F.lit(False)))
    both = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.check") == F.col("b.check")) & before)
    first = F.coalesce(F.col("a.before") != F.col("b.before"), F.lit(True))
    last = F.coalesce(F.col("a.after") != F.col("b.after"), F.lit(True))
    edge = both.where(first | last).select(F.col("a.sub").alias("a"), F.col("b.sub").alias("b"), F.col("a.pos").alias("s1"), (F.col("a.pos") - F.col("b.pos")).alias("d"), (first.cast("int") + 2 * last.cast("int")).alias("kind"))
    w = Window.partitionBy("a", "b", "d").orderBy("s1").rowsBetween(0, Window.unboundedFollowing)
    end = F.min(F.when(F.col("kind") >= 2, F.col("s1"))).over(w)
    return edge.withColumn("end", end).where("kind <> 2").select("a", "b", "s1", (F.col("s1") - F.col("d")).alias("s2"), (F.col("end") - F.col("s1") + k).alias("len"))


def maximal_runs(seq: DataFrame, k: int, left: DataFrame | None = None, within: bool = False, make: Callable[[DataFrame], DataFrame] = lambda runs: runs, what: str = "runs") -> DataFrame:
    """``(a, b, s1, s2, len)`` of all maximal common runs of ``k`` words or more, ``a < b``, saved; or ``make`` of them.

    Windows of equal hash are joined, but only a run's first and last window leave the join: those whose words
    before or after differ. On each diagonal the next last window ends a run, so what is shuffled for a pair
    follows its runs, not their lengths. With ``left``, only pairs with a submission of it are formed;
    with ``within``, runs that a submission repeats are found as well, once each, with ``a = b``.
    Pairs are formed in rounds by ``a``; ``make`` gets a round's runs, all of a pair at once.
    """
    windows, rounds = edge_windows(seq, k, within)
    out = stored.saved_parts((make(_joined(windows, k, left, within, (p, rounds))) for p in range(rounds)), what)
    stored.dropped(windows)
    return out


def select_tiles(runs: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Longest runs first, then by starts; what a chosen tile covers on either side is cut from the others.

    A heap holds runs by their last known length; one that has been cut since is cut again and put back.
    """
    heap = [(-n, a, b) for a, b, n in runs]
    heapq.heapify(heap)
    chosen: list[tuple[int, int, int]] = []
    left: set[int] = set()
    right: set[int] = set()
    while heap:
        n, a, b = heapq.heappop(heap)
        free = [k for k in range(-n) if a + k not in left and b + k not in right]
        if len(free) == -n:
            chosen.append((a, b, -n))
            left.update(range(a, a - n))
            right.update(range(b, b - n))
            continue
        start = prev = None
        for k in [*free, None]:
            if prev is not None and k != prev + 1:
                if prev - start + 1 >= least:
                    heapq.heappush(heap, (-(prev - start + 1), a + start, b + start))
                start = None
            start = k if start is None else start
            prev = k
    return chosen


def tiles(runs: DataFrame, least: int, sizes: DataFrame | None = None) -> DataFrame:
    """``(a, b, s1, s2, len)`` of the greedy tiles of each pair.

    Of runs of one length the leftmost on the smaller side comes first: that of fewer tokens by ``sizes(sub,
    n_tokens)``, then of the lesser name; without sizes that is ``a``.
    A pair of one run keeps it as it is and never reaches Python; the others go there as arrays, many pairs at
    once.
    """
    pairs = runs.groupBy("a", "b").agg(F.collect_list(F.struct("s1", "s2", "len")).alias("runs"))
    kind = "array<struct<s1:int,s2:int,len:int>>"
    turned = F.lit(False)
    single = pairs.where(F.size("runs") == 1).select("a", "b", F.col("runs").cast(kind).alias("runs"))
    pairs = pairs.where(F.size("runs") > 1)
    if sizes is not None:
        left, right = (sizes.select(F.col("sub").alias(s), F.col("n_tokens").alias(f"n_{s}")) for s in ("a", "b"))
        pairs = pairs.join(left, "a").join(right, "b")
        turned = F.struct("n_b", "b") < F.struct("n_a", "a")
    turn = lambda runs: F.transform(runs, lambda r: F.struct(r["s2"].alias("s1"), r["s1"].alias("s2"), r["len"].alias("len")))
    pairs = pairs.select("a", "b", turned.alias("turned"), F.when(turned, turn(F.col("runs"))).otherwise(F.col("runs")).cast(kind).alias("runs"))

    @F.arrow_udf(kind)
    def greedy(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = [[{"s1": x, "s2": y, "len": n} for x, y, n in select_tiles([(r["s1"], r["s2"], r["len"]) for r in rows], least)] for rows in batch.to_pylist()]
            yield pa.array(out, pa.list_(pa.struct([("s1", pa.int32()), ("s2", pa.int32()), ("len", pa.int32())])))

    chosen = pairs.select("a", "b", "turned", greedy(F.col("runs")).alias("runs"))
    several = chosen.select("a", "b", F.when(F.col("turned"), turn(F.col("runs"))).otherwise(F.col("runs")).alias("runs"))
    return single.unionByName(several).select("a", "b", F.inline("runs"))


def neighbors(matches: DataFrame) -> DataFrame:
    """``matches(a, b, s1, s2, len)`` with their rank on both sides and the gaps to the next on the left side."""
    pair = ["a", "b"]
    left, right = Window.partitionBy(*pair).orderBy("s1", "s2"), Window.partitionBy(*pair).orderBy("s2", "s1")
    ranked = matches.withColumn("r1", F.row_number().over(left)).withColumn("r2", F.row_number().over(right))
    gap = lambda c: F.lead(c).over(left) - F.col(c) - F.col("len")
    return ranked.select("*", gap("s1").alias("gap1"), gap("s2").alias("gap2"), (F.lead("r2").over(left) == F.col("r2") + 1).alias("adjacent"))


def merged(matches: DataFrame, min_match: int, gap: int, required: int, file_ends: DataFrame | None = None) -> DataFrame:
    """``(a, b, s1, s2, l1, l2, merges)``: matches of each pair after coalescing neighbours.

    Neighbours are next to each other in both orders; they merge if the mean of their gaps is ``gap`` at most and
    no file ends in between. A merged match keeps its parts' outer ends, so one pass of islands gives the
    fixed point. Pairs with fewer than ``required`` merges keep their matches as they are. What is shorter than
    ``min_match`` drops out either way. ``file_ends(sub, pos)`` is needed for submissions of several files.
    """
    n = neighbors(matches)
    link = F.coalesce(F.col("adjacent") & ((F.col("gap1") + F.col("gap2")) / 2 <= gap), F.lit(False))
    rows = n.select("a", "b", "s1", "s2", "len", "r1", "gap1", "gap2", link.alias("link"))
    if file_ends is not None:
        ends = file_ends.groupBy("sub").agg(F.collect_set("pos").alias("ends"))
        for side, s, g in (("a", "s1", "gap1"), ("b", "s2", "gap2")):
            rows = rows.join(ends.withColumnsRenamed({"sub": side, "ends": f"ends_{side}"}), side, "left")
            crossed = F.expr(f"exists(coalesce(ends_{side}, array()), e -> e >= {s} + len and e < {s} + len + {g})")
            rows = rows.withColumn("link", F.col("link") & ~crossed).drop(f"ends_{side}")
    w = Window.partitionBy("a", "b").orderBy("r1")
    starts = (~F.coalesce(F.lag("link").over(w), F.lit(False))).cast("int")
    islands = rows.withColumn("start", starts).withColumn("island", F.sum("start").over(w))
    all_merges = F.sum(F.col("link").cast("int")).over(Window.partitionBy("a", "b"))
    islands = islands.withColumn("merges", all_merges).withColumn("island", F.when(F.col("merges") >= required, F.col("island")).otherwise(F.col("r1")))
    out = islands.groupBy("a", "b", "island", "merges").agg(F.min("s1").alias("s1"), F.min("s2").alias("s2"), F.max(F.col("s1") + F.col("len")).alias("e1"), F.max(F.col("s2") + F.col("len")).alias("e2"))
    out = out.select("a", "b", "s1", "s2", (F.col("e1") - F.col("s1")).alias("l1"), (F.col("e2") - F.col("s2")).alias("l2"), F.when(F.col("merges") >= required, F.col("merges")).otherwise(0).cast("long").alias("merges"))
    return out.where(F.least("l1", "l2") >= min_match)


def metrics(matches: DataFrame, sizes: DataFrame) -> DataFrame:
    """Similarities of each pair of ``matches(a, b, l1, l2)``; ``sizes(sub, divisor, n_tokens)``."""
    sums = matches.groupBy("a", "b").agg(F.sum("l1").alias("m1"), F.sum("l2").alias("m2"), F.sum(F.least("l1", "l2")).alias("matched"), F.max(F.least("l1", "l2")).cast("long").alias("longest"), F.count("*").alias("n_matches"))
    left = sizes.select(F.col("sub").alias("a"), F.col("divisor").alias("d1"), F.col("n_tokens").alias("n1"))
    right = sizes.select(F.col("sub").alias("b"), F.col("divisor").alias("d2"), F.col("n_tokens").alias("n2"))
    both = sums.join(left, "a").join(right, "b")
    return _rounded(both, F.greatest("n1", "n2"), F.col("n_matches"), ())


def similarities(pairs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The same of ``pairing.paired`` pairs that carry ``divisor`` and ``n_tokens``, without a join."""
    both = pairs.withColumnsRenamed({"divisor_a": "d1", "divisor_b": "d2"}).withColumns({"m1": F.col("matched"), "m2": F.col("matched"), "longest": F.col("longest").cast("long")})
    return _rounded(both, F.greatest("n_tokens_a", "n_tokens_b"), F.col("n_matches").cast("long").alias("n_matches"), tuple(f"{c}_{s}" for c in carry for s in "ab"))


def _rounded(both: DataFrame, most: Column, n: Column, more: tuple[str, ...]) -> DataFrame:
    share = lambda m, d: F.when(d > 0, m / d).otherwise(0.0)
    one, two = share(F.col("m1"), F.col("d1")), share(F.col("m2"), F.col("d2"))
    avg = share(F.col("m1") + F.col("m2"), F.col("d1") + F.col("d2"))
    return both.select("a", "b", n, "matched", "longest", most.alias("max_len"), N.rounded(avg).alias("avg_sim"), N.rounded(F.greatest(one, two)).alias("max_sim"), N.rounded(F.least(one, two)).alias("min_sim"), *more)
