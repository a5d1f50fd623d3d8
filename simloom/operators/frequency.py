"""How often matched token sequences occur, and similarities weighted by their rarity.

Matches are ``(a, b, s1, s2, l1, l2, seq)`` with ``seq`` the first side's token codes.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.functions import numbers as N
from simloom.operators import pairing, tokens
from simloom.sources import stored


def _distinct(matches: DataFrame) -> DataFrame:
    """``(sub, words, n)``: each distinct sequence under a number, and how many matches have it; saved."""
    seqs = matches.groupBy(F.col("seq").alias("words")).agg(F.count("*").alias("n")).select(F.xxhash64("words").alias("sub"), "words", "n")
    return stored.saved(seqs, "sequences")


def _weights(seqs: DataFrame, by_sub: DataFrame) -> DataFrame:
    return seqs.join(by_sub, "sub", "left").select(F.col("words").alias("seq"), F.coalesce("weight", F.lit(0.0)).cast("double").alias("weight"))


def complete(matches: DataFrame, least: int) -> DataFrame:
    """``(seq, weight)``: how many matches have exactly this sequence."""
    return matches.groupBy("seq").agg(F.count("*").cast("double").alias("weight"))


def contained(matches: DataFrame, least: int) -> DataFrame:
    """Mean count of whole matches of ``least`` tokens or more over those parts of a sequence that are one."""
    seqs = _distinct(matches)
    return _weights(seqs, contained_of(seqs, least))


def submatches(matches: DataFrame, least: int) -> DataFrame:
    """Mean count, over all matches, of all parts of a sequence of ``least`` tokens or more."""
    seqs = _distinct(matches)
    return _weights(seqs, submatches_of(seqs, least))


def windows(matches: DataFrame, size: int) -> DataFrame:
    """Mean count of the windows of a sequence; 0 for one that is shorter."""
    seqs = _distinct(matches)
    return _weights(seqs, windows_of(seqs, size))


def _shared(seqs: DataFrame, least: int) -> DataFrame:
    """``seqs(sub, n, size)`` with what each shares with the others and in other places with itself (``pairing.paired`` of ``parts``).

    Equal parts of two sequences lie in their maximal common runs, and a run of r tokens holds as many pairs of
    equal parts as it has parts; one that is a whole sequence shows that as inside the other. So parts, which grow
    with the square of a match's length, are never listed, and runs are counted where they are found.
    """
    words = seqs.select("sub", "words")
    kept = stored.saved_parts(pairing.windows(words, least, pairing.size(words, least), within=True), "inner")
    about = seqs.select("sub", F.size("words").cast("long").alias("n_tokens"), "n")
    sums = pairing.paired(kept, kept.count(), least, about, "parts", ("n",)).groupBy("sub").agg(*(F.sum(c).alias(c) for c in ("equal", "wholes", "n_wholes")))
    return seqs.select("sub", "n", F.size("words").alias("size")).join(sums, "sub", "left").na.fill(0, ["equal", "wholes", "n_wholes"])


def contained_of(seqs: DataFrame, least: int) -> DataFrame:
    """``(sub, weight)`` of ``contained``, of saved distinct sequences ``(sub, words, n)``."""
    mean = (F.col("wholes") + F.col("n")) / (F.col("n_wholes") + 1)
    return _shared(seqs, least).select("sub", F.when(F.col("size") >= least, mean).otherwise(0.0).alias("weight"))


def submatches_of(seqs: DataFrame, least: int) -> DataFrame:
    """The same of ``submatches``. A sequence shorter than ``least`` has itself as its one part."""
    parts = (F.col("size") - least + 1) * (F.col("size") - least + 2) / 2
    return _shared(seqs, least).select("sub", F.when(F.col("size") < least, F.col("n").cast("double")).otherwise(F.col("equal") / parts + F.col("n")).alias("weight"))


def windows_of(seqs: DataFrame, size: int) -> DataFrame:
    """The same of ``windows``."""
    grams = tokens.grams(seqs, size).select("sub", "gram")
    counts = grams.join(seqs.select("sub", "n"), "sub").groupBy("gram").agg(F.sum("n").alias("n"))
    return grams.join(counts, "gram").groupBy("sub").agg(F.avg("n").alias("weight"))


STRATEGIES: dict[str, Callable[[DataFrame, int], DataFrame]] = {"complete": complete, "contained": contained, "submatches": submatches, "windows": windows}


def _sigmoid(r: Column) -> Column:
    s = lambda x: 1 / (1 + F.exp(-10 * (x - 0.5)))
    low, high = s(F.lit(0.0)), s(F.lit(1.0))
    return 1 + (s(r) - low) / (high - low)


#: Weight of a match by its rarity from 0 to 1.
WEIGHTINGS: dict[str, Callable[[Column], Column]] = {
    "linear": lambda r: 1 + r,
    "proportional": lambda r: 2 * r,
    "quadratic": lambda r: 1 + r * r,
    "sigmoid": _sigmoid,
}


def scaled(weighting: str, factor: float) -> Column:
    """The factor of a match's length, of its ``weight`` and the greatest, ``most``."""
    rarity = 1 - F.least(F.col("weight") / F.greatest("most", F.lit(1.0)), F.lit(1.0))
    return F.when(F.col("weight") == 0, 1.0).otherwise((1 - factor) + factor * WEIGHTINGS[weighting](rarity))


def spans_weighted(spans: DataFrame, weighting: str, factor: float) -> DataFrame:
    """``(sub, worth)``: of ``spans(sub, s1, len, weight)`` the list ``(s1, len, m)`` of each submission, ``m`` both sides' length times the factor, in units of 1e-10."""
    most = spans.agg(F.coalesce(F.max("weight"), F.lit(1.0)).alias("most"))
    m = (2 * F.col("len") * scaled(weighting, factor)).cast("decimal(28,10)")
    rows = spans.crossJoin(F.broadcast(most)).withColumn("m", (m * 10_000_000_000).cast("long"))  # one row
    return rows.groupBy("sub").agg(F.collect_list(F.struct(F.col("s1").cast("int").alias("s1"), F.col("len").cast("int").alias("len"), "m")).alias("worth"))


def similarity_of(pairs: DataFrame) -> DataFrame:
    """``weighted_similarity`` of ``pairing.paired`` pairs whose tiles are ``weighted``."""
    m, d = (F.col("m").cast("decimal(28,0)") * F.lit(Decimal("0.0000000001"))).cast("double"), F.col("divisor_a") + F.col("divisor_b")
    return pairs.select("a", "b", N.rounded(F.when(d > 0, m / d).otherwise(0.0)).alias("weighted_sim"))


def weighted_similarity(matches: DataFrame, weights: DataFrame, sizes: DataFrame, weighting: str, factor: float) -> DataFrame:
    """``(a, b, weighted_sim)``: the average similarity with each match's length times its factor.

    The factor is ``(1 - f) + f * w(rarity)`` with ``rarity = 1 - min(weight / greatest weight, 1)``; a match
    whose sequence has no weight counts in full.
    """
    most = weights.agg(F.coalesce(F.max("weight"), F.lit(1.0)).alias("most"))
    rows = matches.join(weights, "seq", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0))).crossJoin(F.broadcast(most))  # one row
    scale = scaled(weighting, factor)
    sums = rows.groupBy("a", "b").agg(F.sum(((F.col("l1") + F.col("l2")) * scale).cast("decimal(28,10)")).cast("double").alias("m"))
    left, right = (sizes.select(F.col("sub").alias(s), F.col("divisor").alias(f"d_{s}")) for s in ("a", "b"))
    d = F.col("d_a") + F.col("d_b")
    return sums.join(left, "a").join(right, "b").select("a", "b", N.rounded(F.when(d > 0, F.col("m") / d).otherwise(0.0)).alias("weighted_sim"))
