"""Submissions as token sequences: states, long form, k-grams, exclusion by base code."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions import text as T

#: Files end with one token of a kind that is excluded from matching.
FILE_END = 1


def sequences(docs: DataFrame, sub: str = "doc_id", text: str = "text") -> DataFrame:
    """``(sub, words)``: one row a submission of one file, its words as an array."""
    return docs.select(F.col(sub).alias("sub"), T.words(F.col(text)).alias("words"))


def states(seq: DataFrame, min_match: int) -> DataFrame:
    """``(sub, n_tokens, state)``; tokens include the file's end."""
    n = F.size("words") + FILE_END
    state = F.when(F.col("words").isNull(), "NOTHING_TO_PARSE").when(n < min_match, "TOO_SMALL").otherwise("VALID")
    return seq.select("sub", F.when(F.col("words").isNull(), 0).otherwise(n).cast("long").alias("n_tokens"), state.alias("state"))


def valid(seq: DataFrame, min_match: int) -> DataFrame:
    return seq.where(F.size("words") + FILE_END >= min_match)


def long_form(seq: DataFrame) -> DataFrame:
    """``(sub, pos, tok)``."""
    return seq.select("sub", F.posexplode("words").alias("pos", "tok"))


def grams(seq: DataFrame, k: int, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """``(sub, pos, gram, check, before, after)``: two hashes of each window of k words, and those of the words around it.

    ``gram`` and ``check`` are 128 bits together, so that among 10^12 windows no two unlike ones are expected to agree.
    Windows come from the arrays themselves, so no window function shuffles or sorts the tokens. ``part`` of
    (number, of how many) keeps one part of them, chosen by their outer words, so that equal windows stay together.
    """
    coded = seq.select("sub", F.transform("words", lambda w: F.xxhash64(w)).alias("c"))
    at = F.explode(F.sequence(F.lit(0), F.size("c") - k))
    rows = coded.where(F.size("c") >= k).select("sub", "c", at.alias("pos"))
    if part[1] > 1:
        rows = rows.where(F.pmod(F.xxhash64(F.get("c", F.col("pos")), F.get("c", F.col("pos") + (k - 1))), F.lit(part[1])) == part[0])
    rows = rows.withColumn("w", F.slice("c", F.col("pos") + 1, k))
    # Which word is before or after matters only for equality, so null stands for none and equals nothing.
    return rows.select("sub", "pos", F.xxhash64("w").alias("gram"), F.xxhash64(F.lit(k), F.reverse("w")).alias("check"), F.get("c", F.col("pos") - 1).alias("before"), F.get("c", F.col("pos") + k).alias("after"))


def dictionary(seq: DataFrame) -> DataFrame:
    """``(tok, n, tok_id)``: every distinct token with a dense number in order, 0 being kept for the file's end.

    Numbers are counted within a two-character prefix and moved on by the counts of earlier prefixes, so that
    only the small table of prefixes is ordered as a whole.
    """
    distinct = long_form(seq).groupBy("tok").agg(F.count("*").alias("n")).withColumn("p", F.substring("tok", 1, 2))
    sizes = distinct.groupBy("p").agg(F.count("*").alias("m"))
    offsets = sizes.select("p", (F.sum("m").over(Window.orderBy("p")) - F.col("m")).alias("before"))
    own = F.row_number().over(Window.partitionBy("p").orderBy("tok"))
    return distinct.withColumn("k", own).join(offsets, "p").select("tok", "n", (F.col("before") + F.col("k")).alias("tok_id"))


def base_marking(seq: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """``(sub, s, e)``: the maximal stretches [s, e) of each submission that windows shared with ``base`` cover."""
    shared = grams(seq, k).join(grams(base, k).select("gram", "check").distinct(), ["gram", "check"], "left_semi").select("sub", "pos")
    w = Window.partitionBy("sub").orderBy("pos")
    new = F.coalesce(F.col("pos") > F.lag("pos").over(w) + k, F.lit(True)).cast("int")
    island = F.sum("new").over(w)
    return shared.withColumn("new", new).withColumn("g", island).groupBy("sub", "g").agg(F.min("pos").alias("s"), (F.max("pos") + k).alias("e")).drop("g")


def exclusion_mask(seq: DataFrame, marking: DataFrame) -> DataFrame:
    """``(sub, n_tokens, n_excluded)``: tokens, file's end included, and those that matching must not use."""
    covered = marking.groupBy("sub").agg(F.sum(F.col("e") - F.col("s")).alias("covered"))
    n = (F.size("words") + FILE_END).cast("long")
    return seq.join(covered, "sub", "left").select("sub", n.alias("n_tokens"), (F.coalesce("covered", F.lit(0)) + FILE_END).cast("long").alias("n_excluded"))


def masked(seq: DataFrame, marking: DataFrame) -> DataFrame:
    """``seq`` with each marked token replaced by a word of its own, which equals no other."""
    spans = marking.groupBy("sub").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    inside = lambda k: F.exists("spans", lambda x: (k >= x["s"]) & (k < x["e"]))
    own = lambda w, k: F.when(inside(k), F.concat_ws(":", F.lit("\0"), F.col("sub").cast("string"), k.cast("string"))).otherwise(w)
    words = F.when(F.col("spans").isNull(), F.col("words")).otherwise(F.transform("words", own))
    return seq.join(spans, "sub", "left").select("sub", words.alias("words"))
