"""A whole run: from files of submissions to comparisons, distribution and clusters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.config import ClusterOptions, Options
from simloom.operators import clustering, frequency, matching, results, tokens
from simloom.sources import stored
from simloom.tokenize import registry


@dataclass(frozen=True)
class Result:
    """Tables of a run; ``matches`` holds (a, b, s1, s2, l1, l2), ``base`` the same of submissions and the base code.

    ``places`` has the file, line and column of each token of a submission. Clusters are made when they are asked
    for, so a run whose clusters need too large a matrix has all its other tables.
    """

    options: Options
    states: DataFrame
    places: DataFrame
    base: DataFrame
    matches: DataFrame
    comparisons: DataFrame
    distribution: DataFrame

    @cached_property
    def clusters(self) -> DataFrame | None:
        """``(cluster_id, member)``; None if they were not wanted."""
        return clusters(self.comparisons, self.options.clustering) if self.options.clustering.enabled else None


def submissions(files: DataFrame, options: Options) -> DataFrame:
    """``(sub, words, places, n_files, is_new, is_base, error)`` of ``files(sub, path, text, is_new, is_base)``.

    Words are token types in order of path, places their file, line, column and length. Each file's end is a word of
    its own that equals no other.
    """
    read = registry.tokenized(files, options.language, options.normalize)
    end = F.concat_ws(":", F.lit("\0end"), F.col("sub"), F.col("path"))
    words = F.transform("tokens", lambda t: F.when(t["type"] == "EOF", end).otherwise(t["type"]))
    places = F.transform("tokens", lambda t: F.struct(F.col("path").alias("file"), t["line"].alias("line"), t["column"].alias("column"), t["length"].alias("length")))
    rows = read.select("sub", "path", words.alias("w"), places.alias("p"), "is_new", "is_base", "error")
    out = rows.groupBy("sub", "is_base").agg(F.array_sort(F.collect_list(F.struct("path", "w", "p"))).alias("all"), F.count("*").alias("n_files"), F.bool_or("is_new").alias("is_new"), F.max("error").alias("error"))
    return out.select("sub", F.flatten(F.transform("all", lambda x: x["w"])).alias("words"), F.flatten(F.transform("all", lambda x: x["p"])).alias("places"), "n_files", "is_new", "is_base", "error")


class RunError(ValueError):
    """A run that can't be made: too few valid submissions, or a base code that isn't valid."""


def run(files: DataFrame, options: Options = Options()) -> Result:
    """Compare all submissions of ``files``, old ones with new ones only.

    Files are tokenised once; what is computed from them is written to the shared folder. Fewer than two valid
    submissions are an error, and so is a base code that can't be parsed or is shorter than a match.
    """
    every = stored.saved(submissions(stored.spread(files), options), "submissions")
    n = F.greatest(F.coalesce(F.size("words"), F.lit(0)), F.lit(0))
    state = F.when(F.col("error").isNotNull(), "CANNOT_PARSE").when(n <= 0, "NOTHING_TO_PARSE").when(n < options.min_match, "TOO_SMALL").otherwise("VALID")
    told = every.select("sub", "is_base", n.cast("long").alias("n_tokens"), state.alias("state"))
    checked(told, options)
    states = told.where("not is_base").drop("is_base")
    mine = every.where("not is_base")
    usable = mine.join(states.where("state = 'VALID'").select("sub"), "sub", "left_semi")

    least = options.tile_length
    marking = tokens.base_marking(usable.select("sub", "words"), every.where("is_base").select("sub", "words"), options.min_match)
    covered = marking.groupBy("sub").agg(F.sum(F.col("e") - F.col("s")).alias("covered"))
    sizes = usable.join(covered, "sub", "left").select("sub", (F.size("words") - F.col("n_files") - F.coalesce("covered", F.lit(0))).cast("long").alias("divisor"), F.size("words").cast("long").alias("n_tokens"))

    seq = stored.saved(tokens.masked(usable.select("sub", "words"), marking), "masked")
    tiles = matching.maximal_runs(seq, least, left=usable.where("is_new").select("sub"), make=lambda runs: matching.tiles(runs, least, sizes), what="tiles")
    if options.merging.enabled:
        ends = tokens.long_form(seq).where(F.startswith("tok", F.lit("\0end"))).select("sub", "pos")
        matches = matching.merged(tiles, options.min_match, options.merging.gap, options.merging.required, ends).drop("merges")
    else:
        matches = tiles.where(F.col("len") >= options.min_match).select("a", "b", "s1", "s2", F.col("len").alias("l1"), F.col("len").alias("l2"))
    matches = stored.saved(matches, "matches")
    comparisons = matching.metrics(matches, sizes).where(F.col(options.metric) >= options.threshold)
    if options.frequency.enabled:
        coded = seq.select(F.col("sub").alias("a"), F.transform("words", lambda w: F.xxhash64(w)).alias("codes"))
        worded = matches.join(coded, "a").withColumn("seq", F.slice("codes", F.col("s1") + 1, F.col("l1"))).drop("codes")
        weights = frequency.STRATEGIES[options.frequency.strategy](worded, options.frequency.least)
        weighted = frequency.weighted_similarity(worded, weights, sizes, options.frequency.weighting, options.frequency.factor)
        comparisons = comparisons.drop("avg_sim").join(weighted.withColumnRenamed("weighted_sim", "avg_sim"), ["a", "b"])
    new = F.count(F.when(F.col("is_new"), 1))
    two = lambda c: c * (c - 1) / 2
    universe = usable.agg(F.count("*").alias("all"), new.alias("new")).select((two(F.col("all")) - two(F.col("all") - F.col("new"))).cast("long").alias("n"))
    distribution = results.distribution(comparisons, "avg_sim", universe if options.threshold == 0 else None)
    base = marking.select("sub", "s", (F.col("e") - F.col("s")).alias("len"))
    return Result(options, states, usable.select("sub", "places"), base, matches, comparisons, distribution)


def checked(told: DataFrame, options: Options) -> None:
    """An error unless two submissions or more of ``told(sub, is_base, n_tokens, state)`` are valid, and the base code is."""
    base = told.where("is_base and state <> 'VALID'").first()
    if base is not None:
        why = f"it has {base['n_tokens']} tokens, a match needs {options.min_match}" if base["state"] == "TOO_SMALL" else base["state"]
        raise RunError(f"base code {base['sub']}: {why}")
    if told.where("not is_base and state = 'VALID'").limit(2).count() < 2:
        few = [f"{r['sub']}: {r['state']}" for r in told.where("not is_base and state <> 'VALID'").limit(20).collect()]
        raise RunError("fewer than two valid submissions; " + ", ".join(few))


def clusters(comparisons: DataFrame, c: ClusterOptions) -> DataFrame:
    """``(cluster_id, member)`` of comparisons, after preprocessing."""
    ids = comparisons.select(F.col("a").alias("name")).union(comparisons.select("b")).distinct().withColumn("id", F.xxhash64("name"))
    edges = comparisons.join(ids.select(F.col("name").alias("a"), F.col("id").alias("x")), "a").join(ids.select(F.col("name").alias("b"), F.col("id").alias("y")), "b")
    edges = stored.saved(edges.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), F.col(c.metric).alias("w")), "edges")
    prepared = {"cdf": clustering.by_cumulative, "threshold": lambda e: clustering.by_threshold(e, c.threshold), "percentile": lambda e: clustering.by_percentile(e, c.percentile), "none": lambda e: e}[c.preprocessing](edges)
    members = clustering.clusters(prepared, c.algorithm, c.agglomerative_threshold, c.linkage, c.seed)
    return members.join(ids, members["member"] == ids["id"]).select("cluster_id", F.col("name").alias("member"))
