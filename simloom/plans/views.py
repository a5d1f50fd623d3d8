"""Tables of a run over ``documents`` and the SQL that makes the same tables, for the catalogue's queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.operators import clustering, matching, pairing, tokens
from simloom.sources import stored
from simloom.sources.tables import table

#: Least match in tokens, and least average similarity of a cluster's edge.
K, EDGE = 12, 0.2


#: Tables that the query in hand has saved; each query starts with none.
_SAVED: dict[str, DataFrame] = {}


def start() -> None:
    """Forget what the query before has saved."""
    _SAVED.clear()


def _once(name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is written once for a query, however often the query reads it."""
    if name not in _SAVED:
        made = make()
        _SAVED[name] = made if hasattr(made, "stored_at") else stored.saved(made, name)
    return _SAVED[name]


def _forget(*names: str) -> None:
    """Delete saved tables that a query has read for the last time; what asks for one again makes it anew."""
    for name in names:
        stored.dropped(_SAVED.pop(name))


def words(spark: SparkSession, sf: str) -> DataFrame:
    return _once("words", lambda: tokens.sequences(stored.spread(table(spark, sf, "documents", "doc_id", "text"))))


def valid(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.valid(words(spark, sf), K)


def coded(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a number of 64 bits for each word, for what compares words and never shows them; or with words, once these are saved."""
    if "words" in _SAVED:
        return valid(spark, sf)

    def make() -> DataFrame:
        seq = tokens.sequences(stored.spread(table(spark, sf, "documents", "doc_id", "text")))
        return seq.select("sub", F.transform("words", lambda w: F.xxhash64(w)).alias("words"))

    return tokens.valid(_once("codes", make), K)


def base_words(spark: SparkSession, sf: str) -> DataFrame:
    """The base code: each item of ``benchmark`` is a file of the one base submission."""
    return tokens.sequences(table(spark, sf, "benchmark", "item_id", "text"), "item_id")


def sizes(spark: SparkSession, sf: str) -> DataFrame:
    return coded(spark, sf).select("sub", F.size("words").cast("long").alias("divisor"), (F.size("words") + 1).cast("long").alias("n_tokens"))


def windows(spark: SparkSession, sf: str) -> DataFrame:
    def make() -> DataFrame:
        seq = coded(spark, sf)
        return stored.saved_parts(pairing.windows(seq, K, pairing.size(seq, K)), "windows")

    return _once("windows", make)


def paired(spark: SparkSession, sf: str, what: str, about: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Tiles of all pairs, as they are, by pairs or by spans, not saved; ``about(sub, ...)`` has what else is carried along."""
    rows = sizes(spark, sf)
    if about is not None:
        rows = rows.join(about, "sub", "left")
    w = windows(spark, sf)
    return pairing.paired(w, w.count(), K, rows, what, carry)


def all_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Maximal common runs of all pairs, made anew by each that reads them: none is saved or shuffled."""
    w = windows(spark, sf)
    return pairing.paired(w, w.count(), K, None, "runs")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return _once("runs", lambda: all_runs(spark, sf))


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    return _once("tiles", lambda: paired(spark, sf, "tiles"))


def comparisons(spark: SparkSession, sf: str, about: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Similarities of each pair, made anew by each that reads them: nothing of a pair is saved or shuffled.

    ``about(sub, ...)`` has columns ``carry`` that come along as ``c_a`` and ``c_b``, so that no pair is joined for them.
    """
    return matching.similarities(paired(spark, sf, "pairs", about, ("divisor", "n_tokens", *carry)), carry)


def files(spark: SparkSession, sf: str, *places: str) -> DataFrame:
    """Both sides of each pair with their places among those of the other side; nothing of a pair is saved or shuffled."""
    w = windows(spark, sf)
    return pairing.filed(w, w.count(), K, sizes(spark, sf), places)


def names(spark: SparkSession, sf: str) -> DataFrame:
    """``(sub, name)``: a submission's name in a run over several roots."""
    return table(spark, sf, "documents", "doc_id", "source").select(F.col("doc_id").alias("sub"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("name"))


def named(spark: SparkSession, sf: str) -> DataFrame:
    """Comparisons with the names of both sides."""
    return comparisons(spark, sf, names(spark, sf), ("name",))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return comparisons(spark, sf).select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("avg_sim").alias("w"))


def members(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters for the queries on clusters: components of edges of ``EDGE`` or more, named by their least member."""
    return _once("members", lambda: clustering.single_linkage(edges(spark, sf), EDGE).select(F.col("component").alias("cluster_id"), F.col("node").alias("member")))


def sequences_of_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles with the first side's token codes."""
    coded = valid(spark, sf).select(F.col("sub").alias("a"), F.transform("words", lambda w: F.xxhash64(w)).alias("codes"))
    rows = tiles(spark, sf).join(coded, "a")
    return rows.select("a", "b", "s1", "s2", F.col("len").alias("l1"), F.col("len").alias("l2"), F.slice("codes", F.col("s1") + 1, F.col("len")).alias("seq"))


def spans(spark: SparkSession, sf: str, again: bool = False) -> DataFrame:
    """``(sub, spans)``: the tiles of each first side by their place there, with how many have it; no tile is saved or shuffled.

    Windows go once they are read, unless they are to be read ``again``.
    """

    def make() -> DataFrame:
        words(spark, sf)  # which digests need; windows are then made of them too
        at = paired(spark, sf, "spans").groupBy("a", "s1", "len").agg(F.sum("n").alias("n"))
        made = stored.saved(at.groupBy(F.col("a").alias("sub")).agg(F.collect_list(F.struct("s1", "len", "n")).alias("spans")), "spans")
        if not again:
            _forget("windows")
        return made

    return _once("spans", make)


def _digested(spark: SparkSession, sf: str, again: bool = False) -> DataFrame:
    """``(sub, s1, len, n, md5)``: spans with the digest of their words."""
    each = spans(spark, sf, again).join(valid(spark, sf), "sub").select("sub", "words", F.explode("spans").alias("s"))
    text = F.array_join(F.slice("words", F.col("s.s1") + 1, F.col("s.len")), " ")
    return each.select("sub", "s.s1", "s.len", "s.n", F.unhex(F.md5(text.cast("binary"))).alias("md5"))


def span_weights(spark: SparkSession, sf: str) -> DataFrame:
    """``(sub, s1, len, weight)``: the spans of tiles with how many tiles have their sequence; windows stay."""

    def make() -> DataFrame:
        each = stored.saved(_digested(spark, sf, again=True), "each")
        return each.join(each.groupBy("md5").agg(F.sum("n").cast("double").alias("weight")), "md5").select("sub", "s1", "len", "weight")

    return _once("span_weights", make)


def digests(spark: SparkSession, sf: str) -> DataFrame:
    """``(seq_md5, n, first)``: each distinct sequence of tiles by the digest of its words, how many tiles have it, and where one is."""
    each = _digested(spark, sf).select("md5", "n", F.struct("sub", "s1", "len").alias("first"))
    out = each.groupBy("md5").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return out.select(F.lower(F.hex("md5")).alias("seq_md5"), "n", "first")


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """``(sub, words, n, seq_md5)``: the same with a number and its words as codes."""

    def make() -> DataFrame:
        rows = _once("digests", lambda: digests(spark, sf))
        number = F.conv(F.substring("seq_md5", 1, 15), 16, 10).cast("long")
        lists = rows.groupBy("first.sub").agg(F.collect_list(F.struct(number.alias("number"), "first.s1", "first.len", "n", "seq_md5")).alias("found"))
        coded = valid(spark, sf).select("sub", F.transform("words", lambda w: F.xxhash64(w)).alias("codes"))
        each = lists.join(coded, "sub").select("codes", F.explode("found").alias("f"))
        made = each.select(F.col("f.number").alias("sub"), F.slice("codes", F.col("f.s1") + 1, F.col("f.len")).alias("words"), "f.n", "f.seq_md5")
        made = stored.saved(made, "sequences")
        _forget("words", "spans", "digests")
        return made

    return _once("sequences", make)


def universe(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count("*")
    return coded(spark, sf).agg((n * (n - 1) / 2).cast("long").alias("n"))


def statements(spark: SparkSession, sf: str) -> DataFrame:
    """``(sub, line, n_tokens, first)``: consecutive tokens of one line; lines without tokens have no row."""
    lines = table(spark, sf, "documents", "doc_id", "text").select(F.col("doc_id").alias("sub"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return lines.select("sub", (F.col("line") + 1).alias("line"), w.alias("w")).where(F.size("w") > 0).select("sub", "line", F.size("w").cast("long").alias("n_tokens"), F.col("w")[0].alias("first"))



WORDS = r"words AS (SELECT doc_id AS sub, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)"
VALID = f"{WORDS}, valid AS (SELECT sub, w FROM words WHERE len(w) + 1 >= {K})"
SIZES = f"{VALID}, sizes AS (SELECT sub, len(w) AS divisor, len(w) + 1 AS n_tokens FROM valid)"
GRAMS = f"{SIZES}, grams AS (SELECT sub, pos, array_to_string(w[pos + 1:pos + {K}], ' ') AS gram FROM (SELECT sub, w, unnest(range(0, len(w) - {K - 1})) AS pos FROM valid))"
RUNS = f"""{GRAMS}, seeds AS (SELECT x.sub AS a, y.sub AS b, x.pos AS s1, y.pos AS s2 FROM grams x JOIN grams y ON x.gram = y.gram AND x.sub < y.sub),
islands AS (SELECT *, s1 - row_number() OVER (PARTITION BY a, b, s1 - s2 ORDER BY s1) AS g FROM seeds),
runs AS (SELECT a, b, min(s1) AS s1, min(s2) AS s2, count(*) + {K - 1} AS len FROM islands GROUP BY a, b, s1 - s2, g)"""
#: Longest first, then leftmost on the side of fewer tokens.
_PICK = "OVER (PARTITION BY a, b ORDER BY len DESC, CASE WHEN fwd THEN s1 ELSE s2 END, CASE WHEN fwd THEN s2 ELSE s1 END)"
_STEP = f"fwd, row_number() {_PICK} AS k, first_value(s1) {_PICK} AS c1, first_value(s2) {_PICK} AS c2, first_value(len) {_PICK} AS cl"
TILES = f"""{RUNS}, step AS (
  SELECT a, b, s1, s2, len, {_STEP} FROM (SELECT runs.*, (x.n_tokens, a) <= (y.n_tokens, b) AS fwd FROM runs JOIN sizes x ON x.sub = a JOIN sizes y ON y.sub = b)
  UNION ALL
  SELECT a, b, s1, s2, len, {_STEP} FROM (
    SELECT a, b, fwd, s1 + p.lo AS s1, s2 + p.lo AS s2, p.hi - p.lo AS len FROM (
      SELECT a, b, fwd, s1, s2, unnest([{{'lo': 0, 'hi': least(x, len)}}, {{'lo': greatest(x + cl, 0), 'hi': least(y, len)}}, {{'lo': greatest(y + cl, 0), 'hi': len}}]) AS p
      FROM (SELECT *, least(c1 - s1, c2 - s2) AS x, greatest(c1 - s1, c2 - s2) AS y FROM step WHERE k > 1)
    ) WHERE p.hi - p.lo >= {K}
  )
),
tiles AS (SELECT a, b, s1, s2, len FROM step WHERE k = 1)"""
CMP = f"""{TILES}, cmp AS (
  SELECT a, b, count(*) AS n_matches, CAST(sum(len) AS BIGINT) AS matched, max(len) AS longest, greatest(any_value(x.n_tokens), any_value(y.n_tokens)) AS max_len,
    round(2 * sum(len) / (any_value(x.divisor) + any_value(y.divisor)), 6) AS avg_sim, round(sum(len) / least(any_value(x.divisor), any_value(y.divisor)), 6) AS max_sim, round(sum(len) / greatest(any_value(x.divisor), any_value(y.divisor)), 6) AS min_sim
  FROM tiles JOIN sizes x ON x.sub = a JOIN sizes y ON y.sub = b GROUP BY a, b)"""
NAMED = f"""{CMP}, names AS (SELECT doc_id AS sub, concat_ws('/', source, doc_id) AS name FROM documents),
named AS (SELECT cmp.*, x.name AS name_a, y.name AS name_b FROM cmp JOIN names x ON x.sub = a JOIN names y ON y.sub = b)"""
MEMBERS = f"""{NAMED}, near AS (SELECT a AS i, b AS j FROM cmp WHERE avg_sim >= {EDGE} UNION SELECT b, a FROM cmp WHERE avg_sim >= {EDGE}),
reach(i, j) AS (SELECT i, i FROM near UNION SELECT reach.i, near.j FROM reach JOIN near ON reach.j = near.i),
members AS (SELECT min(j) AS cluster_id, i AS member FROM reach GROUP BY i)"""


def sql(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body}"
