"""What a report says of matches: lines, colours, and its files."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from dataclasses import asdict
from datetime import datetime
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simloom.config import Options
from simloom.functions import numbers as N

COLORS = 7
VERSION = (1, 0, 0)


def line_ranges(matches: DataFrame, statements: DataFrame) -> DataFrame:
    """``matches(a, b, s1, s2, len)`` with the first and last line of each side: ``line1, end1, line2, end2``.

    Lines come as one sorted array a submission, in which a match's first and last token are looked up, so no
    range join is needed.
    """
    w = Window.partitionBy("sub").orderBy("line")
    ends = statements.withColumn("to", F.sum("n_tokens").over(w))
    arrays = ends.groupBy("sub").agg(F.array_sort(F.collect_list(F.struct("line", "to"))).alias("lines"))
    rows = matches
    for k, side in ((1, "a"), (2, "b")):
        at = lambda pos: F.filter("lines", lambda x: x["to"] > pos)[0]["line"]
        start = F.col(f"s{k}")
        rows = rows.join(arrays.withColumnRenamed("sub", side), side).withColumns({f"line{k}": at(start), f"end{k}": at(start + F.col("len") - 1)}).drop("lines")
    return rows.select("a", "b", "s1", "s2", "len", "line1", "end1", "line2", "end2")


def positions(matches: DataFrame, places: DataFrame) -> DataFrame:
    """``matches(a, b, s1, s2, l1, l2)`` with ``first`` and ``second``: where each side begins and ends.

    A side is ``struct(file, start, end)`` and each end ``struct(line, column, token)``: the least begin and the
    greatest end of the match's tokens by line and column, columns from 0. ``places(sub, places)`` is what a run has.
    """
    rows = matches
    for name, side, s, n in (("first", "a", "s1", "l1"), ("second", "b", "s2", "l2")):
        mine = places.select(F.col("sub").alias(side), F.col("places").alias("p"))
        rows = rows.join(mine, side).withColumn("p", F.slice("p", F.col(s) + 1, F.col(n)))
        low = F.array_min(F.transform("p", lambda t: F.struct(t["line"].alias("line"), t["column"].alias("column"), t["file"].alias("file"))))
        high = F.array_max(F.transform("p", lambda t: F.struct(t["line"].alias("line"), (t["column"] + t["length"]).alias("column"))))
        end = lambda x, token: F.struct(x["line"].alias("line"), (x["column"] - 1).alias("column"), token.cast("long").alias("token"))
        rows = rows.withColumn(name, F.struct(low["file"].alias("file"), end(low, F.col(s)).alias("start"), end(high, F.col(s) + F.col(n) - 1).alias("end"))).drop("p")
    return rows


def base_code(base: DataFrame, places: DataFrame, shown: DataFrame) -> DataFrame:
    """``(sub, matches)`` for each submission of ``shown(sub)``: where it matches the base code; empty if it doesn't."""
    rows = positions(base.select(F.col("sub").alias("a"), F.col("sub").alias("b"), F.col("s").alias("s1"), F.col("s").alias("s2"), F.col("len").alias("l1"), F.col("len").alias("l2")), places)
    lists = rows.groupBy(F.col("a").alias("sub")).agg(F.array_sort(F.collect_list(F.struct(F.col("s1").cast("long").alias("token"), F.col("l1").cast("long").alias("length"), F.col("first").alias("place")))).alias("matches"))
    return shown.select("sub").distinct().join(lists, "sub", "left").withColumn("matches", F.coalesce("matches", F.array().cast(lists.schema["matches"].dataType)))


def run_information(states: DataFrame, n_comparisons: int, began: datetime, milliseconds: int) -> DataFrame:
    """One row: version, date, duration in milliseconds and as text, number of comparisons, and what could not be compared."""
    failed = states.where("state <> 'VALID'").agg(F.array_sort(F.collect_list(F.struct(F.col("sub").alias("submission"), "state"))).alias("failed"))
    took = F.lit(milliseconds).cast("long")
    version = F.struct(*(F.lit(v).alias(n) for n, v in zip(("major", "minor", "patch"), VERSION, strict=True)))
    return failed.select(version.alias("version"), N.day(F.lit(began)).alias("date"), took.alias("milliseconds"), N.duration(took).alias("duration"), F.lit(n_comparisons).cast("long").alias("comparisons"), "failed")


def colors(matches: DataFrame) -> DataFrame:
    """``(a, b, s1, s2, color)``: one of seven colours for each match of a pair, unlike its neighbours' on either side."""
    kind = "array<struct<s1:long,s2:long,color:int>>"

    @F.arrow_udf(kind)
    def paint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for rows in batch.to_pylist():
                near: dict[int, set[int]] = {k: set() for k in range(len(rows))}
                for side in ("s1", "s2"):
                    order = sorted(range(len(rows)), key=lambda k, side=side: rows[k][side])
                    for x, y in zip(order, order[1:], strict=False):
                        near[x].add(y)
                        near[y].add(x)
                got: dict[int, int] = {}
                for k in sorted(near, key=lambda k: (rows[k]["s1"], rows[k]["s2"])):
                    taken = {got[j] for j in near[k] if j in got}
                    got[k] = next(c for c in range(COLORS) if c not in taken)
                out.append([{"s1": r["s1"], "s2": r["s2"], "color": got[k]} for k, r in enumerate(rows)])
            yield pa.array(out, pa.list_(pa.struct([("s1", pa.int64()), ("s2", pa.int64()), ("color", pa.int32())])))

    pairs = matches.groupBy("a", "b").agg(F.collect_list(F.struct(F.col("s1").cast("long").alias("s1"), F.col("s2").cast("long").alias("s2"))).alias("m"))
    return pairs.select("a", "b", F.inline(paint(F.col("m"))))


def options_json(options: Options) -> str:
    return json.dumps(asdict(options), sort_keys=True)


def tables(spark, options: Options, comparisons: DataFrame, matches: DataFrame, distribution: DataFrame, states: DataFrame, clusters: DataFrame | None) -> dict[str, DataFrame]:
    """The report's parts as tables of one JSON column ``value``, details only of the comparisons shown."""
    from simloom.operators import results

    shown = results.top(comparisons, options.metric, options.shown)
    detail = shown.select("a", "b").join(matches, ["a", "b"]).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("s1", "s2", "l1", "l2"))).alias("matches"))
    failed = states.where("state <> 'VALID'").select("sub", "state")
    one = lambda df: df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    out = {"topComparisons": one(shown), "comparisons": one(detail), "distribution": one(distribution), "failed": one(failed), "options": spark.createDataFrame([(options_json(options),)], "value string"), "runInformation": one(spark.createDataFrame([VERSION], "major int, minor int, patch int"))}
    if clusters is not None:
        out["cluster"] = one(clusters.groupBy("cluster_id").agg(F.sort_array(F.collect_list("member")).alias("members")))
    return out


def write(parts: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines for each part, written by the executors."""
    for name, df in parts.items():
        df.write.mode("overwrite").text(f"{path}/{name}")


def free_name(path: str, overwrite: bool = False, tries: int = 4) -> str:
    """``path``, or with a number before its suffix if it exists."""
    p = Path(path)
    if overwrite or not p.exists():
        return str(p)
    for k in range(1, tries + 1):
        if not (q := p.with_name(f"{p.stem}({k}){p.suffix}")).exists():
            return str(q)
    raise FileExistsError(path)


def archive(folder: str, path: str, overwrite: bool = False) -> str:
    """One zip of a written report, for reports whose shown part is small enough to carry."""
    target = free_name(path, overwrite)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for part in sorted(p for p in Path(folder).iterdir() if p.is_dir()):
            with z.open(f"{part.name}.jsonl", "w") as out:
                for piece in sorted(part.glob("part-*")):
                    out.write(piece.read_bytes())
    return target


def read_archive(path: str, least: tuple[int, int, int] = (1, 0, 0)) -> dict[str, list[dict]]:
    """The parts of an archive; an older version than ``least`` is refused."""
    with zipfile.ZipFile(path) as z:
        out = {n.removesuffix(".jsonl"): [json.loads(x) for x in z.read(n).decode().splitlines()] for n in z.namelist()}
    run = out["runInformation"][0]
    if (run["major"], run["minor"], run["patch"]) < least:
        raise ValueError(f"report of version {run}; at least {least} is needed")
    return out
