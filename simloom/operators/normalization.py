"""Order-free token sequences by the dependences of statements.

A statement holds the tokens of one line with what they read and write. Statements are vertices; an edge means
that the later one must stay behind the earlier. Statements that nothing critical depends on are dead and drop
out; the others are emitted layer by layer, those with more tokens first.

``edges`` states the dependences as joins of what statements read and write, for all submissions at once. The order needs
no edges: a statement's layer is the length of the longest path to it, which the greatest layers of each variable's
reads and writes give in one pass, so work is linear in accesses where edges are quadratic in a variable's uses.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOW, REVERSE, ORDER, FULL, PARTIAL = "VARIABLE_FLOW", "VARIABLE_REVERSE_FLOW", "VARIABLE_ORDER", "POSITION_FULL", "POSITION_PARTIAL"


class Statement(NamedTuple):
    """Line, size and first kind; whether it is critical; position 0 none, 1 partial, 2 full; change of loop depth."""

    line: int
    n_tokens: int
    kind: str
    critical: bool
    position: int
    depth: int
    reads: frozenset
    writes: frozenset


STATEMENTS = "sub long, line int, n_tokens long, kind string, critical boolean, position int, depth int, reads array<string>, writes array<string>"


def from_statements(lines: DataFrame) -> DataFrame:
    """Statements of plain text: a line writes its first word and reads that of the line before; the last is critical."""
    w = Window.partitionBy("sub").orderBy("line")
    before = F.lag("first").over(w)
    reads = F.when(before.isNull(), F.array().cast("array<string>")).otherwise(F.array(before))
    return lines.select("sub", "line", "n_tokens", F.col("first").alias("kind"), F.lead("line").over(w).isNull().alias("critical"), F.lit(0).alias("position"), F.lit(0).alias("depth"), reads.alias("reads"), F.array("first").alias("writes"))


def _placed(statements: DataFrame) -> DataFrame:
    """Statements with ``place`` (1, 2, ... by line), ``epoch`` (full positions so far) and ``loop`` (the stretch within loops; else null).

    Null kinds of access count as none, a null position or change of depth as 0.
    """
    so_far = Window.partitionBy("sub").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = statements.select("sub", "line", F.coalesce("position", F.lit(0)).alias("position"), F.coalesce("depth", F.lit(0)).alias("depth"), "reads", "writes")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("sub").orderBy("line"))).withColumn("epoch", F.sum(F.when(F.col("position") == 2, 1).otherwise(0)).over(so_far))
    rows = rows.withColumn("__inside", F.sum("depth").over(so_far) > 0)
    stretch = F.sum(F.when(F.col("__inside"), 0).otherwise(1)).over(so_far)
    return rows.select("sub", "line", "place", "position", "epoch", "reads", "writes", F.when(F.col("__inside"), stretch).alias("loop"))


def edges(statements: DataFrame) -> DataFrame:
    """``(sub, line, later, kinds)``: every dependence, its kinds sorted and joined by commas.

    A later read of what was written is a flow; a later write of what was read is a reverse flow within one stretch of
    loops, else an order, as is a later write of what was written. Full positions hold back all that follows and wait
    for all since the one before; partial positions keep their order among themselves.
    """
    rows = _placed(statements)

    def uses(column: str, *more: str) -> DataFrame:
        return rows.select("sub", "line", "place", *more, F.explode(F.array_distinct(column)).alias("name"))

    def pairs(earlier: DataFrame, later: DataFrame, on: list[str], when: str, kind: Column) -> DataFrame:
        both = earlier.alias("x").join(later.alias("y"), on).where(when)
        return both.select("sub", F.col("x.line").alias("line"), F.col("y.line").alias("later"), kind.alias("kind"))

    reads, writes = uses("reads", "loop"), uses("writes", "loop")
    before = "x.place < y.place"
    full = rows.where("position = 2").select("sub", "line", "place", "epoch")
    in_epoch = rows.select("sub", "line", "place", "epoch")
    partial = Window.partitionBy("sub").orderBy("line")
    found = [
        pairs(writes, reads, ["sub", "name"], before, F.lit(FLOW)),
        pairs(writes, writes, ["sub", "name"], before, F.lit(ORDER)),
        pairs(reads, writes, ["sub", "name"], before, F.when(F.col("x.loop") == F.col("y.loop"), REVERSE).otherwise(ORDER)),
        pairs(full, in_epoch, ["sub", "epoch"], before, F.lit(FULL)),
        pairs(in_epoch, full.withColumn("epoch", F.col("epoch") - 1), ["sub", "epoch"], "true", F.lit(FULL)),
        rows.where("position = 1").select("sub", F.lag("line").over(partial).alias("line"), F.col("line").alias("later"), F.lit(PARTIAL).alias("kind")).where("line is not null"),
    ]
    out = functools.reduce(DataFrame.unionAll, found)
    return out.groupBy("sub", "line", "later").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def layers(statements: list[Statement]) -> list[int]:
    """The longest path of dependences to each statement."""
    read, written = defaultdict(int), defaultdict(int)  # one more than the greatest layer of a variable's uses so far
    since_full = after_full = after_partial = 0
    out = []
    for s in statements:
        waits = [written[v] for v in s.reads | s.writes] + [read[v] for v in s.writes]
        layer = max([after_full, *waits, since_full if s.position == 2 else 0, after_partial if s.position == 1 else 0])
        since_full = max(since_full, layer + 1)
        if s.position == 2:
            since_full = after_full = layer + 1
        elif s.position == 1:
            after_partial = layer + 1
        for table, names in ((read, s.reads), (written, s.writes)):
            for v in names:
                table[v] = max(table[v], layer + 1)
        out.append(layer)
    return out


def living(statements: list[Statement]) -> set[int]:
    """Indices of the critical statements and of all that a living one reads from.

    That is every write before a living read, and within one stretch of loops every write after it. A variable's writes
    are taken from lists, each once, however many reads ask for them.
    """
    early: dict = defaultdict(list)  # by variable, the last first: a read takes those before it from the end
    late: dict = defaultdict(list)  # by variable and stretch of loops, the first first
    stretch, depth = [], 0
    for k, s in enumerate(statements):
        depth += s.depth
        stretch.append(None if depth <= 0 else stretch[-1] if k and stretch[-1] is not None else k)
        for v in s.writes:
            late[v, stretch[k]].append(k)
    for k in reversed(range(len(statements))):
        for v in statements[k].writes:
            early[v].append(k)
    todo = [k for k, s in enumerate(statements) if s.critical]
    out = set(todo)
    while todo:
        k = todo.pop()
        for v in statements[k].reads:
            taken = []
            while early[v] and early[v][-1] < k:
                taken.append(early[v].pop())
            following = late[v, stretch[k]] if stretch[k] is not None else []
            while following and following[-1] > k:
                taken.append(following.pop())
            new = set(taken) - out
            out |= new
            todo += new
    return out


def emitted(statements: list[Statement]) -> list[int]:
    """Indices of the statements that stay, in normal order."""
    layer = layers(statements)
    return sorted(living(statements), key=lambda k: (layer[k], -statements[k].n_tokens, statements[k].kind, k))


def _rows(pdf: pd.DataFrame) -> list[Statement]:
    columns = (pdf.sort_values("line")[c] for c in Statement._fields)
    return [Statement(line, n, kind, bool(critical), position, depth, frozenset(reads), frozenset(writes)) for line, n, kind, critical, position, depth, reads, writes in zip(*columns, strict=True)]


def normalized(statements: DataFrame) -> DataFrame:
    """``(sub, place, line, n_tokens)``: the statements that stay, in normal order."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s = _rows(pdf)
        return pd.DataFrame([(key[0], p, s[k].line, s[k].n_tokens) for p, k in enumerate(emitted(s))], columns=["sub", "place", "line", "n_tokens"])

    return statements.groupBy("sub").applyInPandas(run, "sub long, place int, line int, n_tokens long")


def joined(parts: Iterator[Statement]) -> Statement:
    """One statement of several of the same line: critical if one is, the greatest position, depths added."""
    all_ = list(parts)
    return Statement(all_[0].line, sum(s.n_tokens for s in all_), all_[0].kind, any(s.critical for s in all_), max(s.position for s in all_), sum(s.depth for s in all_), frozenset().union(*(s.reads for s in all_)), frozenset().union(*(s.writes for s in all_)))
