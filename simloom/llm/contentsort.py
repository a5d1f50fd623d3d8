"""Exact deduplication by sorting contents.

Normalised texts are range-partitioned by sampled splitters and sorted on disk where they do not fit in memory,
so equal texts become neighbours and one pass compares each with the one before it in full. The splitters hold
only a bounded prefix, a digest and the row's rank among its copies; since the rank is part of them, a text with
very many copies spans several partitions. Copies on both sides of a border are stitched from one first and
one last group of each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from simloom.llm import store

#: Characters that normalisation deletes.
WHITE = (" ", "\t", "\n", "\v", "\f", "\r")
#: Code points of a text in a splitter.
PREFIX = 32

ROWS = "doc_id long, text_sha256 string, first boolean, keep_id long, n long, part int, edge string, edge_text string"
ARROW = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("first", pa.bool_()), ("keep_id", pa.int64()), ("n", pa.int64()), ("part", pa.int32()), ("edge", pa.string()), ("edge_text", pa.string())])


def normalised(text: Column) -> Column:
    """The text without blanks, tabs, line breaks and page breaks; null counts as empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Group each run of equal neighbours of one sorted partition.

    Of a run only ids and one text are held. Its rows carry its size and the id of its first row; the first and
    last run of the partition are marked, and one row of each brings the text for the comparison across borders.
    """
    part = TaskContext.get().partitionId()
    rows: list[tuple] = []
    run_ids: list[int | None] = []
    text = digest = None
    runs = 0

    def close(last: bool) -> None:
        edge = ("f" if runs == 1 else "") + ("l" if last else "")
        keep = run_ids[0]
        for k, doc_id in enumerate(run_ids):
            rows.append((doc_id, digest, k == 0, keep, len(run_ids), part, edge or None, text if edge and k == 0 else None))

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)
        rows.clear()
        return batch

    for batch in batches:
        ids, digests, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        for k in range(len(ids)):
            if run_ids and digests[k] == digest and texts[k].as_py() == text:
                run_ids.append(ids[k])
                continue
            if run_ids:
                close(False)
            runs += 1
            run_ids, digest, text = [ids[k]], digests[k], texts[k].as_py()
            if len(rows) > 20_000:
                yield out()
    if run_ids:
        close(True)
    if rows:
        yield out()


def _chains(parts: list[int], facts: dict, linked: set[int]) -> list[tuple]:
    """Runs that go on over borders: the first one's keeper stays for all, and their sizes add up."""
    out: list[tuple] = []
    chain: list = []

    def flush() -> None:
        if len(chain) > 1:
            total = sum(r["n"] for r in chain)
            out.extend((r["part"], r["edge"], chain[0]["keep_id"], total, k == 0) for k, r in enumerate(chain))
        chain.clear()

    for p in parts:
        if p not in linked:
            flush()
        chain.append(facts[p, "f"])
        if facts[p, "f"]["edge"] != "fl":
            flush()
            chain.append(facts[p, "l"])
    flush()
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are so after deleting blanks, tabs, line and page breaks; a null text counts as
    empty. Of equal texts the row with the most code points stays, then the smallest id, a null id last; of
    rows equal in both, one stays, so exactly one row of each group has ``kept``. Other columns are ignored;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = normalised(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).alias("size"), text.alias("norm"))
    rows = rows.select("doc_id", "size", "norm", F.sha2("norm", 256).alias("digest"), F.substring("norm", 1, PREFIX).alias("prefix"))
    rank = [F.col("size").desc(), F.col("doc_id").asc_nulls_last()]
    ranged = rows.repartitionByRange("prefix", "digest", *rank).sortWithinPartitions("prefix", "digest", "norm", *rank)
    found = store.save(ranged.select("doc_id", "digest", "norm").mapInArrow(_neighbours, ROWS), "content-sort", small_batches=True)

    # Does the last run of a partition go on as the first of the next one that has rows?
    ends = found.where("edge is not null and first").select("part", "edge", "text_sha256", "edge_text", "keep_id", "n")
    facts = {(r["part"], e): r for r in ends.drop("text_sha256", "edge_text").collect() for e in r["edge"]}  # two a partition at most
    parts = sorted({p for p, _ in facts})
    after = spark.createDataFrame(list(zip(parts, parts[1:], strict=False)), "part int, next int")
    a = ends.where(F.col("edge").contains("l")).join(F.broadcast(after), "part")
    b = ends.where(F.col("edge").contains("f")).select(F.col("part").alias("next"), "text_sha256", "edge_text")
    linked = {r["next"] for r in a.join(b, ["next", "text_sha256", "edge_text"]).select("next").collect()}
    fixes = spark.createDataFrame(_chains(parts, facts, linked), "part int, edge string, all_keep long, all_n long, leads boolean")
    out = found.join(F.broadcast(fixes), ["part", "edge"], "left")  # two rows a partition at most
    whole = F.col("all_n").isNull()
    return out.select(
        "doc_id",
        F.when(whole, F.col("keep_id")).otherwise(F.col("all_keep")).alias("keep_id"),
        F.coalesce("all_n", "n").alias("group_size"),
        (F.col("first") & (whole | F.col("leads"))).alias("kept"),
        "text_sha256",
    )


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run of equal neighbours of a sorted partition its first row; that of the first and last run with an edge.

    Rows come as ``(row, digest, norm)``. One row is held back until its run ends.
    """
    part = TaskContext.get().partitionId()
    held: tuple | None = None
    runs = 0
    digest = text = None

    def out(rows: pa.Array, n: int, edges: list[str | None], digests: list[str | None], texts: list[str | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows, pa.array([part] * n, pa.int32()), *(pa.array(c, pa.string()) for c in (edges, digests, texts))], names=["row", "part", "edge", "digest", "edge_text"])

    for batch in batches:
        rows, digests, texts = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
        starts = []
        for k in range(len(digests)):
            if runs and digests[k] == digest and texts[k].as_py() == text:
                continue
            runs += 1
            digest, text = digests[k], texts[k].as_py()
            starts.append(k)
            if len(starts) == 1 and held is not None:  # the run that the batches before began has ended
                first = held[3] == 1
                yield out(held[0], 1, ["f" if first else None], [held[1] if first else None], [held[2] if first else None])
                held = None
        if not starts:
            continue
        done, first = starts[:-1], runs - len(starts) == 0
        if done:
            lead = [k == 0 and first for k in range(len(done))]
            yield out(rows.take(pa.array(done)), len(done), ["f" if x else None for x in lead], [digests[k] if x else None for k, x in zip(done, lead, strict=True)], [texts[k].as_py() if x else None for k, x in zip(done, lead, strict=True)])
        held = (rows.take(pa.array(starts[-1:])), digest, text, runs)
    if held is not None:
        yield out(held[0], 1, ["fl" if held[3] == 1 else "l"], [held[1]], [held[2]])


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``dedup`` keeps, with all their columns.

    Whole rows go through the sort, once. Of rows equal in normalised text, length and id, the one of the least text
    stays; of rows with the same text as well, one. Columns of any name are kept as they are.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.coalesce(F.length(text), F.lit(0)).alias("size"), normalised(F.col("text")).alias("norm"))
    rows = rows.select("row", "id", "size", F.sha2("norm", 256).alias("digest"), F.substring("norm", 1, PREFIX).alias("prefix"))
    rank = [F.col("size").desc(), F.col("id").asc_nulls_last()]
    # The normalised text is made again behind the exchange, so that only one form of a text is shuffled.
    ranged = rows.repartitionByRange("prefix", "digest", *rank).withColumn("norm", normalised(F.col("row.text")))
    ranged = ranged.sortWithinPartitions("prefix", "digest", "norm", *rank, F.col("row.text").cast("string")).select("row", "digest", "norm")
    made = StructType([StructField("row", docs.schema), *StructType.fromDDL("part int, edge string, digest string, edge_text string")])
    found = store.save(ranged.mapInArrow(_leaders, made), "content-sort", small_batches=True)

    ends = found.where("edge is not null").select("part", "edge", "digest", "edge_text")
    parts = sorted({r["part"] for r in ends.select("part").distinct().collect()})
    after = spark.createDataFrame(list(zip(parts, parts[1:], strict=False)), "part int, next int")
    a = ends.where(F.col("edge").contains("l")).join(F.broadcast(after), "part")
    b = ends.where(F.col("edge").contains("f")).select(F.col("part").alias("next"), "digest", "edge_text")
    linked = [(r["next"],) for r in a.join(b, ["next", "digest", "edge_text"]).select("next").collect()]
    gone = F.broadcast(spark.createDataFrame(linked, "part int").withColumn("goes_on", F.lit(True)))  # one row a partition at most
    stay = found.join(gone, "part", "left").where(~F.coalesce(F.col("edge").contains("f") & F.col("goes_on"), F.lit(False)))
    return stay.select("row.*")
