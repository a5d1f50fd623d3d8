"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

1. Every text becomes a set of shingle hashes and a sketch. Documents of equal sets form one class, so exact
   copies cost nothing further.
2. Classes that share a band's key fall into one bucket. In each bucket all members are verified against one
   pivot (the pivot's order changes with the key, so a large group meets several pivots). Verified links give
   first components.
3. Only buckets whose members still belong to several components are looked at again: each member outside
   the bucket's most frequent component meets all members of other components. Large buckets are dealt in
   blocks of bounded size. Members whose sketch is near none of the others' drop out, the rest is verified.
   After this every pair that shares a bucket has been looked at, or was connected anyway, so no bucket is
   capped and no pairs are listed.
4. Components over all verified links.

Verification counts the common shingles of whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm import shingles, store
from simloom.llm.components import components

#: Bands and their rows: at a similarity of 0.75 a pair shares no band with a probability of 6 in 100,000.
BANDS, ROWS = 50, 6
#: Similarity in percent.
PERCENT = 75
#: Sketches may agree on less of their coordinates than sets do, by so many standard deviations.
SLACK = 4.5
#: Members of a side of a verification task.
BLOCK = 256
#: Ids that are broadcast at most, of 8 bytes each.
FEW_IDS = 500_000
#: Orders from which a bucket's pivot is taken.
ORDERS = 5


def _fingerprint(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _slices(batches: Iterator[pa.RecordBatch], bytes_at_once: int = 1_500_000) -> Iterator[tuple[list, list]]:
    """Ids and UTF-8 texts, a bounded number of bytes at once."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        at = 0
        while at < len(ids):
            end, size = at, 0
            while end < len(ids) and (end == at or size < bytes_at_once):
                size += len(texts[end].as_buffer()) if texts[end].is_valid else 0
                end += 1
            yield ids.slice(at, end - at).to_pylist(), [x.as_buffer().to_pybytes() if x.is_valid else None for x in texts.slice(at, end - at)]
            at = end


def sketched(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, fp, n, bands)`` of each document: its set's fingerprint and size, and its bands' keys."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _slices(batches):
            sets = [shingles.shingles(x) for x in texts]
            full = [k for k, s in enumerate(sets) if len(s)]
            keys: list[np.ndarray | None] = [None] * len(sets)
            if full:
                for k, row in zip(full, shingles.bands(shingles.sketches([sets[k] for k in full], bands * rows), rows).view(np.int64), strict=True):
                    keys[k] = row
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([_fingerprint(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp binary, n long, bands array<long>")


def _sets(docs: DataFrame, t: int) -> DataFrame:
    """``(node, fp, shingles, sketch)``: each set as sorted little-endian 64-bit hashes, its sketch by low bytes."""
    schema = pa.schema([("node", pa.int64()), ("fp", pa.binary()), ("shingles", pa.binary()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _slices(batches):
            some = [(i, s) for i, s in ((i, shingles.shingles(x)) for i, x in zip(ids, texts, strict=True)) if len(s)]
            low = (shingles.sketches([s for _, s in some], t) & np.uint64(255)).astype(np.uint8)
            cols = [[i for i, _ in some], [_fingerprint(s) for _, s in some], [s.astype("<u8").tobytes() for _, s in some], [x.tobytes() for x in low]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, "node long, fp binary, shingles binary, sketch binary")


def links_of(a: list[tuple], b: list[tuple], percent: int) -> Iterator[tuple[int, int]]:
    """Links between the rows ``(node, label, set)`` of ``a`` and ``b`` that join different labels, a forest of them."""
    owner = np.repeat(np.arange(len(b)), [len(s) for *_, s in b])
    flat = np.concatenate([s for *_, s in b])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    size = np.array([len(s) for *_, s in b])
    label = np.array([x for _, x, _ in b])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            x = y
        return x

    for node, own, s in a:
        low, high = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
        n = high - low
        hits = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(owner[hits], minlength=len(b))
        near = 100 * common >= percent * (len(s) + size - common)
        for k in np.flatnonzero(near & (label != own)):
            x, y = find(own), find(int(label[k]))
            if x != y:
                root[max(x, y)] = min(x, y)
                yield node, b[k][0]


TASK = "struct<k:long,i:long,j:long>"
Side = list[tuple]


def _met(tasks: DataFrame, payloads: DataFrame, what: str, meet: Callable[[dict, Side, Side], Iterator[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """What ``meet`` yields for each task of ``tasks(task, first, node, label)``: its first side against the other.

    A side's rows are (node, label, payload). A task's rows are bounded by its making; tasks are streamed.
    """
    rows = tasks.join(payloads.select("node", what), "node").select("task", "first", "node", "label", what)
    rows = rows.repartition("task").sortWithinPartitions("task", F.col("first").desc(), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = None
        sides: dict[bool, Side] = {True: [], False: []}

        def done() -> Iterator[pa.RecordBatch]:
            found = list(meet(task, sides[True], sides[False])) if sides[True] and sides[False] else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for t, first, node, label, raw in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if t != task:
                    yield from done()
                    task, sides = t, {True: [], False: []}
                sides[first].append((node, label, raw))
        yield from done()

    return rows.mapInArrow(run, ddl)


def _verified(tasks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: links by whole sets."""
    whole = lambda side: [(node, label, np.frombuffer(raw, dtype="<u8")) for node, label, raw in side]
    meet = lambda _, a, b: links_of(whole(a), whole(b), percent)
    return _met(tasks, sets, "shingles", meet, pa.schema([("a", pa.int64()), ("b", pa.int64())]), "a long, b long")


def _plausible(tasks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``tasks`` whose sketch is near one of another label on the other side."""

    def meet(task: dict, a: Side, b: Side) -> Iterator[tuple]:
        sb = np.array([np.frombuffer(raw, dtype=np.uint8) for *_, raw in b])
        label = np.array([x for _, x, _ in b])
        wanted = np.zeros(len(b), dtype=bool)
        p = percent / 100
        least = p - SLACK * (p * (1 - p) / sb.shape[1]) ** 0.5
        for node, own, raw in a:
            near = ((sb == np.frombuffer(raw, dtype=np.uint8)).mean(1) >= least) & (label != own)
            if near.any():
                wanted |= near
                yield task, True, node, own
        for k in np.flatnonzero(wanted):
            yield task, False, b[k][0], b[k][1]

    one = pa.struct([("k", pa.int64()), ("i", pa.int64()), ("j", pa.int64())])
    return _met(tasks, sets, "sketch", meet, pa.schema([("task", one), ("first", pa.bool_()), ("node", pa.int64()), ("label", pa.int64())]), f"task {TASK}, first boolean, node long, label long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of five-word shingles have a Jaccard similarity of ``percent`` or more;
    ``component_id`` is the least id that links reach, and the document of that id is kept. Texts without words
    and null texts have no shingle and link with nothing. Rows without id have no component and are kept. Rows
    that share an id count as one document where links are followed. Other columns are ignored; an empty table
    gives no rows.
    """
    sk = store.save(sketched(docs, bands, rows), "sketches", small_batches=True)
    # A class's sketch depends on its set alone, so any row's will do.
    classes = sk.where("n > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
    spread = classes.select("fp", "node", "n", F.explode("bands").alias("key"))
    order = F.xxhash64("node", F.pmod("key", F.lit(ORDERS)))
    stars = spread.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct(order.alias("o"), "node", "n")).alias("p")).where("size > 1")
    members = store.save(spread.join(stars, "key").select("key", "size", "fp", "node", "n", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n")), "buckets")

    involved = members.select("node", "fp").distinct()
    ids = involved.select(F.col("node").alias("doc_id")).distinct()
    if ids.limit(FEW_IDS + 1).count() <= FEW_IDS:
        ids = F.broadcast(ids)  # so that texts stay where they are; more ids than that take a shuffle of the texts
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    sets = store.save(_sets(texts, bands * rows).join(involved, ["node", "fp"], "left_semi").dropDuplicates(["node"]).drop("fp"), "sets", small_batches=True)

    close = (100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")) & (F.col("node") != F.col("pivot"))
    pairs = members.where(close).select("pivot", "node").distinct()
    spokes = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / block).alias("blocks"))
    part = F.pmod(F.xxhash64("node"), F.col("blocks"))
    other = pairs.join(spokes, "pivot").select(F.struct(F.col("pivot").alias("k"), part.alias("i"), F.lit(0).cast("long").alias("j")).alias("task"), F.lit(False).alias("first"), "node", F.col("node").alias("label"))
    one = spokes.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("i")).select(F.struct(F.col("pivot").alias("k"), "i", F.lit(0).cast("long").alias("j")).alias("task"), F.lit(True).alias("first"), F.col("pivot").alias("node"), F.col("pivot").alias("label"))
    links = store.save(_verified(one.unionByName(other), sets, percent), "links", small_batches=True)

    # Buckets that hold several components: what is outside the most frequent one meets all others.
    found = components(links)
    labelled = members.select("key", "size", "node").join(found, "node", "left").select("key", "size", "node", F.coalesce("component", "node").alias("label"))
    labelled = store.save(labelled, "labels")
    counts = labelled.groupBy("key", "label").agg(F.count("*").alias("m"))
    most = counts.groupBy("key").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("size")).where("size > top.m")
    most = most.select("key", F.col("top.label").alias("most"), F.ceil((F.col("size") - F.col("top.m")) / block).alias("few_blocks"), F.ceil(F.col("size") / block).alias("blocks"))
    mixed = labelled.drop("size").join(most, "key")
    h = F.xxhash64("node")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    few = mixed.where("label <> most").select("key", F.pmod(h, F.col("few_blocks")).alias("i"), upto("blocks").alias("j"), F.lit(True).alias("first"), "node", "label")
    every = mixed.select("key", upto("few_blocks").alias("i"), F.pmod(h, F.col("blocks")).alias("j"), F.lit(False).alias("first"), "node", "label")
    tasks = few.unionByName(every).select(F.struct(F.col("key").alias("k"), "i", "j").alias("task"), "first", "node", "label")
    more = store.save(_verified(_plausible(tasks, sets, percent), sets, percent), "links", small_batches=True)

    # Links of the second round join components of the first by their members.
    final = components(links.unionByName(more))
    of_class = classes.select("fp", "node").join(final, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    out = sk.select("doc_id", "fp", "n").join(of_class, "fp", "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
