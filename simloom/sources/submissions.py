"""Folders of submissions as one row a file."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.config import Options
from simloom.functions import text as T

#: Byte order marks and their charsets, longer ones first.
MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def decode(raw: bytes, charset: str | None = None) -> str:
    """Text of a file: by its byte order mark, else the given charset, else UTF-8 if it is that, else Latin-1."""
    for mark, name in MARKS:
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    if charset:
        return raw.decode(charset, "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def decoded(content: Column, charset: str | None = None) -> Column:
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([decode(x, charset) if x is not None else None for x in batch.to_pylist()], pa.string())

    return run(content)


def joint_charset(confidences: DataFrame) -> DataFrame:
    """One row ``charset``: the best mean of ``(file, charset, confidence)``; a charset that a file excludes is out."""
    means = confidences.groupBy("charset").agg(F.when(F.min("confidence") == 0, 0.0).otherwise(F.avg("confidence")).alias("mean"))
    return means.agg(F.coalesce(F.max_by("charset", F.when(F.col("mean") > 0, F.col("mean"))), F.lit("UTF-8")).alias("charset"))


def checked_roots(spark: SparkSession, new: list[str], old: list[str]) -> tuple[list[str], list[str]]:
    """Distinct qualified roots; one that is in both lists is new. Missing ones and equal names are errors."""
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm

    def qualified(root: str) -> str:
        path = jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(conf)
        if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
            raise ValueError(f"not a folder: {root}")
        return fs.makeQualified(path).toString().rstrip("/")

    fresh = list(dict.fromkeys(map(qualified, new)))
    known = [r for r in dict.fromkeys(map(qualified, old)) if r not in fresh]
    if not fresh:
        raise ValueError("at least one root must be new")
    names = [r.rpartition("/")[2] for r in fresh + known]
    if doubles := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"roots of equal names: {doubles}")
    return fresh, known


def excluded_names(spark: SparkSession, path: str) -> tuple[str, ...]:
    """One suffix a line; a file that can't be read excludes nothing."""
    try:
        return tuple(r[0] for r in spark.read.text(path).where("trim(value) <> ''").collect())
    except Exception:  # a missing file has its own class on each file system
        return ()


def read(spark: SparkSession, new: list[str], old: list[str] = (), options: Options = Options(), base: str | None = None, charset: str | None = None) -> DataFrame:
    """``(sub, root, path, text, is_new, is_base)``: the files of all submissions in order of path.

    A submission is a child of a root, folder or file; with several roots its name starts with the root's. Files
    are taken by suffix, case aside, and left out by the end of their name. With ``subdirectory`` only files
    below that folder of each submission count. ``base`` is a submission of its own, never compared.
    """
    fresh, known = checked_roots(spark, list(new), list(old))
    several = len(fresh) + len(known) > 1
    parts = []
    for roots, is_new in ((fresh, True), (known, False)):
        for root in roots:
            parts.append(_files(spark, root).withColumn("is_new", F.lit(is_new)).withColumn("is_base", F.lit(False)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    child = F.element_at(F.split("rest", "/"), 1)
    name = F.concat_ws("/", F.substring_index("root", "/", -1), child) if several else child
    inner = F.substring_index("rest", "/", -1)
    keep = T.ends_with_any(inner, options.suffixes, True)
    if options.excluded:
        keep = keep & ~T.ends_with_any(inner, options.excluded, False)
    if options.subdirectory:
        keep = keep & F.startswith(F.col("rest"), F.concat(child, F.lit(f"/{options.subdirectory.strip('/')}/")))
    out = out.withColumn("sub", name).where(keep)
    if base:
        root = checked_roots(spark, [base], [])[0][0]
        mine = _files(spark, root).where(T.ends_with_any(F.col("rest"), options.suffixes, True)).withColumns({"is_new": F.lit(False), "is_base": F.lit(True), "sub": F.lit("base")})
        out = out.where(~F.startswith(F.col("path"), F.lit(root + "/"))).unionByName(mine)
    return out.select("sub", "root", "path", decoded(F.col("content"), charset).alias("text"), "is_new", "is_base")


def _files(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rest = F.expr(f"substring(path, locate('{_path_of(root)}/', path) + {len(_path_of(root)) + 1})")
    return files.select(F.lit(root).alias("root"), F.concat(F.lit(root + "/"), rest).alias("path"), rest.alias("rest"), "content")


def _path_of(root: str) -> str:
    return root.split(":", 1)[-1].rstrip("/") if ":" in root else root
