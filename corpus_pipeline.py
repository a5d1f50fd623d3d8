"""A corpus pipeline of five stages over ``documents``; each stage's rows are written and read again by the next.

All stages but the last return the columns of ``documents``. Null and empty texts have no language and go in the
first stage; nulls in other columns, repeated rows and extra columns pass through as the operators state; an empty
table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.llm import contentsort, langid, neardup, packing, registry, secrets, store

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found, those without a label under the one that is found; texts without any letter go."""
    found = docs.select(*COLUMNS, langid.identify(F.col("text"), registry.learnt(docs)).alias("found"))
    kept = found.where(F.col("found.lang") != langid.UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", "found.lang")).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, white space aside."""
    return contentsort.keep_first(docs.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts: that of the least id."""
    kept = neardup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    rows = docs.select(*COLUMNS)
    return rows.join(kept, "doc_id", "left_semi").select(*COLUMNS).unionByName(rows.where("doc_id is null"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its secrets replaced by a mark."""
    clean = secrets.redacted(F.col("text"), F.col("spans"))
    out = secrets.scan(docs.select(*COLUMNS)).select("doc_id", clean.alias("text"), "lang", "source", "n_chars", (F.size("spans") > 0).alias("__hit"))
    return out.withColumn("n_chars", F.when(F.col("__hit"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2,048 ids, with the ids themselves."""
    return packing.pack_texts(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("secrets", redact), ("packing", pack)]

#: Language, sketches and packing have no equivalent in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
