"""Corpus pipeline over ``documents``: five stages, each written as Parquet and read
again as the next one's input.

1. toxicity: documents scored 0.5 or higher go;
2. quality: documents that fail the quality rules go; the others lose their failing lines;
3. near_dedup: of each SimHash class the document with the smallest id stays;
4. passages: repeated passages go from the texts of later documents;
5. packing: the remaining texts as pieces of power-of-two lengths, with their token ids
   (little-endian unsigned 32-bit) and the bucket of equal lengths they belong to.

All but the last return the columns of ``documents``. The folders of the stages go when the
application ends; write the result elsewhere to keep it (``packing.write_buckets``). Null, empty and repeated rows
are treated as the operators' docstrings say; an empty table passes through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homerange.llm import packing, quality_rules, simhash, suffix_dedup, toxicity
from homerange.llm.common import read
from homerange.session import checkpoint_dir, remove_at_exit


def _as_struct(docs: DataFrame) -> DataFrame:
    """The row as one column beside its id and text, so that no result column can
    take the place of one of its own."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row).select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn_tables(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    scored = toxicity.score(_as_struct(docs), model, keep=["row"])
    return scored.filter("score < 0.5").select("row.*")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = quality_rules.judge(_as_struct(docs).select("row", "text")).filter("kept")
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return kept.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = suffix_dedup.cleaned(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_dedup", drop_near_duplicates),
    ("passages", drop_repeated_passages),
    ("packing", pack),
]

#: SQL can express neither the scores nor the fingerprints; tests/llm holds the
#: pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over the whole of ``documents``."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/corpus_pipeline-{uuid.uuid4().hex}"
    remove_at_exit(spark, base)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
