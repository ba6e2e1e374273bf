"""A training corpus from documents: quality rules, line dedup, near-duplicate removal, decontamination and packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the
columns of documents. Stages are written as Parquet and read again, so a lost executor costs a stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.llm import decontaminate, line_dedup, packing, quality, simhash
from geostrata.llm.common import free_prefix, table, written


MAX_BROADCAST = 500_000  # documents to drop that are broadcast at most


def _names(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _with_text(docs: DataFrame, text) -> DataFrame:
    """docs with new texts; n_chars, if there, follows."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules and the perplexity bands keep. The verdict depends on text and language, so rows alike share it. Null texts have no words and go; an empty table stays empty."""
    verdict = free_prefix(docs) + "verdict"
    out = quality.quality(docs, keep_columns=verdict)
    return out.where(verdict).select(*_names(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that an earlier document has. A document that loses all its lines holds nothing new and goes; one that was empty before stays. Rows that repeat a doc_id are one document, those without one keep all lines."""
    p = free_prefix(docs)
    out = line_dedup.line_dedup(docs, prefix=p)
    kept = out.where((F.col(p + "n") == 0) | (F.col(p + "n") < line_dedup.n_lines(F.col("text"))))
    return _with_text(kept, F.when(F.col(p + "n") == 0, F.col("text")).otherwise(F.col(p + "kept"))).select(*_names(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest doc_id. Rows that repeat a doc_id are one document and stay or go together; those without a doc_id stay."""
    own = free_prefix(docs) + "id"
    drop = written(simhash.near_dedup(docs).where("component_id <> doc_id").select(F.col("doc_id").alias(own)).distinct(), "near-duplicates")
    if drop.count() <= MAX_BROADCAST:  # beyond, the documents are shuffled by doc_id
        drop = F.broadcast(drop)
    return docs.join(drop, F.col("doc_id") == F.col(own), "left_anti").select(*_names(docs))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold two benchmark items or more go; of the others, the words of benchmark windows go. Null texts hold none and stay; rows alike share their fate."""
    return decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), remove=2).select(*_names(docs))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed. Null texts are empty, so their piece is the end's id alone; each row, repeated or without a doc_id, has pieces of its own; an empty table gives none."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pack", pack_stage),
]

#: The n-gram model, the fingerprints and the packing are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
