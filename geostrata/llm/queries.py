"""The registered queries: each applies its operator to its whole table and derives the columns that are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.llm import decontaminate, edit_counts, html_text, licenses, line_dedup, oracles, packing, pii, quality, secrets, simhash
from geostrata.llm.common import table


def _counts(kinds: tuple[str, ...]) -> list:
    def count(kind: int) -> Column:  # a second parameter of the lambda, even with a default, would be the element's index
        return F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long")

    return [count(k).alias(f"n_{name}") for k, name in enumerate(kinds)]


def op1_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *_counts(pii.KINDS), F.sha2(pii.named(F.col("base")), 256).alias("base_sha256"), pii.named(F.col("spans")).alias("spans"))


def op2_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *_counts(secrets.KINDS[:3]), F.sha2(secrets.named(F.col("base")), 256).alias("base_sha256"), secrets.named(F.col("spans")).alias("spans"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", line_dedup.n_lines(F.col("text")).alias("n_lines"), F.col("_n").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


def op4_ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("text_hash", "lang")


def op5_license_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find(table(spark, sf_dir, "documents"))


def op6_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.recount(table(spark, sf_dir, "documents"), edit_counts.usual_edits(F.col("text")))


def op7_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    words = F.aggregate(F.transform(F.sequence(F.lit(0), (F.size("__edges") / 2).cast("int") - 1), lambda i: F.get("__edges", 2 * i + 1) - F.get("__edges", 2 * i)), F.lit(0).cast("long"), lambda a, x: a + x)
    items = F.array_join(F.array_sort(F.transform("__items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", F.col("__n_words").alias("n_words"), F.when(F.size("__edges") > 0, words).otherwise(0).cast("long").alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.size("__items") >= 2).alias("contaminated"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii_bootstrap, op2_secret_crf, op3_line_dedup, op4_ngram_perplexity, op5_license_minhash, op6_edit_counts, op7_site_style_tree, op8_decontaminate, op9_simhash, op10_packing)}
ORACLES = oracles.ORACLES
