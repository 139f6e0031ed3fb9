"""Queries that apply language identification, toxicity and training order to whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.llm import language, toxicity, training_order
from lagwise.llm.scratch import Scratch, table

#: Labels of these documents are never learned from.
HELD_OUT = 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (doc_id) and all pages (page_id), judged together."""
    none = F.lit(None).cast("long")
    docs = language.document_rows(table(spark, sf_dir, "documents"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), none.alias("page_id")))
    pages = language.page_rows(table(spark, sf_dir, "pages"), F.struct(none.alias("doc_id"), F.col("page_id").cast("long").alias("page_id")))
    out = language.identify(docs.unionByName(pages))
    return out.select("id.doc_id", "id.page_id", "declared", "lang", F.round("confidence", 6).alias("confidence"), "kept")


def toxicity_machine(docs: DataFrame, sf_dir: str) -> toxicity.Machine:
    labels = table(docs.sparkSession, sf_dir, "labels")
    return toxicity.learn(docs, labels.filter(~held_out(F.col("doc_id"))))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity_machine(docs, sf_dir))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence as read back from the shards, in the order of training, with the documents that it holds."""
    path = Scratch(spark, "op4").path("order")
    training_order.write_shards(table(spark, sf_dir, "documents"), path, seed=20)
    stored = training_order.checksums(training_order.read_slots(spark, path)).select("slot", "shard", "ids_crc32")
    index = spark.read.parquet(f"{path}/index").select(F.col("slot").alias("i_slot"), "count", "docs")
    return stored.join(index, F.col("slot") == F.col("i_slot")).select("slot", "shard", "count", F.col("docs.doc_id").alias("doc_ids"), F.col("docs.start").alias("starts"), "ids_crc32")


QUERIES = {"op2_language": op2_language, "op3_toxicity": op3_toxicity, "op4_training_order": op4_training_order}
SQL: dict[str, str] = {}
