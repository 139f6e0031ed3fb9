"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

All stages take nulls in any column, empty and very long texts, ties, repeated rows, empty tables and
columns of other names; their docstrings say what becomes of them. All but the last return the
columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lagwise.llm import jaccard_join, language, mixing, packing, queries_a, queries_c, toxicity
from lagwise.llm.scratch import Scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language, as text, declared language and source together say; the others go.

    A null or empty text, or one without a letter, goes; a null declaration or source says nothing.
    Repeated rows go or stay together; ties go to the language that comes first.
    """
    return language.drop_rejected(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, learned from the labels of these documents, doesn't call toxic.

    A null or empty text has the score of no terms; a null id has no label, and is judged like any
    other. Repeated rows go or stay together; a score equal to the threshold goes.
    """
    out = toxicity.score(docs, queries_c.toxicity_machine(docs, sf_dir))
    return out.filter("predicted = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id, null before all others.

    A text without words, null or empty, is in no group and stays; of fully repeated rows one stays.
    """
    return jaccard_join.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, weighed by the labels' quality.

    A null source is a source, the last; a null text has no words and is taken as its source's whole
    epochs say; of equal rows as many are taken as fit.
    """
    return mixing.repeat_mixed(docs, quality=queries_a.quality_weights(spark, sf_dir), **queries_a.MIX)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in the training sequences.

    A null or empty text is the end id alone; a null id stays null; repeated rows are packed each.
    """
    return packing.pack(docs)


STAGES = [("language", language_id), ("toxicity", toxicity_filter), ("jaccard", near_duplicates), ("mixing", mix_sources), ("packing", pack)]

#: The stages learn models and hash; they are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(out, name)
    return out
