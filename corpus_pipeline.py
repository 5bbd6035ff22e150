"""From documents to packed sequences: language, quality, exact and near copies, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes each to the cluster's shared folder and reads it again for the next.
All but the last return the columns of ``docs``.

Verdicts are of rows, not of doc_ids: a row without an id is treated by its
text as any other, rows that share an id are told apart, and of rows repeated
whole one is packed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwise.llm import exact_dedup, jaccard, langid, packing, quality
from leafwise.llm.common import bound_batches, fold, saved, table


#: Near copies: similarity in per cent, and words in a shingle (op5's query has its own).
NEAR_PERCENT, NEAR_WORDS = 80, 5


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` as ``row``, each with a number ``rid`` of its own; written once, so the numbers stay."""
    return saved(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("rid")), name)


def _by_number(rows: DataFrame) -> DataFrame:
    """doc_id (the row's number) and text, for an operator that needs an id per row."""
    return rows.select(F.col("rid").alias("doc_id"), F.col("row")["text"].alias("text"))


def _one_of_each(rows: DataFrame, groups: DataFrame, winner: Column) -> DataFrame:
    """One row per group: ``groups`` has rid and group, ``winner`` aggregates structs that end with the rid."""
    ids = rows.select("rid", F.col("row")["doc_id"].alias("doc_id"))
    kept = groups.join(ids, "rid").groupBy("group").agg(winner.alias("w")).select(F.col("w")["rid"].alias("rid"))
    return rows.join(kept, "rid", "left_semi").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a text without letters, or far from every language, goes."""
    model = langid.fit(docs.where(fold("doc_id") != 0).select(F.col("doc_id").alias("id"), "text", "lang"))
    bound_batches(spark)
    return docs.where(~langid.predict_column(model)["rejected"])


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs keep."""
    cutoffs = quality.calibrate(quality.measure(docs), table(spark, sf_dir, "labels"))
    # texts are not kept beside their measures: a row's are taken again for its verdict
    judged = docs.select(F.struct(*docs.columns).alias("row"), quality.stratum_column().alias("stratum"), quality.measures_column().alias("m"))
    _, kept = quality.verdict(cutoffs, F.col("stratum"), lambda name: F.col("m")[name])
    return judged.where(kept).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, with the largest doc_id (none ranks lowest)."""
    rows = _numbered(docs, "exact_rows")
    groups = exact_dedup.exact_dedup(_by_number(rows)).select(F.col("doc_id").alias("rid"), F.col("keep_id").alias("group"))
    return _one_of_each(rows, groups, F.max(F.struct("doc_id", "rid")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, with the smallest doc_id (none ranks last)."""
    rows = _numbered(docs, "near_rows")
    found = jaccard.jaccard_join(_by_number(rows), percent=NEAR_PERCENT, words=NEAR_WORDS)
    groups = found.select(F.col("doc_id").alias("rid"), F.col("component_id").alias("group"))
    return _one_of_each(rows, groups, F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their places in sequences."""
    return packing.pack_documents(docs, keep_ids=False)


STAGES = [("language", language), ("quality", rules), ("exact", exact), ("near", near), ("pack", pack)]

#: The stages learn models and pack; SQL cannot state them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
