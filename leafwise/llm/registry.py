"""Registered queries of the training-data operators: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwise.llm import bpe, clustering, exact_dedup, html_extract, jaccard, langid, license_scan, line_quality, lm, packing, quality, sharding, vector_codes
from leafwise.llm.common import bound_batches, fold, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), keep_ids=False)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = html_extract.extract_pages(table(spark, sf_dir, "pages"))
    return got.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.shard(table(spark, sf_dir, "documents"))
    return got.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", *quality.BASE, "base_failed", "kept")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe.encode_documents(table(spark, sf_dir, "documents"))
    return got.select(
        "doc_id", F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold("doc_id") != 0).select(F.col("doc_id").alias("id"), "text", "lang"))
    bound_batches(spark)
    got = docs.select("doc_id", (fold("doc_id") == 0).alias("held_out"), langid.predict_column(model).alias("p"))
    return got.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = line_quality.fit(docs.where(fold("doc_id") != 0), table(spark, sf_dir, "labels"))
    got = docs.select("doc_id", (fold("doc_id") == 0).alias("held_out"), line_quality.score_column(model).alias("score"))
    return got.withColumn("predicted", (F.col("score") >= line_quality.CUTOFF).cast("int"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.centroid_report(*clustering.cluster(table(spark, sf_dir, "embeddings")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(*vector_codes.vector_codes(table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_lm_scoring, op3_best_fit_packing, op4_html_extraction, op5_ngram_jaccard, op6_sharding, op7_quality_rules,
        op8_byte_bpe, op9_exact_dedup, op10_language_id, op11_quality_classifier, op12_centroid_clustering, op13_vector_codes,
    )
}

#: Queries that SQL can state.
ORACLE: dict[str, str] = {
    "op9_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        ), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM d JOIN g USING (t)
    """,
}
