"""Readers for the parquet tables and the stand-in inputs derived from them.

The operators are written against the reference's data model (leaf vectors,
prediction tables, training logs, generated answers).  The functions below
derive those inputs from the given tables with plain projections, so every
registered query does work proportional to the tables it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the test layout: ``{sf_dir}/{name}.parquet``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- leaf vectors and token tables (from ``embeddings``) --------------------

LEAF_BINS = 8  # leaf code = floor(LEAF_BINS * x) per embedding position


def leaf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id long, label int, leaves array<int>)``: one leaf code per position.

    Stands in for a tree-ensemble leaf matrix: 64 positions play the role of
    64 trees; labels are folded to the binary approved (1) / unapproved (0).
    """
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").alias("id"),
        (F.col("label") % 2).cast("int").alias("label"),
        F.transform("embedding", lambda x: F.floor(x * LEAF_BINS).cast("int")).alias("leaves"),
    )


def token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id long, pos int, mask int, vec array<float>)`` for masked pooling.

    Each ``label`` is one sequence; ``vec_id`` is the token position.
    """
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("label").cast("long").alias("id"),
        F.col("vec_id").cast("int").alias("pos"),
        F.when(F.col("vec_id") % 3 != 0, 1).otherwise(0).alias("mask"),
        F.col("embedding").alias("vec"),
    )


# --- prediction tables (from ``labels`` and ``documents``) ------------------


def _label_text(c: Column) -> Column:
    return F.when(c == 1, F.lit("approved")).when(c == 0, F.lit("unapproved"))


def prediction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, y_true string, y_pred string)`` in the text form.

    Truth is ``quality``, prediction is ``1 - toxic``; every 17th document
    carries an unparseable prediction ``'n/a'``, as a generated answer may.
    """
    lab = table(spark, sf_dir, "labels")
    return lab.select(
        "doc_id",
        _label_text(F.col("quality")).alias("y_true"),
        F.when(F.col("doc_id") % 17 == 0, F.lit("n/a"))
        .otherwise(_label_text(1 - F.col("toxic")))
        .alias("y_pred"),
    )


SPLIT_SUFFIXES = ("_test", "_val", "_external")


def model_prediction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(model, doc_id, y_true, y_pred)``: one row per (model file, record).

    The model name is ``documents.source`` plus a split suffix chosen by
    ``doc_id % 3``.  Names from ``src0`` keep the text labels (the reference's
    text-valued files); all others carry ``'1'``/``'0'`` strings.
    """
    preds = prediction_table(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    suffix = F.element_at(F.array(*[F.lit(s) for s in SPLIT_SUFFIXES]), (F.col("doc_id") % 3 + 1).cast("int"))
    joined = preds.join(docs, "doc_id")
    text_model = F.col("source") == "src0"

    def as_file_value(c: str) -> Column:
        numeric = F.when(F.col(c) == "approved", F.lit("1")).when(F.col(c) == "unapproved", F.lit("0")).otherwise(F.col(c))
        return F.when(text_model, F.col(c)).otherwise(numeric).alias(c)

    return joined.select(
        F.concat(F.col("source"), suffix).alias("model"),
        "doc_id",
        as_file_value("y_true"),
        as_file_value("y_pred"),
    )


CHECKPOINT_STEP = 500
CHECKPOINT_GROUPS = 29


def checkpoint_prediction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(checkpoint int, doc_id, y_true, y_pred)``: the checkpoint family.

    ``checkpoint = (doc_id % 29) * 500``; checkpoint 0 is the zero-shot base.
    """
    preds = prediction_table(spark, sf_dir)
    return preds.select(
        ((F.col("doc_id") % CHECKPOINT_GROUPS) * CHECKPOINT_STEP).cast("int").alias("checkpoint"),
        "doc_id",
        "y_true",
        "y_pred",
    )


# --- training-log series (from ``events``) ----------------------------------


def log_series_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(series, ts, seq, value)``: series = ``event_type``, ordered by
    ``(ts, event_id)`` (``seq`` is the tie-free ``event_id``)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_type").alias("series"),
        F.col("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").cast("double").alias("value"),
    )


# --- generated answers and prompts (from ``conversations``) -----------------


def generated_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, text)``: answers in the tagged format, some tags left out.

    ``turn % 4`` decides the shape: 0 complete, 1 no ``<label>`` open tag,
    2 no ``</score>`` close tag, 3 no tags at all around the score.
    """
    conv = table(spark, sf_dir, "conversations")
    t = F.col("text")
    label = F.when(F.length(t) % 2 == 0, F.lit("Approved")).otherwise(F.lit("unapproved "))
    score = F.format_string("%.2f", (F.length(t) % 100) / F.lit(100.0))
    shape = F.col("turn") % 4
    body = (
        F.when(shape == 0, F.concat(F.lit("<think>"), t, F.lit("</think>\n<label> "), label, F.lit("</label>\n<score>\t"), score, F.lit("\n</score>")))
        .when(shape == 1, F.concat(F.lit("<think>\n"), t, F.lit("</think>"), label, F.lit("</label><score>"), score, F.lit("</score>")))
        .when(shape == 2, F.concat(F.lit("<think>"), t, F.lit("</think><label>"), label, F.lit("</label><score> "), score))
        .otherwise(F.concat(t, F.lit(" "), score))
    )
    return conv.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        body.alias("text"),
    )
