"""Evaluation jobs: one prediction file, the model comparison report and the
checkpoint curve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwise.functions.labels import binarize, is_valid_prediction, map_label, recode_label, split_of, to_binary
from leafwise.functions.numeric import round_half_even
from leafwise.functions.text import strip_suffix
from leafwise.operators.metrics import COUNT_COLS, confusion_counts, evaluate, metric_columns
from leafwise.operators.reshape import melt, ordered_category, rank_by_order

# Display names and display order of the report metrics.
REPORT_METRICS = {
    "auc": "AUC",
    "f1": "F1-score",
    "recall": "Recall (Sensitivity)",
    "specificity": "Specificity",
    "precision": "Precision",
}
METRIC_ORDER = ["AUC", "F1-score", "Recall (Sensitivity)", "Specificity", "Precision"]

# The reference's model display order per split.
DEFAULT_MODEL_ORDER = {
    "test": {"logestic_test": 0, "knn_test": 1, "svm_test": 2, "xgboost_test": 3, "reasoner_test": 4},
    "val": {"logestic_val": 0, "knn_val": 1, "svm_val": 2, "xgboost_val": 3, "reasoner_val": 4},
    "external": {
        "logestic_external": 0, "knn_external": 1, "svm_external": 2, "xgboost_external": 3,
        "ChemAp_external": 4, "reasoner_external": 5,
    },
}
# Suffix patterns removed for display, per split.
SUFFIX_PATTERNS = {"test": "(_test|_val)$", "val": "(_test|_val)$", "external": "(_external)$"}


def evaluate_predictions(df: DataFrame, truth: str = "y_true", pred: str = "y_pred", by=()) -> DataFrame:
    """One prediction file → seven metrics (command-line evaluation).

    Both columns are recoded (``approved`` → 1, ``unapproved`` → 0); the
    prediction is binarised (anything but 1 → 0).
    """
    hard = df.select(*by, recode_label(truth).cast("int").alias("t"), binarize(recode_label(pred)).alias("p"))
    return evaluate(hard, "t", "p", by=by, policy="cli")


def model_metrics(df: DataFrame, model: str = "model", truth: str = "y_true", pred: str = "y_pred",
                  invalid: str = "as_negative") -> DataFrame:
    """Per-model report metrics, all models in one aggregation.

    ``df`` holds every model file's rows with a ``model`` column.  Labels may
    be text or numbers; invalid predictions count as negative
    (``invalid='as_negative'``) or are dropped (``'drop'``).
    """
    t = to_binary(truth)
    p = to_binary(pred)
    if invalid == "as_negative":
        p = F.coalesce(p, F.lit(0))
    hard = df.select(F.col(model).alias("model"), t.alias("t"), p.alias("p")).where(F.col("p").isNotNull())
    out = evaluate(hard, "t", "p", by=["model"], policy="report")
    return out.withColumn("split", split_of("model"))


def model_report(df: DataFrame, order: dict[str, dict[str, int]] | None = None, digits: int = 3) -> DataFrame:
    """Model comparison in long form: one row per (split, model, metric).

    Columns: ``split, model, display_name`` (suffix removed),
    ``sort_rank`` (display order within the split), ``Metric``,
    ``metric_rank`` and ``Score`` (rounded half-even).
    """
    order = DEFAULT_MODEL_ORDER if order is None else order
    wide = model_metrics(df).where(F.col("split").isNotNull())
    wide = wide.select("split", "model", *[round_half_even(k, digits).alias(v) for k, v in REPORT_METRICS.items()])
    flat_order = {name: rank for per_split in order.values() for name, rank in per_split.items()}
    ranked = rank_by_order(wide, "model", flat_order, by=["split"])   # order kept as a column
    display = F.when(F.col("split") == "external", strip_suffix("model", SUFFIX_PATTERNS["external"])).otherwise(
        strip_suffix("model", SUFFIX_PATTERNS["test"])
    )
    named = ranked.withColumn("display_name", display)
    long = melt(named, ["split", "model", "display_name", "sort_rank"], list(REPORT_METRICS.values()))
    return long.withColumn("metric_rank", ordered_category("Metric", METRIC_ORDER))


def checkpoint_report(df: DataFrame, expected_n: int = 451) -> DataFrame:
    """Checkpoint curve: valid share and metrics per checkpoint.

    Junk predictions are dropped first; labels map strictly (others NULL); a
    checkpoint whose valid rows include a NULL truth is left out, as the
    reference skips a group whose metric call fails.
    """
    valid = df.where(is_valid_prediction("y_pred"))
    hard = valid.select("checkpoint", map_label("y_true").alias("t"), map_label("y_pred").alias("p"))
    t, p = F.col("t"), F.col("p")
    counts = hard.groupBy("checkpoint").agg(
        F.count_if((t == 0) & (p == 0)).alias("tn"),
        F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"),
        F.count_if((t == 1) & (p == 1)).alias("tp"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(t.isNull()).alias("_null_truth"),
    )
    m = metric_columns("checkpoint")
    out = counts.where(F.col("_null_truth") == 0).select(
        "checkpoint",
        F.col("n").alias("n_samples"),
        (F.col("n") / F.lit(float(expected_n)) * 100.0).alias("valid_percent"),
        m["f1"].alias("f1"),
        m["precision"].alias("precision"),
        m["recall"].alias("recall"),
        m["auc"].alias("auc"),
        m["specificity"].alias("specificity"),
    )
    return out.orderBy("checkpoint")


def valid_share(df: DataFrame, expected_n: int = 451) -> DataFrame:
    """Valid predictions per checkpoint and their share of ``expected_n``."""
    valid = df.where(is_valid_prediction("y_pred"))
    return valid.groupBy("checkpoint").agg(F.count(F.lit(1)).alias("n_valid")).withColumn(
        "valid_y_pred", F.col("n_valid") / F.lit(float(expected_n)) * 100.0
    )


def confusion_by_model(df: DataFrame, invalid: str = "as_negative") -> DataFrame:
    """Per model: four cells ``(true_label, pred_label, count)``, zero cells kept,
    with the display title (``_test``/``_val`` removed literally)."""
    from leafwise.functions.text import replace_literal
    from leafwise.operators.metrics import confusion_long

    p = to_binary("y_pred")
    if invalid == "as_negative":
        p = F.coalesce(p, F.lit(0))
    hard = df.select("model", to_binary("y_true").alias("t"), p.alias("p"))
    counts = confusion_counts(hard, "t", "p", by=["model"])
    return confusion_long(counts, by=["model"]).withColumn("title", replace_literal("model", "_test", "_val"))
