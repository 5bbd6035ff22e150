"""Binary-classification metrics per group, in one aggregation pass.

The reference evaluates with three different error policies (command-line
evaluation, model report, checkpoint curve).  They differ only in what an
undefined ratio becomes, so one parameterised function covers all three:

============  ==============  ===========  ==================  ===================
policy        prec/rec/F1     spec/NPV     AUC, one-class      counts, one class
============  ==============  ===========  ==================  ===================
``cli``       0 if undefined  0            NULL                as counted
``report``    0 if undefined  NULL         NULL                as counted
``checkpoint``0 if undefined  0            0.0                 all zero → spec 0
============  ==============  ===========  ==================  ===================

(NaN of the reference is NULL here: a SQL missing value.)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwise.functions.numeric import safe_ratio
from leafwise.operators.scan import prefix_sums


@dataclass(frozen=True)
class Policy:
    spec_undefined: float | None
    auc_undefined: float | None
    zero_counts_if_one_class: bool


POLICIES = {
    "cli": Policy(spec_undefined=0.0, auc_undefined=None, zero_counts_if_one_class=False),
    "report": Policy(spec_undefined=None, auc_undefined=None, zero_counts_if_one_class=False),
    "checkpoint": Policy(spec_undefined=0.0, auc_undefined=0.0, zero_counts_if_one_class=True),
}

COUNT_COLS = ("tn", "fp", "fn", "tp")


def confusion_counts(df: DataFrame, truth: str = "y_true", pred: str = "y_pred", by=(),
                     with_dropped: bool = False) -> DataFrame:
    """TN, FP, FN, TP and n per group; always all four cells, zero-filled.

    ``n`` counts the rows with a readable truth and prediction; only they
    enter a metric.  ``with_dropped`` adds ``n_dropped``, the other rows.

    Inputs are 0/1 integers.  One ``groupBy().agg`` → partial aggregation on
    the map side, so a group holding a third of all rows costs one small
    partial row per task, never a large shuffle of that group.
    """
    t, p = F.col(truth), F.col(pred)
    readable = F.coalesce(t.isin(0, 1) & p.isin(0, 1), F.lit(False))
    dropped = [F.count_if(~readable).alias("n_dropped")] if with_dropped else []
    return df.groupBy(*by).agg(
        F.count_if((t == 0) & (p == 0)).alias("tn"),
        F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"),
        F.count_if((t == 1) & (p == 1)).alias("tp"),
        F.count_if(readable).alias("n"),
        *dropped,
    )


def metric_columns(policy: str = "cli") -> dict[str, Column]:
    """Metric expressions over a row of counts (``tn fp fn tp n``)."""
    pol = POLICIES[policy]
    tn, fp, fn, tp, n = (F.col(c) for c in (*COUNT_COLS, "n"))
    pos, neg = tp + fn, tn + fp
    pred_pos = tp + fp
    precision = safe_ratio(tp, pred_pos, 0.0)
    recall = safe_ratio(tp, pos, 0.0)
    f1 = safe_ratio(2 * tp, 2 * tp + fp + fn, 0.0)
    accuracy = safe_ratio(tp + tn, n)
    specificity = safe_ratio(tn, neg, pol.spec_undefined)
    if pol.zero_counts_if_one_class:
        # confusion matrix smaller than 2x2 ⇒ every cell taken as 0 ⇒ spec 0
        # (labels seen in truth ∪ prediction are a single class)
        one_class = ((pos == 0) & (pred_pos == 0)) | ((neg == 0) & (pred_pos == n))
        specificity = F.when(one_class, F.lit(0.0)).otherwise(specificity)
    npv = safe_ratio(tn, tn + fn, pol.spec_undefined)
    both = (pos > 0) & (neg > 0)
    auc_hard = (recall + safe_ratio(tn, neg, 0.0)) / 2.0
    undefined_auc = F.lit(None).cast("double") if pol.auc_undefined is None else F.lit(float(pol.auc_undefined))
    auc = F.when(both, auc_hard).otherwise(undefined_auc)
    return {
        "accuracy": accuracy,
        "precision": precision,
        "recall": recall,
        "f1": f1,
        "specificity": specificity,
        "npv": npv,
        "auc": auc,
    }


def evaluate(df: DataFrame, truth: str = "y_true", pred: str = "y_pred", by=(), policy: str = "cli",
             keep_counts: bool = True) -> DataFrame:
    """All metrics per group from hard 0/1 labels.

    On hard predictions the ROC AUC with average ranks equals
    ``(recall + specificity) / 2`` — the count-based form needs no sort.
    Rows whose truth or prediction is NULL are not counted.
    """
    counts = confusion_counts(df, truth, pred, by)
    out = counts.withColumns(metric_columns(policy))
    return out if keep_counts else out.drop(*COUNT_COLS)


def roc_auc(df: DataFrame, label: str = "y_true", score: str = "score", by=(),
            undefined: float | None = None, num_partitions: int | None = None) -> DataFrame:
    """ROC AUC for arbitrary scores (ties get the average rank).

    Mann–Whitney form: AUC = Σ_s pos_s·(neg_below_s + neg_s/2) / (P·N).
    Rows are first reduced to one row per distinct ``(group, score)`` level;
    ``neg_below`` is a distributed prefix sum over the levels, so a group with
    very many distinct scores is spread over many tasks.  Rows with a NULL
    score or a label other than 0 and 1 are not counted; a NULL group is a
    group.
    """
    labelled = df.where(F.col(label).isin(0, 1) & F.col(score).isNotNull())
    levels = labelled.groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).cast("long").alias("pos"),
        F.count_if(F.col(label) == 0).cast("long").alias("neg"),
    )
    ranked = prefix_sums(levels, list(by), [score], ["neg"], num_partitions=num_partitions)
    contrib = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)
    agg = ranked.groupBy(*by).agg(
        F.sum(contrib).alias("_u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
    )
    undefined_col = F.lit(None).cast("double") if undefined is None else F.lit(float(undefined))
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                 F.col("_u") / (F.col("n_pos").cast("double") * F.col("n_neg"))).otherwise(undefined_col)
    return agg.select(*by, "n_pos", "n_neg", auc.alias("auc"))


def confusion_long(counts: DataFrame, by=()) -> DataFrame:
    """Four rows per group ``(true_label, pred_label, count)``, zero cells kept."""
    cells = F.array(
        F.struct(F.lit(0).alias("true_label"), F.lit(0).alias("pred_label"), F.col("tn").alias("count")),
        F.struct(F.lit(0).alias("true_label"), F.lit(1).alias("pred_label"), F.col("fp").alias("count")),
        F.struct(F.lit(1).alias("true_label"), F.lit(0).alias("pred_label"), F.col("fn").alias("count")),
        F.struct(F.lit(1).alias("true_label"), F.lit(1).alias("pred_label"), F.col("tp").alias("count")),
    )
    return counts.select(*by, F.inline(cells))


def mean_score(long_df: DataFrame, by=("Metric", "Model"), value: str = "Score") -> DataFrame:
    """Mean of the value per key pair (the bar heights of a grouped bar chart)."""
    return long_df.groupBy(*by).agg(F.avg(value).alias("mean_score"))
