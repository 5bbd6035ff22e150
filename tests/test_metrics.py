import math
import random

import pytest
from pyspark.sql import functions as F

from leafwise.functions.labels import binarize, map_label, recode_label, to_binary
from leafwise.functions.numeric import round_half_even
from leafwise.operators.metrics import evaluate, roc_auc


def brute(pairs, policy):
    """Direct statement of the metric definitions for one group."""
    tn = sum(1 for t, p in pairs if t == 0 and p == 0)
    fp = sum(1 for t, p in pairs if t == 0 and p == 1)
    fn = sum(1 for t, p in pairs if t == 1 and p == 0)
    tp = sum(1 for t, p in pairs if t == 1 and p == 1)
    div = lambda a, b, z: a / b if b else z
    spec_z = None if policy == "report" else 0.0
    out = {
        "precision": div(tp, tp + fp, 0.0), "recall": div(tp, tp + fn, 0.0),
        "f1": div(2 * tp, 2 * tp + fp + fn, 0.0), "specificity": div(tn, tn + fp, spec_z),
        "npv": div(tn, tn + fn, spec_z),
    }
    labels = {t for t, _ in pairs} | {p for _, p in pairs}
    if policy == "checkpoint" and len(labels) == 1:
        out["specificity"] = 0.0
    pos, neg = tp + fn, tn + fp
    if pos and neg:
        # pairwise AUC: P(score_pos > score_neg) + 0.5 P(equal)
        ps = [p for t, p in pairs if t == 1]
        ns = [p for t, p in pairs if t == 0]
        out["auc"] = sum((a > b) + 0.5 * (a == b) for a in ps for b in ns) / (len(ps) * len(ns))
    else:
        out["auc"] = 0.0 if policy == "checkpoint" else None
    return out


GROUPS = {
    "all0": [(0, 0)] * 5,
    "all1": [(1, 1)] * 4,
    "truth0_pred1": [(0, 1)] * 3,
    "no_pred_pos": [(0, 0), (1, 0), (1, 0)],
    "mixed": [(0, 0), (0, 1), (1, 0), (1, 1), (1, 1), (0, 0)],
}


@pytest.mark.parametrize("policy", ["cli", "report", "checkpoint"])
def test_policies_match_definitions(spark, policy):
    rows = [(g, t, p) for g, pairs in GROUPS.items() for t, p in pairs]
    df = spark.createDataFrame(rows, "g string, t int, p int")
    got = {r["g"]: r.asDict() for r in evaluate(df, "t", "p", by=["g"], policy=policy).collect()}
    for g, pairs in GROUPS.items():
        exp = brute(pairs, policy)
        for k, v in exp.items():
            assert (got[g][k] is None and v is None) or math.isclose(got[g][k], v), (policy, g, k, got[g][k], v)


def test_empty_input_gives_no_groups(spark):
    df = spark.createDataFrame([], "g string, t int, p int")
    assert evaluate(df, "t", "p", by=["g"]).count() == 0


def test_labels_and_junk(spark):
    df = spark.createDataFrame([("approved",), ("unapproved",), ("1",), ("0.0",), ("n/a",), (None,)], "y string")
    rows = df.select(recode_label("y"), map_label("y"), binarize(recode_label("y")), to_binary("y")).collect()
    assert [tuple(r) for r in rows] == [
        (1.0, 1, 1, 1), (0.0, 0, 0, 0), (1.0, None, 1, 1), (0.0, None, 0, 0), (None, None, 0, None), (None, None, 0, None)]


def test_auc_rank_formula_matches_pairwise(spark):
    rng = random.Random(7)
    groups = [0, 1, 2, None]
    rows = [(g, rng.randint(0, 1), float(rng.randint(0, 30))) for g in groups for _ in range(60)]
    rows += [(0, 1, None), (0, None, 3.0)]   # no score, no label: not counted
    df = spark.createDataFrame(rows, "g int, t int, s double")
    got = {r["g"]: r["auc"] for r in roc_auc(df, "t", "s", by=["g"], num_partitions=3).collect()}
    assert set(got) == set(groups)
    for g in groups:
        ps = [s for gg, t, s in rows if gg == g and t == 1 and s is not None]
        ns = [s for gg, t, s in rows if gg == g and t == 0 and s is not None]
        exp = sum((a > b) + 0.5 * (a == b) for a in ps for b in ns) / (len(ps) * len(ns))
        assert math.isclose(got[g], exp)


def test_hard_auc_equals_balanced_accuracy(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), rng.randint(0, 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "t int, p int")
    hard = evaluate(df, "t", "p").first()["auc"]
    ranked = roc_auc(df.withColumn("s", F.col("p").cast("double")), "t", "s").first()["auc"]
    assert math.isclose(hard, ranked)


def test_metrics_invariant_under_repartition(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 3), rng.randint(0, 1), rng.randint(0, 1)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g int, t int, p int")
    a = sorted(map(tuple, evaluate(df, "t", "p", by=["g"]).collect()))
    b = sorted(map(tuple, evaluate(df.repartition(7), "t", "p", by=["g"]).collect()))
    assert a == b


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.0005,), (0.0015,), (0.1235,)], "x double")
    assert [r[0] for r in df.select(round_half_even("x", 3)).collect()] == [0.0, 0.002, 0.124]


def test_rows_without_truth_are_dropped_and_counted(spark):
    from leafwise.operators.metrics import confusion_counts

    df = spark.createDataFrame([(1, 1), (0, 0), (None, 1), (None, 0)], "t int, p int")
    row = evaluate(df, "t", "p").first()
    assert row["accuracy"] == 1.0 and row["n"] == 2
    assert confusion_counts(df, "t", "p", with_dropped=True).first()["n_dropped"] == 2
