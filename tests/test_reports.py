import math

from leafwise.plans.reports import checkpoint_report, valid_share
from leafwise.plans.scoring import extract_answers


def test_checkpoint_report_policies(spark):
    rows = [
        (0, "approved", "approved"), (0, "unapproved", "n/a"), (0, "unapproved", "unapproved"),   # junk dropped (L16)
        (500, "approved", "approved"), (500, "weird", "approved"),                                # NULL truth: skipped (L29)
        (1000, "unapproved", "unapproved"), (1000, "unapproved", "unapproved"),                   # one class: spec 0, AUC 0 (L19, L18)
        (1500, "approved", "junk"),                                                               # no valid rows: absent (L24)
    ]
    df = spark.createDataFrame(rows, "checkpoint int, y_true string, y_pred string")
    rep = {r["checkpoint"]: r.asDict() for r in checkpoint_report(df).collect()}
    assert sorted(rep) == [0, 1000]
    assert rep[0]["n_samples"] == 2 and math.isclose(rep[0]["valid_percent"], 2 / 451 * 100)
    assert rep[0]["auc"] == 1.0 and rep[0]["specificity"] == 1.0
    assert rep[1000]["specificity"] == 0.0 and rep[1000]["auc"] == 0.0 and rep[1000]["f1"] == 0.0
    share = {r["checkpoint"]: r["n_valid"] for r in valid_share(df).collect()}
    assert share == {0: 2, 500: 2, 1000: 2}


def test_confidence_kept_as_text(spark):
    df = spark.createDataFrame([(1, "<score> 0.75 </score>"), (2, "<score>high</score>")], "id int, generated string")
    got = {r["id"]: (r["confidence_score"], r["confidence_value"]) for r in extract_answers(df).collect()}
    assert got == {1: ("0.75", 0.75), 2: ("high", None)}


def test_saved_scores_are_the_returned_ones(spark, tmp_path):
    import uuid

    from leafwise.plans.scoring import RESULT_COLUMNS, score_batch
    from leafwise.sources.files import read_csv

    def random_factory(options):
        return lambda prompts: [f"<think>{uuid.uuid4()}</think><label>approved</label><score>1</score>" for _ in prompts]

    ctx = spark.createDataFrame([(i, "{}", "[]", "[]") for i in range(20)],
                                "id long, rdkit_properties string, similar_approved string, similar_unapproved string")
    names = spark.createDataFrame([(i, f"s{i}") for i in range(20)], "id long, SMILES string")
    out = str(tmp_path / "scores")
    got = score_batch(ctx, names, generator_factory=random_factory, save_path=out)
    schema = ", ".join(f"`{c}` string" for c in RESULT_COLUMNS)
    returned = {(r["SMILES"], r["thinking"]) for r in got.collect()}
    assert returned == {(r["SMILES"], r["thinking"]) for r in read_csv(spark, out, schema, multi_line=True).collect()}
    assert len(returned) == 20
