"""The README's usage flow on small files."""

import json

import leafwise as lw


def _csv(path, rows):
    path.write_text("y_true,y_pred\n" + "\n".join(f"{t},{p}" for t, p in rows) + "\n")


def test_readme_flow(spark, tmp_path):
    _csv(tmp_path / "results.csv", [("approved", "approved"), ("unapproved", "approved"), ("approved", "junk")])
    ev = lw.evaluate_predictions(lw.read_csv(spark, str(tmp_path / "results.csv"))).first()
    assert (ev["tn"], ev["fp"], ev["fn"], ev["tp"]) == (0, 1, 1, 1)

    out = tmp_path / "outputs"
    out.mkdir()
    _csv(out / "knn_test.csv", [(1, 1), (0, 1), (1, 0)])
    _csv(out / "reasoner_test.csv", [("approved", "approved"), ("unapproved", "unapproved")])
    _csv(out / "svm_external.csv", [(0, 0), (1, 1)])
    rep = lw.model_report(lw.read_prediction_files(spark, str(out)))
    ranks = {(r["split"], r["display_name"]): r["sort_rank"] for r in rep.collect()}
    assert ranks == {("test", "knn"): 1, ("test", "reasoner"): 2, ("external", "svm"): 1}

    ck = tmp_path / "ck"
    ck.mkdir()
    _csv(ck / "zeroshot_base.csv", [("approved", "approved"), ("unapproved", "n/a")])
    _csv(ck / "prediction_df_1.0_0.9_9_500_final_setting.csv", [("approved", "unapproved"), ("unapproved", "unapproved")])
    curve = {r["checkpoint"]: r["n_samples"] for r in lw.checkpoint_report(lw.read_checkpoint_files(spark, str(ck))).collect()}
    assert curve == {0: 1, 500: 2}

    doc = {"log_history": [{"step": s, **{k: float(s) for k in lw.operators.series.REWARD_LABELS}} for s in (1, 2, 3)]}
    (tmp_path / "trainer_state.json").write_text(json.dumps(doc))
    log = lw.read_training_log(spark, str(tmp_path / "trainer_state.json"), list(lw.operators.series.REWARD_LABELS),
                               multi_line=True)
    series = lw.reward_series(log, ["pos"], alpha=0.05)
    assert series.count() == 3 * len(lw.operators.series.REWARD_LABELS)
    assert {r["label"] for r in series.select("label").distinct().collect()} == set(lw.operators.series.REWARD_LABELS.values())


def test_command_line_evaluate(tmp_path):
    import os
    import subprocess
    import sys

    _csv(tmp_path / "p.csv", [("approved", "approved"), ("unapproved", "approved")])
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-m", "leafwise", "evaluate", str(tmp_path / "p.csv")], cwd=repo,
                         capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "accuracy" in out.stdout and "0.5" in out.stdout
