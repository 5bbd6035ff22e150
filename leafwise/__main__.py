"""Command line: ``python -m leafwise <command> PATH``.

  evaluate PATH            one prediction CSV (y_true, y_pred) → seven metrics
  model-report DIR         every *_test/_val/_external CSV in DIR → long report
  checkpoint-report DIR    checkpoint family in DIR → valid share and metrics
  fit-forest PATH          boosted forest of the shipped size on a parquet table; ``--out`` names the
                           model's folder, its node table goes to ``<out>/nodes``

Each report command builds the same Spark job as the library call and prints the
(small) result table.  ``--out PATH`` writes it as CSV instead.
"""

from __future__ import annotations

import argparse

from leafwise import checkpoint_report, evaluate_predictions, get_session, model_report, read_csv
from leafwise import fit_forest, read_checkpoint_files, read_prediction_files, write_csv
from leafwise.operators.models import forest_table


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m leafwise")
    parser.add_argument("command", choices=["evaluate", "model-report", "checkpoint-report", "fit-forest"])
    parser.add_argument("path")
    parser.add_argument("--out", help="write the result as CSV to this path instead of printing it")
    parser.add_argument("--features", default="embedding", help="fit-forest: column of feature arrays")
    parser.add_argument("--label", default="label", help="fit-forest: column of 0/1 labels")
    parser.add_argument("--trees", type=int, help="fit-forest: number of trees (default: as shipped)")
    parser.add_argument("--depth", type=int, help="fit-forest: depth of trees (default: as shipped)")
    args = parser.parse_args(argv)
    if args.command == "fit-forest" and not args.out:
        parser.error("fit-forest needs --out")
    spark = get_session()
    if args.command == "fit-forest":
        rows = spark.read.parquet(args.path).where(f"`{args.features}` is not null and `{args.label}` is not null")
        model = fit_forest(rows, features=args.features, label=args.label, n_estimators=args.trees, max_depth=args.depth)
        forest_table(model, f"{args.out.rstrip('/')}/model").write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/nodes")
        print(f"{len(model.trees)} trees")
        return 0
    if args.command == "evaluate":
        result = evaluate_predictions(read_csv(spark, args.path))
    elif args.command == "model-report":
        result = model_report(read_prediction_files(spark, args.path)).orderBy("split", "sort_rank", "metric_rank")
    else:
        result = checkpoint_report(read_checkpoint_files(spark, args.path))
    if args.out:
        write_csv(result, args.out)
    else:
        result.show(n=1000, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
