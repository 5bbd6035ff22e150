"""leafwise: Spark DataFrame operators for nearest-neighbour context building
and binary-prediction evaluation.

Every public operator takes and returns ``pyspark.sql.DataFrame`` objects and
builds a lazy plan; nothing is collected to the driver.  The most used entry
points are re-exported here.
"""

from leafwise.functions.text import extract_tag, unicode_strip
from leafwise.operators.features import catalog_matches, featurize, forest_leaves, masked_mean_pool
from leafwise.operators.knn import knn_leave_one_out, knn_query_ref, neighbor_lists, neighbor_records
from leafwise.operators.metrics import confusion_counts, evaluate, roc_auc
from leafwise.operators.models import embed_text, fit_forest, model_leaves
from leafwise.operators.series import ema, reward_series
from leafwise.plans.reports import checkpoint_report, evaluate_predictions, model_report
from leafwise.plans.scoring import neighbor_context, neighbor_context_from_features, score_batch
from leafwise.session import get_session, scratch_dir
from leafwise.sources.files import (read_checkpoint_files, read_csv, read_prediction_files, read_training_log,
                                    write_csv)

__all__ = [
    "catalog_matches", "checkpoint_report", "confusion_counts", "ema", "embed_text", "evaluate",
    "evaluate_predictions", "extract_tag", "featurize", "fit_forest", "forest_leaves", "get_session",
    "knn_leave_one_out", "knn_query_ref", "masked_mean_pool", "model_leaves", "model_report",
    "neighbor_context", "neighbor_context_from_features", "neighbor_lists", "neighbor_records",
    "read_checkpoint_files", "read_csv", "read_prediction_files", "read_training_log", "reward_series",
    "roc_auc", "scratch_dir", "score_batch", "unicode_strip", "write_csv",
]
