"""Registered queries: ``name → (spark, sf_dir) → DataFrame``.

Each query reads the given tables (or data Spark derives from them) in full
and runs one library operator or job.  Doubles are rounded with
:func:`round_fixed` so the independent SQL oracle can compare values exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from leafwise.functions import labels as L
from leafwise.functions import text as T
from leafwise.functions.numeric import round_fixed, round_half_even
from leafwise.operators import features as FE
from leafwise.operators import generate as G
from leafwise.operators import knn as K
from leafwise.operators import metrics as M
from leafwise.operators import models as MO
from leafwise.operators import series as W
from leafwise.operators.features import text_features
from leafwise.operators.scan import spread
from leafwise.plans import reports as R
from leafwise.plans import scoring as SC
from leafwise.session import scratch_dir
from leafwise.sources import files as FS
from leafwise.sources import tables as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double/float column for cross-engine comparison."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(round_fixed(f.name, digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _hard_checkpoint(spark, sf):
    """Valid checkpoint rows with strictly mapped 0/1 labels."""
    ck = S.checkpoint_prediction_table(spark, sf)
    return ck.where(L.is_valid_prediction("y_pred")).select(
        "checkpoint", L.map_label("y_true").alias("t"), L.map_label("y_pred").alias("p")
    )


# --- aggregations -------------------------------------------------------------


@register("confusion_counts")
def q_confusion_counts(spark, sf):
    return M.confusion_counts(_hard_checkpoint(spark, sf), "t", "p", by=["checkpoint"])


def _one_metric(name: str, policy: str = "cli"):
    def q(spark, sf):
        ev = M.evaluate(_hard_checkpoint(spark, sf), "t", "p", by=["checkpoint"], policy=policy)
        return rounded(ev.select("checkpoint", name))

    return q


for _name in ("accuracy", "precision", "recall", "f1", "specificity", "npv"):
    register(_name)(_one_metric(_name))


@register("roc_auc")
def q_roc_auc(spark, sf):
    """AUC of document length as a score for quality, per checkpoint group
    (continuous scores with ties: the general rank formula)."""
    ck = S.checkpoint_prediction_table(spark, sf).select("checkpoint", "doc_id", L.map_label("y_true").alias("t"))
    docs = S.table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    scored = ck.join(docs, "doc_id")
    return rounded(M.roc_auc(scored, "t", "score", by=["checkpoint"]))


@register("evaluate_bundle")
def q_evaluate_bundle(spark, sf):
    return rounded(R.evaluate_predictions(S.prediction_table(spark, sf)))


@register("evaluate_safe")
def q_evaluate_safe(spark, sf):
    ev = M.evaluate(_hard_checkpoint(spark, sf), "t", "p", by=["checkpoint"], policy="checkpoint")
    return rounded(ev.drop("accuracy", "npv"))


@register("metrics_by_model")
def q_metrics_by_model(spark, sf):
    return rounded(R.model_metrics(S.model_prediction_table(spark, sf)))


@register("metrics_by_checkpoint")
def q_metrics_by_checkpoint(spark, sf):
    return rounded(R.checkpoint_report(S.checkpoint_prediction_table(spark, sf)).drop("valid_percent"))


@register("checkpoint_report")
def q_checkpoint_report(spark, sf):
    return rounded(R.checkpoint_report(S.checkpoint_prediction_table(spark, sf)))


@register("valid_percent")
def q_valid_percent(spark, sf):
    return rounded(R.valid_share(S.checkpoint_prediction_table(spark, sf)))


@register("confusion_by_model")
def q_confusion_by_model(spark, sf):
    return R.confusion_by_model(S.model_prediction_table(spark, sf))


@register("model_report")
def q_model_report(spark, sf):
    return rounded(R.model_report(S.model_prediction_table(spark, sf), order=STANDIN_ORDER))


@register("mean_score")
def q_mean_score(spark, sf):
    long = R.model_report(S.model_prediction_table(spark, sf), order=STANDIN_ORDER)
    return rounded(M.mean_score(long, by=("split", "Metric", "display_name")))


# Parameter: display order for the stand-in model names (the reference passes
# its own literal maps the same way; unmapped names sort last).
STANDIN_ORDER = {
    "test": {"src3_test": 0, "src1_test": 1, "src0_test": 2, "src7_test": 3},
    "val": {"src3_val": 0, "src1_val": 1, "src0_val": 2, "src7_val": 3},
    "external": {"src3_external": 0, "src1_external": 1, "src0_external": 2, "src7_external": 3},
}


# --- reshaping / ordering -----------------------------------------------------


@register("custom_order")
def q_custom_order(spark, sf):
    from leafwise.operators.reshape import custom_order

    wide = R.model_metrics(S.model_prediction_table(spark, sf)).select("split", "model")
    flat = {k: v for m in STANDIN_ORDER.values() for k, v in m.items()}
    return custom_order(wide, "model", flat, by=["split"])


@register("melt_metrics")
def q_melt_metrics(spark, sf):
    from leafwise.operators.reshape import melt

    wide = R.model_metrics(S.model_prediction_table(spark, sf))
    wide = wide.select("model", *[F.col(k).alias(v) for k, v in R.REPORT_METRICS.items()])
    return rounded(melt(wide, ["model"], list(R.REPORT_METRICS.values())))


@register("ordered_category")
def q_ordered_category(spark, sf):
    from leafwise.operators.reshape import melt, ordered_category

    wide = R.model_metrics(S.model_prediction_table(spark, sf))
    wide = wide.select("model", *[F.col(k).alias(k) for k in ("auc", "f1", "accuracy")])
    long = melt(wide, ["model"], ["auc", "f1", "accuracy"])
    return long.select("model", "Metric", ordered_category("Metric", ["f1", "auc", "recall"]).alias("metric_rank"))


@register("round_metrics")
def q_round_metrics(spark, sf):
    wide = R.model_metrics(S.model_prediction_table(spark, sf))
    return wide.select("model", *[round_half_even(c, 3).alias(c) for c in ("auc", "f1", "recall", "specificity", "precision")])


# --- scalar label functions ---------------------------------------------------


@register("recode_labels")
def q_recode_labels(spark, sf):
    return L.recode_labels(S.model_prediction_table(spark, sf), ["y_true", "y_pred"])


@register("map_labels")
def q_map_labels(spark, sf):
    ck = S.checkpoint_prediction_table(spark, sf)
    return ck.select("doc_id", L.map_label("y_true").alias("t"), L.map_label("y_pred").alias("p"))


@register("binarize_pred")
def q_binarize_pred(spark, sf):
    mp = S.model_prediction_table(spark, sf)
    return mp.select("model", "doc_id", L.binarize(L.recode_label("y_pred")).alias("p"))


@register("filter_valid")
def q_filter_valid(spark, sf):
    return S.checkpoint_prediction_table(spark, sf).where(L.is_valid_prediction("y_pred"))


@register("route_split")
def q_route_split(spark, sf):
    return S.model_prediction_table(spark, sf).select("model", "doc_id", L.split_of("model").alias("split"))


@register("strip_suffix")
def q_strip_suffix(spark, sf):
    mp = S.model_prediction_table(spark, sf).select("model").distinct()
    return mp.select(
        "model",
        T.strip_suffix("model", R.SUFFIX_PATTERNS["test"]).alias("test_val_name"),
        T.strip_suffix("model", R.SUFFIX_PATTERNS["external"]).alias("external_name"),
    )


@register("replace_literal")
def q_replace_literal(spark, sf):
    mp = S.model_prediction_table(spark, sf).select("model").distinct()
    return mp.select("model", T.replace_literal("model", "_test", "_val").alias("title"))


# --- tagged text ----------------------------------------------------------------


@register("extract_tags")
def q_extract_tags(spark, sf):
    g = spread(S.generated_table(spark, sf))
    return g.select(
        "id",
        T.extract_tag("text", "think").alias("thinking"),
        T.extract_tag("text", "label").alias("prediction"),
        T.extract_tag("text", "score").alias("confidence_score"),
    )


@register("strip_lower")
def q_strip_lower(spark, sf):
    conv = spread(S.table(spark, sf, "conversations"))
    return conv.select("conv_id", "turn", T.strip_lower("text").alias("text"))


# --- nearest neighbours ---------------------------------------------------------



def _neighbor_props(spark, sf):
    """Property records of reference rows: text features of the document
    with the same id (only documents that are reference rows are featurised)."""
    docs = S.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    ids = S.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    # only the texts that are needed are dealt out; both uses of the records read what is written here
    wanted = docs.join(ids, "id", "left_semi").repartition(spark.sparkContext.defaultParallelism)
    path = scratch_dir(spark, "props")
    text_features(wanted, "id").write.parquet(path)
    return spark.read.parquet(path)


@register("knn_leave_one_out")
def q_knn_leave_one_out(spark, sf):
    return rounded(K.knn_leave_one_out(S.leaf_table(spark, sf), k=5))


@register("knn_query_ref")
def q_knn_query_ref(spark, sf):
    leaves = S.leaf_table(spark, sf)
    return rounded(K.knn_query_ref(leaves.select("id", "leaves"), leaves, k=5))


@register("knn_index_leave_one_out")
def q_knn_index_leave_one_out(spark, sf):
    """The same search through posting lists, with the grid for what they leave open."""
    return rounded(K.knn_leave_one_out(S.leaf_table(spark, sf), k=5, method="index"))


@register("knn_index_query_ref")
def q_knn_index_query_ref(spark, sf):
    leaves = S.leaf_table(spark, sf)
    return rounded(K.knn_query_ref(leaves.select("id", "leaves"), leaves, k=5, method="index"))


@register("knn_repeated_vectors")
def q_knn_repeated_vectors(spark, sf):
    """Leaf vectors cut to their first four positions: most rows repeat another's vector."""
    leaves = S.leaf_table(spark, sf).withColumn("leaves", F.slice("leaves", 1, 4))
    return rounded(K.knn_leave_one_out(leaves, k=5))


@register("hamming_pairs")
def q_hamming_pairs(spark, sf):
    leaves = S.leaf_table(spark, sf)
    nb = K.knn_leave_one_out(leaves, k=5)
    return rounded(K.neighbor_distances(nb, leaves, leaves))


@register("class_partition")
def q_class_partition(spark, sf):
    return K.class_partition(S.leaf_table(spark, sf)).select("id", "label", "cls")


@register("topk_per_group")
def q_topk_per_group(spark, sf):
    ev = S.table(spark, sf, "events").select("event_type", "event_id", "value")
    return K.top_k_per_group(ev, ["event_type"], [F.col("value"), F.col("event_id")], 5)


@register("neighbor_lookup")
def q_neighbor_lookup(spark, sf):
    nb = K.knn_leave_one_out(S.leaf_table(spark, sf), k=5)
    return K.neighbor_records(nb, _neighbor_props(spark, sf), as_json=True)


@register("neighbor_lookup_one")
def q_neighbor_lookup_one(spark, sf):
    nb = K.knn_leave_one_out(S.leaf_table(spark, sf), k=5)
    return rounded(K.neighbor_lookup(nb, _neighbor_props(spark, sf)))


@register("neighbor_lists")
def q_neighbor_lists(spark, sf):
    leaves = S.leaf_table(spark, sf)
    lists = K.neighbor_lists(K.knn_leave_one_out(leaves, k=5), leaves)
    as_text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return lists.select("qid", as_text("approved_neighbors").alias("approved_neighbors"),
                        as_text("unapproved_neighbors").alias("unapproved_neighbors"))


# --- series -----------------------------------------------------------------------


EMA_ALPHA = 0.05  # the smoothing the reference applies to its logs


@register("ema")
def q_ema(spark, sf):
    log = S.log_series_table(spark, sf)
    return rounded(W.ema(log, "series", ["ts", "seq"], "value", alpha=EMA_ALPHA).drop("ts"))


@register("reward_series")
def q_reward_series(spark, sf):
    ev = S.table(spark, sf, "events").select("ts", "event_id", "value", "user_id")
    labels = {"value": "Event value", "user_id": "User id"}
    return rounded(W.reward_series(ev, ["ts", "event_id"], labels, alpha=EMA_ALPHA).drop("ts"))


# --- features ---------------------------------------------------------------------


FOREST_TREES, FOREST_DEPTH = 16, 4  # literal rule-built forest for the leaf encoder
SMALL_FOREST_TREES = 5


@register("masked_mean_pool")
def q_masked_mean_pool(spark, sf):
    return rounded(FE.masked_mean_pool(S.token_table(spark, sf)))


@register("forest_leaves")
def q_forest_leaves(spark, sf):
    emb = S.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    forest = FE.synthetic_forest(spark, FOREST_TREES, FOREST_DEPTH, 64)
    return FE.forest_leaves(emb, forest)


@register("forest_leaves_small")
def q_forest_leaves_small(spark, sf):
    """A forest that fits a column expression: no Python worker."""
    emb = S.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    return FE.forest_leaves(emb, FE.synthetic_forest(spark, SMALL_FOREST_TREES, FOREST_DEPTH, 64))


@register("pattern_catalog_match")
def q_pattern_catalog_match(spark, sf):
    docs = spread(S.table(spark, sf, "documents"))
    hits = docs.select("doc_id", FE.catalog_matches("text").alias("alerts"))
    return hits.select(
        "doc_id", F.size("alerts").alias("n_alerts"),
        F.when(F.size("alerts") == 0, F.lit("None")).otherwise(F.array_join("alerts", "; ")).alias("alerts"),
    )


@register("pattern_catalog_large")
def q_pattern_catalog_large(spark, sf):
    """Every pair of neighbouring plain words of the benchmark items as a pattern, searched in all documents."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), 0)
    pairs = S.table(spark, sf, "benchmark").select(F.explode(F.arrays_zip(words.alias("a"), F.slice(words, 2, 1 << 20).alias("b"))).alias("p"))
    pairs = pairs.select("p.*").where("a is not null and b is not null").distinct()
    catalog = pairs.select(F.concat_ws(" ", "a", "b").alias("name"), F.concat("a", F.lit("[ ,.]+"), "b").alias("pattern"), F.array("a").alias("literals"))
    docs = spread(S.table(spark, sf, "documents").select("doc_id", "text"))
    found = FE.catalog_search(docs, catalog)
    return found.select("doc_id", F.size("matches").alias("n_matches"), F.array_join("matches", ";").alias("matches"))


@register("featurize_distinct")
def q_featurize_distinct(spark, sf):
    docs = spread(S.table(spark, sf, "documents").select("text"))
    return FE.featurize_distinct(docs, "text")


@register("featurize_hook")
def q_featurize_hook(spark, sf):
    docs = spread(S.table(spark, sf, "documents").select("doc_id", "text"))
    feats = FE.featurize(docs, "text", fn=FE.pandas_text_features, schema=FE.PANDAS_TEXT_SCHEMA)
    return feats.select("doc_id", "n_chars", "n_words", "n_digits")


@register("embed_text")
def q_embed_text(spark, sf):
    docs = spread(S.table(spark, sf, "documents").select("doc_id", "text"))
    return rounded(MO.embed_text(docs, "text").select("doc_id", F.posexplode("embedding").alias("dim", "value")))


@register("forest_fit")
def q_forest_fit(spark, sf):
    """Fit the boosted forest (reference hyperparameters, fewer and lower trees:
    see ``_small_forest``) and encode every row as its leaf vector."""
    emb = S.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding",
                                                     (F.col("label") % 2).alias("label"))
    return MO.model_leaves(_small_forest(emb), emb)


def _small_forest(emb):
    """8 trees of depth 5 so that the check stays quick; the shipped forest has 589 of depth 9."""
    return MO.fit_forest(emb, n_estimators=8, max_depth=5)


@register("forest_export")
def q_forest_export(spark, sf):
    """A fitted forest against its exported node table: the walk must reach the leaves the model names."""
    emb = S.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding",
                                                     (F.col("label") % 2).alias("label"))
    model = _small_forest(emb)
    nodes = MO.forest_table(model, scratch_dir(spark, "forest"))
    walked = FE.forest_leaves(emb.select("id", F.col("embedding").alias("features")), nodes)
    named = walked.join(F.broadcast(nodes.select("tree", F.col("node").alias("leaf"), F.col("leaf").alias("name"))), ["tree", "leaf"])
    per_tree = MO.model_leaves(model, emb).select("id", F.posexplode("leaves").alias("tree", "want"))
    return per_tree.join(named, ["id", "tree"], "left").groupBy("id").agg(
        F.bool_and(F.coalesce(F.col("name") == F.col("want"), F.lit(False))).alias("agrees"),
        (F.count(F.lit(1)) == len(model.trees)).alias("all_trees"))


@register("strings_to_neighbors")
def q_strings_to_neighbors(spark, sf):
    """Strings to neighbours in one job: embed all texts, fit a forest on the labelled ones, encode, and
    search every text among the labelled ones other than itself.  A NULL text has no embedding."""
    docs = S.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    labels = S.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label"))
    path = scratch_dir(spark, "embedded")
    MO.embed_text(docs, "text").where("embedding is not null").select("id", "embedding").write.parquet(path)
    emb = spark.read.parquet(path)
    nodes = MO.forest_table(_small_forest(emb.join(labels, "id")), scratch_dir(spark, "forest"))
    path = scratch_dir(spark, "leaves")
    FE.forest_leaves(emb.select("id", F.col("embedding").alias("features")), nodes, as_array=True).write.parquet(path)
    leaves = spark.read.parquet(path)
    return rounded(K.knn_per_class(leaves, leaves.join(labels, "id"), k=5, exclude_self=True))


# --- prompts, generation, scoring ------------------------------------------------



def _docs_by_id(spark, sf):
    return S.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def _context(spark, sf):
    """Neighbour context for every leaf row (queries = reference = the whole table)."""
    leaves = S.leaf_table(spark, sf)
    props = _neighbor_props(spark, sf)
    return SC.neighbor_context(leaves.select("id", "leaves"), leaves, props, props)


@register("neighbor_context")
def q_neighbor_context(spark, sf):
    return _context(spark, sf)


@register("build_prompt")
def q_build_prompt(spark, sf):
    conv = S.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    p = G.build_prompt(conv, {"features": "text", "approved": "text", "unapproved": "text"})
    return p.select("id", F.size("prompt").alias("n_messages"),
                    F.col("prompt")[0]["role"].alias("system_role"), F.col("prompt")[0]["content"].alias("system_content"),
                    F.col("prompt")[1]["role"].alias("user_role"), F.col("prompt")[1]["content"].alias("user_content"))


@register("batch_generate")
def q_batch_generate(spark, sf):
    conv = S.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    p = G.build_prompt(conv, {"features": "text", "approved": "text", "unapproved": "text"})
    return G.batch_generate(p)


@register("batch_generate_resumed")
def q_batch_generate_resumed(spark, sf):
    """A job that finds a third of its answers in its store and generates the rest."""
    conv = S.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    p = G.build_prompt(conv, {"features": "text", "approved": "text", "unapproved": "text"})
    store = scratch_dir(spark, "answers")
    G.batch_generate(p.where(F.col("id") % 3 == 0), store=store, chunks=2)
    return G.batch_generate(p, store=store, chunks=4)


@register("score_batch")
def q_score_batch(spark, sf):
    ctx = _context(spark, sf)
    names = _docs_by_id(spark, sf).select("id", F.md5("text").alias("SMILES"))
    return SC.score_batch(ctx, names)


@register("assemble_results")
def q_assemble_results(spark, sf):
    return q_score_batch(spark, sf).drop("id")


# --- files ------------------------------------------------------------------------



@register("scan_train")
def q_scan_train(spark, sf):
    path = scratch_dir(spark, "train")
    emb = S.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.lit("train").alias("split"))
    emb.write.mode("overwrite").partitionBy("split").parquet(path)
    return FS.read_train(spark, path, schema="id long, label int, split string").select("id", "label")


def _model_files(spark, sf):
    """Model prediction files, partitioned layout (parallel writers)."""
    root = scratch_dir(spark, "models")
    return FS.write_partitioned_csv(S.model_prediction_table(spark, sf), "model", root)


@register("scan_multi_csv")
def q_scan_multi_csv(spark, sf):
    root = _model_files(spark, sf)
    return FS.read_prediction_files(spark, root, schema="doc_id long, y_true string, y_pred string",
                                    layout="partitioned")


@register("file_stem")
def q_file_stem(spark, sf):
    """Key of each row from the name of the file it lies in: one file per model."""
    root = scratch_dir(spark, "stems")
    FS.write_named_csv(S.model_prediction_table(spark, sf), "model", root)
    df = FS.read_csv(spark, root, "doc_id long", with_file=True)
    return df.select("doc_id", FS.file_stem(F.col("file_name")).alias("stem"))


@register("scan_multi_csv_flat")
def q_scan_multi_csv_flat(spark, sf):
    """One file per model, columns in another order and with one more: the flat layout."""
    root = scratch_dir(spark, "models-flat")
    rows = S.model_prediction_table(spark, sf)
    FS.write_named_csv(rows.select("model", F.lit("a, \"b\"").alias("note"), "y_pred", "doc_id", "y_true"), "model", root)
    return FS.read_prediction_files(spark, root, schema="doc_id long, y_true string, y_pred string")


@register("scan_checkpoints_flat")
def q_scan_checkpoints_flat(spark, sf):
    root = scratch_dir(spark, "checkpoints-flat")
    FS.write_named_csv(_named_checkpoints(spark, sf), "file", root)
    return FS.read_checkpoint_files(spark, root, "doc_id long, y_true string, y_pred string",
                                    expected=FS.EXPECTED_CHECKPOINTS[:S.CHECKPOINT_GROUPS])


def _prediction_csv(spark, sf):
    path = scratch_dir(spark, "predictions")
    S.prediction_table(spark, sf).write.mode("overwrite").option("header", True).csv(path)
    return path


@register("scan_csv")
def q_scan_csv(spark, sf):
    return FS.read_csv(spark, _prediction_csv(spark, sf), "doc_id long, y_true string, y_pred string")


@register("evaluate_file")
def q_evaluate_file(spark, sf):
    df = FS.read_csv(spark, _prediction_csv(spark, sf), "doc_id long, y_true string, y_pred string")
    return rounded(R.evaluate_predictions(df))


def _named_checkpoints(spark, sf):
    ck = S.checkpoint_prediction_table(spark, sf)
    name = F.when(F.col("checkpoint") == 0, F.lit(FS.BASE_CHECKPOINT_STEM)).otherwise(
        F.format_string(FS.CHECKPOINT_FILE_FORMAT.format(setting=FS.DECODING_SETTING, ckpt="%d").removesuffix(".csv"), F.col("checkpoint")))
    return ck.withColumn("file", name).drop("checkpoint")


def _checkpoint_files(spark, sf):
    return FS.write_partitioned_csv(_named_checkpoints(spark, sf), "file", scratch_dir(spark, "checkpoints"))


@register("scan_checkpoints")
def q_scan_checkpoints(spark, sf):
    root = _checkpoint_files(spark, sf)
    return FS.read_checkpoint_files(spark, root, "doc_id long, y_true string, y_pred string",
                                    expected=FS.EXPECTED_CHECKPOINTS[:S.CHECKPOINT_GROUPS], layout="partitioned")


@register("checkpoint_report_files")
def q_checkpoint_report_files(spark, sf):
    root = _checkpoint_files(spark, sf)
    ck = FS.read_checkpoint_files(spark, root, "doc_id long, y_true string, y_pred string", layout="partitioned")
    return rounded(R.checkpoint_report(ck))


@register("union_by_name")
def q_union_by_name(spark, sf):
    from leafwise.operators.reshape import union_by_name

    a = S.prediction_table(spark, sf)
    b = S.table(spark, sf, "documents").select("doc_id", "source")
    return union_by_name([a, b])


LOG_METRICS = ["reward", "rewards/correctness_rewards"]


@register("scan_log_json")
def q_scan_log_json(spark, sf):
    path = scratch_dir(spark, "log")
    ev = S.table(spark, sf, "events").select(
        F.col("event_id").alias("step"), F.col("value").alias("reward"),
        F.col("user_id").cast("double").alias("rewards/correctness_rewards"))
    ev.write.mode("overwrite").json(path)
    return FS.read_training_log(spark, path, LOG_METRICS).select(
        "step", F.col("reward"), F.col("`rewards/correctness_rewards`").alias("correctness"))


@register("scan_log_nested")
def q_scan_log_nested(spark, sf):
    """Trainer-state documents with a nested log: one file per run (here: hour), positions in log order."""
    path = scratch_dir(spark, "log-nested")
    ev = S.table(spark, sf, "events").withColumn("run", F.date_format("ts", "yyyyMMddHH"))
    entry = F.struct(F.col("event_id").alias("step"), F.col("value").alias("reward"),
                     F.col("user_id").cast("double").alias("rewards/correctness_rewards"))
    ev.groupBy("run").agg(F.sort_array(F.collect_list(entry)).alias("log_history")).write.partitionBy("run").json(path)
    return FS.read_training_log(spark, path, LOG_METRICS, multi_line=True).select(
        "pos", "step", "reward", F.col("`rewards/correctness_rewards`").alias("correctness"))


@register("sink_split_tables")
def q_sink_split_tables(spark, sf):
    """The model table of each split as a file of its own, with index; read back by name."""
    report = rounded(R.model_report(S.model_prediction_table(spark, sf)))
    schema = "`index` long, model string, Metric string, Score double"
    out = None
    for split in ("test", "val", "external"):
        path = scratch_dir(spark, f"split-{split}")
        rows = report.where(F.col("split") == split).select("model", "Metric", "Score")
        FS.write_csv(rows, path, index=True, order=["model", "Metric"])
        got = FS.read_csv(spark, path, schema).withColumn("split", F.lit(split))
        out = got if out is None else out.unionByName(got)
    return out


@register("sink_results_csv")
def q_sink_results_csv(spark, sf):
    path = scratch_dir(spark, "results")
    ctx = _context(spark, sf)
    names = _docs_by_id(spark, sf).select("id", F.md5("text").alias("SMILES"))
    SC.score_batch(ctx, names, save_path=path)
    schema = ", ".join(f"`{c}` string" for c in SC.RESULT_COLUMNS)
    return FS.read_csv(spark, path, schema, multi_line=True)


@register("sink_metrics_csv")
def q_sink_metrics_csv(spark, sf):
    path = scratch_dir(spark, "metrics")
    report = rounded(R.checkpoint_report(S.checkpoint_prediction_table(spark, sf)))
    FS.write_csv(report, path)
    schema = ("checkpoint int, n_samples long, valid_percent double, f1 double, precision double, "
              "recall double, auc double, specificity double")
    return FS.read_csv(spark, path, schema)


# --- streaming ----------------------------------------------------------------------


@register("checkpoint_report_stream")
def q_checkpoint_report_stream(spark, sf):
    from leafwise.streaming.checkpoints import start_checkpoint_report

    root = _checkpoint_files(spark, sf)
    out = scratch_dir(spark, "stream-report")
    q = start_checkpoint_report(spark, root, out, schema="doc_id long, y_true string, y_pred string",
                                layout="partitioned")
    q.awaitTermination()
    return rounded(spark.read.parquet(out))



@register("neighbor_context_forest")
def q_neighbor_context_forest(spark, sf):
    """The whole chain: embedding vectors → forest leaves → neighbours → properties."""
    emb = S.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("features"), (F.col("label") % 2).alias("label"))
    forest = FE.synthetic_forest(spark, FOREST_TREES, FOREST_DEPTH, 64)
    props = _neighbor_props(spark, sf)
    return SC.neighbor_context_from_features(emb.select("id", "features"), emb, forest, props, props)
