"""Scoring jobs: neighbour context per input row, then prompt → generate →
extract → seven-column result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwise.functions.text import extract_tag
from leafwise.operators.generate import batch_generate, build_prompt, template_generator_factory
from leafwise.operators.knn import knn_query_ref, neighbor_lookup

# The seven columns of the scored result, in order.
RESULT_COLUMNS = ["SMILES", "thinking", "prediction", "confidence_score", "rdkit_properties",
                  "similar_approved", "similar_unapproved"]


def neighbor_context(queries: DataFrame, reference: DataFrame, query_props: DataFrame, ref_props: DataFrame,
                     k: int = 5, key: str = "id", query_ids: DataFrame | None = None, **knn_kw) -> DataFrame:
    """Per query: its own property record and both neighbour lists, as JSON text.

    ``queries``: ``(id, leaves)``; ``reference``: ``(id, label, leaves)``;
    ``*_props``: ``(id, <property columns>)``.  One neighbour search serves
    both classes (the reference ran it once per class).
    """
    nb = knn_query_ref(queries.select(key, "leaves"), reference, k=k, **knn_kw)
    # one aggregation per query builds both lists (each at most k records)
    looked = neighbor_lookup(nb, ref_props, key=key)
    prop_cols = [c for c in ref_props.columns if c != key]
    rec = F.struct(F.col("rank"), F.struct(*prop_cols).alias("props"))

    def as_json(cls: int):
        items = F.sort_array(F.collect_list(F.when(F.col("cls") == cls, rec)))
        return F.to_json(F.transform(items, lambda x: x["props"]), {"ignoreNullFields": "false"})

    lists = looked.groupBy("qid").agg(as_json(1).alias("similar_approved"), as_json(0).alias("similar_unapproved"))
    own_cols = [c for c in query_props.columns if c != key]
    own = query_props.select(F.col(key).alias("qid"), F.to_json(F.struct(*own_cols), {"ignoreNullFields": "false"}).alias("rdkit_properties"))
    ids = (query_ids if query_ids is not None else queries).select(F.col(key).alias("qid"))
    return (
        ids.join(own, "qid", "left").join(lists, "qid", "left")
        .select(F.col("qid").alias(key), "rdkit_properties",
                F.coalesce("similar_approved", F.lit("[]")).alias("similar_approved"),
                F.coalesce("similar_unapproved", F.lit("[]")).alias("similar_unapproved"))
    )


def extract_answers(generated: DataFrame, text: str = "generated") -> DataFrame:
    """Three tagged fields, stripped and lower-cased; unreadable → ``n/a``.

    ``confidence_score`` stays text (as generated); ``confidence_value`` is
    its numeric reading (NULL when it is not a number).
    """
    return generated.withColumns({
        "thinking": extract_tag(text, "think"),
        "prediction": extract_tag(text, "label"),
        "confidence_score": extract_tag(text, "score"),
    }).withColumn("confidence_value", F.col("confidence_score").try_cast("double"))


def score_batch(context: DataFrame, names: DataFrame, key: str = "id", generator_factory=template_generator_factory,
                options: dict | None = None, save_path: str | None = None, **prompt_kw) -> DataFrame:
    """Context → prompt → generator → extraction → the seven result columns.

    ``names``: ``(id, SMILES)`` — the input string of each row.  The result
    keeps ``id`` so it can be joined back; with ``save_path`` the result is
    also written as CSV (header, no index).
    """
    prompted = build_prompt(context, {"features": "rdkit_properties", "approved": "similar_approved",
                                      "unapproved": "similar_unapproved"}, **prompt_kw)
    # the context columns ride through the generator: no second neighbour search
    gen = batch_generate(prompted, generator_factory, key=key, options=options,
                         keep=["rdkit_properties", "similar_approved", "similar_unapproved"])
    answers = extract_answers(gen)
    result = answers.join(names, key).select(key, *RESULT_COLUMNS)
    if save_path:
        from leafwise.session import scratch_dir
        from leafwise.sources.files import write_csv

        # one generation per row: the written rows are those returned
        kept = scratch_dir(result.sparkSession, "scored")
        result.write.parquet(kept)
        result = result.sparkSession.read.schema(result.schema).parquet(kept)
        write_csv(result.drop(key), save_path)
    return result


def neighbor_context_from_features(queries: DataFrame, reference: DataFrame, forest: DataFrame,
                                   query_props: DataFrame, ref_props: DataFrame, k: int = 5, key: str = "id",
                                   features: str = "features", label: str = "label", **knn_kw) -> DataFrame:
    """Feature vectors → forest leaf codes → neighbour context.

    ``queries``: ``(id, features)``; ``reference``: ``(id, features, label)``;
    ``forest``: node table.  The leaf encoding runs once per row of each
    side (not once per query and class, as the reference did).
    """
    from leafwise.operators.features import forest_leaves

    q_leaves = forest_leaves(queries.select(key, features), forest, id_col=key, features=features, as_array=True)
    r_leaves = forest_leaves(reference.select(key, features), forest, id_col=key, features=features, as_array=True)
    r_leaves = r_leaves.join(reference.select(key, label), key)  # ids and labels only
    # sizes of the raw inputs: counting the encoded sides would run the walk
    knn_kw.setdefault("sizes", (queries.count(), reference.count()))
    return neighbor_context(q_leaves, r_leaves, query_props, ref_props, k=k, key=key,
                            query_ids=queries.select(key), **knn_kw)
