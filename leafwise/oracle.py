"""Independent SQL (DuckDB dialect) for each registered query.

Written from the operator definitions, not from the Spark plans: the base
views re-derive the stand-in inputs from the raw tables.  Doubles are rounded
as ``round(x * 1e6) / 1e6`` on both sides.
"""

from __future__ import annotations

from leafwise.functions.text import STRIP_PATTERN
from leafwise.operators.features import TEXT_ALERTS
from leafwise.operators.generate import DEFAULT_SYSTEM_PROMPT, DEFAULT_USER_TEMPLATE

ORACLE: dict[str, str] = {}


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE) * 1e6) / 1e6"


PREDS = """preds AS (
  SELECT doc_id,
    CASE quality WHEN 1 THEN 'approved' WHEN 0 THEN 'unapproved' END AS y_true,
    CASE WHEN doc_id % 17 = 0 THEN 'n/a'
         WHEN 1 - toxic = 1 THEN 'approved' WHEN 1 - toxic = 0 THEN 'unapproved' END AS y_pred
  FROM labels)"""


def _file_value(c: str) -> str:
    return (f"CASE WHEN d.source = 'src0' THEN p.{c} WHEN p.{c} = 'approved' THEN '1' "
            f"WHEN p.{c} = 'unapproved' THEN '0' ELSE p.{c} END AS {c}")


MPREDS = PREDS + f""",
mpreds AS (
  SELECT d.source || ['_test', '_val', '_external'][CAST(p.doc_id % 3 AS INTEGER) + 1] AS model, p.doc_id,
    {_file_value('y_true')}, {_file_value('y_pred')}
  FROM preds p JOIN documents d ON p.doc_id = d.doc_id)"""

CPREDS = PREDS + """,
cpreds AS (SELECT CAST((doc_id % 29) * 500 AS INTEGER) AS checkpoint, doc_id, y_true, y_pred FROM preds)"""


def map_label(c: str) -> str:
    return f"CASE {c} WHEN 'unapproved' THEN 0 WHEN 'approved' THEN 1 END"


def to_binary(c: str) -> str:
    return (f"CASE WHEN {c} = 'approved' THEN 1 WHEN {c} = 'unapproved' THEN 0 "
            f"WHEN TRY_CAST({c} AS DOUBLE) = 1 THEN 1 WHEN TRY_CAST({c} AS DOUBLE) = 0 THEN 0 END")


def recode(c: str) -> str:
    return f"CASE WHEN {c} = 'approved' THEN 1.0 WHEN {c} = 'unapproved' THEN 0.0 ELSE TRY_CAST({c} AS DOUBLE) END"


HARD = CPREDS + f""",
hard AS (SELECT checkpoint, {map_label('y_true')} AS t, {map_label('y_pred')} AS p
         FROM cpreds WHERE y_pred IN ('approved', 'unapproved'))"""


def counts(src: str, keys: str) -> str:
    k = f"{keys}, " if keys else ""
    g = f" GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}
    CAST(count_if(t = 0 AND p = 0) AS BIGINT) AS tn, CAST(count_if(t = 0 AND p = 1) AS BIGINT) AS fp,
    CAST(count_if(t = 1 AND p = 0) AS BIGINT) AS fn, CAST(count_if(t = 1 AND p = 1) AS BIGINT) AS tp,
    CAST(count(*) AS BIGINT) AS n
  FROM {src}{g}"""


def metric_sql(policy: str) -> dict[str, str]:
    spec_undef = "NULL" if policy == "report" else "0.0"
    auc_undef = "0.0" if policy == "checkpoint" else "NULL"
    spec = f"CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE {spec_undef} END"
    if policy == "checkpoint":
        spec = f"CASE WHEN (tp + fn = 0 AND tp + fp = 0) OR (tn + fp = 0 AND tp + fp = n) THEN 0.0 ELSE {spec} END"
    return {
        "accuracy": "(tp + tn) / n",
        "precision": "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END",
        "recall": "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END",
        "f1": "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END",
        "specificity": spec,
        "npv": f"CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE {spec_undef} END",
        "auc": f"CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2 ELSE {auc_undef} END",
    }


def metric_select(policy: str, names) -> str:
    m = metric_sql(policy)
    return ", ".join(f"{r6(m[n])} AS {n}" for n in names)


ALL_METRICS = ("accuracy", "precision", "recall", "f1", "specificity", "npv", "auc")

# --- aggregations -------------------------------------------------------------

ORACLE["confusion_counts"] = f"WITH {HARD} {counts('hard', 'checkpoint')}"

for _n in ("accuracy", "precision", "recall", "f1", "specificity", "npv"):
    ORACLE[_n] = f"WITH {HARD}, c AS ({counts('hard', 'checkpoint')}) SELECT checkpoint, {metric_select('cli', [_n])} FROM c"

ORACLE["roc_auc"] = f"""WITH {CPREDS},
s AS (SELECT c.checkpoint, {map_label('c.y_true')} AS t, CAST(d.n_chars AS DOUBLE) AS score
      FROM cpreds c JOIN documents d ON c.doc_id = d.doc_id),
r AS (SELECT checkpoint, t,
        rank() OVER (PARTITION BY checkpoint ORDER BY score)
        + (count(*) OVER (PARTITION BY checkpoint, score) - 1) / 2.0 AS avg_rank
      FROM s WHERE t IN (0, 1)),
u AS (SELECT checkpoint, CAST(count_if(t = 1) AS BIGINT) AS n_pos, CAST(count_if(t = 0) AS BIGINT) AS n_neg,
        sum(avg_rank) FILTER (WHERE t = 1) AS rank_sum
      FROM r GROUP BY checkpoint)
SELECT checkpoint, n_pos, n_neg,
  {r6("CASE WHEN n_pos > 0 AND n_neg > 0 THEN (rank_sum - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) END")} AS auc
FROM u"""

ORACLE["evaluate_bundle"] = f"""WITH {PREDS},
h AS (SELECT CAST({recode('y_true')} AS INTEGER) AS t,
             CASE WHEN {recode('y_pred')} = 1 THEN 1 ELSE 0 END AS p FROM preds),
c AS ({counts('h', '')})
SELECT tn, fp, fn, tp, n, {metric_select('cli', ALL_METRICS)} FROM c"""

ORACLE["evaluate_safe"] = f"""WITH {HARD}, c AS ({counts('hard', 'checkpoint')})
SELECT checkpoint, tn, fp, fn, tp, n, {metric_select('checkpoint', ('precision', 'recall', 'f1', 'specificity', 'auc'))} FROM c"""

MODEL_HARD = MPREDS + f""",
mh AS (SELECT model, {to_binary('y_true')} AS t, coalesce({to_binary('y_pred')}, 0) AS p FROM mpreds)"""

SPLIT = ("CASE WHEN model LIKE '%\\_test' ESCAPE '\\' THEN 'test' WHEN model LIKE '%\\_val' ESCAPE '\\' THEN 'val' "
         "WHEN model LIKE '%\\_external' ESCAPE '\\' THEN 'external' END")

MODEL_METRICS = MODEL_HARD + f""",
mc AS ({counts('mh', 'model')}),
mm AS (SELECT model, tn, fp, fn, tp, n, {metric_select('report', ALL_METRICS)}, {SPLIT} AS split FROM mc)"""

ORACLE["metrics_by_model"] = f"WITH {MODEL_METRICS} SELECT * FROM mm"

CKPT_REPORT = CPREDS + f""",
v AS (SELECT checkpoint, {map_label('y_true')} AS t, {map_label('y_pred')} AS p
      FROM cpreds WHERE y_pred IN ('approved', 'unapproved')),
c AS (SELECT checkpoint,
        CAST(count_if(t = 0 AND p = 0) AS BIGINT) AS tn, CAST(count_if(t = 0 AND p = 1) AS BIGINT) AS fp,
        CAST(count_if(t = 1 AND p = 0) AS BIGINT) AS fn, CAST(count_if(t = 1 AND p = 1) AS BIGINT) AS tp,
        CAST(count(*) AS BIGINT) AS n, count_if(t IS NULL) AS null_truth
      FROM v GROUP BY checkpoint)"""

ORACLE["metrics_by_checkpoint"] = f"""WITH {CKPT_REPORT}
SELECT checkpoint, n AS n_samples, {metric_select('checkpoint', ('f1', 'precision', 'recall', 'auc', 'specificity'))}
FROM c WHERE null_truth = 0"""

ORACLE["checkpoint_report"] = f"""WITH {CKPT_REPORT}
SELECT checkpoint, n AS n_samples, {r6('n / 451.0 * 100.0')} AS valid_percent,
  {metric_select('checkpoint', ('f1', 'precision', 'recall', 'auc', 'specificity'))}
FROM c WHERE null_truth = 0"""

ORACLE["valid_percent"] = f"""WITH {CPREDS}
SELECT checkpoint, CAST(count(*) AS BIGINT) AS n_valid, {r6('count(*) / 451.0 * 100.0')} AS valid_y_pred
FROM cpreds WHERE y_pred IN ('approved', 'unapproved') GROUP BY checkpoint"""

ORACLE["confusion_by_model"] = f"""WITH {MODEL_HARD}, mc AS ({counts('mh', 'model')}),
cells AS (
  SELECT model, 0 AS true_label, 0 AS pred_label, tn AS count FROM mc UNION ALL
  SELECT model, 0, 1, fp FROM mc UNION ALL
  SELECT model, 1, 0, fn FROM mc UNION ALL
  SELECT model, 1, 1, tp FROM mc)
SELECT model, true_label, pred_label, count, replace(replace(model, '_test', ''), '_val', '') AS title FROM cells"""

STANDIN_ORDER_SQL = """CASE model
  WHEN 'src3_test' THEN 0 WHEN 'src1_test' THEN 1 WHEN 'src0_test' THEN 2 WHEN 'src7_test' THEN 3
  WHEN 'src3_val' THEN 0 WHEN 'src1_val' THEN 1 WHEN 'src0_val' THEN 2 WHEN 'src7_val' THEN 3
  WHEN 'src3_external' THEN 0 WHEN 'src1_external' THEN 1 WHEN 'src0_external' THEN 2 WHEN 'src7_external' THEN 3
END"""

REPORT_NAMES = [("auc", "AUC"), ("f1", "F1-score"), ("recall", "Recall (Sensitivity)"),
                ("specificity", "Specificity"), ("precision", "Precision")]

MODEL_REPORT = MODEL_METRICS + f""",
ranked AS (
  SELECT split, model,
    CAST(row_number() OVER (PARTITION BY split ORDER BY {STANDIN_ORDER_SQL} ASC NULLS LAST, model ASC) AS INTEGER) AS sort_rank,
    CASE WHEN split = 'external' THEN regexp_replace(model, '(_external)$', '')
         ELSE regexp_replace(model, '(_test|_val)$', '') END AS display_name,
    {", ".join(f'round_even({k}, 3) AS "{v}"' for k, v in REPORT_NAMES)}
  FROM mm WHERE split IS NOT NULL),
long AS (
  {" UNION ALL ".join(f"SELECT split, model, display_name, sort_rank, '{v}' AS \"Metric\", \"{v}\" AS \"Score\" FROM ranked" for _, v in REPORT_NAMES)})"""

ORACLE["model_report"] = f"""WITH {MODEL_REPORT}
SELECT split, model, display_name, sort_rank, "Metric", {r6('"Score"')} AS "Score",
  CAST(CASE "Metric" WHEN 'AUC' THEN 1 WHEN 'F1-score' THEN 2 WHEN 'Recall (Sensitivity)' THEN 3
       WHEN 'Specificity' THEN 4 WHEN 'Precision' THEN 5 END AS INTEGER) AS metric_rank
FROM long"""

ORACLE["mean_score"] = f"""WITH {MODEL_REPORT}
SELECT split, "Metric", display_name, {r6('avg("Score")')} AS mean_score FROM long GROUP BY split, "Metric", display_name """

ORACLE["custom_order"] = f"""WITH {MODEL_METRICS}
SELECT split, model, CAST(row_number() OVER (PARTITION BY split ORDER BY {STANDIN_ORDER_SQL} ASC NULLS LAST, model ASC) AS INTEGER) AS sort_rank
FROM mm"""

ORACLE["melt_metrics"] = f"""WITH {MODEL_METRICS}
{" UNION ALL ".join(f"SELECT model, '{v}' AS \"Metric\", {k} AS \"Score\" FROM mm" for k, v in REPORT_NAMES)}"""

ORACLE["ordered_category"] = f"""WITH {MODEL_METRICS}
SELECT model, "Metric", CAST(CASE "Metric" WHEN 'f1' THEN 1 WHEN 'auc' THEN 2 WHEN 'recall' THEN 3 END AS INTEGER) AS metric_rank
FROM (SELECT model, 'auc' AS "Metric" FROM mm UNION ALL SELECT model, 'f1' FROM mm UNION ALL SELECT model, 'accuracy' FROM mm)"""

ORACLE["round_metrics"] = f"""WITH {MODEL_HARD}, mc AS ({counts('mh', 'model')}),
mm AS (SELECT model, {", ".join(f"{metric_sql('report')[k]} AS {k}" for k in ('auc', 'f1', 'recall', 'specificity', 'precision'))} FROM mc)
SELECT model, {", ".join(f"round_even({k}, 3) AS {k}" for k in ('auc', 'f1', 'recall', 'specificity', 'precision'))} FROM mm"""

# --- scalar label functions ---------------------------------------------------

ORACLE["recode_labels"] = f"WITH {MPREDS} SELECT model, doc_id, {recode('y_true')} AS y_true, {recode('y_pred')} AS y_pred FROM mpreds"
ORACLE["map_labels"] = f"WITH {CPREDS} SELECT doc_id, {map_label('y_true')} AS t, {map_label('y_pred')} AS p FROM cpreds"
ORACLE["binarize_pred"] = f"WITH {MPREDS} SELECT model, doc_id, CASE WHEN {recode('y_pred')} = 1 THEN 1 ELSE 0 END AS p FROM mpreds"
ORACLE["filter_valid"] = f"WITH {CPREDS} SELECT * FROM cpreds WHERE y_pred IN ('approved', 'unapproved')"
ORACLE["route_split"] = f"WITH {MPREDS} SELECT model, doc_id, {SPLIT} AS split FROM mpreds"
ORACLE["strip_suffix"] = f"""WITH {MPREDS}
SELECT model, regexp_replace(model, '(_test|_val)$', '') AS test_val_name,
       regexp_replace(model, '(_external)$', '') AS external_name
FROM (SELECT DISTINCT model FROM mpreds)"""
ORACLE["replace_literal"] = f"""WITH {MPREDS}
SELECT model, replace(replace(model, '_test', ''), '_val', '') AS title FROM (SELECT DISTINCT model FROM mpreds)"""

# --- tagged text ------------------------------------------------------------------

STRIP_SQL = STRIP_PATTERN.replace("'", "''")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '{STRIP_SQL}', '', 'g')"


def tag(x: str, t: str) -> str:
    return f"coalesce(lower({strip(f'string_split(string_split({x}, {chr(39)}<{t}>{chr(39)})[-1], {chr(39)}</{t}>{chr(39)})[1]')}), 'n/a')"


GENERATED = """gen AS (
  SELECT conv_id * 1000 + turn AS id,
    CASE turn % 4
      WHEN 0 THEN '<think>' || text || '</think>' || chr(10) || '<label> ' || lbl || '</label>' || chr(10) || '<score>' || chr(9) || sc || chr(10) || '</score>'
      WHEN 1 THEN '<think>' || chr(10) || text || '</think>' || lbl || '</label><score>' || sc || '</score>'
      WHEN 2 THEN '<think>' || text || '</think><label>' || lbl || '</label><score> ' || sc
      ELSE text || ' ' || sc END AS text
  FROM (SELECT *, CASE WHEN length(text) % 2 = 0 THEN 'Approved' ELSE 'unapproved ' END AS lbl,
               printf('%.2f', (length(text) % 100) / 100.0) AS sc
        FROM conversations))"""

ORACLE["extract_tags"] = f"""WITH {GENERATED}
SELECT id, {tag('text', 'think')} AS thinking, {tag('text', 'label')} AS prediction, {tag('text', 'score')} AS confidence_score
FROM gen"""

ORACLE["strip_lower"] = f"SELECT conv_id, turn, lower({strip('text')}) AS text FROM conversations"


# --- nearest neighbours ---------------------------------------------------------

LEAVES = """leaves AS (
  SELECT vec_id AS id, CAST(label % 2 AS INTEGER) AS label,
         list_transform(embedding, lambda x: CAST(floor(x * 8) AS INTEGER)) AS leaves
  FROM embeddings)"""


def knn_sql(exclude_self: bool, k: int = 5, leaves_cte: str | None = None) -> str:
    cond = "q.id <> r.id" if exclude_self else "TRUE"
    return (leaves_cte or LEAVES) + f""",
pairs AS (
  SELECT q.id AS qid, r.label AS cls, r.id AS nid, len(q.leaves) AS width,
    list_sum(list_transform(range(1, len(q.leaves) + 1),
             lambda i: CASE WHEN q.leaves[i] <> r.leaves[i] THEN 1 ELSE 0 END)) AS cnt
  FROM leaves q JOIN leaves r ON {cond}),
nb AS (
  SELECT qid, CAST(cls AS INTEGER) AS cls, nid, cnt / width AS dist,
    CAST(row_number() OVER (PARTITION BY qid, cls ORDER BY cnt, nid) AS INTEGER) AS rank
  FROM pairs QUALIFY rank <= {k})"""


ORACLE["knn_leave_one_out"] = f"WITH {knn_sql(True)} SELECT qid, cls, rank, nid, {r6('dist')} AS dist FROM nb"
ORACLE["knn_query_ref"] = f"WITH {knn_sql(False)} SELECT qid, cls, rank, nid, {r6('dist')} AS dist FROM nb"
ORACLE["knn_index_leave_one_out"] = ORACLE["knn_leave_one_out"]
ORACLE["knn_index_query_ref"] = ORACLE["knn_query_ref"]
ORACLE["knn_repeated_vectors"] = ORACLE["knn_leave_one_out"].replace("FROM leaves q JOIN leaves r", "FROM short q JOIN short r", 1).replace(
    LEAVES, LEAVES + ",\nshort AS (SELECT id, label, list_slice(leaves, 1, 4) AS leaves FROM leaves)", 1)
ORACLE["hamming_pairs"] = ORACLE["knn_leave_one_out"]
ORACLE["class_partition"] = "SELECT vec_id AS id, CAST(label % 2 AS INTEGER) AS label, CAST(label % 2 AS INTEGER) AS cls FROM embeddings"
ORACLE["topk_per_group"] = """SELECT event_type, event_id, value,
  CAST(row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS INTEGER) AS rank
FROM events QUALIFY rank <= 5"""

PROPS = """props AS (
  SELECT doc_id AS nid, CAST(length(text) AS INTEGER) AS n_chars,
    CAST(len(regexp_extract_all(text, '[^ \t\n\r]+')) AS INTEGER) AS n_words,
    CAST(length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS INTEGER) AS n_digits
  FROM documents)"""

ORACLE["neighbor_lookup_one"] = f"""WITH {knn_sql(True)}, {PROPS}
SELECT nb.qid, nb.cls, nb.rank, nb.nid, {r6('nb.dist')} AS dist, p.n_chars, p.n_words, p.n_digits
FROM nb LEFT JOIN props p ON nb.nid = p.nid"""

ORACLE["neighbor_lookup"] = f"""WITH {knn_sql(True)}, {PROPS}
SELECT nb.qid, nb.cls,
  CAST(to_json(list({{'n_chars': p.n_chars, 'n_words': p.n_words, 'n_digits': p.n_digits}} ORDER BY nb.rank)) AS VARCHAR) AS records
FROM nb LEFT JOIN props p ON nb.nid = p.nid GROUP BY nb.qid, nb.cls"""

ORACLE["neighbor_lists"] = f"""WITH {knn_sql(True)}
SELECT l.id AS qid,
  coalesce(string_agg(CAST(nb.nid AS VARCHAR), ',' ORDER BY nb.rank) FILTER (WHERE nb.cls = 1), '') AS approved_neighbors,
  coalesce(string_agg(CAST(nb.nid AS VARCHAR), ',' ORDER BY nb.rank) FILTER (WHERE nb.cls = 0), '') AS unapproved_neighbors
FROM leaves l LEFT JOIN nb ON l.id = nb.qid GROUP BY l.id"""


# --- series -----------------------------------------------------------------------

ORACLE["ema"] = f"""WITH RECURSIVE s AS (
  SELECT event_type AS series, event_id AS seq, CAST(value AS DOUBLE) AS value,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i
  FROM events),
e(series, i, seq, value, ema) AS (
  SELECT series, i, seq, value, value FROM s WHERE i = 0
  UNION ALL
  SELECT s.series, s.i, s.seq, s.value, 0.05 * s.value + (1 - 0.05) * e.ema
  FROM e JOIN s ON s.series = e.series AND s.i = e.i + 1)
SELECT series, seq, {r6('value')} AS value, {r6('ema')} AS ema FROM e"""

ORACLE["reward_series"] = f"""WITH RECURSIVE s AS (
  SELECT metric, label, event_id, raw, row_number() OVER (PARTITION BY metric ORDER BY ts, event_id) - 1 AS i
  FROM (SELECT ts, event_id, 'value' AS metric, 'Event value' AS label, CAST(value AS DOUBLE) AS raw FROM events
        UNION ALL
        SELECT ts, event_id, 'user_id', 'User id', CAST(user_id AS DOUBLE) FROM events)),
e(metric, label, i, event_id, raw, smoothed) AS (
  SELECT metric, label, i, event_id, raw, raw FROM s WHERE i = 0
  UNION ALL
  SELECT s.metric, s.label, s.i, s.event_id, s.raw, 0.05 * s.raw + (1 - 0.05) * e.smoothed
  FROM e JOIN s ON s.metric = e.metric AND s.i = e.i + 1)
SELECT metric, label, event_id, {r6('raw')} AS raw, {r6('smoothed')} AS smoothed FROM e"""


# --- features ---------------------------------------------------------------------

ORACLE["masked_mean_pool"] = f"""WITH t AS (
  SELECT CAST(label AS BIGINT) AS id, CASE WHEN vec_id % 3 <> 0 THEN 1.0 ELSE 0.0 END AS m,
         unnest(embedding) AS v, unnest(range(0, len(embedding))) AS dim
  FROM embeddings)
SELECT id, CAST(dim AS INTEGER) AS dim, {r6('sum(CAST(v AS DOUBLE) * m) / greatest(sum(m), 1e-9)')} AS value
FROM t GROUP BY id, dim"""

ORACLE["embed_text"] = f"""WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS word FROM documents),
c AS (SELECT doc_id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 64 AS dim, count(*) AS n FROM w GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(r.dim AS INTEGER) AS dim, {r6("coalesce(c.n, 0) / coalesce(t.total, 1)")} AS value
FROM documents d CROSS JOIN (SELECT unnest(range(0, 64)) AS dim) r
LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN c ON d.doc_id = c.doc_id AND r.dim = c.dim
WHERE d.text IS NOT NULL"""

ORACLE["pattern_catalog_large"] = """WITH b AS (SELECT regexp_extract_all(text, '[A-Za-z0-9]+') AS w FROM benchmark),
p AS (SELECT w, unnest(range(1, len(w))) AS i FROM b),
cat AS (SELECT DISTINCT w[i] AS a, w[i + 1] AS b FROM p),
hit AS (
  SELECT d.doc_id, cat.a || ' ' || cat.b AS name FROM documents d JOIN cat
  ON contains(d.text, cat.a) AND contains(d.text, cat.b) AND regexp_matches(d.text, cat.a || '[ ,.]+' || cat.b)),
g AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n_matches, string_agg(name, ';' ORDER BY name) AS matches FROM hit GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(matches, '') AS matches
FROM documents d LEFT JOIN g USING (doc_id)"""

_T, _D, _NF = 16, 4, 64
_NODES = 2 ** (_D + 1) - 1
_INTERNAL = 2 ** _D - 1
_walk = "0"
for _ in range(_D):
    _walk = f"""CASE WHEN ({_walk}) >= {_INTERNAL} THEN ({_walk})
      WHEN embedding[(t * 5 + ({_walk}) * 3) % {_NF} + 1] < (({_walk}) % 5 - 2) / 20.0 THEN ({_walk}) * 2 + 1
      ELSE ({_walk}) * 2 + 2 END"""
ORACLE["forest_leaves"] = f"""SELECT vec_id AS id, CAST(t AS INTEGER) AS tree, CAST(leaf AS INTEGER) AS leaf FROM (
  SELECT vec_id, t, {_walk} AS leaf
  FROM embeddings, (SELECT range AS t FROM range({_T})) trees)"""


ORACLE["forest_leaves_small"] = f"SELECT * FROM ({ORACLE['forest_leaves']}) WHERE tree < 5"

_alerts = ", ".join(
    f"CASE WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN '{d}' END" for d, p, _ in TEXT_ALERTS)
ORACLE["pattern_catalog_match"] = f"""WITH a AS (SELECT doc_id, list_filter([{_alerts}], lambda x: x IS NOT NULL) AS alerts FROM documents)
SELECT doc_id, CAST(len(alerts) AS INTEGER) AS n_alerts,
  CASE WHEN len(alerts) = 0 THEN 'None' ELSE array_to_string(alerts, '; ') END AS alerts
FROM a"""

_FEATS = """CAST(length(text) AS INTEGER) AS n_chars,
    CAST(len(regexp_extract_all(text, '[^ \t\n\r]+')) AS INTEGER) AS n_words,
    CAST(length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS INTEGER) AS n_digits"""
ORACLE["featurize_distinct"] = f"SELECT md5(text) AS text_md5, {_FEATS} FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)"
ORACLE["featurize_hook"] = f"SELECT doc_id, {_FEATS} FROM documents"


# --- prompts, generation, scoring ------------------------------------------------



def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _template_sql(fields: dict[str, str]) -> str:
    import re as _re

    parts, pos = [], 0
    for m in _re.finditer(r"\{(\w+)\}", DEFAULT_USER_TEMPLATE):
        if m.start() > pos:
            parts.append(_lit(DEFAULT_USER_TEMPLATE[pos:m.start()]))
        parts.append(f"coalesce(CAST({fields[m.group(1)]} AS VARCHAR), '')")
        pos = m.end()
    if pos < len(DEFAULT_USER_TEMPLATE):
        parts.append(_lit(DEFAULT_USER_TEMPLATE[pos:]))
    return " || ".join(parts)


CONTEXT = knn_sql(False) + ", " + PROPS + """,
recs AS (
  SELECT nb.qid, nb.cls,
    CAST(to_json(list({'n_chars': p.n_chars, 'n_words': p.n_words, 'n_digits': p.n_digits} ORDER BY nb.rank)) AS VARCHAR) AS records
  FROM nb LEFT JOIN props p ON nb.nid = p.nid GROUP BY nb.qid, nb.cls),
ctx AS (
  SELECT l.id,
    CASE WHEN p.nid IS NOT NULL
         THEN CAST(to_json({'n_chars': p.n_chars, 'n_words': p.n_words, 'n_digits': p.n_digits}) AS VARCHAR) END AS rdkit_properties,
    coalesce(max(CASE WHEN r.cls = 1 THEN r.records END), '[]') AS similar_approved,
    coalesce(max(CASE WHEN r.cls = 0 THEN r.records END), '[]') AS similar_unapproved
  FROM leaves l LEFT JOIN props p ON l.id = p.nid LEFT JOIN recs r ON l.id = r.qid
  GROUP BY l.id, p.nid, p.n_chars, p.n_words, p.n_digits)"""

ORACLE["neighbor_context"] = f"WITH {CONTEXT} SELECT * FROM ctx"

ORACLE["build_prompt"] = f"""SELECT conv_id * 1000 + turn AS id, 2 AS n_messages,
  'system' AS system_role, {_lit(DEFAULT_SYSTEM_PROMPT)} AS system_content,
  'user' AS user_role, {_template_sql({'features': 'text', 'approved': 'text', 'unapproved': 'text'})} AS user_content
FROM conversations"""

_GEN_TEXT = ("'<think>' || chr(10) || 'user message of ' || CAST(n AS VARCHAR) || ' characters' || chr(10) || '</think>' || chr(10) "
             "|| '<label>' || chr(10) || CASE WHEN n % 2 = 0 THEN 'approved' ELSE 'unapproved' END || chr(10) || '</label>' || chr(10) "
             "|| '<score>' || chr(10) || printf('%.2f', (n % 100) / 100.0) || chr(10) || '</score>'")

ORACLE["batch_generate"] = f"""SELECT id, {_GEN_TEXT} AS generated FROM (
  SELECT conv_id * 1000 + turn AS id,
    length({_template_sql({'features': 'text', 'approved': 'text', 'unapproved': 'text'})}) AS n
  FROM conversations)"""

ORACLE["batch_generate_resumed"] = ORACLE["batch_generate"]

SCORED = CONTEXT + f""",
scored AS (
  SELECT c.*, md5(d.text) AS "SMILES",
    length({_template_sql({'features': 'c.rdkit_properties', 'approved': 'c.similar_approved', 'unapproved': 'c.similar_unapproved'})}) AS n
  FROM ctx c JOIN documents d ON c.id = d.doc_id),
gen AS (SELECT *, {_GEN_TEXT} AS generated FROM scored)"""

ORACLE["score_batch"] = f"""WITH {SCORED}
SELECT id, "SMILES", {tag('generated', 'think')} AS thinking, {tag('generated', 'label')} AS prediction,
  {tag('generated', 'score')} AS confidence_score, rdkit_properties, similar_approved, similar_unapproved
FROM gen"""

ORACLE["assemble_results"] = f"""WITH {SCORED}
SELECT "SMILES", {tag('generated', 'think')} AS thinking, {tag('generated', 'label')} AS prediction,
  {tag('generated', 'score')} AS confidence_score, rdkit_properties, similar_approved, similar_unapproved
FROM gen"""
ORACLE["sink_results_csv"] = ORACLE["assemble_results"]

# --- files ------------------------------------------------------------------------

ORACLE["scan_train"] = "SELECT vec_id AS id, label FROM embeddings"
ORACLE["scan_multi_csv"] = f"WITH {MPREDS} SELECT model, doc_id, y_true, y_pred FROM mpreds"
ORACLE["file_stem"] = f"WITH {MPREDS} SELECT doc_id, model AS stem FROM mpreds"
ORACLE["scan_csv"] = f"WITH {PREDS} SELECT doc_id, y_true, y_pred FROM preds"
ORACLE["evaluate_file"] = ORACLE["evaluate_bundle"]
ORACLE["scan_checkpoints"] = f"WITH {CPREDS} SELECT checkpoint, doc_id, y_true, y_pred FROM cpreds"
ORACLE["checkpoint_report_files"] = ORACLE["checkpoint_report"]
ORACLE["union_by_name"] = f"""WITH {PREDS}
SELECT doc_id, y_true, y_pred, NULL::VARCHAR AS source FROM preds
UNION ALL SELECT doc_id, NULL, NULL, source FROM documents"""
ORACLE["scan_log_json"] = "SELECT event_id AS step, value AS reward, CAST(user_id AS DOUBLE) AS correctness FROM events"
ORACLE["sink_metrics_csv"] = f"""WITH {CKPT_REPORT}
SELECT checkpoint, n AS n_samples,
  {r6('n / 451.0 * 100.0')} AS valid_percent,
  {metric_select('checkpoint', ('f1', 'precision', 'recall', 'auc', 'specificity'))}
FROM c WHERE null_truth = 0"""
ORACLE["scan_multi_csv_flat"] = ORACLE["scan_multi_csv"]
ORACLE["scan_checkpoints_flat"] = ORACLE["scan_checkpoints"]
ORACLE["scan_log_nested"] = """SELECT CAST(row_number() OVER (PARTITION BY strftime(ts, '%Y%m%d%H') ORDER BY event_id) - 1 AS INTEGER) AS pos,
  event_id AS step, value AS reward, CAST(user_id AS DOUBLE) AS correctness FROM events"""
ORACLE["sink_split_tables"] = f"""WITH rep AS ({ORACLE["model_report"]})
SELECT CAST(row_number() OVER (PARTITION BY split ORDER BY model, "Metric") - 1 AS BIGINT) AS "index", model, "Metric", "Score", split
FROM rep"""
ORACLE["forest_export"] = "SELECT vec_id AS id, true AS agrees, true AS all_trees FROM embeddings"

ORACLE["checkpoint_report_stream"] = ORACLE["checkpoint_report"]


FOREST_LEAVES = f"""leaves AS (
  SELECT id, label, list(leaf ORDER BY tree) AS leaves FROM (
    SELECT e.vec_id AS id, CAST(e.label % 2 AS INTEGER) AS label, f.tree, f.leaf
    FROM embeddings e JOIN ({ORACLE["forest_leaves"]}) f ON e.vec_id = f.id)
  GROUP BY id, label)"""

ORACLE["neighbor_context_forest"] = "WITH " + CONTEXT.replace(knn_sql(False), knn_sql(False, leaves_cte=FOREST_LEAVES), 1) + " SELECT * FROM ctx"
