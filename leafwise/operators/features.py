"""Feature jobs: text features per distinct key, pattern catalogues, masked
pooling, forest leaf encoding, batch embedding and forest fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word = maximal run of characters other than space, tab, CR, LF (a class
# that Java regex and RE2 read the same way).
WORD_PATTERN = r"[^ \t\n\r]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_feature_columns(text: str = "text") -> dict[str, Column]:
    t = _col(text)
    return {
        "n_chars": F.length(t).cast("int"),
        "n_words": F.size(F.regexp_extract_all(t, F.lit(WORD_PATTERN), 0)).cast("int"),
        "n_digits": (F.length(t) - F.length(F.regexp_replace(t, "[0-9]", ""))).cast("int"),
    }


def text_features(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, n_chars, n_words, n_digits)`` per row (native expressions)."""
    return df.select(key, *[c.alias(n) for n, c in text_feature_columns(text).items()])


def featurize_distinct(df: DataFrame, text: str = "text") -> DataFrame:
    """``(text_md5, <features>)``: one row per distinct text.

    The native features are cheap per-row expressions, so they are computed
    map-side and only the 128-bit text digest and the feature values are
    shuffled for the de-duplication — never the texts.  A text repeated by a
    third of all rows collapses in the map-side partial dedup.
    """
    keyed = df.where(F.col(text).isNotNull()).select(
        F.md5(F.col(text)).alias("text_md5"), *[c.alias(n) for n, c in text_feature_columns(text).items()])
    return keyed.dropDuplicates(["text_md5"])


def featurize(df: DataFrame, key: str, fn=None, schema: str | None = None, mode: str = "failfast",
              rejects: list | None = None) -> DataFrame:
    """Per-distinct-key feature job: dedupe, compute once, join back by key.

    Without ``fn`` the native text features are plain column expressions
    (no shuffle).  ``fn`` is an optional pandas hook ``(pd.Series of keys) -> pd.DataFrame``
    of the declared ``schema`` (row-aligned), run through ``mapInPandas``
    once per Arrow batch over the distinct keys.  Its output is written once,
    with a status, so both what is kept and what is rejected come from one
    evaluation.  Keys meet by a 128-bit digest and travel once, to the hook;
    a key that many rows share is joined by broadcast.

    ``mode='failfast'`` lets the hook's exception stop the job.
    ``mode='quarantine'`` keeps rows whose hook output is all-NULL, or whose
    key makes the hook raise, out of the result and, if ``rejects`` is a
    list, appends a DataFrame ``(key, reason)`` of them to it.  A NULL key
    has no features: NULL columns, or left out under quarantine.
    """
    if fn is None:
        # native features: a projection, no de-duplication or join needed
        return df.withColumns(text_feature_columns(key))
    if mode not in ("failfast", "quarantine"):
        raise ValueError("mode must be 'failfast' or 'quarantine'")
    from pyspark.sql.types import StructType

    from leafwise.operators.scan import attach
    from leafwise.session import scratch_dir

    spark = df.sparkSession
    out_schema = StructType.fromDDL(schema)
    names = out_schema.fieldNames()
    quarantine = mode == "quarantine"
    keyed = df.withColumn("__digest", F.md5(F.col(key).cast("string").cast("binary")))
    distinct = keyed.where(F.col(key).isNotNull()).groupBy("__digest").agg(F.first(key).alias("__key"), F.count(F.lit(1)).alias("__rows"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            reason = None
            try:
                res = fn(pdf["__key"]).reset_index(drop=True)
            except Exception:                 # the batch holds a bad key: find it
                if not quarantine:
                    raise
                res, reason = _one_by_one(fn, pdf["__key"], names)
            out = pd.concat([pdf.reset_index(drop=True), res[names]], axis=1)
            out["__status"] = [None] * len(out) if reason is None else reason
            yield out

    more = "`__digest` string, `__key` " + distinct.schema["__key"].dataType.simpleString() + ", `__rows` long"
    path = scratch_dir(spark, "features")
    distinct.mapInPandas(run, f"{more}, {schema}, `__status` string").write.parquet(path)
    feats = spark.read.parquet(path)
    if quarantine:
        empty = F.lit(True)
        for n in names:
            empty = empty & F.col(f"`{n}`").isNull()
        status = F.coalesce("__status", F.when(empty, F.lit("no output")))
        if rejects is not None:
            rejects.append(feats.where(status.isNotNull()).select(F.col("__key").alias(key), status.alias("reason")))
        feats = feats.where(status.isNull())
    feats = feats.drop("__key", "__status")
    joined = attach(keyed, feats, "__digest", "__rows", "inner" if quarantine else "left")
    return joined.select(*df.columns, *names)


def _one_by_one(fn, keys, names: list[str]):
    """The hook on each key alone: its output, NULL where it raises, and the reason why."""
    import pandas as pd

    rows, reasons = [], []
    for i in range(len(keys)):
        try:
            rows.append(fn(keys.iloc[i : i + 1]).reset_index(drop=True)[names])
            reasons.append(None)
        except Exception as e:  # noqa: BLE001 - the reason is reported with the key
            rows.append(pd.DataFrame([[None] * len(names)], columns=names))
            reasons.append(f"{type(e).__name__}: {e}")
    return pd.concat(rows, ignore_index=True), reasons


def pandas_text_features(texts):
    """The native text features computed in pandas (a hook for :func:`featurize`)."""
    import pandas as pd

    s = texts.astype("string")
    return pd.DataFrame({
        "n_chars": s.str.len().astype("int32"),
        "n_words": s.str.count(r"[^ \t\n\r]+").astype("int32"),
        "n_digits": s.str.count(r"[0-9]").astype("int32"),
    })


PANDAS_TEXT_SCHEMA = "n_chars int, n_words int, n_digits int"


# --- SMILES text expressions -----------------------------------------------

# Fixed value: atom tokens of SMILES text (bracket atoms, two-letter organic
# atoms first, then one-letter and aromatic organic atoms).
SMILES_ATOM_PATTERN = r"\[[^\]]+\]|Cl|Br|[BCNOPSFI]|[bcnops]"
# Fixed value: a bracket atom whose element is hydrogen (not heavy).
SMILES_HYDROGEN_PATTERN = r"^\[[0-9]*H([^a-z].*)?\]$"


def smiles_atoms(c) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(SMILES_ATOM_PATTERN), 0)


def smiles_heavy_atoms(c) -> Column:
    """Number of non-hydrogen atoms written in a SMILES string (text level)."""
    return F.size(F.filter(smiles_atoms(c), lambda t: ~t.rlike(SMILES_HYDROGEN_PATTERN))).cast("int")


def smiles_formal_charge(c) -> Column:
    """Sum of the charges written in bracket atoms (``+``, ``++``, ``+3``, ``-``…)."""

    def charge(t):
        signs = F.regexp_extract(t, r"^\[[^+\-]*([+-]+)([0-9]*)", 1)
        digits = F.regexp_extract(t, r"^\[[^+\-]*([+-]+)([0-9]*)", 2)
        mag = F.when(digits == "", F.length(signs)).otherwise(digits.cast("int"))
        sign = F.when(F.substring(signs, 1, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
        return F.when(signs == "", F.lit(0)).otherwise(sign * mag)

    brackets = F.filter(smiles_atoms(c), lambda t: t.startswith("["))
    return F.aggregate(F.transform(brackets, charge), F.lit(0), lambda a, b: a + b).cast("int")


# --- pattern catalogue --------------------------------------------------------

# Our text alert catalogue (description, pattern, literals).
# Patterns use only syntax Java regex and RE2 read identically: no \b, no
# \s/\w, no (?i).  Matching is "occurs anywhere", so a leading run such as
# the local part of an e-mail address is reduced to one character (same
# answer, no backtracking over long tokens).  ``literals``: substrings any
# match must contain — a cheap ``contains`` test that runs before the regex.
TEXT_ALERTS = [
    ("email address", r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)*[.][A-Za-z]{2,}", ("@",)),
    ("web link", r"https?://[^ \t\n\r]+", ("://",)),
    ("ipv4 address", r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", (".",)),
    ("phone number", r"[+][0-9]{1,3}[ -]?([(][0-9]{2,4}[)]|[0-9]{2,4})[ -]?[0-9]{3}[ -]?[0-9]{3,4}", ("+",)),
    ("long digit run", r"[0-9]{12,}", ()),
    ("secret token", r"(token|secret|password|api_key|apikey)[ ]*[=:][ ]*[\"']?[A-Za-z0-9_-]{16,}",
     ("token", "secret", "password", "api_key", "apikey")),
    ("aws key id", r"AKIA[0-9A-Z]{16}", ("AKIA",)),
    ("license text", r"(Licensed under|License|LICENSE|Copyright|copyright|SPDX-License-Identifier)",
     ("icense", "ICENSE", "opyright", "SPDX")),
    ("repeated punctuation", r"[!?.]{4,}", ()),
    ("html markup", r"<[A-Za-z/][^<>]*>", ("<",)),
]


def catalog_matches(c, catalog=TEXT_ALERTS) -> Column:
    """Descriptions of every catalogue entry whose pattern occurs in the text.

    A fixed catalogue becomes one array expression (no join, no shuffle);
    an empty array means no alert.  Literal prefilters short-circuit the
    regex for texts that cannot match.
    """
    t = _col(c)
    hits = []
    for entry in catalog:
        d, p = entry[0], entry[1]
        literals = entry[2] if len(entry) > 2 else ()
        cond = t.rlike(p)
        if literals:
            pre = None
            for lit in literals:
                pre = t.contains(lit) if pre is None else (pre | t.contains(lit))
            cond = pre & cond
        hits.append(F.when(cond, F.lit(d)))
    return F.array_compact(F.array(*hits))


#: Entries of a catalogue that is shipped to every worker, at most.
CATALOG_LIMIT = 200_000


def catalog_search(df: DataFrame, catalog: DataFrame, text: str = "text", out: str = "matches") -> DataFrame:
    """``df`` plus ``out``: names of the entries of a large catalogue that occur in each text, sorted.

    ``catalog``: (name, pattern, literals array<string>); every match of a
    pattern must contain one of its literals, an entry without literals is
    tried on every text.  Patterns of two words with a run of separators
    between them (``a[ ,.]+b``) are found by an automaton over the text with
    every run made one separator, however many there are; of the others, an
    automaton over all literals reads a text once and only the patterns whose
    literal was met are then searched.  Patterns are
    searched anywhere in the text and should use syntax that all engines
    read alike.  The catalogue is a model, not data: its size is checked and
    it is broadcast.  NULL text has NULL matches; a NULL pattern matches
    nothing.
    """
    from pyspark.sql.types import ArrayType, StringType, StructField, StructType

    rows = catalog.where("pattern is not null").select("name", "pattern", "literals").limit(CATALOG_LIMIT + 1).collect()
    if len(rows) > CATALOG_LIMIT:
        raise ValueError(f"a catalogue of more than {CATALOG_LIMIT} entries is not a catalogue: join it as a table")
    entries = df.sparkSession.sparkContext.broadcast([(r["name"], r["pattern"], [x for x in r["literals"] or [] if x]) for r in rows])
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(StringType()))])

    def run(batches):
        matcher = _matcher(entries.value)
        for batch in batches:
            import pyarrow as pa

            found = [None if t is None else matcher(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


#: Two words (letters and digits) and one or more of some separators between them.
WORD_PAIR = r"([A-Za-z0-9]+)\[([ ,.;:!?/_]+)\]\+([A-Za-z0-9]+)"


def _automaton(entries: dict):
    """Automaton of strings and what each stands for."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for key, of in entries.items():
        automaton.add_word(key, of)
    automaton.make_automaton()
    return automaton


def _matcher(entries: list):
    """Names of all entries that occur in a text: word pairs and literals by automata, of the latter then their patterns."""
    import re

    always = []
    literals: dict[str, list[int]] = {}
    # by separators: "a b" for a pattern a[separators]+b, and its names
    pairs: dict[str, dict[str, list[str]]] = {}
    for i, (name, pattern, needed) in enumerate(entries):
        form = re.fullmatch(WORD_PAIR, pattern)
        # a literal that is no part of either word is a condition of its own
        if form and (not needed or any(x in form[1] or x in form[3] for x in needed)):
            separators = "".join(sorted(set(form[2])))
            pairs.setdefault(separators, {}).setdefault(form[1] + separators[0] + form[3], []).append(name)
            continue
        if not needed:
            always.append(i)
        for literal in needed:
            literals.setdefault(literal, []).append(i)
    met_by = _automaton(literals) if literals else None
    runs = [(re.compile(f"[{re.escape(x)}]+"), x[0], _automaton(of)) for x, of in pairs.items()]
    compiled: dict[int, re.Pattern] = {}      # a pattern is compiled when its literal is first met

    def search(text: str) -> list[str]:
        met = set(always)
        if met_by is not None:
            for _, hits in met_by.iter(text):
                met.update(hits)
        names = set()
        for run, separator, automaton in runs:
            # words hold no separators, so a pair matches where it stands once every run is one separator
            for _, hits in automaton.iter(run.sub(separator, text)):
                names.update(hits)
        for i in met:
            if i not in compiled:
                compiled[i] = re.compile(entries[i][1], re.ASCII)
            if compiled[i].search(text):
                names.add(entries[i][0])
        return sorted(names)

    return search


def pool(rows: DataFrame, by: str, vector: Column, weight: Column) -> DataFrame:
    """``(by, pooled array<double>)``: sum of vectors over sum of weights (at least 1e-9), per group.

    One buffer of the vector's length per group and task (``Summarizer``,
    combined before the shuffle): a group of any size sends one row per task.
    """
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    parts = rows.select(F.col(by), vector.alias("__v"), weight.alias("__w")).where("__v is not null")
    sums = parts.groupBy(by).agg(Summarizer.sum(F.col("__v")).alias("__s"), F.sum("__w").alias("__n"))
    total = F.greatest(F.col("__n"), F.lit(1e-9))
    return sums.select(by, F.transform(vector_to_array("__s"), lambda x: x / total).alias("pooled"))


def masked_mean_pool(tokens: DataFrame, id_col: str = "id", vec: str = "vec", mask: str = "mask",
                     as_array: bool = False) -> DataFrame:
    """Per sequence and dimension: ``Σ v·m / max(Σ m, 1e-9)``.

    Vectors are added up whole, see :func:`pool`; all vectors must have one
    length.  A NULL vector is no token, a NULL component counts as 0, a NULL
    mask masks its token.  ``as_array=True`` gives ``(id, pooled array<double>)``,
    else one row per dimension.
    """
    from pyspark.ml.functions import array_to_vector

    m = F.coalesce(F.col(mask).cast("double"), F.lit(0.0))
    weighted = array_to_vector(F.transform(vec, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)) * m))
    pooled = pool(tokens.where(F.col(vec).isNotNull()), id_col, weighted, m)
    if as_array:
        return pooled
    return pooled.select(id_col, F.posexplode("pooled").alias("dim", "value"))


# --- forest leaf encoding ------------------------------------------------------


def synthetic_forest(spark, trees: int, depth: int, n_features: int) -> DataFrame:
    """A node table ``(tree, node, feature, threshold, left, right)`` built by
    rule: complete binary trees, heap-numbered nodes, leaves have NULL feature.

    Internal node ``n`` of tree ``t`` splits feature ``(5t + 3n) % n_features``
    at ``((n % 5) - 2) / 20``.
    """
    n_nodes = 2 ** (depth + 1) - 1
    n_internal = 2**depth - 1
    nodes = spark.range(trees * n_nodes).select(
        (F.col("id") / n_nodes).cast("int").alias("tree"), (F.col("id") % n_nodes).cast("int").alias("node"))
    internal = F.col("node") < n_internal
    return nodes.select(
        "tree", "node",
        F.when(internal, ((F.col("tree") * 5 + F.col("node") * 3) % n_features).cast("int")).alias("feature"),
        F.when(internal, ((F.col("node") % 5) - 2) / 20.0).alias("threshold"),
        F.when(internal, F.col("node") * 2 + 1).cast("int").alias("left"),
        F.when(internal, F.col("node") * 2 + 2).cast("int").alias("right"),
    )


# How a forest is walked follows from its size; the result is the same.  Up to
# EXPRESSION_NODES nodes it is a column expression (the JVM compiles generated
# methods up to 8,000 bytes, about 50 go on a node); up to NUMPY_NODE_LIMIT
# nodes the table is shipped to Python workers (about 40 bytes a node); a
# larger one stays a table and is walked by joins.
EXPRESSION_NODES = 160
NUMPY_NODE_LIMIT = 5_000_000
NODE_COLUMNS = ["tree", "node", "feature", "threshold", "left", "right"]


def _node_table(forest: DataFrame) -> DataFrame:
    """The node columns, with ``missing_left`` (where NULL and NaN go; right unless the table says so)."""
    says = F.coalesce(F.col("missing_left"), F.lit(False)) if "missing_left" in forest.columns else F.lit(False)
    return forest.select(*NODE_COLUMNS, says.alias("missing_left"))


def _walk_expression(rows: DataFrame, forest: DataFrame, id_col: str, features: str, as_array: bool) -> DataFrame:
    """Every tree as nested conditions over the features: no Python worker and no shuffle."""
    nodes: dict[int, dict[int, object]] = {}
    for r in _node_table(forest).collect():
        nodes.setdefault(r["tree"], {})[r["node"]] = r

    # a missing feature becomes NaN, which is greater than every number and so goes right by itself
    used = sorted({n["feature"] for tree in nodes.values() for n in tree.values() if n["feature"] is not None})
    value = lambda f: F.coalesce(F.get(F.col(features), F.lit(f)).cast("double"), F.lit(float("nan")))
    known = rows.select(id_col, *[value(f).alias(f"__x{f}") for f in used])

    def leaf(tree: dict, at: int) -> Column:
        n = tree[at]
        if n["feature"] is None:
            return F.lit(at)
        x = F.col(f"__x{n['feature']}")
        left = x < F.lit(n["threshold"])
        return F.when(F.isnan(x) | left if n["missing_left"] else left, leaf(tree, n["left"])).otherwise(leaf(tree, n["right"]))

    trees = sorted(nodes)
    leaves = [leaf(nodes[t], 0).cast("int") for t in trees]
    if as_array:
        return known.select(id_col, F.array(*leaves).alias("leaves"))
    pairs = F.array(*[F.struct(F.lit(t).cast("int").alias("tree"), x.alias("leaf")) for t, x in zip(trees, leaves)])
    return known.select(id_col, F.inline(pairs))


def _matrix(vectors, width: int):
    """An Arrow column of feature vectors as rows of ``width``, NaN where a vector is NULL, short or has a NULL."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lens = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lens)), lens)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    out = np.full((len(lens), width), np.nan)
    used = place < width
    out[row[used], place[used]] = flat[used]
    return out


def _walk_numpy(rows: DataFrame, forest: DataFrame, id_col: str, features: str, as_array: bool) -> DataFrame:
    """The node table as flat arrays, broadcast once; a batch of rows walks each tree until every row is on a leaf."""
    import numpy as np

    nodes = _node_table(forest).toPandas().sort_values(["tree", "node"], kind="stable").reset_index(drop=True)
    tree, node = nodes["tree"].to_numpy(np.int64), nodes["node"].to_numpy(np.int64)
    internal = nodes["feature"].notna().to_numpy()
    trees, first = np.unique(tree, return_index=True)
    at = {(t, n): i for i, (t, n) in enumerate(zip(tree.tolist(), node.tolist()))}

    def target(side: str) -> "np.ndarray":
        out = np.arange(len(nodes))
        out[internal] = [at[t, int(n)] for t, n in zip(tree[internal].tolist(), nodes[side][internal])]
        return out

    feature = np.where(internal, nodes["feature"].fillna(-1).to_numpy(float), -1).astype(np.int64)
    threshold = nodes["threshold"].fillna(0).to_numpy(float)
    roots = np.array([at[t, 0] for t in trees.tolist()], np.int64)
    model = rows.sparkSession.sparkContext.broadcast(
        (trees.astype(np.int32), roots, feature, threshold, target("left"), target("right"), nodes["missing_left"].to_numpy(bool), node.astype(np.int32)))
    key_type = dict(rows.dtypes)[id_col]

    def walk(batches):
        import pyarrow as pa

        tree_ids, roots_, f_, t_, l_, r_, m_, name = model.value
        width = max(1, int(f_.max(initial=-1)) + 1)
        for batch in batches:
            n, ids = batch.num_rows, batch.column(0)
            X = _matrix(batch.column(1), width)
            each = np.arange(n)
            out = np.zeros((n, len(tree_ids)), dtype=np.int32)
            for k, root in enumerate(roots_):
                at = np.full(n, root)
                while (f_[at] >= 0).any():
                    f = f_[at]
                    x = X[each, np.maximum(f, 0)]
                    left = np.where(np.isnan(x), m_[at], x < t_[at])
                    at = np.where(f < 0, at, np.where(left, l_[at], r_[at]))
                out[:, k] = name[at]
            leaf = pa.array(out.ravel())
            if as_array:
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * len(tree_ids))
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, leaf)], names=[id_col, "leaves"])
            else:
                again = ids.take(pa.array(np.repeat(each, len(tree_ids))))
                yield pa.RecordBatch.from_arrays([again, pa.array(np.tile(tree_ids, n)), leaf], names=[id_col, "tree", "leaf"])

    schema = (f"`{id_col}` {key_type}, leaves array<int>" if as_array
              else f"`{id_col}` {key_type}, tree int, leaf int")
    return rows.select(id_col, features).mapInArrow(walk, schema)


def forest_depth(forest: DataFrame) -> int:
    """Edges on the longest path from a root to a leaf, measured level by level along the edges."""
    nodes = _node_table(forest)
    level, depth = nodes.where("node = 0").select("tree", "node"), 0
    while True:
        inner = level.join(nodes, ["tree", "node"]).where("feature is not null")
        level = inner.select("tree", F.explode(F.array("left", "right")).alias("node"))
        if level.isEmpty():
            return depth
        depth += 1


def _walk_join(rows: DataFrame, forest: DataFrame, id_col: str, features: str, as_array: bool) -> DataFrame:
    """One equi-join with the node table per level, for forests too large to ship; rows are told apart by number."""
    from leafwise.session import scratch_dir

    nodes = _node_table(forest)
    path = scratch_dir(rows.sparkSession, "forest_rows")
    rows.select(id_col, features, F.monotonically_increasing_id().alias("__row")).write.parquet(path)
    numbered = rows.sparkSession.read.parquet(path)
    state = numbered.crossJoin(F.broadcast(forest.where("node = 0").select("tree"))).withColumn("node", F.lit(0))
    for _ in range(forest_depth(forest)):
        step = state.join(nodes, ["tree", "node"])
        x = F.get(F.col(features), F.col("feature")).cast("double")
        left = F.when(x.isNull() | F.isnan(x), F.col("missing_left")).otherwise(x < F.col("threshold"))
        nxt = F.when(F.col("feature").isNull(), F.col("node")).when(left, F.col("left")).otherwise(F.col("right"))
        state = step.select("__row", id_col, features, "tree", nxt.cast("int").alias("node"))
    leaves = state.select("__row", id_col, "tree", F.col("node").alias("leaf"))
    if not as_array:
        return leaves.drop("__row")
    arr = F.sort_array(F.collect_list(F.struct("tree", "leaf")))  # one entry per tree
    return leaves.groupBy("__row").agg(F.first(id_col).alias(id_col), F.transform(arr, lambda s: s["leaf"]).alias("leaves")).drop("__row")


def forest_leaves(rows: DataFrame, forest: DataFrame, id_col: str = "id", features: str = "features",
                  as_array: bool = False, node_limit: int = NUMPY_NODE_LIMIT, expression_nodes: int = EXPRESSION_NODES) -> DataFrame:
    """Leaf reached in every tree, for every row: ``(id, tree, leaf)``, or ``(id, leaves)`` by tree.

    ``forest``: one row per node; the root of each tree is node 0, ids may
    be numbered in any way and trees may have gaps and any shape.  ``x <
    threshold`` goes left; NULL and NaN, features beyond a vector's end and
    all features of a NULL vector are missing, and go right unless
    ``missing_left``.  Rows with equal ids are rows of their own.  The model's
    size does not grow with the data: it is checked, and decides between a
    column expression, a walk in Python workers and joins, with one result.
    """
    size = forest.count()
    walk = _walk_expression if size <= expression_nodes else _walk_numpy if size <= node_limit else _walk_join
    return walk(rows, forest, id_col, features, as_array)
