import pytest
import math

from pyspark.sql import functions as F

from leafwise.operators.features import catalog_matches, masked_mean_pool, smiles_formal_charge, smiles_heavy_atoms
from leafwise.operators.reshape import custom_order, ordered_category, union_by_name

SMILES = [
    ("CCO", 3, 0), ("Oc1ccccc1", 7, 0), ("CC(N)C(=O)O", 6, 0), ("ClCCBr", 4, 0), ("[Na+].[O-]C(=O)C", 5, 0), ("C[N+](C)(C)C", 5, 1),
    ("[Fe+3].[2H]C[nH]", 3, 3), ("[Ca++]", 1, 2), ("[Cl-:2].[H][H]", 1, -1),
]


def test_smiles_text_expressions(spark):
    df = spark.createDataFrame([(s,) for s, _, _ in SMILES], "s string")
    got = [tuple(r) for r in df.select(smiles_heavy_atoms("s"), smiles_formal_charge("s")).collect()]
    assert got == [(h, c) for _, h, c in SMILES]


def test_union_different_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id int, a string")
    b = spark.createDataFrame([(2, 2.5)], "id int, b double")
    rows = sorted(map(tuple, union_by_name([a, b, a]).collect()), key=str)
    assert rows == sorted([(1, "x", None), (2, None, 2.5), (1, "x", None)], key=str)


def test_order_unmapped_last(spark):
    df = spark.createDataFrame([("zzz",), ("svm_test",), ("knn_test",), ("aaa",)], "m string")
    out = [r["m"] for r in custom_order(df, "m", {"svm_test": 2, "knn_test": 1}).collect()]
    assert out == ["knn_test", "svm_test", "aaa", "zzz"]


def test_ordered_category(spark):
    df = spark.createDataFrame([("AUC",), ("Other",)], "m string")
    assert [r[0] for r in df.select(ordered_category("m", ["F1", "AUC"])).collect()] == [2, None]


def test_catalog(spark):
    df = spark.createDataFrame([("mail me at a.b@x.example.org now",), ("plain",), ("token = \"0123456789abcdef0123\"",)], "t string")
    got = [r[0] for r in df.select(catalog_matches("t")).collect()]
    assert got == [["email address"], [], ["secret token"]]


def test_masked_mean_pool(spark):
    rows = [(1, 0, 1, [1.0, 2.0]), (1, 1, 0, [100.0, 100.0]), (1, 2, 1, [3.0, 4.0]), (2, 0, 0, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "id long, pos int, mask int, vec array<float>")
    got = {r["id"]: r["pooled"] for r in masked_mean_pool(df, as_array=True).collect()}
    assert got[1] == [2.0, 3.0] and got[2] == [0.0, 0.0]


def _walk(nodes, tree, x):
    """Leaf of one row by following the edges."""
    by = {n[1]: n for n in nodes if n[0] == tree}
    at = 0
    while by[at][2] is not None:
        _, _, f, cut, left, right = by[at]
        at = left if x[f] is not None and x[f] < cut else right
    return at


FORESTS = {
    # a chain to the right, numbered in pre-order: node 2i splits, 2i + 1 is its left leaf
    "chain": [(0, 2 * i, 0, float(i), 2 * i + 1, 2 * i + 2) for i in range(9)] + [(0, 2 * i + 1, None, None, None, None) for i in range(9)] + [(0, 18, None, None, None, None)],
    # pre-order numbering and gaps between tree ids and node ids
    "gaps": [(0, 0, 1, 0.5, 1, 40), (0, 1, 0, -1.0, 2, 3), (0, 2, None, None, None, None), (0, 3, None, None, None, None), (0, 40, None, None, None, None),
             (5, 0, None, None, None, None), (9, 0, 0, 3.0, 7, 4), (9, 7, None, None, None, None), (9, 4, None, None, None, None)],
}


@pytest.mark.parametrize("name", sorted(FORESTS))
def test_forest_leaves_on_any_tree(spark, name):
    from leafwise.operators.features import forest_depth, forest_leaves

    nodes = FORESTS[name]
    forest = spark.createDataFrame(nodes, "tree int, node int, feature int, threshold double, left int, right int")
    xs = [[-5.0, 0.0], [100.0, 100.0], [4.5, 0.5], [None, None]]
    rows = spark.createDataFrame(list(enumerate(xs)), "id long, features array<double>")
    want = {(i, t, _walk(nodes, t, x)) for i, x in enumerate(xs) for t in {n[0] for n in nodes}}
    for limit, small in ((10**6, 10**6), (10**6, 0), (0, 0)):   # expression, shipped, joined
        assert {tuple(r) for r in forest_leaves(rows, forest, node_limit=limit, expression_nodes=small).collect()} == want
        arrays = forest_leaves(rows, forest, as_array=True, node_limit=limit, expression_nodes=small).collect()
        assert {(r["id"], t, leaf) for r in arrays for t, leaf in zip(sorted({n[0] for n in nodes}), r["leaves"])} == want
    assert forest_depth(forest) == (9 if name == "chain" else 2)


def test_forest_dump(spark, tmp_path):
    import json

    from leafwise.operators.features import forest_leaves
    from leafwise.operators.models import read_forest_dump

    leaf = lambda i: {"nodeid": i, "leaf": 0.1}
    dump = [{"nodeid": 0, "split": "f1", "split_condition": 2.0, "yes": 1, "no": 2, "missing": 1, "children": [leaf(1), leaf(2)]}, leaf(0)]
    (tmp_path / "dump.json").write_text(json.dumps(dump, indent=1))
    forest = read_forest_dump(spark, str(tmp_path / "dump.json"))
    rows = spark.createDataFrame([(0, [0.0, 1.0]), (1, [0.0, 2.0]), (2, [0.0, None])], "id long, features array<double>")
    for limit, small in ((10, 10), (10, 0), (0, 0)):
        got = {r["id"]: r["leaves"] for r in forest_leaves(rows, forest, as_array=True, node_limit=limit, expression_nodes=small).collect()}
        assert got == {0: [1, 0], 1: [2, 0], 2: [1, 0]}


def _length_or_null(keys):
    import pandas as pd

    return pd.DataFrame({"n": [None if k.startswith("bad") else len(k) for k in keys]}, dtype="Int32")


def test_featurize_quarantine_and_failfast(spark):
    from leafwise.operators.features import featurize

    df = spark.createDataFrame([(1, "ok"), (2, "bad1"), (3, "ok"), (4, "fine!")], "id int, s string")
    rejects = []
    good = featurize(df, "s", fn=_length_or_null, schema="n int", mode="quarantine", rejects=rejects)
    assert sorted(map(tuple, good.select("id", "n").collect())) == [(1, 2), (3, 2), (4, 5)]
    assert [r[0] for r in rejects[0].collect()] == ["bad1"]
    kept = featurize(df, "s", fn=_length_or_null, schema="n int")
    assert sorted(map(tuple, kept.select("id", "n").collect()), key=str) == sorted([(1, 2), (2, None), (3, 2), (4, 5)], key=str)


def _length_encoder():
    import numpy as np

    return lambda texts: np.array([[len(t), t.count("a")] for t in texts], dtype=float)


def test_forest_walks_agree_on_odd_rows(spark):
    """NULL, short and NaN vectors and repeated ids: one result by all three walks."""
    from leafwise.operators.features import forest_leaves

    forest = spark.createDataFrame([(*n, n[1] % 2 == 0) for n in FORESTS["gaps"]], "tree int, node int, feature int, threshold double, left int, right int, missing_left boolean")
    xs = [(1, None), (2, []), (3, [0.5]), (3, [0.5]), (3, [9.0, 9.0]), (4, [float("nan"), 0.0]), (None, [0.0, 0.0]), (None, [5.0, None]), (2**53 + 1, [1.0, 2.0, 3.0])]
    rows = spark.createDataFrame(xs, "id long, features array<double>")
    got = [sorted(((r["id"], r["leaves"]) for r in forest_leaves(rows, forest, as_array=True, node_limit=a, expression_nodes=b).collect()), key=str) for a, b in ((99, 99), (99, 0), (0, 0))]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(xs)
    assert dict(map(lambda x: (x[0], x[1]), got[0]))[1] == [3, 0, 7]     # all missing: left at even nodes
    long = [sorted(map(tuple, forest_leaves(rows, forest, node_limit=a, expression_nodes=b).collect()), key=str) for a, b in ((99, 99), (99, 0), (0, 0))]
    assert long[0] == long[1] == long[2] and len(long[0]) == 3 * len(xs)
    plan = forest_leaves(rows, forest)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan


def test_masked_mean_pool_edges(spark):
    rows = [(1, 1, [1.0, 2.0]), (1, 0, [9.0, 9.0]), (1, None, [5.0, 5.0]), (1, 1, None), (1, 1, [3.0, None]), (2, 0, [4.0, 4.0]), (None, 1, [7.0, 8.0]), (3, 1, None)]
    df = spark.createDataFrame(rows, "id int, mask int, vec array<double>")
    got = {r["id"]: r["pooled"] for r in masked_mean_pool(df, as_array=True).collect()}
    assert got == {1: [2.0, 1.0], 2: [0.0, 0.0], None: [7.0, 8.0]}
    long = {(r["id"], r["dim"]): r["value"] for r in masked_mean_pool(df).collect()}
    assert long[1, 0] == 2.0 and len(long) == 6


def _counting_hook(path):
    """A hook that leaves a line per key it sees."""

    def hook(keys):
        import os

        import pandas as pd

        with open(path, "a") as f:
            f.write("".join(f"{k}\n" for k in keys))
        if any(k == "boom" for k in keys):
            raise ValueError("boom")
        return pd.DataFrame({"n": [None if k.startswith("bad") else len(k) + 0 * os.getpid() for k in keys]}, dtype="Int32")

    return hook


def test_featurize_evaluates_once(spark, tmp_path):
    from leafwise.operators.features import featurize

    df = spark.createDataFrame([(i, "hot") for i in range(50)] + [(60, "bad"), (61, "x"), (62, None)], "id int, s string")
    rejects, seen = [], str(tmp_path / "seen")
    good = featurize(df, "s", fn=_counting_hook(seen), schema="n int", mode="quarantine", rejects=rejects)
    assert good.count() == 51 and good.columns == ["id", "s", "n"]
    assert [tuple(r) for r in rejects[0].collect()] == [("bad", "no output")]
    with open(seen) as f:
        assert sorted(f.read().split()) == ["bad", "hot", "x"]     # both outputs read, one evaluation each
    all_rows = featurize(df, "s", fn=_counting_hook(seen), schema="n int")
    assert all_rows.count() == 53 and all_rows.where("s is null and n is null").count() == 1


def test_featurize_reports_keys_that_raise(spark, tmp_path):
    from leafwise.operators.features import featurize

    df = spark.createDataFrame([(1, "boom"), (2, "okay"), (3, "fine")], "id int, s string").coalesce(1)
    rejects = []
    good = featurize(df, "s", fn=_counting_hook(str(tmp_path / "s")), schema="n int", mode="quarantine", rejects=rejects)
    assert sorted(r["n"] for r in good.collect()) == [4, 4]
    assert [tuple(r) for r in rejects[0].collect()] == [("boom", "ValueError: boom")]
    with pytest.raises(Exception, match="boom"):
        featurize(df, "s", fn=_counting_hook(str(tmp_path / "s")), schema="n int")


def test_attach_hot_groups(spark, monkeypatch):
    from leafwise.operators import scan

    monkeypatch.setattr(scan, "HEAVY", 5)
    rows = spark.createDataFrame([("a", i) for i in range(40)] + [("b", 1), ("c", 2), (None, 3)], "k string, i int")
    groups = spark.createDataFrame([("a", 7, 40), ("b", 8, 1)], "k string, v int, n long")
    got = scan.attach(rows, groups, "k", "n")
    assert got.count() == 43 and got.where("v = 7").count() == 40 and got.where("v is null").count() == 2
    assert scan.attach(rows, groups, "k", "n", "inner").count() == 41


def test_catalog_search(spark):
    import re

    from leafwise.operators.features import catalog_search

    entries = [(f"n{i}", f"w{i}[ ,]+w{i + 1}", [f"w{i}"]) for i in range(300)]
    entries += [("digits", "[0-9]{4,}", []), ("none", None, ["w1"]), ("either", "foo|bar", ["foo", "bar"]), ("n5", "w5x", ["w5x"]), ("blank", "zz", [""])]
    catalog = spark.createDataFrame(entries, "name string, pattern string, literals array<string>")
    texts = ["w1 w2, w3 w4", "w10,w11 w299 w300", "nothing", "", None, "12345 foo", "w5x bar zz", "w299, w300 " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r["matches"] for r in catalog_search(df, catalog).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else sorted({n for n, p, _ in entries if p and re.search(p, t)}))
    assert catalog_search(df, catalog.limit(0)).where("size(matches) > 0").count() == 0


def test_embed_text_windows_and_rows(spark):
    import hashlib

    from leafwise.operators.models import embed_text

    words = [f"w{i % 7}" for i in range(50)]
    texts = ["a b a", "", None, " ".join(words), "a b a", "\t\n"]
    df = spark.createDataFrame([(i, t, i * 2) for i, t in enumerate(texts)] + [(None, "a", 1)], "id long, text string, extra int")
    for window in (4, 512):
        out = embed_text(df, dim=8, window=window)
        assert out.columns == ["id", "extra", "embedding"]
        got = {r["id"]: r["embedding"] for r in out.collect()}
        assert len(got) == 7 and got[2] is None and got[1] == got[5] == [0.0] * 8 and got[0] == got[4]
        for i in (0, 3):
            want = [0.0] * 8
            for w in texts[i].split():
                want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 8] += 1 / len(texts[i].split())
            assert got[i] == pytest.approx(want)
    # an encoder sees windows, pooled by their words
    plug = {r["id"]: r["embedding"] for r in embed_text(df, encoder_factory=_length_encoder, window=20).collect()}
    parts = [" ".join(words[i : i + 20]) for i in (0, 20, 40)]
    assert plug[3][0] == pytest.approx(sum(len(p) * len(p.split()) for p in parts) / 50)
    assert plug[0] == [5.0, 2.0] and plug[1] == [0.0, 0.0] and plug[2] is None


def test_embed_text_moves_no_text(spark, tmp_path):
    from leafwise.operators.models import embed_text

    spark.createDataFrame([(1, "some words")], "id long, text string").write.parquet(str(tmp_path / "t"))
    out = embed_text(spark.read.parquet(str(tmp_path / "t")))
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # the text is read and turned into its digest there; nothing above sees it
    assert all("md5(" in x or "Relation" in x for x in lines if "text#" in x) and any("md5(" in x for x in lines)


def test_embed_text_default_and_plugin(spark):
    from leafwise.operators.models import embed_text

    df = spark.createDataFrame([(1, "banana"), (2, "apple"), (3, "banana")], "id int, text string")
    dflt = {r["id"]: r["embedding"] for r in embed_text(df, dim=16).collect()}
    assert len(dflt[1]) == 16 and abs(sum(dflt[1]) - 1.0) < 1e-9 and dflt[1] == dflt[3]
    plug = {r["id"]: r["embedding"] for r in embed_text(df, encoder_factory=_length_encoder, batch_size=1).collect()}
    assert plug == {1: [6.0, 3.0], 2: [5.0, 1.0], 3: [6.0, 3.0]}


def test_word_pairs_are_found_without_their_patterns(monkeypatch):
    import random
    import re

    from leafwise.operators.features import _matcher

    words = ("a", "b", "ab", "ba", "aa", "bba")
    entries = [(f"{x}-{y}{s}", f"{x}[{s}]+{y}", needed) for x in words for y in words for s in (" ", ",. ", " ,.", "._?")
               for needed in ([x], [y], [], ["x", x])]
    odd = [("other", "a[ ,]+b", ["zz"]), ("range", "a[ -.]+b", ["a"]), ("many", "a[ ]+b[ ]+a", ["a"]), ("star", "a[ ]*b", ["b"]), ("not", "a[^ ]+b", ["a"])]
    draw = random.Random(1)
    texts = ["".join(draw.choice("ab ,.-?_\nä") for _ in range(draw.randint(0, 60))) for _ in range(300)] + ["", " ", "a b", "a, .b", "aab bba"]
    search = _matcher(entries + odd)
    for t in texts:
        want = {n for n, p, needed in entries + odd if re.search(p, t, re.ASCII) and (not needed or any(x in t for x in needed))}
        assert search(t) == sorted(want)
    # no pattern of a pair is compiled or searched: the time does not grow with the pairs that share a word
    pairs = _matcher([(str(i), f"a[ ,.]+w{i}", ["a"]) for i in range(3000)])
    monkeypatch.setattr(re, "compile", lambda *a: 1 / 0)
    assert pairs("a w5, a. w17 aw6 a  , w2999 " * 3) == sorted(["1", "2", "29", "299", "5", "17", "2999"])
