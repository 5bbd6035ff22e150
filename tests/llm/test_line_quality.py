"""The field over lines against enumeration, its gradient against differences, and its verdicts on held-out rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwise.llm import line_quality as lq
from leafwise.llm.common import fold
from leafwise.llm.registry import QUERIES

SF = "/root/testdata/sf0.01"
#: Extra columns whose names the operator uses inside.
SCHEMA = "doc_id long, text string, label int, h long, score double, run int, n long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 7, 8, 0.5, 1, 2) for i, t in rows], SCHEMA)


def enumerate_chain(e, t):
    """Weights of all labellings of a chain."""
    out = {}
    for y in itertools.product((0, 1), repeat=len(e)):
        out[y] = np.exp(sum(e[i] for i in range(len(e)) if y[i]) + sum(t[a, b] for a, b in zip(y, y[1:])))
    return out


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    t = rng.normal(size=(2, 2)) * 2
    chains = [rng.normal(size=n) * 3 for n in (1, 5, 1, 7, 2)]
    starts = np.concatenate([np.arange(len(c)) == 0 for c in chains])
    got = lq.good_probability(np.concatenate(chains), starts, t)
    want = []
    for c in chains:
        w = enumerate_chain(c, t)
        want += [sum(v for y, v in w.items() if y[i]) / sum(w.values()) for i in range(len(c))]
    assert np.allclose(got, want, atol=1e-12)


def test_marginals_of_a_long_chain():
    e = np.where(np.arange(100_000) % 50 < 25, 40.0, -40.0)
    p = lq.good_probability(e, np.arange(len(e)) == 0, np.array([[1.0, -1], [-1, 1]]))
    assert np.isfinite(p).all() and ((p > 0.5) == (e > 0)).all()


def test_likelihood_and_gradient():
    rng = np.random.default_rng(1)
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0], [1, 1, 1, 0]], bool)
    label = np.array([1, 0, 0, 1])
    e, t = rng.normal(size=mask.shape), rng.normal(size=(2, 2))
    like, by_line, by_step = lq.gradient(e, mask, t, label)
    for k in range(4):
        w = enumerate_chain(e[k][mask[k]], t)
        p = w[(1,) * mask[k].sum()] / sum(w.values())
        assert np.isclose(like[k], np.log(p if label[k] else 1 - p))
    eps = 1e-6
    for k, i in zip(*np.nonzero(mask)):
        moved = e.copy()
        moved[k, i] += eps
        assert np.isclose((lq.gradient(moved, mask, t, label)[0][k] - like[k]) / eps, by_line[k, i], atol=1e-4)
    for a, b in itertools.product((0, 1), repeat=2):
        moved = t.copy()
        moved[a, b] += eps
        assert np.allclose((lq.gradient(e, mask, moved, label)[0] - like) / eps, by_step[:, a, b], atol=1e-4)


def test_line_features():
    texts = [b"Abc abc abc\n\nAbc abc abc\n!! $$ x1", b"", b"\n", "É é long-long-word-here\ttab".encode(), b"same\nsame"]
    f, size, text = lq.line_features(texts)
    assert text.tolist() == [0, 0, 0, 0, 1, 2, 2, 3, 4, 4] and size.tolist()[:5] == [11, 0, 11, 8, 0]
    col = {n: f[:, i] for i, n in enumerate(lq.FEATURES)}
    assert np.allclose(np.expm1(col["words"]), [3, 0, 3, 3, 0, 0, 0, 4, 1, 1])
    assert np.allclose(col["same_as_last"][:4], [1 / 3, 0, 1 / 3, 0]) and col["repeated_line"].tolist() == [1, 0, 1, 0, 0, 0, 0, 0, 1, 1]
    assert col["first"].tolist() == [1, 0, 0, 0, 1, 1, 0, 1, 1, 0] and col["blank"].tolist() == [0, 1, 0, 0, 1, 1, 1, 0, 0, 0]
    x = lq.with_neighbours(f, text)
    w = lq.WIDTH
    assert (x[4, 2 * w :] == 0).all() and (x[1, 2 * w : 3 * w] == f[0]).all() and (x[1, 3 * w :] == f[2]).all()


def test_texts_do_not_depend_on_their_batch():
    rng = np.random.default_rng(2)
    model = lq.Model(np.zeros(4 * lq.WIDTH), np.ones(4 * lq.WIDTH), rng.normal(size=4 * lq.WIDTH) * 0.3, 0.1, rng.normal(size=(2, 2)))
    texts = [b"a b c\nd d d\n", b"", b"word " * 50_000 + b"\n" * 300, "ünï\n\n!!".encode(), b"x" * 100_000]
    assert np.allclose(lq.quality(model, texts), [lq.quality(model, [t])[0] for t in texts], atol=1e-12)


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, "\n".join(["plain words here and there of it."] * (1 + i % 3)) + f" {i}") for i in range(60)]
    rows += [(100 + i, f"head line {i}\n" + "$$$ %%% spam spam spam spam\n" * (1 + i % 4)) for i in range(40)]
    labels = [(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(40)] + [(None, 0), (3, 0), (500, None), (501, 1)]
    return docs(spark, rows), spark.createDataFrame([(i, q, 1) for i, q in labels], "doc_id long, quality int, text int")


def test_edges(spark, labelled):
    d, labels = labelled
    model = lq.fit(d, labels)
    odd = docs(spark, [(1, None), (1, None), (2, ""), (None, "\n\n"), (4, "$$$ %%% spam spam spam\n" * 4000), (5, "plain words here and there.\n" * 4000), (6, "z" * 300_000)])
    got = odd.select("doc_id", lq.score_column(model).alias("s")).collect()
    assert len(got) == 7 and all(0 <= r["s"] <= 1 for r in got)
    assert got[0]["s"] == got[1]["s"] == got[2]["s"]
    by = {r["doc_id"]: r["s"] for r in got}
    assert by[4] < 0.3 < by[5]
    assert docs(spark, []).select(lq.score_column(model)).count() == 0


def test_copies_teach_once(spark, labelled):
    d, labels = labelled
    once = d.unionByName(docs(spark, [(900 + i, "plain words of a hot text.") for i in range(2)]))
    often = d.unionByName(docs(spark, [(900 + i, "plain words of a hot text.") for i in range(200)]))
    more = labels.unionByName(spark.createDataFrame([(900 + i, 1, 1) for i in range(200)], labels.schema))
    a, b = lq.fit(once, more), lq.fit(often, more)
    assert np.allclose(a.weights, b.weights) and a.slope != b.slope


def test_without_both_labels(spark, labelled):
    d, labels = labelled
    for lab, want in ((labels.limit(0), 0.5), (labels.where("quality = 1 and doc_id between 10 and 19"), 11 / 12)):
        model = lq.fit(d, lab)
        assert {r[0] for r in d.select(lq.score_column(model)).collect()} == {want}
    assert lq.fit(d.limit(0), labels).share == 0.5


def test_query(spark):
    out = QUERIES["op11_quality_classifier"](spark, SF)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").collect()
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(rows) == n
    held = [r for r in rows if r["held_out"] and r["quality"] is not None]
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95
    assert sum(r["predicted"] for r in held if r["quality"]) / sum(r["quality"] for r in held) > 0.97
    assert sum(r["held_out"] for r in rows) == spark.read.parquet(f"{SF}/documents.parquet").where(fold("doc_id") == 0).count()


def test_labels_of_the_held_out_fold_teach_nothing(spark, tmp_path):
    """Flipping the labels of the held-out rows changes no score."""
    d = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    d.write.parquet(str(tmp_path / "a/documents.parquet"))
    d.write.parquet(str(tmp_path / "b/documents.parquet"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.write.parquet(str(tmp_path / "a/labels.parquet"))
    labels.withColumn("quality", F.when(fold("doc_id") == 0, 1 - F.col("quality")).otherwise(F.col("quality"))).write.parquet(str(tmp_path / "b/labels.parquet"))
    a, b = (sorted(map(tuple, QUERIES["op11_quality_classifier"](spark, str(tmp_path / x)).collect())) for x in "ab")
    assert [r[:2] for r in a] == [r[:2] for r in b] and np.allclose([r[2] for r in a], [r[2] for r in b], atol=1e-9)
