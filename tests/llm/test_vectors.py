"""Centroid clustering and vector codes against plain integer versions."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwise.llm import clustering, vector_codes
from leafwise.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
#: Extra columns whose names the operators use inside.
SCHEMA = "vec_id long, embedding array<float>, label int, block string, x int, group string, error string, cluster int, v string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "b", 1, "g", "e", 3, "v") for i, v, label in rows], SCHEMA)


def clumps(n, dims, seed=1, centres=12):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, dims))
    return [(i, [float(np.float32(x)) for x in at[i % centres] + rng.normal(size=dims) * 0.2], i % 5) for i in range(n)]


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v]) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    at = [v for _, v in sorted(kept, key=name)[:k]]
    own = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(own(v)[1], []).append(v)
        at = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(at)]
    return sorted(((i, own(v)[1], own(v)[0]) for i, v in kept), key=str), at


@pytest.mark.parametrize("n, dims, k", [(700, 4, 8), (300, 6, 5), (5, 4, 8), (1, 4, 8)])
def test_clustering(spark, n, dims, k, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK", 64)
    rows = clumps(n, dims)
    rows += rows[: n // 3]  # repeated rows
    rows += [(None, rows[0][1], None), (None, [0.0] * dims, 1), (9000, None, 1), (9001, [], 1), (9002, [1.0], 1)]
    rows += [(9003, [float("nan")] * dims, 1), (9004, [None] + [1.0] * (dims - 1), 1), (9005, [float("inf")] * dims, 1)]
    log = []
    found, centroids = clustering.cluster(vectors(spark, rows), k=k, dims=dims, log=log)
    got = sorted((tuple(r) for r in found.collect()), key=str)
    want, at = plain_clusters(rows, k, 10, dims)
    assert got == want and centroids == at
    if n == 700:
        assert log[0] == len(got) and sum(log[1:]) < 0.5 * log[0] * len(log[1:])  # most are never scanned again


def test_clustering_report(spark):
    rows = clumps(40, 64) + [(7, clumps(8, 64)[7][1], 2)]
    out = clustering.centroid_report(*clustering.cluster(vectors(spark, rows))).collect()
    want, at = plain_clusters(rows, 8, 10, 64)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in out) == sorted(want)
    for r in out:
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
        assert r["inertia"] == sum(d for _, _, d in want)
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, at[r["cluster"]])).encode()).hexdigest()


def test_vectors_empty_and_wide(spark):
    for f in (lambda d: clustering.centroid_report(*clustering.cluster(d)), lambda d: vector_codes.code_report(*vector_codes.vector_codes(d))):
        assert f(vectors(spark, [])).count() == 0
        assert f(vectors(spark, [(1, None, 2), (2, [float("nan")] * 64, 3)])).count() == 0
        with pytest.raises(Exception, match="vector component beyond"):
            f(vectors(spark, [(1, [3e20] * 64, 2)])).count()


def test_loosening_bounds_the_fall():
    rng = np.random.default_rng(5)
    less = 0
    for _ in range(200):
        dims, k = int(rng.integers(2, 6)), 4
        old = rng.normal(size=(k, dims)) * 3
        new = old + rng.normal(size=(k, dims)) * rng.uniform(0, 1)
        radius = rng.uniform(0, 2, size=k)
        loose = clustering.loosening(old, new, radius)
        drift = np.linalg.norm(new - old, axis=1)
        assert (loose <= drift[None] + 1e-9).all()
        less += (loose < drift[None] * 0.9).sum()
        for i in range(k):
            p = rng.normal(size=(100, dims))
            p = old[i] + p / np.linalg.norm(p, axis=1, keepdims=True) * radius[i] * rng.uniform(size=(100, 1)) ** 0.2
            for j in range(k):
                fall = np.linalg.norm(p - old[j], axis=1) - np.linalg.norm(p - new[j], axis=1)
                assert fall.max() <= loose[i, j] + 1e-9
    assert less > 500


# vector codes -----------------------------------------------------------------------------------


def test_hadamard():
    for n in (1, 2, 4, 8, 32):
        h = vector_codes.hadamard(np.eye(n, dtype=np.int64)).T
        assert (h @ h.T == n * np.eye(n)).all()
        assert [(np.diff(r) != 0).sum() for r in h] == list(range(n))
    x = np.arange(6).reshape(2, 3)
    assert vector_codes.hadamard(x).shape == (2, 4) and vector_codes.hadamard(x)[:, 0].tolist() == [3, 12]


@pytest.mark.parametrize("length, spread", [(1, 3), (3, 2), (8, 4000), (5, 1)])
def test_nearest(length, spread):
    rng = np.random.default_rng(length)
    x, e = rng.integers(-spread, spread + 1, (500, length)), rng.integers(-spread, spread + 1, (16, length))
    d = ((x[:, None] - e[None]) ** 2).sum(axis=2)
    index, distance = vector_codes.nearest(x, e)
    assert (index == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
    assert [len(a) for a in vector_codes.nearest(x[:0], e)] == [0, 0]


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, [int(np.floor(4096 * np.float64(np.float32(x)))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    n = len(kept[0][1]) // parts
    cut = [[tuple(v[p * n : p * n + n]) for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    own = lambda x, p: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(own(c[p], p)[1], []).append(c[p])
            new.append([tuple(sum(x) // len(groups[j]) for x in zip(*groups[j])) if j in groups else e for j, e in enumerate(books[p])])
        books = new
    codes = [[own(c[p], p) for p in range(parts)] for c in cut]
    out = [(r[0], "".join(f"{j:02x}" for _, j in c), sum(d for d, _ in c), r[2]) for r, c in zip(kept, codes)]
    totals = {}
    for _, _, e, label in out:
        totals[label] = totals.get(label, 0) + e
    text = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(((i, c, e, totals[label], hashlib.sha256(text.encode()).hexdigest()) for i, c, e, label in out), key=str)


@pytest.mark.parametrize("n, dims", [(400, 16), (60, 24), (3, 8), (1, 64)])
def test_vector_codes(spark, n, dims):
    rows = clumps(n, dims) + [(None, [0.5] * dims, None), (3, [0.25] * dims, None), (9000, None, 1), (9001, [float("nan")] * dims, 1), (9002, [None] * dims, None)]
    rows += rows[:20]
    got = vector_codes.code_report(*vector_codes.vector_codes(vectors(spark, rows))).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_codes(rows, 8, 16, 6)


def test_vector_codes_lengths(spark):
    rows = clumps(30, 16) + [(100, [1.0] * 8, 1), (101, [], 1)]
    got = {r["vec_id"]: r for r in vector_codes.code_report(*vector_codes.vector_codes(vectors(spark, rows))).collect()}
    assert len(got) == 32 and got[100]["code"] is None and got[101]["error"] is None and len(got[5]["code"]) == 16
    odd = vector_codes.code_report(*vector_codes.vector_codes(vectors(spark, [(1, [1.0] * 9, 1), (2, [1.0] * 8, 1)]))).collect()
    assert [r["code"] for r in odd] == [None, None]


def test_queries(spark):
    for name, key in (("op12_centroid_clustering", "cluster"), ("op13_vector_codes", "code")):
        out = QUERIES[name](spark, SF)
        n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
        assert out.count() == n and out.where(F.col(key).isNull()).count() == 0
