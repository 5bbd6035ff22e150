"""The Jaccard join against brute force, also where clusters exceed a block."""

import itertools
import random

import numpy as np
import pytest

from leafwise.llm import jaccard
from leafwise.llm.components import components

SCHEMA = "doc_id long, text string, k int, n string"


def brute(rows):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))) if w else frozenset()
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        inter = len(sets[a] & sets[b])
        if inter and 100 * inter >= 85 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            comp[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), root(i)) for i in sets}


def corpus(seed=3, groups=12, near=14):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows, i = [], 10
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 4, 5, 40, 120, 300]))]
        if g % 3 == 0:
            base += passage
        for _ in range(near):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((i, " ".join(w).upper() if rng.random() < 0.2 else "\n ".join(w), 1, "x"))
            i += 1
    rows += [(1, None, 1, "x"), (2, "", 1, "x"), (3, " \t\n", 1, "x"), (4, "one", 1, "x"), (5, "ONE ", 1, "x"), (6, "öne", 1, "x")]
    return rows


def result(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("block,short", [(2048, 16), (3, 16), (3, 1)])
def test_matches_brute_force(spark, monkeypatch, block, short):
    monkeypatch.setattr(jaccard, "SHORT", short)
    rows = corpus(groups=12 if block > 3 else 4)
    got = result(jaccard.jaccard_join(spark.createDataFrame(rows, SCHEMA), block=block))
    assert got == brute(rows)


def test_empty_table_and_null_ids(spark):
    assert jaccard.jaccard_join(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e", 1, "x"), (7, "a b c d e", 1, "x"), (7, "a b c d e", 1, "x"), (2, "A B c d e", 1, "x")]
    got = sorted(map(tuple, jaccard.jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == [(2, 2, 2), (7, 2, 2), (7, 2, 2), (None, 2, None)]


def test_overlaps():
    a = [np.array([1, 2, 3], np.uint64), np.array([5], np.uint64)]
    b = [np.array([2, 3, 9], np.uint64), np.array([5, 7], np.uint64), np.array([1], np.uint64)]
    assert jaccard.overlaps(a, b).tolist() == [[2, 0, 1], [0, 1, 0]]
    assert jaccard.overlaps(a + b).tolist() == [[3, 0, 2, 0, 1], [0, 1, 0, 1, 0], [2, 0, 3, 0, 0], [0, 1, 0, 2, 0], [1, 0, 0, 0, 1]]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 200), (200, 150), (7, 7)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(i, 0) for i in range(31)} | {(100, 100), (150, 100), (200, 100)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for n, m, shared in [(1, 1, 0), (1, 1, 1), (60, 70, 55), (64, 65, 60), (3000, 3300, 2900), (500, 4200, 490)]:
        common = rng.integers(0, 2**64, shared, np.uint64)
        a = np.unique(np.concatenate([common, rng.integers(0, 2**64, n - shared, np.uint64)]))
        b = np.unique(np.concatenate([common, rng.integers(0, 2**64, m - shared, np.uint64)]))
        bits = [np.frombuffer(jaccard._parity(x), np.uint64) for x in (a, b)]
        x, y = jaccard._folded(bits, min(map(len, bits)))
        differ = int(np.bitwise_count(x ^ y).sum())
        assert differ <= len(np.setxor1d(a, b))
        assert (differ == 0) == (shared == n == m)


def test_passing_pairs_hold_every_link():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**64, 140, np.uint64)
    sets = [np.unique(np.where(rng.random(len(b := base[: rng.integers(100, 141)])) < 0.05, rng.integers(0, 2**64, len(b), np.uint64), b)) for _ in range(300)]
    bits = [np.frombuffer(jaccard._parity(x), np.uint64) for x in sets]
    n = np.array([len(x) for x in sets])
    every = np.arange(len(sets))
    i, j = jaccard.passing(every, every, n, bits, lambda a, b: a < b, 85)
    got, want = set(zip(i.tolist(), j.tolist())), set(zip(*(x.tolist() for x in np.nonzero(np.triu(jaccard.linked(sets), 1)))))
    assert want and want <= got and len(got) < 0.9 * len(sets) * (len(sets) - 1) / 2


@pytest.mark.parametrize("parts", [4096, 400])
def test_large_cluster_without_links(spark, monkeypatch, parts):
    """Thousands of texts that share rare shingles and do not link, with a few that do."""
    monkeypatch.setattr(jaccard, "LIST", parts)
    rng = random.Random(9)
    common = [f"c{i}" for i in range(120)]
    rows = []
    for i in range(2300):
        w = list(common)
        for at in range(3, 120, 6):
            w[at] = f"v{at}.{rng.randrange(5)}"
        rows.append([i, w])
    for i in range(40):                        # copies of some, one or two words changed
        w = list(rows[i * 31][1])
        w[rng.randrange(120)] = "other"
        rows.append([5000 + i, w])
    rows = [(i, " ".join(w), 1, "x") for i, w in rows]
    names: dict = {}
    sets = [{names.setdefault(tuple(w[j : j + 4]), len(names)) for j in range(len(w) - 3)} for w in (t.split() for _, t, *_ in rows)]
    x = np.zeros((len(sets), len(names)), np.float32)
    for r, held in enumerate(sets):
        x[r, list(held)] = 1
    inter, size = x @ x.T, x.sum(axis=1)
    link = 100 * inter >= 85 * (size[:, None] + size[None, :] - inter)
    comp = {i: i for i, *_ in rows}
    for _ in range(3):
        for a, b in zip(*np.nonzero(np.triu(link, 1))):
            least = min(comp[rows[a][0]], comp[rows[b][0]])
            comp[rows[a][0]] = comp[rows[b][0]] = least
    got = result(jaccard.jaccard_join(spark.createDataFrame(rows, SCHEMA)))
    assert got == {(r[0], len(s), comp[r[0]]) for r, s in zip(rows, sets)}
    assert len(set(comp.values())) > 2200


def test_postings_move_once(spark, monkeypatch):
    plans, kept = {}, jaccard.saved

    def saved(df, name):
        plans[name] = df._jdf.queryExecution().toString()
        return kept(df, name)

    monkeypatch.setattr(jaccard, "saved", saved)
    rows = [(1, "a b c d e", 1, "x"), (2, "a b c d e f", 1, "x"), (2, "a b c d e f", 1, "x"), (3, "g h i j", 1, "x")]
    signed = jaccard.signatures(spark.createDataFrame(rows, SCHEMA), np.zeros(1 << jaccard.TABLE_BITS, np.int64), 50)
    held, _ = jaccard.clusters(kept(signed, "signed"), 50)
    physical = plans["shared"].split("== Physical Plan ==")[1]
    assert physical.count("Exchange") == 1 and "Join" not in physical
    got = held.groupBy("token").count().collect()
    assert got and all(r["count"] == 2 for r in got)


def test_stars_take_no_round(spark, monkeypatch):
    """Rounds end with the first whose edges are stars; a round that changes nothing is not run."""
    from leafwise.llm import components as module

    names, kept = [], module.saved
    monkeypatch.setattr(module, "saved", lambda df, name: names.append(name) or kept(df, name))
    stars = [(1, 2), (3, 1), (1, 9), (9, 1), (20, 21), (7, 7)]
    got = {tuple(r) for r in components(spark.createDataFrame(stars, "u long, v long")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (9, 1), (20, 20), (21, 20)} and names == ["edges"]
    names.clear()
    got = {tuple(r) for r in components(spark.createDataFrame([(1, 5), (5, 3), (3, 8)], "u long, v long")).collect()}
    assert got == {(i, 1) for i in (1, 3, 5, 8)} and names[-1] == "small_star"


def test_small_clusters_need_no_second_components(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(jaccard, "components", lambda edges: calls.append(1) or components(edges))
    rows = corpus(groups=3)
    assert result(jaccard.jaccard_join(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert len(calls) == 1


def test_many_strays_by_first_partners(spark, monkeypatch):
    """Above FEW pairs the strays go by one partner each first: the same components."""
    names, kept = [], jaccard.saved
    monkeypatch.setattr(jaccard, "saved", lambda df, name: names.append(name) or kept(df, name))
    monkeypatch.setattr(jaccard, "FEW", 0)
    rows = corpus(groups=4)
    assert result(jaccard.jaccard_join(spark.createDataFrame(rows, SCHEMA), block=3)) == brute(rows)
    assert "first_pairs" in names


def test_tasks_follow_rows(spark):
    from leafwise.llm.common import no_wider

    wide = spark.range(1000).repartition(40)
    assert no_wider(wide, 1000, 500).rdd.getNumPartitions() == 8
    assert no_wider(wide, 1000, 50).rdd.getNumPartitions() == 20
    assert no_wider(wide, 1000, 1).rdd.getNumPartitions() == 40
    assert no_wider(wide, 1000, 500).count() == 1000
