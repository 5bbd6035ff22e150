import random

import pytest
from pyspark.errors import PySparkException
from py4j.protocol import Py4JJavaError

from leafwise.operators.knn import knn_leave_one_out, knn_query_ref, neighbor_lists


def brute_knn(q_rows, r_rows, k, exclude_self):
    out = []
    for qid, qv in q_rows:
        for cls in (0, 1):
            cands = []
            for rid, lab, rv in r_rows:
                if lab != cls or (exclude_self and rid == qid):
                    continue
                cnt = sum(a != b for a, b in zip(qv, rv))
                cands.append((cnt, rid))
            cands.sort()
            for rank, (cnt, rid) in enumerate(cands[:k], 1):
                out.append((qid, cls, rank, rid, cnt / len(qv)))
    return sorted(out)


def fixture_rows():
    rng = random.Random(11)
    rows = [(i, i % 2, [rng.randint(0, 3) for _ in range(6)]) for i in range(40)]
    rows.append((100, 1, list(rows[0][2])))          # duplicate vector, other id
    rows.append((101, 0, [9, 9, 9, 9, 9, 9]))        # shares no leaf with anyone
    return rows


@pytest.mark.parametrize("cell,symmetric", [(7, True), (16, True), (1000, True), (7, False), (16, False)])
def test_leave_one_out_matches_brute_force(spark, cell, symmetric):
    rows = fixture_rows()
    df = spark.createDataFrame(rows, "id long, label int, leaves array<int>")
    got = sorted(map(tuple, knn_leave_one_out(df, k=5, cell_size=cell, symmetric=symmetric).collect()))
    exp = brute_knn([(i, v) for i, _, v in rows], rows, 5, True)
    assert got == exp
    assert any(r[4] == 0.0 and {r[0], r[3]} == {0, 100} for r in got)   # duplicate kept at 0
    assert any(r[0] == 101 and r[4] == 1.0 for r in got)                   # completion at distance 1


def test_small_classes_and_large_k(spark):
    rows = [(1, 1, [0, 1]), (2, 0, [0, 0]), (3, 0, [1, 1]), (4, 0, [1, 0]), (5, 0, [0, 1])]
    df = spark.createDataFrame(rows, "id long, label int, leaves array<int>")
    got = sorted(map(tuple, knn_leave_one_out(df, k=10, cell_size=2).collect()))
    assert got == brute_knn([(i, v) for i, _, v in rows], rows, 10, True)
    # class 1 has one member: it has no approved neighbour of its own
    assert not [r for r in got if r[0] == 1 and r[1] == 1]


def test_empty_class_gives_empty_list(spark):
    rows = [(1, 0, [0, 1]), (2, 0, [1, 1])]
    df = spark.createDataFrame(rows, "id long, label int, leaves array<int>")
    lists = {r["qid"]: r for r in neighbor_lists(knn_leave_one_out(df, k=5), df).collect()}
    assert lists[1]["approved_neighbors"] == [] and lists[1]["unapproved_neighbors"] == [2]


def test_query_ref_has_no_self_exclusion(spark):
    rows = fixture_rows()
    ref = spark.createDataFrame(rows, "id long, label int, leaves array<int>")
    got = sorted(map(tuple, knn_query_ref(ref.select("id", "leaves"), ref, k=3, cell_size=9).collect()))
    assert got == brute_knn([(i, v) for i, _, v in rows], rows, 3, False)


def test_bad_label_raises(spark):
    df = spark.createDataFrame([(1, 2, [0]), (2, 0, [1])], "id long, label int, leaves array<int>")
    with pytest.raises((PySparkException, Py4JJavaError, Exception)):
        knn_leave_one_out(df).collect()


def test_identical_vectors_one_class(spark):
    # every row shares every leaf and one class holds all rows: the grid plan
    # is unaffected (cells are sized by rows, not by leaf popularity)
    rows = [(i, 1, [3, 3, 3, 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label int, leaves array<int>")
    got = knn_leave_one_out(df, k=5, cell_size=64)
    assert got.count() == 300 * 5
    first = sorted((r["rank"], r["nid"], r["dist"]) for r in got.where("qid = 0").collect())
    assert first == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, 0.0), (4, 4, 0.0), (5, 5, 0.0)]
    assert got.where("cls = 0").count() == 0


def test_pack_roundtrip(spark):
    import numpy as np

    from leafwise.operators.knn import pack_leaves, unpack_leaves

    rows = [([0, -1, 32767, -32768],), ([5, 70000, -70000, 3],), ([1, 2, 3, 4],)]
    df = spark.createDataFrame(rows, "v array<int>")
    blobs = [r[0] for r in df.select(pack_leaves("v")).collect()]
    assert len(blobs[0]) == 1 + 2 * 4 and len(blobs[1]) == 1 + 4 * 4
    assert unpack_leaves(blobs).tolist() == [r[0] for r in rows]
    assert unpack_leaves([blobs[0], blobs[2]]).tolist() == [rows[0][0], rows[2][0]]


def test_symmetric_kernel_chunks_match_brute_force(monkeypatch):
    """The cell kernel in-process with tiny query chunks: the transposed
    candidates of the hi block are merged across chunks exactly."""
    import numpy as np
    import pandas as pd

    from leafwise.operators import knn as K

    monkeypatch.setattr(K, "_QUERY_CHUNK", 7)
    rng = np.random.default_rng(3)
    n, width = 60, 5
    leaves = rng.integers(0, 3, size=(n, width))
    ids = rng.permutation(1000)[:n].astype(np.int64)
    cls = rng.integers(0, 2, n)
    blk = np.where(np.arange(n) < 25, 0, 1)

    def pack(v):
        return b"\x00" + b"".join(int(x).to_bytes(2, "big", signed=True) for x in v)

    lists = {c: [[int(i)] if x == c else [] for i, x in zip(ids, cls)] for c in (0, 1)}
    pdf = pd.DataFrame({"qv": ids, "qid": ids, "packed": [pack(v) for v in leaves], "ids1": lists[1], "ids0": lists[0], "blk": blk, "lo": 0, "hi": 1})
    got = K._symmetric_kernel(3)(pdf)
    # merge like the final window: k best per (query, cls) by (cnt, nid)
    got = got.sort_values(["qv", "cls", "cnt", "nid"]).groupby(["qv", "cls"]).head(3)
    got_set = {(int(r.qv), int(r.cls), int(r.nid), int(r.cnt)) for r in got.itertuples()}
    exp = set()
    for i in range(n):
        for c in (0, 1):
            other = [j for j in range(n) if blk[j] != blk[i] and cls[j] == c]
            cand = sorted((int((leaves[i] != leaves[j]).sum()), int(ids[j])) for j in other)[:3]
            exp |= {(int(ids[i]), c, nid, cnt) for cnt, nid in cand}
    assert got_set == exp


def test_grid_copies_the_large_side_once():
    from leafwise.operators.knn import _grid

    qb, rb = _grid(3000, 10**9, 4096, 2000)
    assert qb == 1 and rb >= 2000
    qb, rb = _grid(2000, 2000, 4096, 16)
    assert 8 <= qb * rb <= 32


def test_null_leaf_raises(spark):
    from leafwise.operators.knn import knn_leave_one_out

    rows = spark.createDataFrame([(0, 0, [1, None, 3]), (1, 0, [1, 3, 3])], "id long, label int, leaves array<int>")
    with pytest.raises(Exception, match="NULL leaf"):
        knn_leave_one_out(rows, k=1).collect()


def test_strings_to_neighbors_searches_every_text(spark, tmp_path, monkeypatch):
    from leafwise.operators import knn as K
    from leafwise.registry import QUERIES

    sides = []
    whole = K.knn_per_class
    monkeypatch.setattr(K, "knn_per_class", lambda q, r, **kw: (sides.extend([q, r]), whole(q, r, **kw))[1])

    rows = [(i, None if i == 39 else f"text {'abcdefgh'[i % 8] * 5} number {i}") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i // 2 % 2) for i in range(0, 30, 2)] + [(i, 1) for i in (31, 33)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = QUERIES["strings_to_neighbors"](spark, str(tmp_path)).collect()
    assert {r["qid"] for r in got} == set(range(39))
    assert {r["nid"] for r in got} <= {*range(0, 30, 2), 31, 33}
    assert all(r["qid"] != r["nid"] for r in got)
    counts = {q: sum(r["qid"] == q for r in got) for q in range(39)}
    assert set(counts.values()) == {10}
    # brute force on the leaves that were written
    queries = [(r["id"], r["leaves"]) for r in sides[0].collect()]
    known = [(r["id"], r["label"], r["leaves"]) for r in sides[1].collect()]
    want = [(q, c, k, n, round(d * 1e6) / 1e6) for q, c, k, n, d in brute_knn(queries, known, 5, True)]
    assert sorted((r["qid"], r["cls"], r["rank"], r["nid"], r["dist"]) for r in got) == want


SCHEMA = "id long, label int, leaves array<int>"


def near_copies(n, width, alphabet, seed=2, centres=6):
    """Vectors scattered around a few centres, so that some neighbours are near."""
    rng = random.Random(seed)
    at = [[rng.randrange(alphabet) for _ in range(width)] for _ in range(centres)]
    return [(i, rng.randrange(2), [x if rng.random() < 0.8 else rng.randrange(alphabet) for x in rng.choice(at)]) for i in range(n)]


@pytest.mark.parametrize("alphabet,list_limit,candidates", [(500, 4096, 16384), (500, 30, 60), (5, 12, 100), (40, 1, 5), (3, 0, 0)])
def test_index_matches_brute_force(spark, alphabet, list_limit, candidates):
    rows = near_copies(80, 9, alphabet)
    rows += [(200, 1, [alphabet + i for i in range(9)]), (201, 0, [-5] * 9), (202, 1, rows[0][2]), (203, 0, rows[0][2])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = knn_leave_one_out(df, k=4, cell_size=16, method="index", list_limit=list_limit, candidates=candidates)
    assert sorted(map(tuple, got.collect())) == brute_knn([(i, v) for i, _, v in rows], rows, 4, True)
    queries = [(1000 + i, v) for i, _, v in near_copies(30, 9, alphabet, seed=3)] + [(1, rows[0][2]), (5000, [9999] * 9)]
    q = spark.createDataFrame(queries, "id long, leaves array<int>")
    got = knn_query_ref(q, df, k=3, cell_size=16, method="index", list_limit=list_limit, candidates=candidates)
    assert sorted(map(tuple, got.collect())) == brute_knn(queries, rows, 3, False)


def test_index_settles_near_queries_and_leaves_far_ones(spark):
    from leafwise.operators import knn as K

    rows = near_copies(120, 12, 1000)
    base = spark.createDataFrame(rows, SCHEMA).select("id", K.class_of().alias("cls"), K.pack_leaves("leaves").alias("packed"))
    vectors = K.collapse(None, base, 3, 10**6)
    out = K._index(vectors, vectors, vectors.count(), 3, 64, 12, 24)
    assert 0 < out.where("open").count() < out.count()
    whole = K._index(vectors, vectors, vectors.count(), 3, 64, 10**6, 10**6)
    assert whole.where("open").count() == 0


@pytest.mark.parametrize("method", ["grid", "index"])
def test_repeated_vectors_are_searched_once(spark, method, monkeypatch):
    from leafwise.operators import knn as K

    monkeypatch.setattr(K, "GATHERED", 50)      # ids of one vector come together in parts
    base = near_copies(12, 6, 4)
    rows = [(10**15 + 7 * i, i % 2, base[i % 12][2]) for i in range(240)]     # 95 % repeats
    df = spark.createDataFrame(rows, SCHEMA)
    packed = df.select("id", K.class_of().alias("cls"), K.pack_leaves("leaves").alias("packed"))
    vectors = K.collapse(None, packed, 6, 240).collect()
    assert len(vectors) == len({tuple(v) for _, _, v in base}) and max(len(r["ids1"]) for r in vectors) <= 6
    got = knn_leave_one_out(df, k=5, method=method)
    assert sorted(map(tuple, got.collect())) == brute_knn([(i, v) for i, _, v in rows], rows, 5, True)
    q = df.where("label = 1").select("id", "leaves")
    got = knn_query_ref(q, df, k=2, method=method)
    assert sorted(map(tuple, got.collect())) == brute_knn([(i, v) for i, c, v in rows if c == 1], rows, 2, False)


@pytest.mark.parametrize("method", ["grid", "index"])
def test_null_and_large_ids(spark, method):
    big = 2**53 + 1
    rows = [(big, 1, [1, 2, 3]), (big + 1, 1, [1, 2, 3]), (big + 2, 0, [1, 2, 4]), (7, 0, [9, 9, 9]), (big + 4, 1, [1, 5, 3])]
    with_null = [*rows, (None, 1, [1, 2, 3]), (8, 0, None), (None, 0, None)]
    df = spark.createDataFrame(with_null, SCHEMA)
    got = sorted(map(tuple, knn_leave_one_out(df, k=2, method=method).collect()))
    assert got == brute_knn([(i, v) for i, _, v in rows], rows, 2, True)
    got = sorted(map(tuple, knn_query_ref(df, df, k=2, method=method).collect()))
    assert got == brute_knn([(i, v) for i, _, v in rows], rows, 2, False)


def test_rows_repeated_whole_count_once(spark):
    rows = [(1, 1, [1, 1]), (2, 1, [1, 1]), (3, 0, [1, 2]), (4, 0, [3, 3])]
    df = spark.createDataFrame([*rows, *[rows[0]] * 9, *[rows[2]] * 4], SCHEMA)
    got = set(map(tuple, knn_leave_one_out(df, k=2).collect()))
    assert got == set(brute_knn([(i, v) for i, _, v in rows], rows, 2, True))


@pytest.mark.parametrize("method", ["grid", "index"])
def test_empty_sides(spark, method):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, 1, [1, 2])], SCHEMA)
    for q, r in ((none, some), (some, none), (none, none)):
        assert knn_query_ref(q, r, method=method).count() == 0
    assert knn_leave_one_out(none, method=method).count() == knn_leave_one_out(some, method=method).count() == 0


def test_counts_by_bits_are_exact():
    import numpy as np

    from leafwise.operators import knn as K

    rng = np.random.default_rng(4)
    for low, high, width in ((-5, 5, 64), (0, 2, 3), (-70000, 70000, 70), (0, 1, 64), (-1, 63, 589)):
        q, r = rng.integers(low, high, (30, width)), rng.integers(-3, 3, (5000, width))
        r[:30, width // 3 :] = q[:, width // 3 :]
        assert (K._counter(q, r)(slice(3, 30)) == (q[3:, None] != r[None]).sum(2)).all()


@pytest.mark.parametrize("cells,batch", [((1, 1), 10000), ((2, 3), 7), ((1, 100), 5)])
def test_streamed_grid_matches_brute_force(spark, cells, batch, monkeypatch):
    """Blocks of unequal size whose vectors come in several batches; a vector with rows of both classes."""
    from leafwise.operators import knn as K

    for name, value in (("QUERY_CELLS", cells[0]), ("READ_CELLS", cells[1]), ("SYMMETRIC_CELLS", 0), ("MIN_CELL", 8), ("_QUERY_CHUNK", 3)):
        monkeypatch.setattr(K, name, value)
    rows = [*fixture_rows(), *((200 + i, i % 2, fixture_rows()[5][2]) for i in range(9)), (300, 1, [9] * 6)]
    df = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted(map(tuple, knn_leave_one_out(df, k=4, cell_size=11, method="grid").collect()))
        assert got == brute_knn([(i, v) for i, _, v in rows], rows, 4, True)
        q = df.where("id < 20").select("id", "leaves")
        got = sorted(map(tuple, knn_query_ref(q, df, k=3, cell_size=11, method="grid").collect()))
        assert got == brute_knn([(i, v) for i, _, v in rows if i < 20], rows, 3, False)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_grid_copies_grow_slowly():
    """At 600,000 vectors a vector is copied to some tens of cells, not to one per 4,096 vectors."""
    from leafwise.operators import knn as K

    qb, rb = K._grid(600_000, 600_000, K.QUERY_CELLS * K.DEFAULT_CELL, 48, K.READ_CELLS * K.DEFAULT_CELL)
    assert qb + rb <= 20 and 48 <= qb * rb <= 100


def test_index_that_settles_nothing_is_not_used(spark, monkeypatch):
    from leafwise.operators import knn as K

    monkeypatch.setattr(K, "PROBE", 10)
    asked = []
    index = K._index
    monkeypatch.setattr(K, "_index", lambda q, v, nq, *a: (asked.append(q.count()), index(q, v, nq, *a))[1])
    rng = random.Random(3)
    rows = [(i, i % 2, [rng.randint(0, 2) for _ in range(8)]) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, knn_leave_one_out(df, k=3, cell_size=4, list_limit=4, candidates=8).collect()))
    assert got == brute_knn([(i, v) for i, _, v in rows], rows, 3, True)
    assert len(asked) == 1 and asked[0] < 40
