import math
import random

import pytest

from leafwise.operators.series import ema


def loop_ema(xs, a):
    out = [float(xs[0])]
    for x in xs[1:]:
        out.append(a * x + (1 - a) * out[-1])
    return out


@pytest.mark.parametrize("n,alpha", [(1, 0.1), (4, 0.1), (5, 0.999999), (9, 0.3), (57, 0.05), (300, 0.0001)])
def test_ema_matches_loop(spark, n, alpha):
    rng = random.Random(n)
    rows = [(s, i, rng.uniform(-50, 50)) for s in ("a", "b") for i in range(n)]
    df = spark.createDataFrame(rows, "s string, i long, x double")
    got = {(r["s"], r["i"]): r["e"] for r in ema(df, "s", ["i"], "x", alpha=alpha, out="e", num_partitions=3).collect()}
    for s in ("a", "b"):
        xs = [x for ss, _, x in rows if ss == s]
        for i, e in enumerate(loop_ema(xs, alpha)):
            assert math.isclose(got[(s, i)], e, rel_tol=1e-9, abs_tol=1e-9)


def test_integer_input_and_alpha_one(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([3, 1, 4, 1, 5])], "s string, i long, x int")
    got = [r["e"] for r in ema(df, "s", ["i"], "x", alpha=0.5, out="e").orderBy("i").collect()]
    assert all(math.isclose(a, b) for a, b in zip(got, loop_ema([3, 1, 4, 1, 5], 0.5)))   # doubles, not truncated
    one = [r["e"] for r in ema(df, "s", ["i"], "x", alpha=1.0, out="e").orderBy("i").collect()]
    assert one == [3.0, 1.0, 4.0, 1.0, 5.0]


def test_alpha_range():
    with pytest.raises(ValueError):
        ema(None, "s", ["i"], "x", alpha=0.0)


def test_null_values_skip_the_recurrence(spark):
    rows = [("a", 0, 2.0), ("a", 1, None), ("a", 2, 4.0)]
    df = spark.createDataFrame(rows, "s string, i long, x double")
    got = {r["i"]: r["e"] for r in ema(df, "s", ["i"], "x", alpha=0.5, out="e").collect()}
    assert got == {0: 2.0, 1: None, 2: 3.0}


def test_null_series_is_a_series(spark):
    rows = [(s, i, float(i + k)) for k, s in enumerate(("a", None)) for i in range(40)]
    df = spark.createDataFrame(rows, "s string, i long, x double")
    got = {(r["s"], r["i"]): r["e"] for r in ema(df, "s", ["i"], "x", alpha=0.05, out="e", num_partitions=3).collect()}
    assert len(got) == 80
    for s in ("a", None):
        for i, e in enumerate(loop_ema([x for t, _, x in rows if t == s], 0.05)):
            assert math.isclose(got[(s, i)], e, rel_tol=1e-12)


@pytest.mark.parametrize("batch,parts", [(3, 7), (1, 4), (1000, 7), (5, 1)])
def test_series_across_partitions_and_batches(spark, batch, parts):
    rng = random.Random(batch)
    rows = []
    for s, n in ((None, 5), ("a", 90), ("b", 1), ("c", 2), ("d", 41), ("e", 3)):
        # runs of NULL values at both ends and inside; one series has no value at all
        rows += [(s, i, None if s == "c" or i < 2 < n or i > n - 9 and n > 40 or 20 < i < 50 else rng.uniform(-9, 9), "v", 1) for i in range(n)]
    df = spark.createDataFrame(rows, "`_i` string, c0 long, `value` double, pid string, mark int")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(batch))
    try:
        out = ema(df, "_i", ["c0"], "value", alpha=0.07, out="average", num_partitions=parts)
        assert out.columns == [*df.columns, "average"]
        got = {(r["_i"], r["c0"]): r for r in out.collect()}
    finally:
        spark.conf.set(key, before)
    assert len(got) == len(rows)
    for s in {r[0] for r in rows}:
        present = [(i, x) for t, i, x, _, _ in rows if t == s and x is not None]
        want = dict(zip([i for i, _ in present], loop_ema([x for _, x in present], 0.07))) if present else {}
        for t, i, x, _, _ in rows:
            if t == s:
                e = got[(s, i)]["average"]
                assert (e is None) == (x is None) and (x is None or math.isclose(e, want[i], rel_tol=1e-12, abs_tol=1e-12))


def test_ema_has_one_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 s", "id i", "rand(1) x")
    out = ema(df, "s", ["i"], "x", out="x")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") == 0 and out.columns == ["s", "i", "x"]


def test_ema_of_no_rows(spark):
    assert ema(spark.createDataFrame([], "s string, i long, x double"), "s", ["i"], "x").count() == 0


def test_nan_stays_in_its_series(spark):
    rows = [(s, i, float("nan") if (s, i) == ("a", 2) else float(i)) for s in "ab" for i in range(5)]
    got = {(r["s"], r["i"]): r["e"] for r in ema(spark.createDataFrame(rows, "s string, i long, x double"), "s", ["i"], "x", alpha=0.5, out="e", num_partitions=2).collect()}
    assert [math.isnan(got["a", i]) for i in range(5)] == [False, False, True, True, True]
    assert [got["b", i] for i in range(5)] == loop_ema([0.0, 1, 2, 3, 4], 0.5)
