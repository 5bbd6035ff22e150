"""Exponential moving average over ordered series, without gathering a series.

Recurrence: ``e_0 = x_0``, ``e_i = a·x_i + (1-a)·e_(i-1)``, a chain of affine
maps ``e -> r·e + a·x_i`` with ``r = 1-a``.  Maps compose, so a run of ``n``
rows folds to one pair ``(r^n, s)``, where ``s`` is the run's average started
at zero.

1. One shuffle: rows are range-partitioned and sorted by (series, order).
2. Each partition streams its sorted rows once.  A series that begins inside
   the partition is final at once.  Only the partition's first series can
   have begun earlier: its rows get the average started at zero and the
   weight ``r^(j+1)`` of the value still to come.  The rows are written with
   two marks per partition, the fold of its first series and the last value
   of its last one.
3. The marks (two per partition, whatever the number of rows or series) are
   composed in partition order into the value that enters each partition, and
   pending rows add ``weight · value``: a broadcast of one row per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from leafwise.operators.reshape import melt
from leafwise.operators.scan import target_partitions
from leafwise.session import scratch_dir

# Weights below this are nothing beside a double's last digit.
LEAST_WEIGHT = 1e-25


def decayed_sums(x, place, r: float):
    """``Σ_{i<=j} r^(j-i)·x_i`` within every segment, in log2 steps over the whole array.

    ``place`` is each row's position in its segment.  A step adds the sums
    that end ``step`` rows earlier; it stops when their weight is below
    ``LEAST_WEIGHT``.
    """
    import numpy as np

    out = x.copy()
    step, weight = 1, r
    while step < len(x) and weight > LEAST_WEIGHT:
        more = np.where(place[step:] >= step, out[:-step] * weight, 0.0)
        out[step:] += more
        step, weight = 2 * step, weight * weight
    return out


class _Run:
    """What is known of the series being read: its rows so far, its average started at zero, its first value."""

    def __init__(self) -> None:
        self.n, self.end, self.start = 0, 0.0, None

    def add(self, n: int, end: float, start: float) -> None:
        if n:
            self.start = start if self.start is None else self.start
            self.n, self.end = self.n + n, end


EXTRA = StructType([
    StructField("average", DoubleType()), StructField("weight", DoubleType()), StructField("mark", IntegerType()),
    StructField("pid", IntegerType()), StructField("n", LongType()), StructField("start", DoubleType()),
])


def _kernel(names: list[str], series: str, alpha: float):
    """Streams one sorted partition: its rows with average and weight (mark 0), then the marks of its first (1) and last (2) series.

    The column after ``names`` holds the value as double.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        r = 1.0 - alpha
        pid = TaskContext.get().partitionId()

        def out(batch, average, weight, mark, n=0, start=None):
            size = batch.num_rows
            more = [
                average, weight,
                pa.array(np.full(size, mark, np.int32)), pa.array(np.full(size, pid, np.int32)),
                pa.array(np.full(size, n, np.int64)), pa.array([start] * size, pa.float64()),
            ]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *more], names=[*names, *EXTRA.names])

        none = pa.array([None], pa.float64())
        first = last = head = None            # first and last row; fold of the first series, once it has ended
        now = _Run()
        for batch in batches:
            if not batch.num_rows:
                continue
            if first is None:
                first = batch.slice(0, 1)
            elif not _same(last.column(series)[0].as_py(), batch.column(series)[0].as_py()):
                head, now = head or now, _Run()
            last = batch.slice(batch.num_rows - 1, 1)
            key = pc.dictionary_encode(batch.column(series), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            value = batch.column(len(names))
            there = pc.is_valid(value).to_numpy(zero_copy_only=False)
            x = value.to_numpy(zero_copy_only=False)[there]
            segment = np.r_[0, np.cumsum(key[1:] != key[:-1])]
            seg, tail = segment[there], segment[-1]
            count = np.bincount(seg, minlength=tail + 1)
            begin = np.cumsum(count) - count
            place = np.arange(len(x)) - begin[seg]
            fold = decayed_sums(alpha * x, place, r)
            lead = slice(0, count[0])         # rows that continue the series of the last batch
            fold[lead] += r ** (place[lead] + 1.0) * now.end
            place[lead] += now.n
            weight = r ** (place + 1.0)
            entry = np.full(tail + 1, np.nan)
            entry[count > 0] = x[begin[count > 0]]
            entry[0] = entry[0] if now.start is None else now.start
            pending = (seg == 0) & (head is None)
            average, hang, waits = np.zeros(batch.num_rows), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            average[there] = np.where(pending, fold, fold + weight * entry[seg])
            hang[there], waits[there] = weight, pending
            yield out(batch, pa.array(average, mask=~there), pa.array(hang, mask=~waits), 0)
            for s in {0, int(tail)}:
                if s:
                    head, now = head or now, _Run()
                ends = begin[s] + count[s] - 1
                now.add(int(count[s]), float(fold[ends]) if count[s] else 0.0, float(entry[s]))
        if first is None:
            return
        if head is not None:
            final = None if now.start is None else now.end + r**now.n * now.start
            yield out(last, pa.array([final], pa.float64()), none, 2)
        head = head or now
        yield out(first, pa.array([head.end]), none, 1, head.n, head.start)

    return run


def _same(a, b) -> bool:
    """Equal keys; NULL equals NULL and NaN equals NaN."""
    return a == b or (a != a and b != b)


def _entering(marks: list, r: float) -> dict[int, float]:
    """The value that enters each partition's first series, from the marks in order of partition."""
    by_partition: dict[int, dict] = {}
    for m in marks:
        by_partition.setdefault(m["pid"], {})[m["mark"]] = m
    out: dict[int, float] = {}
    key, value, seen = None, None, False   # of the last series so far
    for pid in sorted(by_partition):
        head, tail = by_partition[pid][1], by_partition[pid].get(2)
        enters = value if seen and _same(key, head["key"]) else None
        enters = head["start"] if enters is None else enters
        if enters is not None:
            out[pid] = enters
        if tail is not None:
            key, value = tail["key"], tail["average"]
        else:
            key, value = head["key"], None if enters is None else head["average"] + r ** head["n"] * enters
        seen = True
    return out


def ema(df: DataFrame, series: str, order: list[str], value: str, alpha: float = 0.1, out: str = "ema",
        num_partitions: int | None = None) -> DataFrame:
    """Add column ``out``: EMA of ``value`` per ``series`` in ``order``.

    ``order`` must be unique within a series.  The result is always double.
    Rows whose value is NULL are not part of the recurrence (the series
    continues over them) and are returned with a NULL ``out``.  The rows of
    a NULL ``series`` are one series.  One plan serves series of any length;
    its sums are taken in parallel, so the last digits may differ from a
    loop's.  Columns may have any names.
    """
    if not 0.0 < alpha <= 1.0:
        raise ValueError("alpha must be in (0, 1]")
    if alpha == 1.0:
        return df.withColumn(out, F.col(f"`{value}`").cast("double"))
    spark = df.sparkSession
    names = [f"c{i}" for i in range(len(df.columns))]
    own = dict(zip(df.columns, names))
    keys = [own[c] for c in (series, *order)]
    rows = df.toDF(*names).repartitionByRange(num_partitions or target_partitions(df), *keys).sortWithinPartitions(*keys)
    schema = StructType([*rows.schema.fields, *EXTRA.fields])
    path = scratch_dir(spark, "ema")
    rows.withColumn("value", F.col(own[value]).cast("double")).mapInArrow(_kernel(names, own[series], alpha), schema).write.parquet(path)
    done = spark.read.schema(schema).parquet(path)
    marks = done.where("mark > 0").select(F.col(own[series]).alias("key"), *EXTRA.names).collect()  # two a partition at most
    enter = spark.createDataFrame(list(_entering(marks, 1.0 - alpha).items()), "at int, enters double")
    joined = done.where("mark = 0").join(F.broadcast(enter), F.col("pid") == F.col("at"), "left")
    result = F.when(F.col("weight").isNull(), F.col("average")).otherwise(F.col("average") + F.col("weight") * F.col("enters"))
    return joined.select(*[F.col(own[c]).alias(c) for c in df.columns if c != out], result.alias(out))


# Display labels of the training-log reward series.
REWARD_LABELS = {
    "reward": "Total Reward",
    "rewards/confident_score_func": "Confidence-alignment",
    "rewards/correctness_rewards": "Correctness",
    "rewards/int_reward_func": "Interpretability",
    "rewards/soft_format_reward_func": "Soft format compliance",
    "rewards/xmlcount_reward_func": "XML format",
}


def reward_series(log: DataFrame, order: list[str], labels: dict[str, str] | None = None, alpha: float = 0.05,
                  num_partitions: int | None = None) -> DataFrame:
    """Several logged value columns → long ``(metric, label, order..., raw, smoothed)``.

    Each column becomes one series, smoothed independently.
    """
    labels = REWARD_LABELS if labels is None else labels
    cols = list(labels)
    wide = log.select(*order, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    long = melt(wide, order, cols, "metric", "raw")
    smoothed = ema(long, "metric", order, "raw", alpha=alpha, out="smoothed", num_partitions=num_partitions)
    label_map = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])
    return smoothed.withColumn("label", label_map[F.col("metric")])
