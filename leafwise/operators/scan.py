"""Distributed ordered scans (prefix sums) without one-partition windows.

A ``Window.partitionBy(group).orderBy(...)`` puts a whole group into one task.
When one group can hold a third of all rows, that task is the job.  Here the
rows are range-partitioned on ``(group, order)`` so a large group is spread
over many partitions; each partition computes its local running sums and a
small table of per-partition totals supplies the offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PID = "_pid"


def join_groups(left: DataFrame, right: DataFrame, exact: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a NULL in a ``by`` column is a key like any other.

    Returns the columns of ``left`` and those of ``right`` that are no key.
    """
    l, r = left.alias("l"), right.alias("r")
    cond = F.lit(True)
    for c in exact:
        cond &= F.col(f"l.`{c}`") == F.col(f"r.`{c}`")
    for c in by:
        cond &= F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
    extra = [c for c in right.columns if c not in (*exact, *by)]
    return l.join(r, cond, how).select(*[F.col(f"l.`{c}`") for c in left.columns], *[F.col(f"r.`{c}`") for c in extra])


#: A group of this many rows, or of 1/HEAVY of all, is joined by broadcast.
HEAVY = 1000


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "left") -> DataFrame:
    """``rows`` joined with one row per ``key`` of ``groups`` (written before), hot keys without a skewed shuffle.

    ``size`` counts a group's rows.  At most ``HEAVY`` groups hold that share
    of the rows, so those few are broadcast; the others join by shuffle.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    bar = F.lit(max(HEAVY, total / HEAVY))
    side, few = groups.where(F.col(size) < bar).drop(size), groups.where(F.col(size) >= bar).drop(size)
    if few.isEmpty():
        return rows.join(side, key, how)
    hot = rows.join(F.broadcast(few), key)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti")
    return hot.unionByName(rest.join(side, key, how))


def target_partitions(df: DataFrame) -> int:
    """Partition count for a sort-based step: at least the shuffle setting,
    and enough that each partition holds about ``spark.sql.files.maxPartitionBytes``
    of the plan's estimated size (Catalyst statistics, no job is run)."""
    spark = df.sparkSession
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        plan = df._jdf.queryExecution().optimizedPlan()
        size = int(str(plan.stats().sizeInBytes()))
        # Without CBO a join's estimate is the product of its inputs; the
        # sum of the scanned relations bounds non-exploding plans far better.
        leaves = plan.collectLeaves()
        scanned = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
        size = min(size, scanned)
        per = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    except Exception:  # noqa: BLE001 - statistics are an estimate; fall back to the setting
        return base
    if size >= 1 << 60:  # an input without statistics is given the largest number
        return base
    return int(max(base, -(-size // max(per, 1))))


def range_partitioned(df: DataFrame, keys: list[str], num_partitions: int | None = None) -> DataFrame:
    """Range-partition on ``keys``, checkpoint, and tag rows with the partition id.

    The reliable checkpoint (in ``spark.checkpoint.dir``) fixes the partition
    boundaries: range bounds come from sampling, so without it the two uses of
    the result below could see different partitionings.  It also cuts lineage,
    so a lost executor re-reads the checkpoint instead of re-sorting.
    """
    from leafwise.session import checkpoint_root

    spark = df.sparkSession
    checkpoint_root(spark)
    n = num_partitions or target_partitions(df)
    ranged = df.repartitionByRange(n, *keys).checkpoint(eager=True)
    return ranged.withColumn(PID, F.spark_partition_id())


def prefix_sums(df: DataFrame, by: list[str], order: list[str], values: list[str], suffix: str = "_before",
                num_partitions: int | None = None) -> DataFrame:
    """Add ``{v}{suffix}`` = sum of ``v`` over earlier rows of the same ``by``
    group in ``order`` (exclusive).  ``order`` must be unique within a group.
    """
    ranged = range_partitioned(df, [*by, *order], num_partitions)
    w_local = Window.partitionBy(PID, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns({f"_l_{v}": F.coalesce(F.sum(v).over(w_local), F.lit(0)) for v in values})
    totals = ranged.groupBy(PID, *by).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    w_off = Window.partitionBy(*by).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(PID, *by, *[F.coalesce(F.sum(f"_t_{v}").over(w_off), F.lit(0)).alias(f"_o_{v}") for v in values])
    joined = join_groups(local, offsets, [PID], by)
    return joined.select(
        *df.columns,
        *[(F.col(f"_l_{v}") + F.col(f"_o_{v}")).alias(f"{v}{suffix}") for v in values],
    )


def row_index(df: DataFrame, by: list[str], order: list[str], name: str = "idx",
              num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row within its ``by`` group in ``order``.

    No window and no second shuffle of the rows: after the range partition,
    a sort within partitions and the checkpoint, ``monotonically_increasing_id``
    is ``partition << 33 | position in partition`` and is stable (the
    checkpoint fixes partitions and their row order).  A small aggregate per
    (partition, group) gives each group's first position in the partition
    and the number of its rows in earlier partitions.
    """
    from leafwise.session import checkpoint_root

    spark = df.sparkSession
    checkpoint_root(spark)
    keys = [*by, *order]
    n = num_partitions or target_partitions(df)
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).checkpoint(eager=True)
    mid = F.monotonically_increasing_id()
    tagged = ranged.withColumn("__mid", mid).withColumns({
        PID: F.shiftright(F.col("__mid"), 33),
        "_pos": F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1)),
    })
    starts = tagged.groupBy(PID, *by).agg(F.min("_pos").alias("_start"), F.count(F.lit(1)).alias("_n"))
    w_off = Window.partitionBy(*by).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = starts.select(PID, *by, "_start", F.coalesce(F.sum("_n").over(w_off), F.lit(0)).alias("_off"))
    joined = join_groups(tagged, offsets, [PID], by)
    return joined.select(*df.columns, (F.col("_off") + F.col("_pos") - F.col("_start")).alias(name))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin the rows over the cluster when the input has fewer
    partitions than task slots (e.g. one small file with one row group), so
    heavy per-row work (regexes over whole texts, feature extraction) uses
    every core.  Inputs that already have enough splits — any large table —
    pass through unchanged.  Counting partitions plans the scan; no job runs.
    Apply it to scans and projections of scans: on a plan that already
    contains a shuffle, asking for the partition count would make adaptive
    execution run that shuffle early.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df
