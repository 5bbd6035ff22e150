"""Lloyd's centroid clustering in exact integers, most distances saved by bounds on centroid movement.

Every vector carries an upper bound on the distance to its own centroid and a
lower bound on the distance to every other one.  When the centroids move, the
lower bound is loosened by geometric drift tightening: the vectors of cluster
``i`` lie in a sphere around its centroid, and seen in the plane through that
centre, another centroid and the place it moves to, the sphere fills an angle;
none of its vectors can come nearer than the drift times the cosine of the
least angle between the drift and the sphere.  That is less than the full
drift, and negative (the bound grows) where a centroid moves away from the
sphere.  Vectors whose bounds leave the answer open are scanned against all
centroids in integer arithmetic, so the result is that of the plain
algorithm, ties to the smaller number included.

Vectors are packed into blocks, dealt to buckets once; the bounds of a round
are a table in the same buckets, so a round joins the two without a shuffle,
and moves to the driver only the changes of the sums (centroids times
dimensions).  Both tables are in the cluster's shared folder: lost executors
cost a task, not the run.

Edge cases: vectors that are NULL, hold NULL, NaN or infinity, or have another
number of components are left out; a NULL id counts as the empty text when
starting vectors are chosen; equal ids are told apart by their components;
with fewer vectors than centroids there are as many centroids as vectors;
rows repeated whole count each; an empty table gives no rows; extra columns
are ignored.  A component of 2**27 / ``scale`` or more raises an error, as
squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwise.llm.common import bound_batches, parts_for, saved
from leafwise.llm.vectors import finite, floored, list_of, summed
from leafwise.session import scratch_dir

CENTROIDS, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Vectors in a block, and blocks in a bucket (what one task reads in a round), about.
BLOCK, BLOCKS = 1024, 256
#: Components stay below this, so that squared distances fit a long.
LIMIT = 2**27

BLOCK_SCHEMA = "block long, ids array<long>, width int, data binary"
STATE_SCHEMA = "block long, own binary, upper binary, lower binary, moved array<long>, counts array<long>, reach array<double>, scans long"


# bounds -----------------------------------------------------------------------------------------


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How much nearer centroid ``j`` can have come to any vector of cluster ``i``, as [i, j].

    ``radius[i]`` bounds the distance of the cluster's vectors from ``old[i]``.
    The distance to a point moving along ``u`` falls at the rate cos(angle
    between ``u`` and the direction to the vector), which only shrinks on the
    way, so drift * cos(angle at the start) bounds the fall.
    """
    step = new - old
    drift = np.sqrt((step * step).sum(axis=1))
    out = np.tile(drift, (len(old), 1))
    for i in range(len(old)):
        for j in range(len(old)):
            towards = old[i] - old[j]
            apart = math.sqrt((towards * towards).sum())
            if i == j or drift[j] == 0 or radius[i] >= apart:
                continue
            phi = math.acos(max(-1.0, min(1.0, float(towards @ step[j]) / (apart * drift[j]))))
            least = max(0.0, phi - math.asin(radius[i] / apart))
            out[i, j] = min(drift[j], drift[j] * (math.cos(least) + 1e-9))
    return out


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances [vector, centroid]."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), distance to it and to the nearest other one."""
    d = squared(x, centroids)
    own = d.argmin(axis=1)
    at = np.arange(len(x))
    upper = np.sqrt(d[at, own].astype(float))
    if d.shape[1] == 1:
        return own, upper, np.full(len(x), np.inf)
    d[at, own] = np.iinfo(np.int64).max
    return own, upper, np.sqrt(d.min(axis=1).astype(float))


def _clear(upper: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Own centroid strictly nearest, beyond what rounding of the bounds could hide."""
    with np.errstate(invalid="ignore"):
        return upper + 1e-6 + 1e-9 * (upper + np.abs(other)) < other


def reassign(x, own, upper, lower, centroids, drift, loose, half) -> int:
    """Bring a block's ``own``, ``upper`` and ``lower`` to the moved centroids, in place; number of vectors scanned."""
    upper += drift[own]
    lower -= loose[own]
    other = np.maximum(lower, half[own])
    open_ = np.flatnonzero(~_clear(upper, other))
    if len(open_):
        exact = ((x[open_] - centroids[own[open_]]) ** 2).sum(axis=1)
        upper[open_] = np.sqrt(exact.astype(float))
        open_ = open_[~_clear(upper[open_], other[open_])]
    if len(open_):
        own[open_], upper[open_], lower[open_] = scan(x[open_], centroids)
    return len(open_)


# tables -----------------------------------------------------------------------------------------


def _bucketed(df: DataFrame, buckets: int, name: str) -> DataFrame:
    """``df`` written in buckets of ``block`` to the shared folder; the name leaves the catalogue at once."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    df.write.format("parquet").option("path", scratch_dir(spark, name)).bucketBy(buckets, "block").sortBy("block").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def _pack(dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        held: list[tuple[pa.Array, np.ndarray]] = []

        def block():
            nonlocal number
            x = np.concatenate([v for _, v in held])
            ids = pa.concat_arrays([i for i, _ in held])
            top = max(int(x.max()), -int(x.min()) - 1)
            width = 2 if top < 2**15 else 4
            got = [pa.array([number], pa.int64()), list_of(ids, pa.int64()), pa.array([width], pa.int32()), pa.array([x.astype(f"<i{width}").tobytes()], pa.binary())]
            number += 1
            held.clear()
            return pa.RecordBatch.from_arrays(got, names=["block", "ids", "width", "data"])

        rows = 0
        for batch in batches:
            at = 0
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            while at < len(x):
                n = min(BLOCK - rows, len(x) - at)
                held.append((batch.column("vec_id").slice(at, n), x[at : at + n]))
                at, rows = at + n, rows + n
                if rows == BLOCK:
                    yield block()
                    rows = 0
        if rows:
            yield block()

    return pack


def _matrix(width: int, data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").reshape(-1, dims).astype(np.int64)


def _assign(step, dims: int, k: int):
    """Apply ``step(x, row) -> (own, upper, lower, before, scanned)`` to every block; the new state with what it adds to the sums."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = _matrix(row["width"], row["data"], dims)
                own, upper, lower, before, scanned = step(x, row)
                changed = np.flatnonzero(own != before)
                moved, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
                np.add.at(moved, own[changed], x[changed])
                np.add.at(counts, own[changed], 1)
                left = changed[before[changed] >= 0]
                np.subtract.at(moved, before[left], x[left])
                np.subtract.at(counts, before[left], 1)
                reach = np.zeros(k)
                np.maximum.at(reach, own, upper)
                sums = moved.ravel() if len(changed) else moved[:0].ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["block"]], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in (own.astype("<i4"), upper, lower)),
                        list_of(sums, pa.int64()), list_of(counts, pa.int64()), list_of(reach, pa.float64()), pa.array([scanned], pa.int64()),
                    ],
                    names=["block", "own", "upper", "lower", "moved", "counts", "reach", "scans"],
                )

    return assign


def _state(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["own"], "<i4").astype(np.int64), np.frombuffer(row["upper"]).copy(), np.frombuffer(row["lower"]).copy()


# clustering -------------------------------------------------------------------------------------


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, vector: str = "embedding", log: list | None = None) -> tuple[DataFrame, list[list[int]]]:
    """Rows vec_id, cluster, distance (squared) of all kept vectors, and the final centroids.

    Each of ``rounds`` rounds assigns every vector and replaces every
    non-empty centroid by the componentwise floor of the mean; then vectors
    are assigned once more.  When a round moves no centroid the following
    ones cannot either and are left out.  ``log`` receives the number of
    vectors scanned against all centroids in each assignment.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    v = F.col(vector)
    kept = vectors.where(finite(v) & (F.size(v) == dims)).select(F.col("vec_id").cast("long").alias("vec_id"), floored(v, scale, LIMIT).alias("x"))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    start = kept.orderBy(F.sha2(name, 256), "x").limit(k).collect()
    if not start:
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), []
    centroids = [list(r["x"]) for r in start]
    k = len(centroids)

    packed = saved(kept.mapInArrow(_pack(dims), BLOCK_SCHEMA), "vector_blocks")
    n_blocks = packed.count()
    buckets = max(parts_for(n_blocks, BLOCKS), min(n_blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    blocks = _bucketed(packed.repartition(buckets, "block"), buckets, "vector_buckets")

    def first(x, row, at=np.array(centroids, np.int64)):
        own, upper, lower = scan(x, at)
        return own, upper, lower, np.full(len(x), -1), len(x)

    state = _bucketed(blocks.mapInArrow(_assign(first, dims, k), STATE_SCHEMA), buckets, "cluster_state")
    sums, counts = [[0] * dims for _ in range(k)], [0] * k
    for _ in range(rounds):
        for at, x in summed(state, "moved").items():
            sums[at // dims][at % dims] += x
        for at, x in summed(state, "counts").items():
            counts[at] += x
        if log is not None:
            log.append(state.agg(F.sum("scans")).first()[0])
        moved = [[s // counts[i] for s in sums[i]] if counts[i] else centroids[i] for i in range(k)]
        if moved == centroids:
            break
        reach = summed(state, "reach", F.max)
        step = _moved_step(centroids, moved, np.array([reach[i] for i in range(k)]))
        joined = blocks.join(state.select("block", "own", "upper", "lower"), "block")
        state = _bucketed(joined.mapInArrow(_assign(step, dims, k), STATE_SCHEMA), buckets, "cluster_state")
        centroids = moved
    else:
        if log is not None:
            log.append(state.agg(F.sum("scans")).first()[0])
    final = np.array(centroids, np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            for i in range(batch.num_rows):
                x = _matrix(batch.column("width")[i].as_py(), batch.column("data")[i].as_py(), dims)
                own = np.frombuffer(batch.column("own")[i].as_py(), "<i4")
                d = ((x - final[own]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids[i].values, pa.array(own), pa.array(d)], names=["vec_id", "cluster", "distance"])

    out = blocks.join(state.select("block", "own"), "block").mapInArrow(rows, "vec_id long, cluster int, distance long")
    return out, centroids


def _moved_step(old: list, new: list, reach: np.ndarray):
    """The step of a round in which the centroids went from ``old`` to ``new``."""
    centroids = np.array(new, np.int64)
    a, b = np.array(old, float), centroids.astype(float)
    k = len(b)
    drift = np.sqrt(((b - a) ** 2).sum(axis=1)) * (1 + 1e-12)
    others = np.where(np.eye(k, dtype=bool), -np.inf, loosening(a, b, reach * (1 + 1e-12)))
    loose = others.max(axis=1) if k > 1 else np.zeros(k)
    apart = np.sqrt(squared(centroids, centroids).astype(float))
    half = np.where(np.eye(k, dtype=bool), np.inf, apart).min(axis=1) / 2

    def step(x, row):
        own, upper, lower = _state(row)
        before = own.copy()
        scanned = reassign(x, own, upper, lower, centroids, drift, loose, half)
        return own, upper, lower, before, scanned

    return step


def centroid_report(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``found`` with inertia per cluster and in all, and a digest of each row's centroid.

    The per-cluster table has a row per centroid, so it is broadcast.
    """
    found = saved(found, "clusters")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    per = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(exact.alias("s")).collect()}
    rows = [(i, per.get(i, 0), sum(per.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    side = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
