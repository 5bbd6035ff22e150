"""Exact per-class k-nearest neighbours by Hamming distance over leaf codes.

Plan
----
1. **Collapse.**  Rows with the same leaf vector have the same distances, so
   each distinct vector stands for all its rows.  Ties are broken by id, hence
   a vector needs only the ``k + 1`` smallest ids of each class (one spare for
   a row that leaves itself out).  Ids are gathered in parts, so that is
   bounded however often a vector repeats.
2. **Index** (``method="index"``, or where the grid would copy rows more
   often).  Vectors are posted under (position, leaf) tokens.  A query reads
   the posting lists of its rarest tokens, ``p`` positions within a budget of
   candidates.  A vector in none of these lists differs in at least ``p``
   positions, so the query is settled once its k-th best count is below ``p``;
   when all positions were read, whatever shares no leaf is at distance 1 and
   the smallest ids fill up.  Copies per row are bounded by the tokens of a
   vector and do not grow with the number of rows.
3. **Grid**, for queries that the index leaves open, and for inputs so small
   that it copies less.  Vectors are cut into hash blocks; each (query block,
   reference block) cell is one group holding at most ``cell_size`` rows a
   side.  Shuffle volume is ``Nq·Nr/cell_size`` rows per side.

In both, a numpy kernel computes a cell's counts and emits only the ``k + 1``
best members per (query, class); ``row_number() <= k`` with a partial
``WindowGroupLimit`` merges the lists, which are then handed to every row of
the vector.  No pair of rows is ever materialised.

Rows without an id or a leaf vector neither have nor are neighbours.  Ids are
unique in the reference, but for rows repeated whole, which count once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwise.functions.arrays import hamming_distance
from leafwise.session import scratch_dir

CLASS_NAMES = {1: "approved", 0: "unapproved"}
# qv: query vector; qid: its smallest query id; nid: neighbour's id; cnt: unequal positions of width
NEIGHBOR_SCHEMA = "qv long, qid long, cls int, nid long, cnt int, width int"
# Rows per side of one cell: replication (shuffle) is N/cell per row, the
# per-cell work cell²·T.  4096 keeps a cell near a few seconds for 589 trees.
DEFAULT_CELL = 4096
# Ids of one vector that are gathered together, about.
GATHERED = 65536
_QUERY_CHUNK = 512
# Cells of the streamed grid: queries held and vectors read, in cells.
QUERY_CELLS, READ_CELLS = 16, 64
# Cells a side up to which a search among a table's own rows compares each pair of blocks once.
SYMMETRIC_CELLS = 4
# Queries that tell whether the index settles enough.
PROBE = 2000
# Index: longest posting list that is read, candidates read per query at most
# (settling decides what they were worth), and the most tokens whose counts
# are shipped to the executors (16 bytes each; beyond it the grid is used).
LIST_LIMIT = 4096
CANDIDATES = 16384
TOKEN_LIMIT = 5_000_000


def pack_leaves(c) -> Column:
    """``array<int>`` → compact ``binary`` for the replicated shuffle.

    Marker byte 0 then big-endian int16 per tree when every value fits
    (half the bytes of an int array), else marker 1 then int32.  Built from
    JVM expressions (``hex``/``unhex``), evaluated once per input row before
    the rows are replicated to their cells.
    """
    c = F.col(c) if isinstance(c, str) else c
    bad = F.exists(c, lambda x: x.isNull()) | (F.size(c) == 0)
    c = F.when(bad, F.raise_error(F.lit("a leaf vector is empty or has a NULL leaf"))).otherwise(c)
    fits = (F.array_min(c) >= -32768) & (F.array_max(c) <= 32767)
    h16 = F.array_join(F.transform(c, lambda x: F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(1 << 16))), 4, "0")), "")
    h32 = F.array_join(F.transform(c, lambda x: F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(1 << 32))), 8, "0")), "")
    return F.unhex(F.when(fits, F.concat(F.lit("00"), h16)).otherwise(F.concat(F.lit("01"), h32)))


def unpack_leaves(blobs) -> np.ndarray:
    """Inverse of :func:`pack_leaves` for a sequence of blobs → (n, T) int64."""
    blobs = [bytes(b) for b in blobs]
    if all(b[:1] == b"\x00" for b in blobs) and len({len(b) for b in blobs}) == 1:
        width = (len(blobs[0]) - 1) // 2
        raw = np.frombuffer(b"".join(b[1:] for b in blobs), dtype=">i2")
        return raw.reshape(len(blobs), width).astype(np.int64)
    rows = [np.frombuffer(b, dtype=">i2" if b[:1] == b"\x00" else ">i4", offset=1).astype(np.int64) for b in blobs]
    if len({len(r) for r in rows}) > 1:
        raise ValueError("leaf vectors differ in length")
    return np.stack(rows)


def class_of(label: str = "label") -> Column:
    """``cls`` = 1 for approved, 0 for unapproved; any other label raises."""
    lab = F.col(label)
    return F.when(lab.isin(0, 1), lab.cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("label must be 0 or 1, got "), F.coalesce(lab.cast("string"), F.lit("NULL"))))
    )


def class_partition(df: DataFrame, label: str = "label") -> DataFrame:
    """Add the validated class column ``cls``."""
    return df.withColumn("cls", class_of(label))


def _planes(leaves: np.ndarray) -> np.ndarray:
    """Leaf vectors as bits [bit, word, vector]: 64 positions to a word, as many bits as the codes need (two's complement,
    so that the last plane stands for all further ones)."""
    n, width = leaves.shape
    bits = int((leaves ^ (leaves >> 63)).max(initial=0)).bit_length() + 1
    words = -(-width // 64)
    out = np.empty((bits, words, n), np.uint64)
    for b in range(bits):
        packed = np.zeros((n, 8 * words), np.uint8)
        packed[:, : -(-width // 8)] = np.packbits(((leaves >> b) & 1).astype(np.uint8), axis=1)
        out[b] = packed.view(np.uint64).T
    return out


def _unequal(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Mismatch counts [query, vector] of two sets of bit planes."""
    total = None
    for word in range(q.shape[1]):
        x = q[0, word][:, None] ^ r[0, word][None, :]
        for b in range(1, max(len(q), len(r))):
            x |= q[min(b, len(q) - 1), word][:, None] ^ r[min(b, len(r) - 1), word][None, :]
        n = np.bitwise_count(x)
        total = n if q.shape[1] == 1 else n.astype(np.int32) if total is None else total + n
    return total


# Pairs whose bits are compared at once: a few words each, within a core's cache.
_TILE = 1 << 16


def _counts(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``_unequal`` in tiles."""
    n = q.shape[2]
    out = np.empty((n, r.shape[2]), np.uint8 if q.shape[1] == 1 else np.int32)
    side = max(1, min(r.shape[2], 4096))
    step = max(1, _TILE // side)
    for c in range(0, r.shape[2], side):
        part = r[:, :, c : c + side]
        for a in range(0, n, step):
            out[a : a + step, c : c + side] = _unequal(q[:, :, a : a + step], part)
    return out


class _Members:
    """The vectors of a cell that have members of one class: columns by their smallest id, and all their ids."""

    def __init__(self, lists) -> None:
        lens = np.array([0 if x is None else len(x) for x in lists], np.int64)
        cols = np.flatnonzero(lens)
        first = np.array([lists[i][0] for i in cols], np.int64)
        self.cols = cols[np.argsort(first, kind="stable")]
        self.lens = lens[self.cols]
        self.starts = np.cumsum(self.lens) - self.lens
        self.ids = np.concatenate([np.asarray(lists[i], np.int64) for i in self.cols]) if len(cols) else np.zeros(0, np.int64)

    def best(self, cnt: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, id, count) of the ``k`` best members of every row of ``cnt`` [query, vector], by count and id.

        Only members of the ``k`` best vectors (by count and smallest id) can
        be among them.
        """
        if not len(self.cols):
            return (np.zeros(0, np.int64),) * 3
        sub = cnt[:, self.cols]
        rows, cols = _best_k(sub, k)
        return self.expand(rows, cols, sub[rows, cols], k)

    def expand(self, rows, cols, cnt, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lens = self.lens[cols]
        if (lens == 1).all():
            return rows, self.ids[self.starts[cols]], cnt
        at = np.repeat(self.starts[cols] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        return _cut(np.repeat(rows, lens), self.ids[at], np.repeat(cnt, lens), k)


def _cut(rows, ids, cnt, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` smallest by (count, id) of every row."""
    order = np.lexsort((ids, cnt, rows))
    rows, ids, cnt = rows[order], ids[order], cnt[order]
    new = np.r_[True, rows[1:] != rows[:-1]]
    keep = np.arange(len(rows)) - np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0)) < k
    return rows[keep], ids[keep], cnt[keep]


def _best_k(cnt: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``cnt``: the ``k`` smallest by (count, column), as (row, column) index arrays."""
    n = cnt.shape[1]
    if k >= n:
        return np.repeat(np.arange(len(cnt)), n), np.tile(np.arange(n), len(cnt))
    key = cnt.astype(np.int64) * n + np.arange(n)[None, :]
    part = np.argpartition(key, k - 1, axis=1)[:, :k]
    return np.repeat(np.arange(len(cnt)), k), part.ravel()


_NOTHING = {"qv": [], "qid": [], "cls": [], "nid": [], "cnt": [], "width": []}


def _found(query: tuple, rows, cls: int, nid, cnt, width: int) -> pd.DataFrame:
    qv, qid = query
    return pd.DataFrame({"qv": qv[rows], "qid": qid[rows], "cls": np.full(len(nid), cls, np.int32), "nid": nid, "cnt": cnt.astype(np.int32), "width": np.full(len(nid), width, np.int32)})


def _named(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and smallest query ids of a cell's query vectors (a vector without a query has none)."""
    return pdf["qv"].to_numpy(np.int64), pdf["qid"].to_numpy(np.int64)


def _counter(Q: np.ndarray, R: np.ndarray):
    """Mismatch counts of a chunk of rows of ``Q`` against ``R``, by bit planes."""
    if Q.shape[1] != R.shape[1]:
        raise ValueError(f"leaf vectors differ in length: {Q.shape[1]} vs {R.shape[1]}")
    q, r = _planes(Q), _planes(R)
    return lambda sl: _counts(q[:, :, sl], r)


def _cell_kernel(k: int):
    """Per-cell kernel: queries (qv, qid, packed) against vectors (vector, list1, list0)."""

    def kernel(qpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        if qpdf.empty or rpdf.empty:
            return pd.DataFrame(_NOTHING)
        query = _named(qpdf)
        Q, R = unpack_leaves(qpdf["packed"]), unpack_leaves(rpdf["vector"])
        counts = _counter(Q, R)
        members = {c: _Members(rpdf[f"list{c}"].to_numpy()) for c in (0, 1)}
        out = []
        for start in range(0, len(qpdf), _QUERY_CHUNK):
            cnt = counts(slice(start, start + _QUERY_CHUNK))
            for cls, m in members.items():
                rows, ids, c = m.best(cnt, k)
                out.append(_found(query, start + rows, cls, ids, c, Q.shape[1]))
        return pd.concat(out, ignore_index=True)

    return kernel


def _symmetric_kernel(k: int):
    """Leave-one-out cell ``(lo, hi)``: vectors of block ``lo`` against those of
    block ``hi`` once; the counts serve both directions (the transpose gives
    the ``hi`` vectors' candidates), and a diagonal cell pairs a block with
    itself."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(_NOTHING)
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        a = pdf[pdf["blk"] == lo]
        c = pdf[pdf["blk"] == hi] if hi != lo else a
        if a.empty or c.empty:
            return pd.DataFrame(_NOTHING)
        A, C = unpack_leaves(a["packed"]), unpack_leaves(c["packed"])
        width = A.shape[1]
        counts = _counter(A, C)
        a_query, c_query = _named(a), _named(c)
        c_members = {x: _Members(c[f"ids{x}"].to_numpy()) for x in (0, 1)}
        a_lists = {x: a[f"ids{x}"].to_numpy() for x in (0, 1)}
        out = []
        # candidates for the hi block's vectors, gathered from the transposed counts
        back: dict[int, list] = {0: [], 1: []}
        for start in range(0, len(a), _QUERY_CHUNK):
            sl = slice(start, start + _QUERY_CHUNK)
            cnt = counts(sl)                                # each count computed once
            for cls, m in c_members.items():
                rows, ids, n = m.best(cnt, k)
                out.append(_found(a_query, start + rows, cls, ids, n, width))
                if hi != lo:
                    back[cls].append(_Members(a_lists[cls][sl]).best(cnt.T, k))
        for cls, parts in back.items():
            if parts:                                       # the k best over the chunks
                rows, ids, n = _cut(*(np.concatenate(x) for x in zip(*parts)), k)
                out.append(_found(c_query, rows, cls, ids, n, width))
        return pd.concat(out, ignore_index=True)

    return kernel


class _Stream:
    """Queries of one cell and the ``k`` best of each class among the vectors read so far."""

    def __init__(self, k: int):
        self.k, self.queries, self.width = k, [], None
        self.chunks = None

    def _read(self, packed) -> np.ndarray:
        leaves = unpack_leaves(packed)
        if self.width not in (None, leaves.shape[1]):
            raise ValueError(f"leaf vectors differ in length: {self.width} vs {leaves.shape[1]}")
        self.width = leaves.shape[1]
        return _planes(leaves)

    def ask(self, pdf: pd.DataFrame) -> None:
        planes, (qv, qid) = self._read(pdf["packed"]), _named(pdf)
        for a in range(0, len(pdf), _QUERY_CHUNK):
            sl = slice(a, a + _QUERY_CHUNK)
            self.queries.append((planes[:, :, sl], (qv[sl], qid[sl]), {0: _Best(len(qv[sl]), self.k), 1: _Best(len(qv[sl]), self.k)}))

    def meet(self, pdf: pd.DataFrame) -> None:
        if not self.queries:
            return
        # columns in order of their classes: 1, both, 0
        lens = {c: np.array([0 if x is None else len(x) for x in pdf[f"ids{c}"]], np.int64) for c in (1, 0)}
        order = np.argsort(np.where(lens[1] == 0, 2, np.where(lens[0] == 0, 0, 1)), kind="stable")
        planes = np.ascontiguousarray(self._read(pdf["packed"])[:, :, order])
        sides = {}
        for c, sl in ((1, slice(0, int((lens[1] > 0).sum()))), (0, slice(len(pdf) - int((lens[0] > 0).sum()), len(pdf)))):
            n = lens[c][order][sl]
            if len(n):
                lists = pdf[f"ids{c}"].to_numpy()[order][sl]
                sides[c] = sl, n, np.cumsum(n) - n, np.concatenate([np.asarray(x, np.int64) for x in lists])
        for q, _, best in self.queries:
            counts = _counts(q, planes)
            for c, (sl, *members) in sides.items():
                best[c].add(counts[:, sl], *members)

    def found(self):
        for _, query, best in self.queries:
            for c, b in best.items():
                if len(b.rows):
                    yield _found(query, b.rows, c, b.ids, b.cnt, self.width)


class _Best:
    """The ``k`` smallest (count, id) of every row, in order."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.rows, self.ids, self.cnt = (np.zeros(0, np.int64),) * 3
        self.bar = np.full(n, np.iinfo(np.int32).max)       # count of the k-th; nothing above it is among them

    def add(self, counts: np.ndarray, lens: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> None:
        """More vectors: ``counts`` [row, vector]; each has ``lens`` ids from ``starts`` on."""
        bar = self.bar
        if counts.shape[1] > self.k and bar.max() > counts.max():
            bar = np.minimum(bar, np.partition(counts, self.k - 1, axis=1)[:, self.k - 1])
        hits = np.flatnonzero(counts <= np.minimum(bar, np.iinfo(counts.dtype).max).astype(counts.dtype)[:, None])
        if not len(hits):
            return
        rows, cols = np.divmod(hits, counts.shape[1])
        n = lens[cols]
        at = np.repeat(starts[cols] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cnt = np.repeat(counts[rows, cols].astype(np.int64), n)
        self.rows, self.ids, self.cnt = _cut(
            np.r_[self.rows, np.repeat(rows, n)], np.r_[self.ids, ids[at]], np.r_[self.cnt, cnt], self.k)
        have = np.bincount(self.rows, minlength=self.n)
        full = have == self.k
        self.bar[full] = self.cnt[(np.cumsum(have) - 1)[full]]


def _stream_kernel(k: int):
    """Cells in order, of each first its queries and then its vectors, which are read as they come."""

    def kernel(batches):
        key, cell = None, None
        for pdf in batches:
            name = pdf["cell"].to_numpy(np.int64) * 2 + pdf["side"].to_numpy(np.int64)
            cuts = np.r_[0, np.flatnonzero(np.diff(name)) + 1, len(pdf)] if len(pdf) else []
            for a, b in zip(cuts, cuts[1:]):
                if name[a] // 2 != key:
                    if cell is not None:
                        yield from cell.found()
                    key, cell = name[a] // 2, _Stream(k)
                (cell.meet if name[a] % 2 else cell.ask)(pdf.iloc[a:b])
        if cell is not None:
            yield from cell.found()

    return kernel


MIN_CELL = 64


def _blocks(n: int, cell_size: int, min_per_side: int) -> int:
    """Blocks per side: cells of at most ``cell_size`` rows, and enough cells
    to occupy the cluster, without cutting below ``MIN_CELL`` rows."""
    by_size = math.ceil(n / cell_size)
    most = max(1, math.ceil(n / MIN_CELL))
    return max(1, by_size, min(min_per_side, most))


def _grid(nq: int, nr: int, cell_size: int, cells: int, read: int | None = None) -> tuple[int, int]:
    """Blocks of queries and of reference rows (of at most ``cell_size`` and
    ``read`` rows): as few as these allow, and a side is split further only while
    there are fewer than ``cells`` cells, the larger side first (the other side is copied then)."""
    qb, rb = _blocks(nq, cell_size, 1), _blocks(nr, read or cell_size, 1)
    while qb * rb < cells:
        can_q, can_r = nq / (qb + 1) >= MIN_CELL, nr / (rb + 1) >= MIN_CELL
        if not (can_q or can_r):
            break
        if can_r and (not can_q or nr / rb >= nq / qb):
            rb += 1
        else:
            qb += 1
    return qb, rb


def collapse(queries: DataFrame | None, reference: DataFrame, keep: int, size: int) -> DataFrame:
    """One row per distinct leaf vector, written once: qv (its number), packed, qid (smallest query id, NULL without a
    query), qn (query ids, at least 2 if there are more), ids1 and ids0 (its ``keep`` smallest reference ids by class).

    ``queries`` (id, packed) and ``reference`` (id, cls, packed); None: the
    reference's rows are the queries.  Rows repeated whole become one id.  Ids
    are gathered by vector and a part of the ids first, so that no group
    holds more than about ``GATHERED`` of ``size`` rows however hot a vector is.
    """
    rows = reference.select("id", "cls", "packed")
    if queries is not None:
        rows = rows.unionByName(queries.select("id", F.lit(2).alias("cls"), "packed"))
    keep = max(keep, 2)
    classes = (1, 0) if queries is None else (1, 0, 2)
    parts = math.ceil(size / GATHERED)
    least = lambda ids: F.slice(F.sort_array(ids), 1, keep)
    found = rows.groupBy("packed", *([_block("id", parts).alias("part")] if parts > 1 else [])).agg(
        *(least(F.collect_set(F.when(F.col("cls") == c, F.col("id")))).alias(f"ids{c}") for c in classes))
    if parts > 1:
        found = found.groupBy("packed").agg(*(least(F.flatten(F.collect_list(f"ids{c}"))).alias(f"ids{c}") for c in classes))
    own = F.col("ids2") if queries is not None else F.sort_array(F.concat("ids1", "ids0"))
    return _saved(found.select(
        F.monotonically_increasing_id().alias("qv"), "packed", F.get(own, F.lit(0)).alias("qid"), F.size(own).alias("qn"), "ids1", "ids0"), "leaf_vectors")


def _saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: numbers stay, lineage is cut."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _block(column: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def _grid_self(vectors: DataFrame, n: int, k: int, cell_size: int) -> DataFrame:
    """Candidates of all vectors among themselves, each pair of blocks once."""
    parallelism = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = _blocks(n, cell_size, math.ceil(math.sqrt(2 * parallelism)))
    rows = vectors.select("qv", "qid", "packed", "ids1", "ids0", _block("qv", blocks).alias("blk"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_x")
    cells = rows.select("*", other).select("qv", "qid", "packed", "ids1", "ids0", "blk", F.least("blk", "_x").alias("lo"), F.greatest("blk", "_x").alias("hi"))
    # a row meets its own block once (x = blk); off-diagonal cells get each row once
    # work is per cell, not per byte: a count of partitions of its own keeps small cells apart
    cells = cells.repartition(max(1, min(blocks * (blocks + 1) // 2, 4 * parallelism)), "lo", "hi")
    return cells.groupBy("lo", "hi").applyInPandas(_symmetric_kernel(k), NEIGHBOR_SCHEMA)


def _reference_columns() -> list[Column]:
    """The reference side of a cogroup under names of its own: both sides may come from one table."""
    return [F.col(a).alias(b) for a, b in (("packed", "vector"), ("ids1", "list1"), ("ids0", "list0"))]


def _grid_pairs(queries: DataFrame, vectors: DataFrame, nq: int, nr: int, k: int, cell_size: int) -> DataFrame:
    """Candidates of the query vectors (qv, qid, packed) among all vectors.

    A task holds a cell's queries and reads its vectors in batches, so a cell
    has ``QUERY_CELLS`` times a cell's queries and ``READ_CELLS`` times its vectors.
    """
    parallelism = queries.sparkSession.sparkContext.defaultParallelism
    qb, rb = _grid(nq, nr, QUERY_CELLS * cell_size, 4 * parallelism, READ_CELLS * cell_size)
    to = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = (F.col("qb") * rb + F.col("rb")).alias("cell")
    q = queries.select("qv", "qid", "packed", F.lit(None).cast("array<bigint>").alias("ids1"), F.lit(None).cast("array<bigint>").alias("ids0"), _block("qv", qb).alias("qb"), to(rb).alias("rb"))
    r = vectors.select(F.lit(0).cast("long").alias("qv"), F.lit(0).cast("long").alias("qid"), "packed", "ids1", "ids0", _block("qv", rb).alias("rb"), to(qb).alias("qb"))
    both = q.select("qv", "qid", "packed", "ids1", "ids0", cell, F.lit(0).alias("side")).unionByName(
        r.select("qv", "qid", "packed", "ids1", "ids0", cell, F.lit(1).alias("side")))
    # more partitions than cells: few of them get two
    return both.repartition(max(1, 4 * qb * rb), "cell").sortWithinPartitions("cell", "side").mapInPandas(_stream_kernel(k), NEIGHBOR_SCHEMA)


def _lists(candidates: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of every (query vector, class): qv, cls, qid, near (array of cnt, nid in order), width."""
    best = top_k_per_group(candidates, ["qv", "cls"], [F.col("cnt"), F.col("nid")], k)
    return best.groupBy("qv", "cls").agg(F.first("qid").alias("qid"), F.sort_array(F.collect_list(F.struct("cnt", "nid"))).alias("near"), F.first("width").alias("width"))


# --- index ---------------------------------------------------------------------


def _tokens(packed) -> np.ndarray:
    """(position, leaf) of every vector as one number [vector, position]."""
    leaves = unpack_leaves(packed)
    return (np.arange(leaves.shape[1], dtype=np.int64) << 32)[None, :] | (leaves & 0xFFFFFFFF)


def _token_counts(batches):
    for pdf in batches:
        if len(pdf):
            token, n = np.unique(_tokens(pdf["packed"]), return_counts=True)
            yield pd.DataFrame({"token": token, "n": n})


def _shipped(counts: DataFrame, value: str, limit: int):
    """A token table as sorted arrays broadcast to the executors, or None beyond ``limit`` rows."""
    if counts.count() > limit:
        return None
    pdf = counts.toPandas().sort_values("token")
    return counts.sparkSession.sparkContext.broadcast((pdf["token"].to_numpy(np.int64), pdf[value].to_numpy(np.int64)))


def _looked_up(table, token: np.ndarray) -> np.ndarray:
    """The value of every token, 0 where there is none."""
    keys, values = table
    if not len(keys):
        return np.zeros(token.shape, np.int64)
    at = np.minimum(np.searchsorted(keys, token), len(keys) - 1)
    return np.where(keys[at] == token, values[at], 0)


def _read_plan(counts, list_limit: int, candidates: int):
    """Of every query: the number of positions it reads (rarest first), their tokens that have postings, and its length."""

    @F.pandas_udf("read int, width int, tokens array<long>")
    def plan(packed: pd.Series) -> pd.DataFrame:
        if not len(packed):
            return pd.DataFrame({"read": [], "width": [], "tokens": []})
        token = _tokens(packed)
        n = _looked_up(counts.value, token)
        order = np.argsort(n, axis=1, kind="stable")
        token, n = np.take_along_axis(token, order, 1), np.take_along_axis(n, order, 1)
        fits = (n <= list_limit) & (np.cumsum(n, axis=1) <= candidates)
        read = fits.sum(axis=1)               # n is in order, so what fits is a prefix
        used = fits & (n > 0)
        return pd.DataFrame({"read": read.astype(np.int32), "width": np.full(len(token), token.shape[1], np.int32), "tokens": [t[u] for t, u in zip(token, used)]})

    return plan


def _posted(used):
    """Of every vector: its tokens that some query reads, each as (token, part) for every part of the token's queries."""

    @F.pandas_udf("array<struct<token:long,part:int>>")
    def post(packed: pd.Series) -> pd.Series:
        out = []
        if len(packed):
            token = _tokens(packed)
            parts = _looked_up(used.value, token)
            for t, p in zip(token, parts):
                out.append([{"token": int(x), "part": i} for x, n in zip(t[p > 0], p[p > 0]) for i in range(n)])
        return pd.Series(out, dtype=object)

    return post


def _index(queries: DataFrame, vectors: DataFrame, nq: int, k: int, cell_size: int, list_limit: int, candidates: int) -> DataFrame | None:
    """qv, qid, packed, open (not settled), near1, near0, width of every query vector; None when the tokens are too many."""
    counts = vectors.select("packed").mapInPandas(_token_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    shipped = _shipped(_saved(counts, "token_counts"), "n", TOKEN_LIMIT)
    if shipped is None:
        return None
    plan = _read_plan(shipped, list_limit, candidates)
    plans = _saved(queries.select("qv", "qid", "packed", plan("packed").alias("p")).select("qv", "qid", "packed", "p.*"), "index_plans")
    asked = plans.select("qv", "qid", "packed", F.explode("tokens").alias("token"))
    # queries of one token are dealt to parts of a cell's size
    used = asked.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / cell_size).cast("long").alias("parts"))
    shipped_used = _shipped(_saved(used, "token_parts"), "parts", TOKEN_LIMIT)
    # a task computes about as many counts as a full cell of the grid
    tasks = max(4 * queries.sparkSession.sparkContext.defaultParallelism, math.ceil(nq * candidates / DEFAULT_CELL**2))
    q = asked.join(used, "token") if len(shipped_used.value[1]) and shipped_used.value[1].max() > 1 else asked.withColumn("parts", F.lit(1).cast("long"))
    q = q.select("qv", "qid", "packed", "token", F.pmod(F.xxhash64("qv"), F.col("parts")).cast("int").alias("part"))
    r = vectors.select(*_reference_columns(), F.explode(_posted(shipped_used)("packed")).alias("t")).select("vector", "list1", "list0", "t.*")
    found = (
        q.repartition(tasks, "token", "part").groupBy("token", "part")
        .cogroup(r.repartition(tasks, "token", "part").groupBy("token", "part"))
        .applyInPandas(_cell_kernel(k), NEIGHBOR_SCHEMA)
    )
    lists = _lists(found.dropDuplicates(["qv", "cls", "nid", "cnt"]), k)
    by_class = lists.groupBy("qv").pivot("cls", [1, 0]).agg(F.first("near")).toDF("qv", "near1", "near0")
    out = plans.drop("tokens").join(by_class, "qv", "left")
    closed = F.lit(True)
    for c in (1, 0):
        # the smallest ids of the class: what shares no leaf with a query that read all its positions
        ids = [r[0] for r in vectors.select(F.explode(f"ids{c}").alias("id")).orderBy("id").limit(2 * k).collect()]
        have = F.coalesce(F.col(f"near{c}"), F.array().cast("array<struct<cnt:int,nid:bigint>>"))
        known = F.transform(have, lambda x: x["nid"])
        far = F.filter(F.array(*map(F.lit, ids)).cast("array<bigint>"), lambda x: ~F.array_contains(known, x)) if ids else F.array().cast("array<bigint>")
        filled = F.slice(F.concat(have, F.transform(far, lambda x: F.struct(F.col("width").alias("cnt"), x.alias("nid")))), 1, k)
        out = out.withColumn(f"near{c}", F.when((F.col("read") == F.col("width")) & (F.size(have) < k), filled).otherwise(have))
        full = (F.size(f"near{c}") == k) & (F.element_at(f"near{c}", -1)["cnt"] < F.col("read"))
        # fewer ids than k in all: the list is whole when it holds every one
        every = (F.size(f"near{c}") == len(ids)) if len(ids) < k else F.lit(False)
        closed = closed & ((F.col("read") == F.col("width")) | F.coalesce(full, F.lit(False)) | every)
    return _saved(out.withColumn("open", ~closed).drop("read"), "index_lists")


# --- whole searches --------------------------------------------------------------


def _search(rows: DataFrame | None, reference: DataFrame, k: int, exclude_self: bool, cell_size: int, method: str,
            symmetric: bool, list_limit: int, candidates: int, size: int) -> DataFrame:
    """Neighbours of ``rows`` (id, packed; None: of the reference's own rows) among ``reference`` (id, cls, packed)."""
    if method not in ("auto", "grid", "index"):
        raise ValueError("method must be 'auto', 'grid' or 'index'")
    if k < 1:
        raise ValueError("k must be at least 1")
    keep = k + 1 if exclude_self else k
    everything = collapse(rows, reference, keep, size)
    vectors = everything.where((F.size("ids1") > 0) | (F.size("ids0") > 0))
    queries = everything.where("qid is not null")
    has = (F.size("ids1") > 0) | (F.size("ids0") > 0)
    stats = everything.agg(
        F.count(F.when(has, 1)).alias("nr"), F.count("qid").alias("nq"), F.sum("qn").alias("rows"),
        F.first(F.length("packed")).alias("bytes")).first()
    nr, nq = stats["nr"], stats["nq"]
    width = max(1, (stats["bytes"] or 1) // 2)
    if method == "auto":
        # copies of a row: one per block of the other side, or one per token
        method = "index" if max(nq, nr) / cell_size > width else "grid"
        if method == "index" and nq > 4 * PROBE:
            # what the index leaves open is searched again: it is worth its work where it settles most queries
            some = queries.where(F.pmod(F.xxhash64("qv"), F.lit(nq // PROBE)) == 0)
            tried = _index(some, vectors, PROBE, keep, cell_size, list_limit, candidates)
            share = tried.agg(F.avg(F.col("open").cast("int"))).first()[0] if tried is not None else 1.0
            method = "grid" if share is not None and share > 0.5 else "index"
    settled = None
    todo, left = queries, nq
    if method == "index" and nr and nq:
        settled = _index(queries, vectors, nq, keep, cell_size, list_limit, candidates)
        if settled is not None:
            todo = settled.where("open")
            left = todo.count()
    if symmetric and rows is None and left == nq and nr <= SYMMETRIC_CELLS * cell_size:
        near = _lists(_grid_self(vectors, nr, keep, cell_size), keep)
    elif left or settled is None:
        near = _lists(_grid_pairs(todo, vectors, left, nr, keep, cell_size), keep)
    else:
        near = None
    if settled is not None and left < nq:
        done = settled.where(~F.col("open"))
        done = [done.where(F.size(f"near{c}") > 0).select("qv", F.lit(c).alias("cls"), "qid", F.col(f"near{c}").alias("near"), "width") for c in (1, 0)]
        done = done[0].unionByName(done[1])
        near = done if near is None else near.unionByName(done)
    # every row of a vector takes its list; without repeated rows the vector's own row is all there is
    if stats["rows"] == nq:
        per_row = near
    else:
        own = rows if rows is not None else reference
        listed = near.join(queries.select("qv", "packed"), "qv").drop("qv", "qid")
        per_row = own.select(F.col("id").alias("qid"), "packed").join(listed, "packed")
    mine = F.filter("near", lambda x: x["nid"] != F.col("qid")) if exclude_self else F.col("near")
    ranked = per_row.select("qid", "cls", "width", F.posexplode(F.slice(mine, 1, k)).alias("at", "n"))
    return ranked.select(
        "qid", "cls", (F.col("at") + 1).alias("rank"), F.col("n")["nid"].alias("nid"),
        (F.col("n")["cnt"].cast("double") / F.col("width")).alias("dist"))


def _leaf_rows(df: DataFrame, id_col: str, leaves: str, *more: Column) -> DataFrame:
    """Rows that have an id and a leaf vector: id, packed and more."""
    there = F.col(id_col).isNotNull() & F.col(leaves).isNotNull()
    return df.where(there).select(F.col(id_col).cast("long").alias("id"), *more, pack_leaves(leaves).alias("packed"))


def knn_per_class(queries: DataFrame, reference: DataFrame, k: int = 5, exclude_self: bool = False,
                  cell_size: int = DEFAULT_CELL, query_id: str = "id", ref_id: str = "id",
                  label: str = "label", leaves: str = "leaves", method: str = "auto",
                  list_limit: int = LIST_LIMIT, candidates: int = CANDIDATES, sizes: tuple[int, int] | None = None) -> DataFrame:
    """``k`` nearest reference rows of each class for every query row.

    Returns ``(qid long, cls int, rank int, nid long, dist double)`` with
    ``rank`` 1..k ordered by ``(dist, nid)``.  ``exclude_self`` drops only the
    pair with equal ids (exact duplicates under another id stay at 0.0).
    Classes with fewer than ``k`` members give shorter lists; an empty class
    gives no rows.  Labels other than 0/1 raise.  ``method``: ``index``,
    ``grid`` or ``auto`` (whichever copies rows less); the result is the same.
    ``sizes`` = (queries, reference) row counts, approximate, spares counting
    inputs that are expensive to compute.
    """
    nq, nr = sizes or (queries.count(), reference.count())
    r = _leaf_rows(reference, ref_id, leaves, class_of(label).alias("cls"))
    return _search(_leaf_rows(queries, query_id, leaves), r, k, exclude_self, cell_size, method, False, list_limit, candidates, nq + nr)


def knn_leave_one_out(leaves_df: DataFrame, k: int = 5, symmetric: bool = True, cell_size: int = DEFAULT_CELL, id_col: str = "id",
                      label: str = "label", leaves: str = "leaves", method: str = "auto",
                      list_limit: int = LIST_LIMIT, candidates: int = CANDIDATES, size: int | None = None) -> DataFrame:
    """Every row against all others (itself excluded), per class.

    ``symmetric=True`` lets a grid of a few cells compute each distance once for
    both vectors of a pair; ``False`` runs the general query/reference grid.
    """
    rows = _leaf_rows(leaves_df, id_col, leaves, class_of(label).alias("cls"))
    size = leaves_df.count() if size is None else size
    return _search(None, rows, k, True, cell_size, method, symmetric, list_limit, candidates, size)


def knn_query_ref(queries: DataFrame, reference: DataFrame, k: int = 5, **kw) -> DataFrame:
    """Query rows against a reference table, no self-exclusion."""
    return knn_per_class(queries, reference, k=k, exclude_self=False, **kw)


def top_k_per_group(df: DataFrame, by: list[str], order: list, k: int, rank_col: str = "rank") -> DataFrame:
    """The ``k`` smallest rows per group by ``order`` (ties need a unique last key).

    ``row_number() <= k`` lets Catalyst insert a partial ``WindowGroupLimit``
    before the shuffle, so at most ``k`` rows per group and task move.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def neighbor_distances(neighbors: DataFrame, q_leaves: DataFrame, r_leaves: DataFrame) -> DataFrame:
    """Recompute each (qid, nid) pair's distance with the array expression."""
    q = q_leaves.select(F.col("id").alias("qid"), F.col("leaves").alias("q_leaves"))
    r = r_leaves.select(F.col("id").alias("nid"), F.col("leaves").alias("r_leaves"))
    return neighbors.join(q, "qid").join(r, "nid").select(
        "qid", "cls", "rank", "nid", hamming_distance("q_leaves", "r_leaves").alias("dist"))


def neighbor_lookup(neighbors: DataFrame, props: DataFrame, key: str = "id") -> DataFrame:
    """Long form: each neighbour row with the neighbour's property columns."""
    p = props.withColumnRenamed(key, "nid")
    return neighbors.join(p, "nid", "left")


def neighbor_records(neighbors: DataFrame, props: DataFrame, key: str = "id", as_json: bool = True) -> DataFrame:
    """Per (qid, cls): neighbours' property records in rank order.

    ``as_json=True`` serialises the list (the text handed to a prompt);
    otherwise an ``array<struct>`` is returned.
    """
    looked = neighbor_lookup(neighbors, props, key)
    prop_cols = [c for c in props.columns if c != key]
    rec = F.struct(F.col("rank"), F.struct(*prop_cols).alias("props"))
    grouped = looked.groupBy("qid", "cls").agg(F.sort_array(F.collect_list(rec)).alias("_r"))
    records = F.transform("_r", lambda x: x["props"])
    as_text = F.to_json(records, {"ignoreNullFields": "false"})   # keep missing properties explicit
    return grouped.select("qid", "cls", (as_text if as_json else records).alias("records"))


def neighbor_lists(neighbors: DataFrame, queries: DataFrame | None = None, query_id: str = "id") -> DataFrame:
    """``(qid, approved_neighbors array<long>, unapproved_neighbors array<long>)``.

    With ``queries`` given, every query appears, with empty arrays for a
    class without members.
    """
    item = F.struct("rank", "nid")
    agg = neighbors.groupBy("qid").agg(
        F.sort_array(F.collect_list(F.when(F.col("cls") == 1, item))).alias("_a"),
        F.sort_array(F.collect_list(F.when(F.col("cls") == 0, item))).alias("_u"),
    )
    out = agg.select(
        "qid",
        F.transform("_a", lambda x: x["nid"]).alias("approved_neighbors"),
        F.transform("_u", lambda x: x["nid"]).alias("unapproved_neighbors"),
    )
    if queries is not None:
        ids = queries.select(F.col(query_id).cast("long").alias("qid"))
        empty = F.array().cast("array<bigint>")
        out = ids.join(out, "qid", "left").select(
            "qid",
            F.coalesce("approved_neighbors", empty).alias("approved_neighbors"),
            F.coalesce("unapproved_neighbors", empty).alias("unapproved_neighbors"),
        )
    return out
