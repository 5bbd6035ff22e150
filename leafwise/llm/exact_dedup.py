"""Exact duplicates against an index of digests seen before.

The history's distinct digests are dealt to buckets by their leading bytes and
every bucket gets a minimal perfect hash: ``n`` digests, ``n`` slots, a
displacement per small group of digests.  A slot holds the full 32-byte digest
and the locator (doc_id) of its winner, so a lookup is one slot and one byte
comparison.  New rows are grouped first (copies meet before the shuffle, a hot
text is one row per task), looked up in their bucket, and those that are no
members stay groups of their own.

Edge cases: NULL text is the empty text; a NULL doc_id ranks below all others;
rows that repeat both text and the winning doc_id are the same row and all
``kept``; an empty table gives no rows; extra input columns are ignored.
"""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwise.llm.common import attach_groups, mix64, parts_for, saved

#: Digests in a bucket, on average; a bucket is what one task builds or looks up at a time.
BUCKET = 4096
#: Buckets in a task, on average.
BUCKETS = 16
#: Digests that share a displacement, on average.
GROUP = 4

INDEX_SCHEMA = "bucket long, n int, seeds binary, digests binary, locators binary, counts binary"
GROUP_SCHEMA = "digest binary, keep_id long, group_size long, member boolean"


def digest_column(text: str = "text") -> Column:
    """SHA-256 of the text with A-Z (only) lower-cased; NULL is the empty text."""
    low = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.unhex(F.sha2(low, 256))


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, digest."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_column().alias("digest"))


def _by_bucket(keyed: DataFrame, buckets: int) -> DataFrame:
    """Rows dealt by bucket to tasks of about ``BUCKETS`` buckets, at least as many tasks as slots.

    The count is given: sizes in bytes would have the few small rows of an
    index land in a few tasks, while building a bucket is the work.
    """
    slots = keyed.sparkSession.sparkContext.defaultParallelism
    return keyed.repartition(min(buckets, max(2 * slots, parts_for(buckets, BUCKETS))), "bucket")


def _bucket(n: int):
    head = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    return F.pmod(head, F.lit(n)).alias("bucket")


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = raw.reshape(-1, 32).copy().view("<u8")
    return w[:, 1], w[:, 2], w[:, 3]


def _slot(a: np.ndarray, b: np.ndarray, seed, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(a + np.asarray(seed, dtype=np.uint64) * (b | np.uint64(1))) % np.uint64(n)).astype(np.int64)


def build_slots(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements and each digest's slot for ``n`` distinct digests (bytes, 32 each).

    A group's displacement is the first under which all its digests fall on
    free slots, largest groups first; a group of one takes a free slot
    directly, written as the negative of slot + 1.
    """
    h, a, b = _words(raw)
    n = len(h)
    groups = n // GROUP + 1
    group = (h % np.uint64(groups)).astype(np.int64)
    seeds, slot, free = np.zeros(groups, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group, minlength=groups)
    ends = np.cumsum(sizes)
    spare = None
    for g in np.argsort(-sizes, kind="stable"):
        rows = order[ends[g] - sizes[g] : ends[g]]
        if not len(rows):
            break
        if len(rows) == 1:
            spare = iter(np.flatnonzero(free)) if spare is None else spare
            at = next(spare)
            seeds[g], slot[rows[0]] = -(at + 1), at
            continue
        seed = 0
        while True:
            at = _slot(a[rows], b[rows], seed, n)
            if free[at].all() and len(set(at.tolist())) == len(rows):
                break
            seed += 1
        seeds[g], slot[rows], free[at] = seed, at, False
    return seeds, slot


def find_slots(raw: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """The only slot in which each digest can be."""
    h, a, b = _words(raw)
    seed = seeds[(h % np.uint64(len(seeds))).astype(np.int64)]
    return np.where(seed < 0, -seed - 1, _slot(a, b, np.maximum(seed, 0), n))


def _raw(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in col), np.uint8)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    raw = _raw(pdf["digest"])
    seeds, slot = build_slots(raw)
    n = len(pdf)
    held, where, counts = np.empty((n, 32), np.uint8), np.empty(n, np.int64), np.empty(n, np.int64)
    held[slot], where[slot], counts[slot] = raw.reshape(-1, 32), pdf["keep_id"], pdf["group_size"]
    row = (int(pdf["bucket"].iloc[0]), n, seeds.tobytes(), held.tobytes(), where.tobytes(), counts.tobytes())
    return pd.DataFrame([row], columns=["bucket", "n", "seeds", "digests", "locators", "counts"])


#: Stands for a NULL doc_id inside the index: below every id.
NO_ID = -(2**63)


def groups_of(rows: DataFrame) -> DataFrame:
    """Distinct digests with the winning doc_id and the number of rows."""
    return rows.groupBy("digest").agg(
        F.coalesce(F.max("doc_id"), F.lit(NO_ID)).alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """The slot tables of a history of digests: one row per bucket, to be written and reused."""
    keyed = groups_of(history).select(_bucket(buckets), "digest", "keep_id", "group_size")
    return _by_bucket(keyed, buckets).groupBy("bucket").applyInPandas(_build, INDEX_SCHEMA)


def _look_up(index: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """All distinct digests of a bucket: the history's, updated by repeats, and the nonmembers."""
    out = []
    fresh = np.ones(len(new), bool)
    if len(index):
        x = index.iloc[0]
        n = int(x["n"])
        held = np.frombuffer(x["digests"], np.uint8).reshape(n, 32)
        keep, count = np.frombuffer(x["locators"], np.int64).copy(), np.frombuffer(x["counts"], np.int64).copy()
        if len(new):
            raw = _raw(new["digest"])
            slot = find_slots(raw, np.frombuffer(x["seeds"], np.int64), n)
            fresh = (held[slot] != raw.reshape(-1, 32)).any(axis=1)
            hit = slot[~fresh]
            keep[hit] = np.maximum(keep[hit], new["keep_id"].to_numpy()[~fresh])
            count[hit] += new["group_size"].to_numpy()[~fresh]
        out.append(pd.DataFrame({"digest": [r.tobytes() for r in held], "keep_id": keep, "group_size": count, "member": True}))
    if fresh.any():
        out.append(new.loc[fresh, ["digest", "keep_id", "group_size"]].assign(member=False))
    if not out:
        return pd.DataFrame({"digest": [], "keep_id": [], "group_size": [], "member": []})
    return pd.concat(out, ignore_index=True)


def resolve(new: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Groups over history and new rows together: digest, keep_id, group_size, member."""
    keyed = groups_of(new).select(_bucket(buckets), "digest", "keep_id", "group_size")
    old, fresh = (_by_bucket(x, buckets).groupBy("bucket") for x in (index, keyed))
    return old.cogroup(fresh).applyInPandas(_look_up, GROUP_SCHEMA)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Every document with the row that stays for its text.

    The rows up to the middle of the id range are the history whose digests
    are indexed, the others the new batch looked up in it; both are read
    whole.  Returns doc_id, keep_id, group_size, kept, digest (binary) and
    member (the text was in the history).
    """
    rows = saved(digests(docs), "digests")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    total = stats["n"]
    middle = 0 if stats["lo"] is None else (stats["lo"] + stats["hi"]) // 2
    buckets = parts_for(total, BUCKET)
    old = F.coalesce(F.col("doc_id") <= middle, F.lit(True))
    index = saved(build_index(rows.where(old), buckets), "digest_index")
    groups = saved(resolve(rows.where(~old), index, buckets), "digest_groups")
    repeated = groups.where("group_size > 1 or member")
    own = F.coalesce(F.col("keep_id"), F.col("doc_id"))
    out = attach_groups(rows, repeated, "digest", "group_size", total)
    keep = F.when(own != NO_ID, own)
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        "digest",
        F.coalesce("member", F.lit(False)).alias("member"),
    )
