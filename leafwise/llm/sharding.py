"""Shards by a k-d tree over document metadata.

A node holds rows; while it weighs more than the target, it is split at the
weighted median of the dimension along which it is widest.  The median is
found on the cluster: rows of a node are histogrammed along the dimension
(all open nodes in one job), the bin in which the median falls is refined
until it is a single place, and rows that share that place are ordered by the digest
of the text and the id, so a cut may fall between any two documents, but
parts equal texts only at a cut.  Only histograms reach the driver.

The dimensions are the log of the size, the language (by hash) and the bytes
per character, each scaled by its range over the table; a node is widest
along the one with the largest extent.  All follow from the text and its
language, not from the source, so that equal texts stay neighbours.  Law
``bytes``: shards weigh nearly the same, up to a document at each cut.

Edge cases: NULL text weighs one byte; a NULL source or language is a place
of its own; repeated rows count as often as they occur; an empty table gives
no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafwise.llm.common import parts_for, saved

SHARDS = 8
#: Bins of a histogram pass, and the passes: together they tell 2**48 places apart.
BITS = 12
PASSES = 4
#: Rows numbered together in one task, on average.
NUMBERED = 50_000

_PLACES = 1 << (BITS * PASSES)


DIMS = ["d0", "d1", "d2"]


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the order of ties, and the dimensions d0..d2 of every document."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    octets = F.octet_length(raw).cast("long")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (octets + 1).alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.xxhash64(raw).alias("tie"),
        F.log2((octets + 1).cast("double")).alias("d0"),
        F.pmod(F.xxhash64(lang), F.lit(1 << 20)).cast("double").alias("d1"),
        (octets / F.greatest(F.char_length(raw), F.lit(1))).alias("d2"),
    )


def _key(node_dim: Column, low: dict[str, float], high: dict[str, float]) -> Column:
    """The row's place (an integer below 2**48) along its node's dimension."""
    x = F.lit(None).cast("double")
    for i, d in enumerate(DIMS):
        x = F.when(node_dim == i, (F.col(d) - low[d]) / ((high[d] - low[d]) or 1.0)).otherwise(x)
    return F.least((x * float(_PLACES)).cast("long"), F.lit(_PLACES - 1))


def _cut(rows: DataFrame, key: str, open_nodes: dict[int, float]) -> dict[int, tuple[int, float]]:
    """Per node: the first place at which the weight up to it reaches the goal, and the weight before that place.

    ``rows``: node, ``key`` (0 <= key < 2**48), size. One pass per ``BITS`` bits of the place.
    """
    found = {n: (0, 0.0) for n in open_nodes}
    for p in range(PASSES):
        shift = BITS * (PASSES - 1 - p)
        prefix = F.lit(None).cast("long")
        for n, (at, _) in found.items():
            prefix = F.when(F.col("node") == n, F.lit(at)).otherwise(prefix)
        inside = F.shiftright(F.col(key), shift + BITS) == prefix
        hist = (
            rows.where(F.col("node").isin(list(found)) & inside)
            .groupBy("node", F.shiftright(F.col(key), shift).alias("bin")).agg(F.sum("size").alias("w"))
            .collect()  # nodes x 2**BITS rows at most
        )
        bins: dict[int, list] = {n: [] for n in found}
        for r in hist:
            bins[r["node"]].append((r["bin"], r["w"]))
        for n, (_, before) in list(found.items()):
            ordered = sorted(bins[n])
            for b, w in ordered:
                if before + w >= open_nodes[n] or b == ordered[-1][0]:
                    found[n] = (b, before)
                    break
                before += w
    return found


def split(rows: DataFrame, nodes: dict[int, float], low: dict[str, float], high: dict[str, float]) -> DataFrame:
    """Both children of every node in ``nodes`` (node -> weight): node becomes 2 * node or 2 * node + 1."""
    where = F.col("node").isin(list(nodes))
    extents = rows.where(where).groupBy("node").agg(*[(F.max(d) - F.min(d)).alias(d) for d in DIMS]).collect()
    dim = F.lit(None).cast("int")
    for r in extents:
        wide = max(range(len(DIMS)), key=lambda i: (r[DIMS[i]] / ((high[DIMS[i]] - low[DIMS[i]]) or 1.0), -i))
        dim = F.when(F.col("node") == r["node"], F.lit(wide)).otherwise(dim)
    keyed = rows.withColumn("key", F.when(where, _key(dim, low, high)))
    goal = {n: w / 2 for n, w in nodes.items()}
    first = _cut(keyed, "key", goal)

    # among the rows on the cutting place, the same search along a hash of the text, then of the id
    left = F.lit(False)
    at_place = F.lit(False)
    for n, (place, _) in first.items():
        own = F.col("node") == n
        left |= own & (F.col("key") < place)
        at_place |= own & (F.col("key") == place)
    cut_bits = 64 - BITS * PASSES
    on = keyed.where(at_place).withColumn("tie_key", F.shiftrightunsigned("tie", cut_bits))
    second = _cut(on, "tie_key", {n: goal[n] - first[n][1] for n in first})
    same_text = F.lit(False)
    for n, (place, _) in second.items():
        own = at_place & (F.col("node") == n)
        tie_key = F.shiftrightunsigned("tie", cut_bits)
        left |= own & (tie_key < place)
        same_text |= own & (tie_key == place)
    by_id = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("id")), cut_bits)
    last = keyed.where(same_text).withColumn("id_key", by_id)
    rest = {n: goal[n] - first[n][1] - second[n][1] for n in second}
    third = _cut(last, "id_key", rest)
    weight_at = {r["node"]: r["w"] for n in third for r in last.where((F.col("node") == n) & (F.col("id_key") == third[n][0])).groupBy("node").agg(F.sum("size").alias("w")).collect()}
    for n, (place, before) in third.items():
        own = same_text & (F.col("node") == n)
        # the document on the cut goes to the side that it unbalances less
        more = 1 if before + weight_at.get(n, 0) / 2 < rest[n] else 0
        left |= own & (by_id < place + more)
    child = F.when(where, F.col("node") * 2 + F.when(F.coalesce(left, F.lit(False)), 0).otherwise(1)).otherwise(F.col("node"))
    return keyed.withColumn("node", child).drop("key")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every document with its shard (0 to ``shards`` - 1, a power of two) and its slot in it.

    Returns doc_id, size, text_crc32, shard, slot.
    """
    depth = int(math.log2(shards))
    if 1 << depth != shards:
        raise ValueError("the number of shards must be a power of two")
    rows = saved(metadata(docs), "kd").withColumn("node", F.lit(1).cast("long"))
    ends = [f(d).alias(f"{f.__name__}_{d}") for d in DIMS for f in (F.min, F.max)]
    total = rows.agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"), *ends).first()
    n = total["n"]
    low, high = ({d: total[f"{f}_{d}"] or 0.0 for d in DIMS} for f in ("min", "max"))
    target = (total["w"] or 0) / shards
    for level in range(depth):
        weights = {r["node"]: r["w"] for r in rows.groupBy("node").agg(F.sum("size").alias("w")).collect()}
        heavy = {k: float(w) for k, w in weights.items() if w > target and k >= 1 << level}
        if not heavy:
            break
        rows = saved(split(rows, heavy, low, high), f"kd{level}")
    # a leaf that stopped early sits at its leftmost place
    node = F.col("node")
    leaf = F.lit(None).cast("long")
    for level in range(depth + 1):
        leaf = F.when(node >= (1 << level), node * (1 << (depth - level)) - shards).otherwise(leaf)
    placed = rows.select("doc_id", "size", "text_crc32", "tie", leaf.cast("int").alias("shard"))

    buckets = parts_for(n, NUMBERED)
    # by the id too: a large group of equal texts is no one task's
    dealt = placed.withColumn("deal", F.pmod(F.xxhash64("tie", "doc_id"), F.lit(buckets)))
    before = (
        dealt.groupBy("shard", "deal").count()
        .withColumn("before", F.sum("count").over(W.partitionBy("shard").orderBy("deal")) - F.col("count")).drop("count")
    )
    local = F.row_number().over(W.partitionBy("shard", "deal").orderBy("tie", "doc_id")) - 1
    out = dealt.withColumn("local", local).join(before, ["shard", "deal"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("local") + F.col("before")).alias("slot"))
