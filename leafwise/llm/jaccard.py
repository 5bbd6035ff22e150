"""Exact Jaccard join of documents on word shingles by a blocked sparse product.

The overlap of two documents is an entry of X X', X the incidence of documents
by shingles.  The product is taken in blocks that can hold a link:

1. Texts with the same words are one row of X.
2. A linked pair shares one of the rarest shingles of both (the first
   n - ceil(0.85 n) + 1 in one global order, rare first by counts in a hashed
   table over all documents) and sizes within 0.85 of each other.  Documents
   that share such a shingle in neighbouring size bands are connected through
   one of them, which gives clusters that no link leaves.
3. A cluster is a block: overlaps accumulate over slices of its shingles, and
   pairs below the bound that follows from their sizes are discarded.  A
   cluster too large for one block is first tried by stars: under every rare
   shingle the text that shares most with others is tried with the rest, so
   that families of copies become components by no more pairs than postings.
   Members outside the largest component are then tried with the texts of
   other components that share a rare shingle with them: short posting lists
   as pairs, long ones by blocks (a list of many parts by pairs of its parts).
   What moves is a parity bitmap: a pair goes whose bitmaps differ in more
   places than the sets of a linked pair can (each place that differs is an
   element of only one of the two sets).  Sets are made only for pairs that
   pass: all at once where few, else one partner of each text first, then
   those that still join two components.

So no link between different texts is lost, and rows of pairs are only those
of texts outside their cluster's largest component that sizes and bitmaps
cannot tell from links.
Shingles and texts are told apart by 64-bit hashes.

Edge cases: NULL or blank text has no shingles and links with nothing; fewer
words than a shingle make one shingle; repeated rows and ties join the same
component; a row with a NULL doc_id takes no part and has a NULL component; an
empty table gives no rows; very long texts are read whole; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwise.llm.common import attach_groups, bound_batches, mix64, no_wider, parts_for, saved, text_bytes
from leafwise.llm.components import components
from leafwise.llm.words import Words, some_at_once

#: Similarity threshold in per cent, and words in a shingle.
PERCENT = 85
WORDS = 4
#: log2 of the slots of the count table.
TABLE_BITS = 20
SLICE = 4096
#: log2 of the bits that tell which documents' sets are needed; others may pass, none is missed.
FILTER_BITS = 23
#: Members of a cluster that are one block; a larger cluster goes by stars.
BLOCK = 2048
#: Numbers in a slice of an incidence matrix.
CELLS = 1 << 22
#: Pairs of texts that a task holds at once, on average.
PAIRS = 200
#: Up to so many pairs outside the largest components are tried at once; of more, one partner of each text goes first.
FEW = 50 * PAIRS
#: Longest posting list that is one block, postings in a task, on average, and rows of bitmaps compared at once.
LIST = 4096
POSTINGS = 10_000
CHUNK = 256
#: Posting lists up to this length are lists of pairs; in longer ones bitmaps are compared first.
SHORT = 16
NO_ID = -(2**63)
#: Documents in a task of small clusters, on average.
TOGETHER = 1000
#: Rows of texts (their ids and sizes) in a task.
TEXTS = 50_000

#: Odd factors of the shingle hash.
_FACTORS = [np.uint64(mix64(np.array([i + 1], np.uint64))[0] | np.uint64(1)) for i in range(32)]


def shingles(texts, words: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """Per text: a hash of its word sequence as a signed 64-bit integer, and the hash of every shingle, repeats included."""
    for run in some_at_once(texts):
        found = Words(run)
        a = found.hashes()
        every = _windows(a, words)
        for n, end in zip(found.counts.tolist(), np.cumsum(found.counts).tolist()):
            own = a[end - n : end]
            # shorter than a shingle: one of all its words
            h = every[end - n : end - words + 1] if n >= words else _windows(own, n)
            yield int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64)), h


def _windows(a: np.ndarray, span: int) -> np.ndarray:
    """Hash of every ``span`` neighbours of the word hashes ``a``."""
    if not 0 < span <= len(a):
        return np.zeros(0, np.uint64)
    h = np.full(len(a) - span + 1, np.uint64(span))
    for i in range(span):
        h += a[i : len(a) - span + 1 + i] * _FACTORS[i]
    return mix64(h)


def _distinct(h: np.ndarray) -> np.ndarray:
    """The hashes in order, each once."""
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def _rarest(h: np.ndarray, count: np.ndarray, m: int) -> np.ndarray:
    """The ``m`` hashes of least count (of equal counts the smaller hashes); ``h`` in order."""
    if not m:
        return h[:0]
    bar = np.partition(count, m - 1)[m - 1]
    below = h[count < bar]
    return np.concatenate([below, h[count == bar][: m - len(below)]])


def _slot(h: np.ndarray, bits: int = TABLE_BITS) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def count_table(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Shingles of all documents counted in 2**TABLE_BITS hashed slots: a bounded table, summed on the cluster."""
    n = 1 << TABLE_BITS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(n, np.int64)
        for pdf in batches:
            got = [h for _, h in shingles(pdf["t"], words)]
            table += np.bincount(_slot(np.concatenate(got)), minlength=n)
        if table.any():
            yield pd.DataFrame({"slice": range(n // SLICE), "counts": [x.tobytes() for x in table.reshape(-1, SLICE)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum((np.frombuffer(x, np.int64) for x in pdf["counts"]), np.zeros(SLICE, np.int64))
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "counts": [total.tobytes()]})

    some = docs.select(text_bytes().alias("t")).mapInPandas(count, "slice int, counts binary")
    some = some.withColumn("salt", F.spark_partition_id() % 256)
    some = some.groupBy("slice", "salt").applyInPandas(add, "slice int, counts binary")
    table = np.zeros((n // SLICE, SLICE), np.int64)
    for r in some.groupBy("slice").applyInPandas(add, "slice int, counts binary").collect():  # n / SLICE rows
        table[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return table.reshape(-1)


def signatures(docs: DataFrame, table: np.ndarray, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, k (hash of the word sequence), n (set size), the prefix (rarest shingles, as binary) and the parity
    bitmap of every document."""
    level = docs.sparkSession.sparkContext.broadcast(table)  # 2**TABLE_BITS numbers

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = level.value
        for pdf in batches:
            rows = []
            for k, h in shingles(pdf["t"], words):
                h = _distinct(h)
                n = len(h)
                rare = _rarest(h, count[_slot(h)], n - (-(-percent * n // 100)) + 1 if n else 0)
                rows.append((k, n, rare.tobytes(), _parity(h)))
            yield pd.DataFrame(rows, columns=["k", "n", "prefix", "bits"]).assign(doc_id=pdf["doc_id"])[["doc_id", "k", "n", "prefix", "bits"]]

    # a NULL id travels as the least number: pandas would make ids beside it inexact
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_bytes().alias("t"))
    return rows.mapInPandas(sign, "doc_id long, k long, n long, prefix binary, bits binary").withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NO_ID)))


def _postings(signed: DataFrame) -> DataFrame:
    """(token, k, n) of every prefix shingle."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tokens = [np.frombuffer(x, np.int64) for x in pdf["prefix"]]
            times = [len(x) for x in tokens]
            if sum(times):
                yield pd.DataFrame({"token": np.concatenate(tokens), "k": np.repeat(pdf["k"].to_numpy(), times), "n": np.repeat(pdf["n"].to_numpy(), times)})

    return signed.select("k", "n", "prefix").mapInPandas(explode, "token long, k long, n long")


def clusters(signed: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(token, k, n) of shared rare shingles, and (node, root): texts that may be linked, by cluster."""
    # most shingles are of one text: all postings move once, and those of a shingle that texts share stay
    of_token = Window.partitionBy("token")
    shared = _postings(signed).withColumns({"a": F.min("k").over(of_token), "b": F.max("k").over(of_token)}).where("a <> b")
    held = shared.select("token", "k", "n").dropDuplicates(["token", "k"])
    # bands a little wider than the bound, so that sizes within it are in the same band or the next
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100.0 / (percent - 0.5))))
    # neighbouring bands meet under the upper one's name; a list's bands lie where the list is
    banded = held.withColumn("upper", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", band + F.col("upper"))
    banded = saved(banded.withColumn("hub", F.min("k").over(Window.partitionBy("token", "band"))).select("token", "k", "n", "upper", "hub"), "shared")
    return banded.where("upper = 0").select("token", "k", "n"), components(banded.select(F.col("k").alias("u"), F.col("hub").alias("v")))


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """``wanted`` (doc_id, k, ...) with s, the shingle set of the document.

    A bitmap of fixed size over hashed ids spares other documents the work;
    what passes it by chance goes in the join.
    """
    spark = docs.sparkSession
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)) + 1  # bitmap positions count from 1
    maps = (
        wanted.select(bit.alias("b")).groupBy(F.expr("bitmap_bucket_number(b)").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("bits")).collect()  # 2**FILTER_BITS bits at most
    )
    span = 4096 * 8
    flags = np.zeros(((1 << FILTER_BITS) // span + 2) * 4096, np.uint8)
    for r in maps:
        flags[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    level = spark.sparkContext.broadcast(flags)

    def shingle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = level.value
        for pdf in batches:
            b = pdf["b"].to_numpy() - 1
            pdf = pdf[(bits[b // 8] >> (b % 8)) & 1 == 1]
            if len(pdf):
                sets = [(k, _distinct(h).tobytes()) for k, h in shingles(pdf["t"], words)]
                yield pd.DataFrame(sets, columns=["k", "s"]).assign(doc_id=pdf["doc_id"].to_numpy())[["doc_id", "k", "s"]]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bit.alias("b"), text_bytes().alias("t"))
    sets = rows.where("doc_id is not null").mapInPandas(shingle, "doc_id long, k long, s binary")
    return wanted.join(sets, ["doc_id", "k"]).dropDuplicates(["doc_id", "k"])  # rows may repeat


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of all intersections of two blocks of sets (or of one with itself).

    The product of the incidence matrices, slice by slice; a shingle that
    only one set holds has no part in it.
    """
    sets = left + (right or [])
    column, at, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    common = np.flatnonzero(held > 1)
    place = np.full(len(column), -1)
    place[common] = np.arange(len(common))
    at = place[at]
    row, at = row[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    m = len(left)
    total = np.zeros((m, len(right) if right is not None else m), np.float32)
    step = max(256, CELLS // len(sets))
    for lo in range(0, len(common), step):
        a, b = np.searchsorted(at, [lo, lo + step])
        x = np.zeros((len(sets), min(step, len(common) - lo)), np.float32)
        x[row[a:b], at[a:b] - lo] = 1
        total += x[:m] @ (x[m:] if right is not None else x).T
    got = np.rint(total).astype(np.int64)
    if right is None:
        np.fill_diagonal(got, [len(x) for x in left])
    return got


def linked(left: list[np.ndarray], right: list[np.ndarray] | None = None, percent: int = PERCENT) -> np.ndarray:
    """Which pairs of two blocks (or of one) reach the threshold."""
    size = [np.array([len(x) for x in y]) for y in (left, left if right is None else right)]
    inter = overlaps(left, right)
    return (100 * inter >= percent * (size[0][:, None] + size[1][None, :] - inter)) & (inter > 0)


def _sets(col: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in col]


def _link_small(percent: int):
    """(node, root) of the components, of two texts or more, of whole clusters."""

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        node, root = [], []
        for _, block in pdf.groupby("root", sort=False):
            k, sets = block["k"].to_numpy(), _sets(block["s"])
            label = np.arange(len(k))
            for i, j in zip(*np.nonzero(np.triu(linked(sets, None, percent), 1))):
                if label[i] != label[j]:
                    label[label == label[j]] = label[i]
            for x in np.unique(label):
                own = k[label == x]
                if len(own) > 1:
                    node += own.tolist()
                    root += [own[0]] * len(own)
        return pd.DataFrame({"node": np.array(node, np.int64), "root": np.array(root, np.int64)})

    return link


def _parity(h: np.ndarray) -> bytes:
    """Bitmap of at least two places per element: the places that an odd number of elements hash to."""
    size = 1 << max(6, (max(len(h), 1) - 1).bit_length() + 1)
    return np.packbits((np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def _folded(bits: list[np.ndarray], words: int) -> np.ndarray:
    """Bitmaps as rows of ``words`` numbers, larger ones folded: folding adds the parities of places that fall together."""
    return np.stack([np.bitwise_xor.reduce(x.reshape(-1, words), axis=0) for x in bits])


def passing(x: np.ndarray, y: np.ndarray, n: np.ndarray, bits: list[np.ndarray], allowed, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of ``x`` and ``y``, positions) that sizes and bitmaps let reach the threshold; ``allowed(i, j)`` masks others.

    Bitmaps are compared at the smaller of two lengths, which are powers of
    two that follow from the sizes; a linked pair's are equal or neighbours.
    """
    length = np.array([len(b) for b in bits])
    out_i, out_j = [], []
    for p in np.unique(length[x]):
        for q in np.unique(length[y]):
            words = int(min(p, q))
            xs, ys = x[length[x] == p], y[length[y] == q]
            if not len(xs) or not len(ys) or 100 * n[xs].max() < percent * n[ys].min() or 100 * n[ys].max() < percent * n[xs].min():
                continue
            b = _folded([bits[i] for i in ys], words)
            for lo in range(0, len(xs), CHUNK):
                some = xs[lo : lo + CHUNK]
                a = _folded([bits[i] for i in some], words)
                total = n[some][:, None] + n[ys][None, :]
                ok = allowed(some[:, None], ys[None, :]) & (100 * np.minimum(n[some][:, None], n[ys][None, :]) >= percent * np.maximum(n[some][:, None], n[ys][None, :]))
                if not ok.any():
                    continue
                differ = np.zeros(ok.shape, np.int64)
                for w in range(words):
                    differ += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
                i, j = np.nonzero(ok & ((total - differ) * (100 + percent) >= 2 * percent * total))
                out_i.append(some[i])
                out_j.append(ys[j])
    if not out_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_i), np.concatenate(out_j)


def _short_pairs(percent: int):
    """Pairs (k, other, total) of strays and texts of other components in short posting lists, many lists at once."""

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("token", kind="stable")
        token, stray, k, comp, n = (pdf[c].to_numpy() for c in ("token", "stray", "k", "comp", "n"))
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        sizes = np.diff(np.r_[starts, len(token)])
        out = []
        for z in np.unique(sizes[sizes > 1]):
            lists = starts[sizes == z][:, None] + np.arange(z)
            i, j = (lists[:, c].ravel() for c in np.triu_indices(z, 1))
            ok = (comp[i] != comp[j]) & (stray[i] | stray[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            i, j = i[ok], j[ok]
            turn = ~stray[i] | (stray[j] & (k[j] < k[i]))
            i, j = np.where(turn, j, i), np.where(turn, i, j)
            out.append(np.stack([k[i], k[j], n[i] + n[j]], axis=1))
        got = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)
        return pd.DataFrame({"k": got[:, 0], "other": got[:, 1], "total": got[:, 2]})

    return pairs


def _long_pairs(percent: int):
    """Pairs (k, other) of strays and texts of other components in long posting lists that pass the bitmaps; a
    token's list is whole in its group, or one of the pairs (a, b) of its parts."""

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for (_, a, b), part in pdf.groupby(["token", "a", "b"], sort=False):
            stray, k, comp, slot = (part[c].to_numpy() for c in ("stray", "k", "comp", "slot"))
            bits = [np.frombuffer(x, np.uint64) for x in part["bits"]]

            def allowed(i, j):
                ok = (comp[i] != comp[j]) & (~stray[j] | (k[i] < k[j]))
                return ok if a == b else ok & (slot[i] != slot[j])

            i, j = passing(np.flatnonzero(stray), np.arange(len(k)), part["n"].to_numpy(), bits, allowed, percent)
            found.append(np.stack([k[i], k[j]], axis=1))
        got = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"k": got[:, 0], "other": got[:, 1]})

    return pairs


def may_link(percent: int):
    """Whether two texts (bitmaps, and the sum of their sizes) can reach the threshold."""

    @F.pandas_udf("boolean")
    def may(a: pd.Series, b: pd.Series, total: pd.Series) -> pd.Series:
        x, y = ([np.frombuffer(v, np.uint64) for v in c] for c in (a, b))
        differ = np.array([int(np.bitwise_count(np.bitwise_xor(*_folded([p, q], min(len(p), len(q))))).sum()) for p, q in zip(x, y)], np.int64)
        both = total.to_numpy()
        return pd.Series((both - differ) * (100 + percent) >= 2 * percent * both, dtype=bool)

    return may


def _link_pairs(percent: int):
    def link(own: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        sets = dict(zip(own["k"].tolist(), _sets(own["s"]))) if len(pairs) else {}
        u, v = [], []
        for k, block in pairs.groupby("k", sort=False) if len(pairs) else []:
            hit = linked([sets[k]], _sets(block["s"]), percent)[0]
            v += block["other"].to_numpy()[hit].tolist()
            u += [k] * int(hit.sum())
        return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    return link


def links(docs: DataFrame, wanted: DataFrame, held: DataFrame, bits: DataFrame, percent: int = PERCENT, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """(node, root): texts that links connect, by component; a root is one of its component's texts.

    ``wanted``: doc_id, k, root (its cluster) and size (of the cluster); ``held``:
    token, k, n of the rare shingles that texts share; ``bits``: doc_id, k and
    bitmap of documents. All written.
    """
    bins = parts_for(wanted.count(), TOGETHER)
    small = shingle_sets(docs, wanted.where(F.col("size") <= block), words).withColumn("bin", F.pmod(F.xxhash64("root"), F.lit(bins)))
    # a small cluster is whole in its task, and so are its components
    joined = saved(small.select("bin", "root", "k", "s").groupBy("bin").applyInPandas(_link_small(percent), "node long, root long"), "links")

    large = wanted.where(F.col("size") > block)
    members = large.count()
    if not members:
        return joined
    # all that is known of a text stays in its row, with its shared rare shingles; postings are made from it when needed
    own = held.join(large.select("k"), "k", "left_semi").groupBy("k").agg(F.first("n").alias("n"), F.collect_list("token").alias("tokens"))
    big = large.join(bits, ["doc_id", "k"]).dropDuplicates(["k"]).join(own, "k")
    rare = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1
    big = big.select("doc_id", "root", "k", "bits", "n", "tokens", (F.size("tokens") / rare).alias("score"))
    big = saved(no_wider(big, members, TOGETHER), "large_clusters")

    # stars: each list's best text against the others. Of copies edited here and there the best are those nearest
    # to what all come from: the most of their rare shingles are shared
    scored = big.select(F.explode("tokens").alias("token"), "score", "k", "n")
    best = scored.groupBy("token").agg(F.max(F.struct("score", "k", "n")).alias("t"))
    star = scored.join(best, "token").where(F.col("k") != F.col("t.k")).where(100 * F.least("n", "t.n") >= percent * F.greatest("n", "t.n"))
    star = star.select("k", F.col("t.k").alias("other"), (F.col("n") + F.col("t.n")).alias("total")).distinct()
    star = saved(_possible(star, big, percent), "star_pairs")
    found = _linked_pairs(star, _sets_of(docs, star, big, words, "star_sets"), percent, "star_links")
    comp = components(found)
    state = big.select("root", "k", "n", "tokens").join(comp.toDF("k", "comp"), "k", "left").withColumn("comp", F.coalesce("comp", "k"))

    # those outside their cluster's largest component, with every text that shares a rare shingle
    top = (
        state.groupBy("root", "comp").count().groupBy("root").agg(F.max(F.struct("count", "comp")).alias("top"))
        .where("top.count > 1").select("root", F.col("top.comp").alias("comp"), F.lit(True).alias("largest"))
    )
    stray = state.join(top, ["root", "comp"], "left").withColumn("stray", F.col("largest").isNull())
    # posting lists that hold a stray and a text of another component
    post = no_wider(stray, members, TOGETHER).select(F.explode("tokens").alias("token"), "k", "n", "comp", "stray")
    post = saved(post, "stray_postings")
    lists = post.groupBy("token").agg(F.count(F.lit(1)).alias("long"), F.max("stray").alias("some"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    post = post.join(lists.where("some and lo <> hi").select("token", "long"), "token")
    bins = parts_for(held.count(), POSTINGS)
    short = post.where(F.col("long") <= SHORT).withColumn("bin", F.pmod(F.xxhash64("token"), F.lit(bins)))
    pairs = no_wider(short.groupBy("bin").applyInPandas(_short_pairs(percent), "k long, other long, total long"), bins, 1)
    pairs = _possible(pairs.distinct(), big, percent)
    # a long list is compared by bitmaps where it is; of one of many parts every pair of its parts is a block
    parts = F.ceil(F.col("long") / LIST).cast("int")
    post = post.where(F.col("long") > SHORT).join(big.select("k", "bits"), "k").withColumn("slot", F.pmod(F.xxhash64("k"), parts).cast("int"))
    post = post.withColumn("with", F.explode(F.sequence(F.lit(0), parts - 1))).withColumns({"a": F.least("slot", "with"), "b": F.greatest("slot", "with")})
    post = post.select("token", "a", "b", "slot", "k", "n", "comp", "stray", "bits", F.pmod(F.xxhash64("token", "a", "b"), F.lit(bins)).alias("bin"))
    pairs = pairs.unionByName(no_wider(post.groupBy("bin").applyInPandas(_long_pairs(percent), "k long, other long"), bins, 1))
    pairs = saved(pairs.distinct(), "stray_pairs")
    many = pairs.count()
    if not many:
        return joined.unionByName(comp)
    sets = _sets_of(docs, pairs, big, words, "stray_sets")
    if many > FEW:
        # one partner of each text first: what that joins needs no further pair
        first = saved(pairs.groupBy("k").agg(F.max("other").alias("other")), "first_pairs")
        comp = saved(_with_links(comp, _linked_pairs(first, sets, percent, "first_links")), "stray_components")
        pairs = pairs.join(first, ["k", "other"], "left_anti")
        for c in ("k", "other"):
            pairs = pairs.join(comp.toDF(c, f"{c}_comp"), c, "left")
        pairs = saved(pairs.where("coalesce(k_comp, k) <> coalesce(other_comp, other)").select("k", "other"), "apart_pairs")
    return joined.unionByName(_with_links(comp, _linked_pairs(pairs, sets, percent, "stray_links")))


def _with_links(comp: DataFrame, found: DataFrame) -> DataFrame:
    """Components (node, root) after the links ``found`` (u, v; written)."""
    return comp if found.isEmpty() else components(comp.toDF("u", "v").unionByName(found))


def _possible(pairs: DataFrame, big: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (k, other, total) those that the bitmaps let reach the threshold."""
    maps = big.select("k", F.col("bits").alias("x"))
    return pairs.join(maps, "k").join(maps.toDF("other", "y"), "other").where(may_link(percent)("x", "y", "total")).select("k", "other")


def _sets_of(docs: DataFrame, pairs: DataFrame, big: DataFrame, words: int, name: str) -> DataFrame:
    """k and s (the shingle set) of the texts of the pairs, written."""
    texts = pairs.select("k").unionByName(pairs.select(F.col("other").alias("k"))).distinct()
    wanted = saved(big.select("doc_id", "k").join(texts, "k", "left_semi"), f"{name}_wanted")
    return saved(shingle_sets(docs, wanted, words).select("k", "s"), name)


def _linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """Edges (u, v) for the pairs (k, other) that are links; ``pairs`` and ``sets`` (k, s) written."""
    bins = parts_for(pairs.count(), PAIRS, 1)
    dealt = pairs.select("k", "other", F.pmod(F.xxhash64("k", "other"), F.lit(bins)).alias("bin"))
    own = sets.select("k", "s").join(dealt.select("k", "bin").distinct(), "k").groupBy("bin")
    others = dealt.join(sets.select(F.col("k").alias("other"), F.col("s").alias("t")), "other")
    others = others.select(F.col("bin").alias("bin"), F.col("k").alias("k"), "other", F.col("t").alias("s")).groupBy("bin")
    return saved(no_wider(own.cogroup(others).applyInPandas(_link_pairs(percent), "u long, v long"), bins, 1), name)


def jaccard_join(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every document."""
    bound_batches(docs.sparkSession)
    signed = saved(signatures(docs, count_table(docs, words), percent, words), "signatures")
    total = signed.count()
    texts = signed.where("n > 0 and doc_id is not null").groupBy("k").agg(
        F.first("n").alias("n"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")
    )
    texts = saved(no_wider(texts, total, TEXTS), "texts")
    held, cluster = clusters(signed.where("n > 0 and doc_id is not null"), percent)
    cluster = saved(no_wider(cluster, total, TEXTS), "clusters").withColumnRenamed("node", "k")
    sizes = cluster.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    wanted = texts.join(cluster, "k").join(sizes, "root").select(F.col("first_id").alias("doc_id"), "k", "root", "size")
    bits = signed.select("doc_id", "k", "bits")
    wanted = saved(no_wider(wanted, total, TEXTS), "wanted")
    comp = links(docs, wanted, held, bits, percent, words, block)
    # texts with copies or links, each beside the root of its component; every other document is its own component
    marked = texts.select("k", "first_id", "copies", F.lit(None).cast("long").alias("root")).unionByName(
        comp.select(F.col("node").alias("k"), F.lit(None).cast("long").alias("first_id"), F.lit(None).cast("long").alias("copies"), "root")
    )
    marked = marked.groupBy("k").agg(F.max("first_id").alias("first_id"), F.max("copies").alias("copies"), F.max("root").alias("root"))
    marked = marked.where("copies > 1 or root is not null").withColumn("root", F.coalesce("root", "k"))
    marked = saved(no_wider(marked, total, TEXTS), "marked")
    least = marked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    groups = marked.join(least, "root").select("k", "component_id", "copies")
    alone = signed.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    rows = signed.where("n > 0 and doc_id is not null").select("doc_id", "k", "n")
    rows = attach_groups(rows, saved(groups, "groups"), "k", "copies", total)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")).unionByName(alone)
