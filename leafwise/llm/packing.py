"""Packing token sequences by a configuration linear program.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches
the driver.  There lengths are classes of ``UNIT`` tokens, and the covering
program "fewest bins such that every class is covered" is solved by
multiplicative weights: classes covered least weigh most, and an
unbounded-knapsack dynamic program prices the best bin for the weights.  The
fractional solution is rounded down; each of its bins takes the longest real
lengths of its classes and is topped up by the longest pieces that still fit,
and so are the bins for what the rounding leaves.  A bin used ``m`` times is
one entry of the plan; a piece finds its bin by arithmetic on its rank among
the pieces of its length, so no sequence is ever built in one task.

Edge cases: a NULL or empty text is the end token alone; repeated rows, and
rows of one or no doc_id, are packed each by itself; very long texts are cut
into pieces; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafwise.llm.common import bound_batches, parts_for, saved, text_bytes

CAPACITY = 4096
END_ID = 1
#: Distinct words (of at most CACHED bytes) whose ids a worker remembers; beyond it, it starts anew.
CACHE = 1_000_000
CACHED = 64
#: A mark that the tokenizer gives one id; words that hold it are encoded alone.
BAR = "~"
#: Words encoded in one call.
JOINED = 10_000
#: Rounds of the multiplicative weights, at most.
ROUNDS = 6000
#: Share of a class's pieces that one round covers.
STEP = 0.05
#: Tokens in a unit; the lengths that round up to the same units are a class of the linear program.
UNIT = 16
#: Pieces numbered together in one task, on average.
NUMBERED = 50_000


def tokens_column(path: str, text: str = "text", end_id: int = END_ID) -> Column:
    """Token ids (little-endian 32-bit, as binary) of a text, the end id last.

    The tokenizer never joins characters across white space, so its ids for
    a word hold wherever the word stands, and are looked up once per word and
    worker process.  As the tokenizer itself does, the strings of its special
    tokens in a text are those tokens.
    """

    @F.pandas_udf("binary")
    def tokenize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = _words(path)
        end = np.array([end_id], "<u4").tobytes()
        for texts in batches:
            yield pd.Series([ids + end for ids in words.encode(list(texts))], dtype=object)

    return tokenize(text_bytes(text))


class Words:
    """Ids of whole texts, word by word, and of the words seen so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        bar = self.tokenizer.encode(BAR, add_special_tokens=False).ids
        self.bar = bar[0] if len(bar) == 1 else None
        self.known: dict[bytes, bytes] = {}

    def one(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[bytes]) -> None:
        """Ids of many words from one call: the words joined by a mark that is one token."""
        known = self.known
        joined = f" {BAR} ".encode().join(words).decode("utf-8", "replace")
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(ids == self.bar) if self.bar is not None else ids[:0]
        if len(cuts) != len(words) - 1:
            known.update((w, self.one(w)) for w in words)
            return
        raw, cuts = ids.tobytes(), 4 * cuts
        known.update(zip(words, map(raw.__getitem__, map(slice, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)]))))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        known = self.known
        split = [t.split() for t in texts]
        if len(known) > CACHE:
            known.clear()
        new = list(set(itertools.chain.from_iterable(split)).difference(known))
        plain = [w for w in new if BAR.encode() not in w]
        for i in range(0, len(plain), JOINED):
            self.learn(plain[i : i + JOINED])
        known.update((w, self.one(w)) for w in new if BAR.encode() in w)
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > CACHED:
                del known[w]
        return out


@cache
def _words(path: str) -> Words:
    """One per worker process: what one task has learnt serves the next."""
    return Words(path)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids; only documents over ``capacity`` are cut."""
    bound_batches(docs.sparkSession)
    ids = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        tokens_column(path or public_tokenizers.path("word_bpe_49k.json")).alias("all"),
    )
    n = F.expr("length(all) div 4")
    cut = ids.withColumn("n", n).select("doc_id", "all", "n", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / capacity).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return cut.select(
        "doc_id", "piece", start.alias("start"),
        F.least(F.lit(capacity).cast("long"), F.col("n") - start).alias("length"),
        F.substring("all", (start * 4 + 1).cast("int"), F.lit(capacity * 4)).alias("ids"),
    )


def _knapsack(value: np.ndarray, room: int) -> dict[int, int]:
    """The bin (class -> copies) of most value: unbounded-knapsack dynamic program; class c takes c + 1 units of ``room``."""
    best, take = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        best[r] = best[r - 1]
        k = min(r, len(value))
        got = best[r - 1 :: -1][:k] + value[:k]
        if got[i := int(got.argmax())] > best[r]:
            best[r], take[r] = got[i], i
    out: dict[int, int] = {}
    r = room
    while r > 0:
        if (i := int(take[r])) < 0:
            r -= 1
        else:
            out[i] = out.get(i, 0) + 1
            r -= i + 1
    return out


def fractional_bins(need: np.ndarray, room: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], float]]:
    """Bins over length classes with fractional multiplicities that cover ``need``.

    Multiplicative weights: a class's dual price falls exponentially with
    the share of it that is covered; each round takes the bin of most value
    until a further ``STEP`` of one of its classes is covered.
    """
    wanted = need > 0
    if not wanted.any():
        return []
    cover = np.where(wanted, 0.0, np.inf)
    found: dict[tuple, float] = {}
    rate = math.log(max(2, len(need))) / STEP
    for _ in range(rounds):
        least = cover.min()
        if least >= 1:
            break
        price = np.where(wanted, np.exp(-np.minimum(rate * (cover - least), 20)) / np.maximum(need, 1), 0.0)
        bin_ = _knapsack(price, room)
        times = min(STEP * need[i] / a for i, a in bin_.items())
        key = tuple(sorted(bin_.items()))
        found[key] = found.get(key, 0.0) + times
        for i, a in bin_.items():
            cover[i] += a * times / need[i]
    return [(dict(k), x) for k, x in found.items()]


@dataclass
class Block:
    """Pieces of one length, ranks lo..hi-1, that fill ``copies`` places in bins from ``first``."""

    length: int
    lo: int
    hi: int
    copies: int
    first: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[Block], int]:
    """Blocks that place every piece, and the number of bins."""
    sizes = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[s] for s in sizes], np.int64)
    used, blocks, bins = np.zeros(len(sizes), np.int64), [], 0

    def place(bin_: dict[int, int], times: int) -> None:
        nonlocal bins
        offset = 0
        for i, a in sorted(bin_.items(), reverse=True):
            blocks.append(Block(int(sizes[i]), int(used[i]), int(used[i] + a * times), a, bins, offset))
            used[i] += a * times
            left[i] -= a * times
            offset += a * int(sizes[i])
        bins += times

    def longest(limit: int) -> int:
        """Index of the longest length with pieces left that is at most ``limit``; -1 without one."""
        i = int(np.searchsorted(sizes, limit, side="right")) - 1
        while i >= 0 and left[i] == 0:
            i -= 1
        return i

    def fill(bin_: dict[int, int], room: int) -> dict[int, int]:
        """The bin with the longest pieces that still fit."""
        limit = room
        while room > 0 and (i := longest(min(room, limit))) >= 0:
            a = min(int(left[i]) - bin_.get(i, 0), room // int(sizes[i]))
            if a > 0:
                bin_[i] = bin_.get(i, 0) + a
                room -= a * int(sizes[i])
            limit = int(sizes[i]) - 1
        return bin_

    def concrete(pattern: dict[int, int]) -> dict[int, int] | None:
        """A bin of real lengths for a bin of classes; None when a class has run out."""
        bin_, room = {}, capacity
        for c, a in sorted(pattern.items(), reverse=True):
            for _ in range(a):
                i = longest((c + 1) * unit)
                while i >= 0 and left[i] <= bin_.get(i, 0) and sizes[i] > c * unit:
                    i = longest(int(sizes[i]) - 1)
                if i < 0 or sizes[i] <= c * unit:
                    return None
                bin_[i] = bin_.get(i, 0) + 1
                room -= int(sizes[i])
        return fill(bin_, room)

    unit = min(UNIT, capacity)
    need = np.zeros(-(-capacity // unit))
    np.add.at(need, (sizes - 1) // unit, left)
    # bins of the longest pieces first: short ones are what tops up and what the rest is filled with
    for pattern, x in sorted(fractional_bins(need, capacity // unit, rounds), key=lambda p: sorted(p[0], reverse=True), reverse=True):
        wanted = math.floor(x)
        while wanted > 0 and (bin_ := concrete(pattern)):
            times = min(wanted, *(int(left[i]) // a for i, a in bin_.items()))
            place(bin_, times)
            wanted -= times
    while left.any():
        bin_ = fill({}, capacity)
        place(bin_, min(int(left[i]) // a for i, a in bin_.items()))
    return blocks, bins


def numbered(items: DataFrame, order: list[str]) -> DataFrame:
    """``items`` with ``rank``, gapless from 0 within each length, without a task per length."""
    buckets = parts_for(items.count(), NUMBERED)
    keyed = items.withColumn("deal", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = (
        keyed.groupBy("length", "deal").count()
        .withColumn("before", F.sum("count").over(W.partitionBy("length").orderBy("deal")) - F.col("count"))
        .drop("count")
    )
    local = F.row_number().over(W.partitionBy("length", "deal").orderBy(*order)) - 1
    ranked = keyed.withColumn("local", local).join(before, ["length", "deal"])
    return ranked.withColumn("rank", F.col("local") + F.col("before")).drop("local", "before", "deal")


def pack(items: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``items`` (with ``length``, 1 to ``capacity``) plus sequence_id and offset.

    ``items`` should be a written table: it is read for the histogram and
    again for the ranks. The plan holds a bounded number of rows (patterns
    over at most ``capacity`` lengths) and is broadcast.
    """
    spark = items.sparkSession
    histogram = {int(r["length"]): r["count"] for r in items.groupBy("length").count().collect()}  # at most `capacity` rows
    blocks, _ = plan(histogram, capacity)
    rows = [(b.length, b.lo, b.hi, b.copies, b.first, b.offset) for b in blocks]
    table = spark.createDataFrame(rows, "b_length long, b_lo long, b_hi long, b_copies long, b_first long, b_offset long")
    found = numbered(items, order).join(
        F.broadcast(table), (F.col("length") == F.col("b_length")) & (F.col("rank") >= F.col("b_lo")) & (F.col("rank") < F.col("b_hi"))
    )
    at = F.col("rank") - F.col("b_lo")
    return found.withColumns({
        "sequence_id": F.expr("b_first + (rank - b_lo) div b_copies"),
        "offset": F.col("b_offset") + F.pmod(at, F.col("b_copies")) * F.col("length"),
    }).select(*items.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if kept).

    The pieces are written once to the shared folder; with ``keep_ids`` the
    token ids travel along, so that a sequence can be written by sorting on
    sequence_id and offset.
    """
    got = pieces(docs, path).withColumns({"ids_crc32": F.crc32("ids"), "row": F.monotonically_increasing_id()})
    # rows are told apart by number: many may share an id
    return pack(saved(got if keep_ids else got.drop("ids"), "pieces"), ["doc_id", "piece", "row"]).drop("row")
