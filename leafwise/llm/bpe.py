"""Byte-level BPE, encoded with a rank queue over a hierarchical bitmap.

The symbols of the pre-tokens form a doubly linked list, cut between
pre-tokens.  Each merge rank that occurs has a bucket of list positions; a
bitmap of 64-way words tells which buckets are not empty, and find-first-set
from the root leads to the lowest rank.  All positions of that rank are
merged at once, left to right; positions whose pair has changed since they
were queued are stale and skipped.  Every merge queues two new pairs at most,
so n bytes cost O(n) queue entries however long a pre-token is.

Edge cases: NULL text is empty; no ids decode to no bytes; very long texts are
encoded whole; an empty table gives no rows; repeated rows and extra columns
change nothing.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwise.llm.common import bound_batches, text_bytes

#: Pre-tokens (of at most CACHED bytes) whose ids a worker remembers; beyond it, it starts anew.
CACHE = 200_000
CACHED = 64
#: Bytes of text whose pre-tokens are held and share the queue: the more, the fewer steps each costs.
TOGETHER = 2_000_000


class RankQueue:
    """Arrays of positions by merge rank; the lowest rank comes first."""

    def __init__(self, ranks: int):
        self.levels = []
        n = ranks
        while True:
            n = (n + 63) // 64
            self.levels.append([0] * n)
            if n == 1:
                break
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            old = level[word]
            level[word] = old | bit
            if old:
                return
            rank = word

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Positions into the buckets of their ranks; a rank below 0 is none."""
        some = ranks >= 0
        ranks, positions = ranks[some], positions[some]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        first = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        lo = 0
        for hi, rank in zip([*first.tolist(), len(ranks)], ranks[np.append(0, first)].tolist()):
            self.push(rank, positions[lo:hi])
            lo = hi

    def pop(self) -> tuple[int, np.ndarray] | None:
        """Lowest rank and its positions, once each in the order of the text, removed; None when empty."""
        if not self.buckets:
            return None
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            at = (at << 6) | ((word & -word).bit_length() - 1)
        rank = at
        for level in self.levels:
            level[at >> 6] &= ~(1 << (at & 63))
            if level[at >> 6]:
                break
            at >>= 6
        return rank, np.unique(np.concatenate(self.buckets.pop(rank)))


class Codec:
    """Encoder and decoder for the ranks of a vocabulary (bytes -> id, which is also the merge rank)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pieces = {i: b for b, i in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.queue = RankQueue(max(ranks.values()) + 1)
        # every way to make a piece of two others: (left id, right id) -> rank
        pairs = {
            (ranks[t[:k]] << 32) | ranks[t[k:]]: i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks
        }
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of two symbols, -1 without one."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32-bit, as bytes) of every pre-token.

        All pre-tokens lie in one list of symbols, cut between them, and share
        the queue: merges of different pre-tokens do not touch, and each
        pre-token sees its own merges in the order of their ranks.
        """
        whole = [self.ranks.get(p) for p in pieces]
        todo = [p for p, w in zip(pieces, whole) if w is None]
        symbol = self.single[np.frombuffer(b"".join(todo), np.uint8)]
        n = len(symbol)
        ends = np.cumsum([len(p) for p in todo], dtype=np.int64)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = n  # n: nothing follows
        before[(ends - [len(p) for p in todo]).astype(np.int64)] = -1
        alive = np.ones(n, bool)
        queue = self.queue
        left = np.flatnonzero(after < n)
        queue.push_all(self._rank(symbol[left], symbol[after[left]]), left)
        while (found := queue.pop()) is not None:
            rank, at = found
            at = at[alive[at]]
            at = at[after[at] < n]
            # stale entries: the pair there is another one by now
            at = at[self._rank(symbol[at], symbol[after[at]]) == rank]
            if not len(at):
                continue
            right = after[at]
            if len(at) > 1 and (chain := right[:-1] == at[1:]).any():
                # in a run of overlapping pairs every second one is merged, from the left
                place = np.arange(len(at))
                start = np.maximum.accumulate(np.where(np.append(False, chain), 0, place))
                take = (place - start) % 2 == 0
                at, right = at[take], right[take]
            follow = after[right]
            symbol[at], after[at], alive[right] = rank, follow, False
            has = follow < n
            before[follow[has]] = at[has]
            prior = before[at]
            some = prior >= 0
            l, r = np.concatenate([prior[some], at[has]]), np.concatenate([at[some], follow[has]])
            queue.push_all(self._rank(symbol[l], symbol[r]), l)
        ids = symbol[alive].astype("<u4").tobytes()
        cuts = np.append(0, np.cumsum(alive))[ends].tolist() if n else []
        out, lo, k = [], 0, 0
        for w in whole:
            if w is not None:
                out.append(w.to_bytes(4, "little"))
            else:
                out.append(ids[4 * lo : 4 * cuts[k]])
                lo, k = cuts[k], k + 1
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        return np.frombuffer(self.encode_pieces([piece])[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _parts(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Texts in runs of about ``TOGETHER`` bytes (a longer text is a run of its own)."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > TOGETHER:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


class Memory:
    """Ids of whole texts; remembers those of short pre-tokens."""

    def __init__(self, codec: Codec, pattern: str):
        import regex

        self.codec, self.find, self.known = codec, regex.compile(pattern).findall, {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32-bit, as bytes) of every text; pre-tokens are held for ``TOGETHER`` bytes of text at a time."""
        out, known = [], self.known
        for part in _parts(iter(texts)):
            split = [self.find(t.decode("utf-8", "replace")) for t in part]
            if len(known) > CACHE:
                known.clear()
            new = list(set(itertools.chain.from_iterable(split)).difference(known))
            known.update(zip(new, self.codec.encode_pieces([p.encode() for p in new])))
            out += [b"".join(map(known.__getitem__, pieces)) for pieces in split]
            for p in new:
                if len(p) > CACHED:
                    del known[p]
        return out


@cache
def _codec(path: str) -> Codec:
    """One per worker process, for all its tasks."""
    return Codec(load_ranks(path))


def encode_column(path: str, pattern: str, text: str = "text") -> Column:
    """Token ids (little-endian 32-bit, as binary) of a text."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memory = Memory(_codec(path), pattern)
        for texts in batches:
            yield pd.Series(memory.encode(list(texts)), dtype=object)

    return encode(text_bytes(text))


def decode_column(path: str, ids: Column) -> Column:
    """The bytes that ids stand for."""

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(path)
        for series in batches:
            yield pd.Series([codec.decode(np.frombuffer(x, "<u4").tolist()) for x in series], dtype=object)

    return decode(ids)


def round_trip_column(path: str, pattern: str, text: str = "text") -> Column:
    """struct(ids, decoded) of a text, from one worker: :func:`encode_column`, then :func:`decode_column` of its ids."""

    @F.pandas_udf("ids binary, decoded binary")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(path)
        memory = Memory(codec, pattern)
        for texts in batches:
            ids = memory.encode(list(texts))
            yield pd.DataFrame({"ids": ids, "decoded": [codec.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]}, dtype=object)

    return both(text_bytes(text))


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (binary) and decoded (binary) of every document."""
    bound_batches(docs.sparkSession)
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = round_trip_column(path, pattern or public_tokenizers.PATTERN)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), both.alias("both")).select("doc_id", "both.ids", "both.decoded")
