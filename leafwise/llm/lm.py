"""Language-model scores from a hierarchical Pitman-Yor process.

Every context has a restaurant whose customers are the words that followed
it.  A context is the preceding word (at the start of a text the end token); each table of
its restaurant sends one customer to the restaurant of the word's class (by its
last character; the start of a text is one of its own), and each table there sends one to the
root that all classes share, whose base is uniform over the known
words and one unknown.

Words are dealt to parts by hash, so all customers and tables of a word, in
every restaurant, are in one part.  In a Gibbs sweep every customer of every
restaurant, one after the other, leaves its table and sits down by the
Chinese-restaurant probabilities given the tables of all others of its dish
and the totals of all other dishes; a dish's own tables count as they stand at
that moment.  Dishes do so side by side; then the tables that came or went are
customers that came to the parent or left it, the parent's customers are seated in
the same way, and the parts exchange the restaurants' totals: those of the few
classes by sums, those of the words in a shuffle, where a part asks for the contexts it has.
Scores use predictive probabilities averaged over the last sweeps.  The
discounts come from the counts of ones and twos; the strengths are fixed.

Scoring: a chunk of texts asks the parts for what they know of its distinct
words and pairs of words, and adds up its own tokens.

Edge cases: a NULL or empty text is the end token alone; repeated rows are
scored once each; a NULL doc_id counts as the empty text
for the fold; with nothing to learn from, every word is unknown; an empty
table gives no rows; very long texts are read whole; extra columns are
ignored.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwise.llm.common import bound_batches, fold, parts_for, release, saved, text_bytes
from leafwise.llm.words import Words

#: Context classes: start; a to z; digit; end of sentence; pause; beyond ASCII; other.
CONTEXTS = 32
START, DIGIT, STOP, PAUSE, BEYOND, OTHER = 0, 27, 28, 29, 30, 31
END = b""
SWEEPS, AVERAGED = 3, 2
STRENGTH = 1.0
#: Bytes of text (and a few per text) that a task gathers before it passes them on.
CHUNK_BYTES = 8_000_000
#: Bytes of text per part, on average, and the fewest parts.
PART_BYTES, LEAST_PARTS = 32_000_000, 32
#: Bytes of text whose chunks are merged at once, on average.
MERGED_BYTES = 8_000_000_000
NO_ID = -(2**63)
#: Code of a context that is not among the most frequent, and so how many those are at most.
RARE = 2**16 - 1

_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[48:58] = DIGIT
_CLASS[[ord(c) for c in ".!?"]] = STOP
_CLASS[[ord(c) for c in ",;:"]] = PAUSE
_CLASS[128:] = BEYOND


class Chunk:
    """Texts as arrays: for every token its word (a number in the chunk), its context and its text."""

    def __init__(self):
        self.texts: list[bytes] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        self.texts.append(text)
        self.size += len(text) + 6  # what an empty text takes

    def full(self) -> bool:
        return self.size >= CHUNK_BYTES

    def arrays(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash and part of every word, by part and hash; per token: its word's place there, context, text number."""
        found = Words(self.texts)
        distinct, word = np.unique(found.hashes(), return_inverse=True)
        one = np.empty(len(distinct), np.int64)
        one[word] = np.arange(len(word))
        spans = zip(found.start[one].tolist(), (found.start[one] + found.length[one]).tolist())
        names = [END, *(found.text[a:b] for a, b in spans)]
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
        part = _part(hashes, parts)
        order = np.lexsort((hashes, part))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        # every text's words and the end; what follows a word is in the context of its last character
        lengths = found.counts + 1
        last = np.cumsum(lengths) - 1
        token = np.full(lengths.sum(), place[0])
        is_word, follows = np.ones(len(token), bool), np.ones(len(token), bool)
        is_word[last] = follows[last - found.counts] = False
        token[is_word] = place[word + 1]
        context = np.full(len(token), START, np.uint8)
        context[follows] = _CLASS[found.last()]
        return hashes[order], part[order], token, context, np.repeat(np.arange(len(lengths)), lengths)


def _chunks(batches: Iterator[pd.DataFrame], extra: list[str]):
    """Filled chunks and the ``extra`` columns of their rows."""
    chunk, rows = Chunk(), []
    for pdf in batches:
        for row in zip(pdf["t"], *(pdf[c] for c in extra)):
            chunk.add(row[0])
            rows.append(row)
            if chunk.full():
                yield chunk, rows
                chunk, rows = Chunk(), []
    if rows:
        yield chunk, rows


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (hashes % np.uint64(parts)).astype(np.int64)


def pack(x: np.ndarray) -> bytes:
    """Numbers of 0 or more, a byte each; those from 255 on follow."""
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype(np.int64).tobytes()


def unpack(packed, n: int) -> np.ndarray:
    data = bytes(packed)
    x = np.frombuffer(data[:n], np.uint8).astype(np.int64)
    x[x == 255] = np.frombuffer(data[n:], np.int64)
    return x


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


class Pairs:
    """Distinct pairs of a word and the one before it (places in a chunk), by place; the end of a text precedes the next one's start."""

    def __init__(self, token: np.ndarray, words: int):
        self.key = token * words + np.roll(token, 1)
        self.words = words

    def distinct(self, inverse: bool = False):
        """Words, words before and how often, or with ``inverse`` the pair of every token; every word of the chunk is the first of some pair."""
        found, more = np.unique(self.key, return_inverse=inverse, return_counts=not inverse)
        return found // self.words, found % self.words, more


def _classes(token: np.ndarray, context: np.ndarray, words: int) -> np.ndarray:
    """Class of every word of a chunk as a context."""
    of = np.zeros(words, np.uint8)
    of[np.roll(token, 1)] = context
    return of


#: w, n: words and how many contexts each has; u, k, c: context, its class and customers of each pair.
PAIRS = "part long, w binary, n binary, u binary, k binary, c binary"


def _count_pairs(parts: int):
    """Customers of every dish in every word's restaurant of a chunk: a row per part."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk, _ in _chunks(batches, []):
            hashes, of_part, token, context, _ = chunk.arrays(parts)
            word, before, c = Pairs(token, len(hashes)).distinct()
            u, k = hashes[before], _classes(token, context, len(hashes))[before]
            first = np.append(_starts(word), len(word))
            n = np.diff(first).astype(np.uint32)
            cuts = np.searchsorted(of_part, np.arange(parts + 1))
            rows = []
            for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    at = slice(first[a], first[b])
                    rows.append((part, hashes[a:b].tobytes(), n[a:b].tobytes(), u[at].tobytes(), k[at].tobytes(), c[at].astype(np.uint32).tobytes()))
            yield pd.DataFrame(rows, columns=_names(PAIRS))

    return count


def _join(col: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in col), kind)


def _merge(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, contexts, their classes and counts of a part, by word and context."""
    w = np.repeat(_join(pdf["w"], np.uint64), _join(pdf["n"], np.uint32))
    u, k, c = _join(pdf["u"], np.uint64), _join(pdf["k"], np.uint8), _join(pdf["c"], np.uint32)
    order = np.lexsort((u, w))
    w, u, k, c = w[order], u[order], k[order], c[order].astype(np.int64)
    new = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (u[1:] != u[:-1])))
    return w[new], u[new], k[new], np.add.reduceat(c, new)


def _merge_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    w, u, k, c = _merge(pdf)
    rows = []
    # counts beyond 32 bits are kept as several rows of a dish
    while len(c):
        first = _starts(w)
        n = np.diff(np.append(first, len(w))).astype(np.uint32)
        now = np.minimum(c, 2**32 - 1)
        rows.append((int(pdf["part"].iloc[0]), w[first].tobytes(), n.tobytes(), u.tobytes(), k.tobytes(), now.astype(np.uint32).tobytes()))
        more = c > now
        w, u, k, c = w[more], u[more], k[more], (c - now)[more]
    return pd.DataFrame(rows, columns=_names(PAIRS))


#: One row per part. w, pairs: words and how many classes each has; u: class of each of these pairs; c, t: its customers and
#: tables after each kept sweep; t0: tables of each word at the root; s, s0: customers of each table after
#: the last sweep, of pairs and words with more than one customer; stats: sums over the part.
#: Below them, the words' restaurants. n: how many contexts each word has; v, k: contexts of the part and their classes; x, b: context
#: (place in v) and customers of each pair; tb: tables after each kept sweep, and sb: customers of each table, where there is more than one customer.
STATE = (
    "part long, w binary, pairs binary, u binary, c array<binary>, t array<binary>, t0 array<binary>, s binary, s0 binary, stats array<double>, "
    "n binary, v binary, k binary, x binary, b binary, tb array<binary>, sb binary"
)
#: Places in stats: customers by class, tables by class, then these.
TOKENS, WORDS, TABLES0, ONES, TWOS, ONES0, TWOS0, ONES_B, TWOS_B = range(2 * CONTEXTS, 2 * CONTEXTS + 9)


def _stats(u, c, t, c0, t0, b) -> list[float]:
    by = lambda x: np.bincount(u, weights=x, minlength=CONTEXTS).tolist()
    few = [float((x == i).sum()) for x in (c, c0, b) for i in (1, 2)]
    return [*by(c), *by(t), float(b.sum()), float(len(c0)), float(t0.sum()), *few]


def _found(pdf: pd.DataFrame) -> pd.DataFrame:
    """A part's state before the first sweep: every dish of a restaurant at one table."""
    w, before, k, b = _merge(pdf)
    first = _starts(w)
    n = np.diff(np.append(first, len(w)))
    v, x = np.unique(before, return_inverse=True)
    of_v = np.empty(len(v), np.uint8)
    of_v[x] = k
    dishes, c = np.unique(np.repeat(np.arange(len(first)), n) * CONTEXTS + k, return_counts=True)
    u, pairs = (dishes % CONTEXTS).astype(np.uint8), np.bincount(dishes // CONTEXTS)
    t, t0 = np.ones(len(u), np.int64), np.ones(len(first), np.int64)
    many = b > 1
    row = (int(pdf["part"].iloc[0]), w[first].tobytes(), pairs.astype(np.uint8).tobytes(), u.tobytes(), [pack(c)], [pack(t)], [pack(t0)],
           pack(c[c > 1]), pack(pairs[pairs > 1]), _stats(u, c, t, pairs, t0, b),
           pack(n), v.tobytes(), of_v.tobytes(), x.astype(np.uint32).tobytes(), pack(b), [pack(np.ones(many.sum(), np.int64))], pack(b[many]))
    return pd.DataFrame([row], columns=_names(STATE))


#: Customers of a dish from which on dishes are scanned together, and of a group of other dishes.
LONG, GROUP = 64, 1_000_000
#: Dishes that are worth a common step.
TOGETHER = 100


class New:
    """Weight of a new table of every dish, by its tables ``t``: (rest + slope * t) * (a + grow * t) / (b + grow * t)."""

    def __init__(self, rest, slope: float = 0.0, a=1.0, b=1.0, grow: int = 0):
        self.rest, self.a, self.b = np.broadcast_arrays(np.asarray(rest, float), a, b)
        self.slope, self.grow = slope, grow

    def take(self, at) -> New:
        return New(self.rest[at], self.slope, self.a[at], self.b[at], self.grow)

    def __call__(self, t, live: int):
        """Of the first ``live`` dishes."""
        return (self.rest[:live] + self.slope * t) * (self.a[:live] + self.grow * t) / (self.b[:live] + self.grow * t)


def _ragged(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of every run, one after the other."""
    return np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def _runs(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def reseat(c: np.ndarray, t: np.ndarray, sizes: np.ndarray, new: New, discount: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A Gibbs scan of dishes of ``c`` customers at ``t`` tables of these ``sizes``: tables and sizes after it.

    One after the other, in random order, every customer leaves its table (an
    empty one goes) and sits down given all others: at a table of n with weight n - discount,
    at a new one with ``new``.  Customers that have no table yet come last.
    """
    tables, out = np.zeros(len(c), np.int64), []
    order = np.argsort(-c, kind="stable")
    ends = np.cumsum(c[order])
    first = _runs(t)
    # dishes of many customers go together, they take many steps; the others in groups
    a = 0
    while a < len(c):
        b = max(int(np.searchsorted(-c[order], -LONG)), a + 1, int(np.searchsorted(ends, ends[a] + GROUP)) if c[order[a]] <= LONG else 0)
        at = order[a:b]
        tables[at], found = _scan(c[at], t[at], sizes[_ragged(first[at], t[at])], new.take(at), discount, rng)
        out.append(found)
        a = b
    flat = np.concatenate(out) if out else np.zeros(0, np.int64)
    # back to the order of the dishes
    starts = np.empty(len(c), np.int64)
    starts[order] = _runs(tables[order])
    return tables, flat[_ragged(starts, tables)]


def _scan(c: np.ndarray, t: np.ndarray, sizes: np.ndarray, new: New, d: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """``reseat`` of dishes in descending order of customers: a step takes the same customer of all of them."""
    kind = np.int32 if c.max() < 2**31 else np.int64
    start, at_table = _runs(c), np.repeat(np.arange(len(c)), t)
    number = (np.arange(len(sizes)) - np.repeat(_runs(t), t)).astype(kind)
    seated = np.bincount(at_table, weights=sizes, minlength=len(c)).astype(np.int64)
    # z: table of every customer (-1: none yet); n: customers of every table; free: stack of unused table numbers
    z, n = np.full(c.sum(), -1, kind), np.zeros(c.sum(), kind)
    z[_ragged(start, seated)] = np.repeat(number, sizes)
    n[start[at_table] + number] = sizes
    free = (np.repeat(start + c - 1, c) - np.arange(len(z))).astype(kind)
    t, unused = t.copy(), c - t
    everyone = bool((seated == c).all())
    falling, i = -c, 0
    while (live := int(np.searchsorted(falling, -i, side="left"))) >= TOGETHER:
        s, own = start[:live], t[:live]
        # the next in random order: a scan in the order of the tables would not leave the probabilities of seatings as they are
        other = s + i + (rng.random(live) * np.maximum(seated[:live] - i, 1)).astype(np.int64)
        k = z[other]
        z[other] = z[s + i]
        left = np.arange(live) if everyone else np.flatnonzero(i < seated[:live])
        place = s[left] + k[left]
        n[place] -= 1
        gone = left[n[place] == 0]
        free[s[gone] + unused[gone]] = k[gone]
        unused[gone] += 1
        t[gone] -= 1
        others = np.where(i < seated[:live], seated[:live] - 1, i)
        weight = new(own, live)
        opens = (others == 0) | (rng.random(live) * (others - d * own + weight) < weight)
        opening = np.flatnonzero(opens)
        unused[opening] -= 1
        t[opening] += 1
        k[opening] = free[s[opening] + unused[opening]]
        # a table of n customers: that of a customer at random, kept with probability 1 - d / n
        rest = np.flatnonzero(~opens)
        while len(rest):
            r = (rng.random(len(rest)) * others[rest]).astype(np.int64)
            r += (i < seated[rest]) & (r >= i)
            k[rest] = z[s[rest] + r]
            rest = rest[rng.random(len(rest)) * n[s[rest] + k[rest]] < d]
        n[s + k] += 1
        z[s + i] = k
        i += 1
    draw = random.Random(int(rng.integers(2**62))).random
    for x in range(live):
        a, b = int(start[x]), int(start[x] + c[x])
        t[x] = _seat_rest(i, int(seated[x]), z[a:b], n[a:b], free[a : a + int(unused[x])].tolist(), int(t[x]), new.take(slice(x, x + 1)), d, draw)
    used = n > 0
    return t, n[used].astype(np.int64)


def _seat_rest(i: int, seated: int, z: np.ndarray, n: np.ndarray, free: list, t: int, new: New, d: float, draw) -> int:
    """The customers of one dish from the ``i``-th on, in place; its tables."""
    rest, slope, a, b, grow = float(new.rest[0]), new.slope, float(new.a[0]), float(new.b[0]), new.grow
    weigh = lambda t: (rest + slope * t) * (a + grow * t) / (b + grow * t)
    table, size = memoryview(z), memoryview(n)
    weight = weigh(t)
    for i in range(i, len(z)):
        k = -1
        if i < seated:
            other = i + int(draw() * (seated - i))
            k = table[other]
            table[other] = table[i]
            size[k] -= 1
            if not size[k]:
                free.append(k)
                t -= 1
                weight = weigh(t)
        others = seated - 1 if i < seated else i
        if not others or draw() * (others - d * t + weight) < weight:
            k = free.pop()
            t += 1
            weight = weigh(t)
        else:
            while True:
                r = int(draw() * others)
                k = table[r + 1 if r >= i and i < seated else r]
                if draw() * size[k] >= d:
                    break
        size[k] += 1
        table[i] = k
    return t


def seat(c: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating ``c`` customers (1 or more) of a dish one after the other; ``new``: weight of a new table."""
    return reseat(c, np.zeros(len(c), np.int64), np.zeros(0, np.int64), New(new), discount, rng)[0]


def leave(c: np.ndarray, t: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Tables and sizes after customers at random have left the dishes that have more than ``c``."""
    dish = np.repeat(np.arange(len(c)), t)
    many = np.bincount(dish, weights=sizes, minlength=len(c)) > c
    mine = np.flatnonzero(many[dish])
    table = np.repeat(mine, sizes[mine])
    order = np.lexsort((rng.random(len(table)), dish[table]))
    table = table[order]
    stay = np.arange(len(table)) - np.repeat(_runs(seen := np.bincount(dish[table], minlength=len(c))), seen) < c[dish[table]]
    sizes = sizes.copy()
    sizes[mine] = np.bincount(table[stay], minlength=len(sizes))[mine]
    return np.bincount(dish[sizes > 0], minlength=len(c)), sizes[sizes > 0]


class Totals:
    """Sums over all parts and what follows from them."""

    def __init__(self, stats: np.ndarray):
        self.customers, self.tables = stats[:CONTEXTS], stats[CONTEXTS : 2 * CONTEXTS]
        self.tokens, self.words, self.tables0 = stats[TOKENS], stats[WORDS], stats[TABLES0]
        self.base = 1.0 / (self.words + 1)
        self.d = self._discount(stats[ONES], stats[TWOS])
        self.d0 = self._discount(stats[ONES0], stats[TWOS0])
        self.d_b = self._discount(stats[ONES_B], stats[TWOS_B])
        #: Weight of a new table, per class and at the root (times the parent's probability).
        self.new = STRENGTH + self.d * self.tables
        self.new0 = STRENGTH + self.d0 * self.tables0
        self.customers0 = self.tables.sum()

    @staticmethod
    def _discount(ones: float, twos: float) -> float:
        return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5

    def root(self, c0: np.ndarray, t0: np.ndarray) -> np.ndarray:
        """Probability of words at the root."""
        return (np.maximum(c0 - self.d0 * t0, 0) + self.new0 * self.base) / (STRENGTH + self.customers0)

    def in_word(self, opened: np.ndarray, tb: np.ndarray, k: np.ndarray, c: np.ndarray, t: np.ndarray, root: np.ndarray) -> New:
        """Weight of a new table of dishes in words' restaurants of ``opened`` tables, whose ``tb`` tables are taken out of the totals
        first; ``c``, ``t``: customers and tables of the dish in the class ``k`` of the word."""
        others = c - tb
        tables = np.clip(t, 1, np.maximum(others, 1))
        return New(STRENGTH + self.d_b * (opened - tb), self.d_b, np.maximum(others - self.d * tables, 0) + self.new[k] * root, STRENGTH + self.customers[k] - tb, 1)

    def in_context(self, u: np.ndarray, t: np.ndarray, c0: np.ndarray, t0: np.ndarray) -> New:
        """Weight of a new table of dishes in classes, whose ``t`` tables are taken out of the totals first."""
        others = c0 - t
        tables = np.clip(t0, 1, np.maximum(others, 1))
        return New(STRENGTH + self.d * (self.tables[u] - t), self.d, others - self.d0 * tables + self.new0 * self.base, STRENGTH + self.customers0 - t, 1)

    def at_root(self, t0: np.ndarray) -> New:
        """Weight of a new table of words at the root."""
        return New(STRENGTH + self.d0 * (self.tables0 - t0), self.d0, self.base)

    def unknown(self) -> float:
        return self.new0 * self.base / (STRENGTH + self.customers0)

    def back_off(self) -> np.ndarray:
        """Weight of the root's probability in each class."""
        return self.new / (STRENGTH + self.customers)


def _sums(state: DataFrame) -> np.ndarray:
    """The stats of all parts added up: a few dozen numbers."""
    stats = np.zeros(TWOS_B + 1)
    for r in state.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():
        stats[r["i"]] = r["x"]
    return stats


class Part:
    """Arrays of a state row."""

    def __init__(self, row):
        read = lambda x, kind: np.frombuffer(bytes(x), kind)
        self.w, pairs = read(row["w"], np.uint64), read(row["pairs"], np.uint8).astype(np.int64)
        self.u = read(row["u"], np.uint8)
        self.cs = [unpack(x, len(self.u)) for x in row["c"]]
        self.t = [unpack(x, len(self.u)) for x in row["t"]]
        self.t0 = [unpack(x, len(self.w)) for x in row["t0"]]
        self.c = self.cs[-1]
        self.word = np.repeat(np.arange(len(self.w)), pairs)
        self.first = np.cumsum(pairs) - pairs
        self.v, self.k, self.x = read(row["v"], np.uint64), read(row["k"], np.uint8), read(row["x"], np.uint32).astype(np.int64)
        self.b = unpack(row["b"], len(self.x))
        n = unpack(row["n"], len(self.w))
        self.of = np.repeat(np.arange(len(self.w)), n)
        self.start = _runs(n)
        self.many = np.flatnonzero(self.b > 1)
        self.tb = []
        for packed in row["tb"]:
            t = np.ones(len(self.b), np.int64)
            t[self.many] = unpack(packed, len(self.many))
            self.tb.append(t)

    def dishes(self) -> np.ndarray:
        """The dish of every pair in the restaurant of its context's class."""
        return np.searchsorted(self.word * CONTEXTS + self.u, self.of * CONTEXTS + self.k[self.x])

    def to_root(self, t: np.ndarray) -> np.ndarray:
        """Customers of each word at the root: its tables in all classes."""
        return np.add.reduceat(t, self.first) if len(t) else t

    def counts(self) -> np.ndarray:
        """How often each word was seen."""
        return np.add.reduceat(self.b, self.start) if len(self.b) else self.b


def _sizes(c: np.ndarray, t: np.ndarray, kept: bytes) -> np.ndarray:
    """Customers of all tables from those that a state keeps."""
    sizes = np.ones(t.sum(), np.int64)
    at = np.repeat(c > 1, t)
    sizes[at] = unpack(kept, at.sum())
    return sizes


#: A part's contexts with its customers and tables (after each kept sweep) there, to where a context's totals are made; what comes back.
ASKED = "home long, part long, v binary, c binary, t array<binary>"
TOLD = "part long, home long, t binary"
#: Contexts of a home with the customers and tables of their restaurants.
HOMES = "home long, hv binary, hc binary, ht array<binary>"


def _homes(v: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of contexts by home, and where in it each home begins."""
    home = _part(v, parts)
    order = np.argsort(home, kind="stable")
    return order, np.searchsorted(home[order], np.arange(parts + 1))


def _ask(parts: int, keep: int):
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                p = Part(row)
                sums = lambda x: np.bincount(p.x, weights=x, minlength=len(p.v)).astype(np.int64)
                c, ts = sums(p.b), [sums(t) for t in p.tb[-keep:]]
                order, cuts = _homes(p.v, parts)
                rows = [(h, row["part"], p.v[at].tobytes(), pack(c[at]), [pack(t[at]) for t in ts])
                        for h, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a for at in [order[a:b]]]
                yield pd.DataFrame(rows, columns=_names(ASKED))

    return ask


def _added(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Contexts of a home; of what each part asked the places in them and the numbers; customers, tables."""
    vs = [np.frombuffer(bytes(x), np.uint64) for x in pdf["v"]]
    lengths = np.array([len(x) for x in vs])
    v, at = np.unique(np.concatenate(vs), return_inverse=True)
    sums = lambda col: np.bincount(at, weights=np.concatenate([unpack(x, n) for x, n in zip(col, lengths)]), minlength=len(v)).astype(np.int64)
    return v, at, lengths, sums(pdf["c"]), [sums([x[i] for x in pdf["t"]]) for i in range(len(pdf["t"].iloc[0]))]


def _tell(pdf: pd.DataFrame) -> pd.DataFrame:
    _, at, lengths, _, (t,) = _added(pdf)
    rows = [(part, pdf["home"].iloc[0], pack(t[x])) for part, x in zip(pdf["part"], np.split(at, np.cumsum(lengths)[:-1]))]
    return pd.DataFrame(rows, columns=_names(TOLD))


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    v, _, _, c, ts = _added(pdf)
    return pd.DataFrame([(pdf["home"].iloc[0], v.tobytes(), pack(c), [pack(t) for t in ts])], columns=_names(HOMES))


def _sweep(totals: Totals, number: int, keep: int, parts: int):
    """Seat every customer anew, with the words before, in the classes and then at the root; the last ``keep`` states stay."""

    def sweep(state: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for row in state.to_dict("records"):
            p = Part(row)
            rng = np.random.default_rng([number, int(row["part"])])
            opened = np.empty(len(p.v), np.int64)
            order, cuts = _homes(p.v, parts)
            for home, t in zip(told["home"], told["t"]):
                at = order[cuts[home] : cuts[home + 1]]
                opened[at] = unpack(t, len(at))
            old, old0 = p.t[-1], p.t0[-1]
            was0 = p.to_root(old)
            # a dish's own tables are not among the totals that its customers meet; they count as they stand in the scan
            many, dish, had = p.many, p.dishes(), p.tb[-1][p.many]
            of = dish[many]
            new = totals.in_word(opened[p.x[many]], had, p.u[of], p.c[of], old[of], totals.root(was0, old0)[p.of[many]])
            tb = np.ones(len(p.b), np.int64)
            tb[many], sizes_b = reseat(p.b[many], had, unpack(row["sb"], had.sum()), new, totals.d_b, rng)
            # tables that came and went are customers that came to the parent and left it
            c = np.bincount(dish, weights=tb, minlength=len(p.u)).astype(np.int64)
            had, sizes = leave(c, old, _sizes(p.c, old, row["s"]), rng)
            t, sizes = reseat(c, had, sizes, totals.in_context(p.u, old, was0[p.word], old0[p.word]), totals.d, rng)
            c0 = p.to_root(t)
            had, sizes0 = leave(c0, old0, _sizes(was0, old0, row["s0"]), rng)
            t0, sizes0 = reseat(c0, had, sizes0, totals.at_root(old0), totals.d0, rng)
            now = {"c": pack(c), "t": pack(t), "t0": pack(t0), "tb": pack(tb[many])}
            rows.append({
                **row, **{name: [*([] if number == 1 else row[name]), x][-keep:] for name, x in now.items()},
                "s": pack(sizes[np.repeat(c > 1, t)]), "s0": pack(sizes0[np.repeat(c0 > 1, t0)]), "sb": pack(sizes_b),
                "stats": _stats(p.u, c, t, c0, t0, p.b)})
        return pd.DataFrame(rows, columns=_names(STATE))

    return sweep


class Model:
    """A fitted model: the state of all parts, the words' restaurants, and the totals after each kept sweep."""

    def __init__(self, state: DataFrame, homes: DataFrame, totals: list[Totals], parts: int):
        self.state, self.homes, self.totals, self.parts = state, homes, totals, parts

    @property
    def tokens(self) -> int:
        return int(self.totals[-1].tokens)

    @property
    def words(self) -> int:
        return int(self.totals[-1].words)


def fit(train: DataFrame, parts: int, sweeps: int = SWEEPS, averaged: int = AVERAGED) -> Model:
    """Model from the column ``t`` (UTF-8 bytes) of ``train``."""
    spark = train.sparkSession
    pairs = train.select("t").mapInPandas(_count_pairs(parts), PAIRS)
    # where very many chunks meet in a part, they meet in groups first: a hot word is a few rows by then
    salts = parts_for(parts * PART_BYTES, MERGED_BYTES)
    if salts > 1:
        pairs = pairs.groupBy("part", F.pmod(F.xxhash64("w"), F.lit(salts)).alias("salt")).applyInPandas(_merge_rows, PAIRS)
    state = saved(pairs.groupBy("part").applyInPandas(_found, STATE), "lm_state0")
    totals = [Totals(_sums(state))]
    release(spark)
    for i in range(1, sweeps + 1):
        told = state.mapInPandas(_ask(parts, 1), ASKED).groupBy("home").applyInPandas(_tell, TOLD)
        swept = state.groupBy("part").cogroup(told.groupBy("part")).applyInPandas(_sweep(totals[-1], i, averaged, parts), STATE)
        before, state = state, saved(swept, f"lm_state{i}")
        totals.append(Totals(_sums(state)))
        del told, swept
        release(spark, before)
    homes = saved(state.mapInPandas(_ask(parts, averaged), ASKED).groupBy("home").applyInPandas(_settle, HOMES), "lm_homes")
    return Model(state, homes, totals[1:][-averaged:], parts)


def _base_log(c: np.ndarray, tokens: int, words: int) -> np.ndarray:
    return np.log10((c + 0.5) / (tokens + 0.5 * (words + 1)))


def _log_probs(p: Part, word: np.ndarray, context: np.ndarray, totals: list[Totals]) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the averaged predictive probability of (word number or -1, class), and the words' counts."""
    at, seen = _dish(p, word, context)
    total = np.zeros(len(word))
    for c, t, t0, x in zip(p.cs, p.t, p.t0, totals):
        root = np.append(x.root(p.to_root(t), t0), x.unknown())[word]  # -1: the unknown
        total += _in_class(x, context, np.where(seen, c[at], 0) if len(c) else 0, np.where(seen, t[at], 0) if len(t) else 0, root)
    return np.log10(total / max(len(totals), 1)), np.append(p.counts(), 0)[word]


def _dish(p: Part, word: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of (word number or -1, class) among the dishes of the classes, and whether it is there."""
    return _locate(p.word * CONTEXTS + p.u, np.where(word >= 0, word * CONTEXTS + k, -1))


def _locate(among: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(among, wanted), max(len(among) - 1, 0))
    return at, among[at] == wanted if len(among) else np.zeros(len(wanted), bool)


def _in_class(x: Totals, k: np.ndarray, c, t, root: np.ndarray) -> np.ndarray:
    """Probability of words in the classes ``k``, from customers, tables and the probability at the root."""
    return np.maximum(c - x.d * t, 0) / (STRENGTH + x.customers[k]) + x.back_off()[k] * root


def _in_word(x: Totals, customers, opened, b, tb, parent: np.ndarray) -> np.ndarray:
    """Probability of words after a word whose restaurant has so many customers and ``opened`` tables."""
    return (np.maximum(b - x.d_b * tb, 0) + (STRENGTH + x.d_b * opened) * parent) / (STRENGTH + customers)


#: Least customers by which the most frequent contexts are chosen.
BARS = sorted({int(2 ** (i / 4)) for i in range(250)})


def hot_contexts(model: Model) -> np.ndarray:
    """Hashes of the most frequent contexts, RARE at most, in order: pairs name them by two bytes."""

    def customers(pdf: pd.DataFrame):
        for row in pdf.to_dict("records"):
            v = np.frombuffer(bytes(row["hv"]), np.uint64)
            yield v, unpack(row["hc"], len(v))

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, c in customers(pdf):
                yield pd.DataFrame({"bar": BARS, "n": len(c) - np.searchsorted(np.sort(c), BARS)})

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"v": [v[c >= bar].tobytes() for v, c in customers(pdf)]})

    found = model.homes.mapInPandas(tally, "bar long, n long").groupBy("bar").agg(F.sum("n").alias("n")).where(F.col("n") <= RARE)
    bar = found.agg(F.min("bar")).first()[0] or 1
    rows = model.homes.mapInPandas(pick, "v binary").collect()
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(bytes(r["v"]), np.uint64) for r in rows)]))


#: What a chunk asks of a part. w, m, n: words, the classes of the words before them (bits) and how many words come before each; h: those words
#: as places among the hot contexts; u: those that are not there.
SENT = "part long, chunk long, w binary, m binary, n binary, h binary, u binary"
#: What comes back. Per word: count, and its restaurant's customers (after) and tables (opened), customers and tables at the root; per word and
#: class asked for: customers and tables (kc, kt); per pair: customers (b), and tables where there is more than one. And what the chunk knows itself:
#: ids and lengths of its texts, its tokens, and the words' classes.
KNOWN = (
    "chunk long, part long, words long, count binary, after binary, opened array<binary>, c0 array<binary>, t0 array<binary>, kc array<binary>, kt array<binary>, "
    "b binary, tb array<binary>, ids binary, lengths binary, token binary, k binary"
)
SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    return pd.DataFrame([[r.get(c) for c in _names(schema)] for r in rows], columns=_names(schema))


def _named_chunks(batches: Iterator[pd.DataFrame], extra: list[str], parts: int):
    """Chunks' names, arrays and rows. A partition's rows and so its chunks are the same when it is read again."""
    for number, (chunk, rows) in enumerate(_chunks(batches, ["task", *extra])):
        yield (int(rows[0][1]) << 32) | number, chunk.arrays(parts), rows


def _asked_classes(word: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Distinct (word, class of the word before) of pairs, as numbers in order."""
    there = np.zeros(len(k) * CONTEXTS, bool)
    there[word * CONTEXTS + k[before]] = True
    return np.flatnonzero(there)


def _send(parts: int, hot):
    """Per chunk and part the words and pairs that it asks for."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, (hashes, of_part, token, context, _), _ in _named_chunks(batches, [], parts):
            word, before, _ = Pairs(token, len(hashes)).distinct()
            asked = _asked_classes(word, before, _classes(token, context, len(hashes)))
            masks = np.bitwise_or.reduceat(np.uint32(1) << (asked % CONTEXTS).astype(np.uint32), _starts(asked // CONTEXTS))
            first = np.append(_starts(word), len(word))
            at, there = _locate(hot.value, hashes)
            n, h = np.diff(first).astype(np.uint32), np.where(there, at, RARE).astype(np.uint16)[before]
            cuts = np.searchsorted(of_part, np.arange(parts + 1))
            yield _frame([
                {"part": p, "chunk": name, "w": hashes[a:b].tobytes(), "m": masks[a:b].tobytes(), "n": n[a:b].tobytes(), "h": h[own].tobytes(), "u": hashes[before[own][h[own] == RARE]].tobytes()}
                for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a for own in [slice(first[a], first[b])]
            ], SENT)

    return send


def _own(parts: int):
    """What chunks know themselves."""

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, (hashes, _, token, context, text), rows in _named_chunks(batches, ["doc_id"], parts):
            yield _frame([{
                "chunk": name, "part": -1, "ids": np.array([r[2] for r in rows], np.int64).tobytes(), "lengths": np.bincount(text, minlength=len(rows)).astype(np.uint32).tobytes(),
                "token": token.astype(np.uint32 if len(hashes) > 2**16 else np.uint16).tobytes(), "k": _classes(token, context, len(hashes)).tobytes(),
            }], KNOWN)

    return own


def _answer(kept: int, hot):
    def answer(state: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        if not len(sent):
            return _frame([], KNOWN)
        row = state.iloc[0] if len(state) else None
        if row is None:
            empty = [b""] * kept
            row = {x: b"" for x in _names(STATE)} | {"c": empty, "t": empty, "t0": empty, "tb": empty, "hv": None}
        p = Part(row)
        # the restaurants of the part's words, where they are a context
        after, opened = np.zeros(len(p.w) + 1, np.int64), [np.zeros(len(p.w) + 1, np.int64) for _ in p.t]
        if isinstance(row["hv"], bytes | bytearray):
            v = np.frombuffer(bytes(row["hv"]), np.uint64)
            at, there = _locate(p.w, v)
            assert there.all()
            after[at] = unpack(row["hc"], len(v))
            for x, packed in zip(opened, row["ht"]):
                x[at] = unpack(packed, len(v))
        key, counts = p.of * len(p.v) + p.x, np.append(p.counts(), 0)
        c0, t0 = [np.append(p.to_root(t), 0) for t in p.t], [np.append(t, 0) for t in p.t0]
        out = []
        for r in sent.itertuples():
            w, n, h = np.frombuffer(r.w, np.uint64), np.frombuffer(r.n, np.uint32), np.frombuffer(r.h, np.uint16)
            u, rare = np.empty(len(h), np.uint64), h == RARE
            u[rare], u[~rare] = np.frombuffer(r.u, np.uint64), hot.value[h[~rare]]
            at, there = _locate(p.w, w)
            word = np.where(there, at, -1)
            asked = np.nonzero((np.frombuffer(r.m, np.uint32)[:, None] >> np.arange(CONTEXTS, dtype=np.uint32)) & 1)
            dish, found = _dish(p, word[asked[0]], asked[1])
            in_class = lambda xs: [pack(np.where(found, x[dish], 0) if len(x) else np.zeros(len(dish), np.int64)) for x in xs]
            at, there = _locate(p.v, u)
            of = np.repeat(word, n)
            at, there = _locate(key, np.where(there & (of >= 0), of * len(p.v) + at, -1))
            b = np.where(there, p.b[at], 0) if len(p.b) else np.zeros(len(u), np.int64)
            several = at[b > 1]
            out.append({
                "chunk": r.chunk, "part": r.part, "words": len(w), "count": pack(counts[word]), "after": pack(after[word]), "opened": [pack(x[word]) for x in opened],
                "c0": [pack(x[word]) for x in c0], "t0": [pack(x[word]) for x in t0], "kc": in_class(p.cs), "kt": in_class(p.t),
                "b": pack(b), "tb": [pack(t[several]) for t in p.tb],
            })
        return _frame(out, KNOWN)

    return answer


def _score(totals: list[Totals], tokens: int, words: int):
    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        """The texts of a chunk, from what the parts know of its words and pairs."""
        own, known = pdf[pdf["part"] < 0].iloc[0], pdf[pdf["part"] >= 0].sort_values("part")
        k = np.frombuffer(own["k"], np.uint8)
        token = np.frombuffer(own["token"], np.uint32 if len(k) > 2**16 else np.uint16).astype(np.int64)
        lengths = np.frombuffer(own["lengths"], np.uint32).astype(np.int64)
        word, before, number = Pairs(token, len(k)).distinct(inverse=True)
        asked = _asked_classes(word, before, k)
        # the parts' words, classes and pairs, one after the other, are the chunk's in order
        first = np.append(_starts(word), len(word))
        first_asked = np.append(_starts(asked // CONTEXTS), len(asked))
        counts, pairs, a = [], [], 0
        dishes: list[list] = []
        for r in known.to_dict("records"):
            n = int(r["words"])
            m, of = int(first_asked[a + n] - first_asked[a]), int(first[a + n] - first[a])
            counts.append([unpack(x, n) for x in (r["count"], r["after"], *r["opened"], *r["c0"], *r["t0"])])
            dishes.append([unpack(x, m) for x in (*r["kc"], *r["kt"])])
            b = unpack(r["b"], of)
            tables = [(b > 0).astype(np.int64) for _ in totals]
            for t, packed in zip(tables, r["tb"]):
                t[b > 1] = unpack(packed, (b > 1).sum())
            pairs.append([b, *tables])
            a += n
        if a != len(k):
            raise ValueError("the documents were not read in the same order again")
        count, after, *more = map(np.concatenate, zip(*counts))
        b, *tb = map(np.concatenate, zip(*pairs))
        in_class = [*map(np.concatenate, zip(*dishes))]
        kept = len(totals)
        opened, c0, t0, kc, kt = more[:kept], more[kept : 2 * kept], more[2 * kept :], in_class[:kept], in_class[kept:]
        at, total = np.searchsorted(asked, word * CONTEXTS + k[before]), np.zeros(len(word))
        for i, x in enumerate(totals):
            parent = _in_class(x, asked % CONTEXTS, kc[i], kt[i], x.root(c0[i], t0[i])[asked // CONTEXTS])
            total += _in_word(x, after[before], opened[i][before], b, tb[i], parent[at])
        text = np.repeat(np.arange(len(lengths)), lengths)
        add = lambda x: np.bincount(text, weights=x, minlength=len(lengths))
        return pd.DataFrame({
            "doc_id": np.frombuffer(own["ids"], np.int64), "n_tokens": lengths, "n_known": add(count[token] > 0).astype(np.int64),
            "base_score": add(_base_log(count, tokens, words)[token]), "score": add(np.log10(total / kept)[number]),
        })

    return score


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    bound_batches(spark)
    octets = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    parts = parts_for(octets, PART_BYTES, LEAST_PARTS)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), (fold("doc_id") == 1).alias("held_out"), text_bytes().alias("t"))
    model = fit(rows.where(~F.col("held_out")), parts)
    # a text's chunk has the same name whenever the documents are read
    named = rows.select(F.spark_partition_id().cast("long").alias("task"), "doc_id", "t")
    release(spark)
    hot = spark.sparkContext.broadcast(hot_contexts(model))
    sent = named.select("task", "t").mapInPandas(_send(parts, hot), SENT)
    state = model.state.drop("s", "s0", "sb", "stats").join(model.homes, F.col("part") == F.col("home"), "left").drop("home")
    answers = saved(state.groupBy("part").cogroup(sent.groupBy("part")).applyInPandas(_answer(len(model.totals), hot), KNOWN), "lm_answers")
    del sent, state
    release(spark, model.state, model.homes)
    known = named.mapInPandas(_own(parts), KNOWN).unionByName(answers)
    per = known.groupBy("chunk").applyInPandas(_score(model.totals, model.tokens, model.words), SCORES)
    return per.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NO_ID))).select(
        "doc_id", (fold("doc_id") == 1).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
