"""Document quality from a linear-chain conditional random field over its lines.

Every line (cut at \\n) gets the label good or bad.  The score of a line's
label depends on features of the line itself and of the lines before and after
it, and on the label before it; forward-backward gives each line's
probability of being good, and the mean of these, weighted by the lines'
bytes, is the document's quality.  A logistic curve fitted on labelled
documents turns it into the probability of label 1.

Only documents are labelled, so line labels are learnt from them: a document
labelled 1 is taken to have good lines only, one labelled 0 at least one bad
line, and the likelihood of just that is maximised.

Training uses a bounded sample, drawn by a hash of the text among all labelled
rows: at most ``SAMPLE`` distinct texts per label, and of each at most
``PIECES`` runs of ``RUN`` lines.  Scoring reads every line of every text.

Edge cases: NULL text is the empty text, one blank line, and is scored as any
other; ids labelled both ways, NULL labels and NULL ids teach nothing; texts
repeated under one label teach once; without rows of both labels every score
is the share of label 1, smoothed; very long texts and lines are read whole;
an empty table gives no rows; extra columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwise.llm.common import bound_batches, mix64, saved, text_bytes

#: Distinct labelled texts per label in the sample; runs of lines of a text, and lines of a run.
SAMPLE, PIECES, RUN = 2000, 4, 64
#: Steps and first rate of the gradient ascent, weight of the squared norm.
STEPS, RATE, RIDGE = 300, 0.1, 1e-3
#: Documents of at least this score are taken as good.
CUTOFF = 0.3
#: Texts are measured together up to so many bytes.
CHUNK = 4_000_000

_SPACE, _UPPER, _LOWER, _DIGIT, _STOP, _BANG, _MARK, _HIGH = range(1, 9)
_CLASS = np.zeros(256, np.uint8)
for _bytes, _class in (
    (b" \t\n\r\x0b\x0c", _SPACE), (range(65, 91), _UPPER), (range(97, 123), _LOWER), (range(48, 58), _DIGIT),
    (b".,;:?", _STOP), (b"!", _BANG), (b"#*$%&|<>{}[]~^_=+@\\/", _MARK), (range(128, 256), _HIGH),
):
    _CLASS[list(_bytes)] = _class

#: Features of a line: shares and means, blank and first lines marked.
FEATURES = [
    "words", "same_as_last", "same_as_second_last", "marks", "bangs", "upper", "short", "long", "word_bytes", "digits", "high", "stops",
    "capital", "repeated_line", "blank", "first",
]
WIDTH = len(FEATURES)


# lines ------------------------------------------------------------------------------------------


def _per_line(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(flags, starts, dtype=np.int64).astype(float)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features [line, feature], bytes and text number of every line of the texts."""
    whole = b"\n".join(texts) + b"\n"
    a = np.frombuffer(whole, np.uint8)
    ends = np.flatnonzero(a == 10)
    starts = np.r_[0, ends[:-1] + 1]
    lines = len(ends)
    size = (ends - starts).astype(float)
    per_text = np.array([t.count(b"\n") + 1 for t in texts])
    text = np.repeat(np.arange(len(texts)), per_text)
    kind = _CLASS[a]
    n = {c: _per_line(kind == c, starts) for c in (_UPPER, _LOWER, _DIGIT, _STOP, _BANG, _MARK, _HIGH)}

    inside = np.r_[False, kind != _SPACE, False]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    length = end - begin
    line = np.searchsorted(ends, begin)
    name = _names(whole, begin, length)
    same = lambda k: np.r_[np.zeros(min(k, len(name)), bool), (name[k:] == name[:-k]) & (line[k:] == line[:-k])]
    count = lambda flags: np.bincount(line, weights=flags, minlength=lines)
    words = count(np.ones(len(line)))
    some, letters = np.maximum(words, 1), np.maximum(n[_UPPER] + n[_LOWER], 1)

    with np.errstate(over="ignore"):
        sign = np.zeros(lines, np.uint64)
        np.add.at(sign, line, mix64(name))
        sign = mix64(sign + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, back, often = np.unique(sign, return_inverse=True, return_counts=True)
    first = np.zeros(lines)
    first[np.cumsum(per_text) - per_text] = 1
    f = np.stack(
        [
            np.log1p(words), count(same(1)) / some, count(same(2)) / some, np.minimum(n[_MARK] / some, 3), np.minimum(n[_BANG] / some, 3),
            n[_UPPER] / letters, count(length <= 3) / some, count(length >= 12) / some, np.log1p(count(length) / some), n[_DIGIT] / np.maximum(size, 1),
            n[_HIGH] / np.maximum(size, 1), np.minimum(n[_STOP] / some, 3), count(kind[begin] == _UPPER) / some,
            ((often[back] > 1) & (words > 0)).astype(float), (words == 0).astype(float), first,
        ],
        axis=1,
    )
    return f, size, text


def _names(whole: bytes, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit name per word from its first and last eight bytes and its length."""
    held = whole + b"\0" * 8
    at = np.ndarray(len(whole) + 1, "<u8", held, strides=(1,))
    head = at[begin]
    short = length < 8
    keep = np.where(short, (np.uint64(1) << (np.minimum(length, 7) * 8).astype(np.uint64)) - np.uint64(1), ~np.uint64(0))
    tail = np.where(short, np.uint64(0), at[np.maximum(begin + length - 8, 0)])
    with np.errstate(over="ignore"):
        return mix64((head & keep) + mix64(tail) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def with_neighbours(f: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Each line's features, their squares, and the features of the lines before and after it in the same text (else zeros)."""
    same = (text[1:] == text[:-1])[:, None]
    before, after = np.zeros_like(f), np.zeros_like(f)
    before[1:] = f[:-1] * same
    after[:-1] = f[1:] * same
    return np.concatenate([f, f * f, before, after], axis=1)


# the field --------------------------------------------------------------------------------------


@dataclass
class Model:
    #: Mean and deviation of the features, weights of the emission, its constant, transition scores [before, now].
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    constant: float
    transition: np.ndarray
    #: Logistic curve on the log-odds of the quality.
    slope: float = 1.0
    offset: float = 0.0
    #: The score of every text when there was nothing to learn from.
    share: float | None = None

    def emission(self, x: np.ndarray) -> np.ndarray:
        """Score of good over bad for every line."""
        return np.clip((x - self.mean) / self.deviation, -8, 8) @ self.weights + self.constant


def scan_products(m: np.ndarray, reverse: bool = False) -> np.ndarray:
    """Running products m[0] ... m[i] of 2x2 matrices, or m[i] ... m[-1], each up to a factor; in log2(n) steps."""
    p = m.copy()
    step, n = 1, len(m)
    while step < n:
        left, right = p[:-step], p[step:]
        joined = left @ right
        joined /= joined.max(axis=(1, 2), keepdims=True)
        if reverse:
            p = np.concatenate([joined, p[n - step :]])
        else:
            p = np.concatenate([p[:step], joined])
        step *= 2
    return p


def good_probability(emission: np.ndarray, starts: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Forward-backward over all chains at once: probability of good for every line; ``starts`` marks first lines.

    The matrix of a first line has equal rows, so products across it forget
    what came before (and, read backward, what comes after).
    """
    e = np.clip(emission, -50, 50)
    m = np.zeros((len(e), 2, 2))
    step = np.where(starts[:, None, None], 0.0, np.clip(transition, -50, 50)[None])
    step[:, :, 1] += e[:, None]
    m[:] = np.exp(step - step.max(axis=(1, 2), keepdims=True))
    forward = scan_products(m).sum(axis=1)
    backward = np.ones((len(e), 2))
    backward[:-1] = scan_products(m[1:], reverse=True).sum(axis=2)
    both = forward * backward
    total = both.sum(axis=1)
    near = np.where(emission > 0, 1.0, 0.0)  # only where both sides underflow
    return np.where(total > 0, both[:, 1] / np.where(total > 0, total, 1), near)


def _chains(e: np.ndarray, mask: np.ndarray, t: np.ndarray):
    """Log partition, line marginals and pair counts of padded chains: e, mask [chain, line]; t [2, 2]."""
    s, n = e.shape
    emit = np.stack([np.zeros_like(e), e], axis=2)
    lift = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    f = np.empty((s, n, 2))
    f[:, 0] = emit[:, 0]
    for i in range(1, n):
        f[:, i] = np.where(mask[:, i, None], lift(f[:, i - 1, :, None] + t, 1) + emit[:, i], f[:, i - 1])
    z = lift(f[:, -1], 1)
    b = np.zeros((s, n, 2))
    pairs = np.zeros((s, 2, 2))
    for i in range(n - 1, 0, -1):
        now = t + (emit[:, i] + b[:, i])[:, None, :]
        b[:, i - 1] = np.where(mask[:, i, None], lift(now, 2), b[:, i])
        pairs += np.where(mask[:, i, None, None], np.exp(f[:, i - 1, :, None] + now - z[:, None, None]), 0)
    good = np.exp(f[:, :, 1] + b[:, :, 1] - z[:, None]) * mask
    return z, good, pairs


def gradient(e: np.ndarray, mask: np.ndarray, t: np.ndarray, label: np.ndarray):
    """Log likelihood of the labels (1: all lines good, 0: not all) and its gradient by emission and transition."""
    z, good, pairs = _chains(e, mask, t)
    steps = mask.sum(axis=1) - 1
    all_good = np.minimum((e * mask).sum(axis=1) + steps * t[1, 1] - z, -1e-9)
    p = np.exp(all_good)
    ratio = p / -np.expm1(all_good)
    likelihood = np.where(label == 1, all_good, np.log(-np.expm1(all_good)))
    # of label 1: counts of 'all good' less expected counts; of label 0: that, times -p / (1 - p)
    factor = np.where(label == 1, 1.0, -ratio)
    by_line = factor[:, None] * (mask - good)
    sure = np.zeros((len(e), 2, 2))
    sure[:, 1, 1] = steps
    return likelihood, by_line, (factor[:, None, None] * (sure - pairs))


def learn(chains: list[tuple[np.ndarray, int]]) -> Model:
    """Weights from (features with neighbours [line, feature], label) of runs of lines."""
    rows = np.concatenate([x for x, _ in chains])
    mean, deviation = rows.mean(axis=0), rows.std(axis=0)
    deviation = np.where(deviation > 1e-9, deviation, 1.0)
    label = np.array([y for _, y in chains])
    length = np.array([len(x) for x, _ in chains])
    mask = np.arange(length.max())[None] < length[:, None]
    z = np.clip((rows - mean) / deviation, -8, 8)
    share = np.where(label == 1, 0.5 / max((label == 1).sum(), 1), 0.5 / max((label == 0).sum(), 1))
    w, c, t = np.zeros(z.shape[1]), 1.0, np.array([[0.5, 0.0], [0.0, 0.5]])
    theta = np.r_[w, c, t.ravel()]
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, STEPS + 1):
        w, c, t = theta[:-5], theta[-5], theta[-4:].reshape(2, 2)
        e = np.zeros(mask.shape)
        e[mask] = z @ w + c
        _, by_line, by_step = gradient(e, mask, t, label)
        by_line = (by_line * share[:, None])[mask]
        g = np.r_[z.T @ by_line, by_line.sum(), (by_step * share[:, None, None]).sum(axis=0).ravel()] - RIDGE * theta
        # Adam, upward
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta = theta + RATE / (1 + i / 100) * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.999**i)) + 1e-8)
    return Model(mean, deviation, theta[:-5], float(theta[-5]), theta[-4:].reshape(2, 2))


# texts ------------------------------------------------------------------------------------------


def chunks(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > CHUNK:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield held


def quality(model: Model, texts: list[bytes]) -> np.ndarray:
    """Mean probability of good over each text's lines, weighted by bytes (the newline counts as one)."""
    out = []
    for part in chunks(iter(texts)):
        f, size, text = line_features(part)
        good = good_probability(model.emission(with_neighbours(f, text)), f[:, -1] > 0, model.transition)
        out.append(np.bincount(text, (size + 1) * good, len(part)) / np.bincount(text, size + 1, len(part)))
    return np.concatenate(out) if out else np.zeros(0)


def _odds(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def score(model: Model, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1, to 9 digits: the last ones depend on how texts are batched."""
    if model.share is not None:
        return np.full(len(texts), model.share)
    return np.round(1 / (1 + np.exp(-(model.slope * _odds(quality(model, texts)) + model.offset))), 9)


def quality_column(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(quality(model, list(texts)), dtype="float64")

    return run(text)


def score_column(model: Model, text: str = "text") -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score(model, list(texts)), dtype="float64")

    return run(text_bytes(text))


def _curve(q: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic curve on the log-odds, by Newton steps with a little ridge."""
    x = np.stack([_odds(q), np.ones(len(q))], axis=1)
    theta = np.array([1.0, 0.0])
    weight = weight / weight.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        g = x.T @ (weight * (label - p)) - 1e-2 * theta
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-2])
        move = np.linalg.solve(h, g)
        theta = theta + np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-9:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """At most PIECES runs of RUN lines of each text, spread by a generator seeded with the text's hash."""
    for pdf in batches:
        out = []
        for t, h, y in zip(pdf["text"], pdf["h"], pdf["label"]):
            f, _, text = line_features([t])
            x = with_neighbours(f, text)
            n = -(-len(x) // RUN)
            for i in np.random.default_rng(int(h) & (2**63 - 1)).permutation(n)[:PIECES]:
                out.append((int(h), int(i), int(y), x[i * RUN : i * RUN + RUN].astype("<f4").tobytes()))
        yield pd.DataFrame(out, columns=["h", "run", "label", "x"])


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """At most SAMPLE distinct texts per label (h, label, text), and the number of labelled rows by label.

    Only ids and hashes meet the labels; texts are fetched for the drawn ids,
    which are few enough to broadcast.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min("quality").cast("int").alias("label"), F.max("quality").cast("int").alias("top")).where("label = top").drop("top")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    rows = keyed.join(known, "doc_id").groupBy("h", "label").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    rows = saved(rows, "quality_labelled")
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    drawn = [rows.where(F.col("label") == y).orderBy(F.xxhash64("h", F.lit("quality")), "h").limit(SAMPLE) for y in (0, 1)]
    drawn = saved(drawn[0].unionByName(drawn[1]).drop("n"), "quality_drawn")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), text_bytes().alias("text"))
    found = texts.join(F.broadcast(drawn), ["doc_id", "h"]).groupBy("h", "label").agg(F.first("text").alias("text"))
    return found, totals


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from documents (doc_id, text) and labels (doc_id, quality)."""
    bound_batches(docs.sparkSession)
    found, totals = sample(docs, labels)
    one, none = totals.get(1, 0), totals.get(0, 0)
    if not one or not none:
        zero = np.zeros(4 * WIDTH)
        return Model(zero, zero + 1, zero, 0.0, np.zeros((2, 2)), share=(one + 1) / (one + none + 2))
    found = saved(found, "quality_sample")
    runs = found.mapInPandas(_runs, "h long, run int, label int, x binary").toPandas().sort_values(["h", "label", "run"], kind="stable")
    model = learn([(np.frombuffer(x, "<f4").reshape(-1, 4 * WIDTH).astype(float), y) for x, y in zip(runs["x"], runs["label"])])
    got = found.select("h", "label", quality_column(model, F.col("text")).alias("q")).toPandas().sort_values(["h", "label"], kind="stable")
    label = got["label"].to_numpy()
    weight = np.where(label == 1, one / (label == 1).sum(), none / (label == 0).sum())
    model.slope, model.offset = _curve(got["q"].to_numpy(), label, weight)
    return model
