"""Quality rules whose cutoffs carry a guarantee.

Each rule rejects a text when a ratio exceeds a cutoff.  For every stratum
and rule the cutoffs of a fixed ladder, laxest first, are tested in turn on
labelled good documents: a cutoff passes when the exact (Clopper-Pearson)
upper bound of its false-rejection rate stays within the rule's share of
``ALPHA``; the first failure ends the sequence.  Testing in a fixed order
needs no correction along the ladder, and the error rate ``DELTA`` is divided
by the number of strata and rules (Bonferroni).  So with probability
1 - DELTA no stratum loses more than ALPHA of its good texts to these rules.
The base rule (few words, repeated windows) is fixed beforehand, has no such
bound, and rejects beside them.  Copies are no independent draws: equal texts
of a stratum count once.  A rule that cannot be certified in a stratum
rejects nothing there.

Edge cases: NULL text has no words and fails the base rule; documents without
a label are not used for calibration, nor are ids labelled both ways; strata
not seen in calibration reject by the base rule only; an empty label table
certifies nothing; an empty table of documents gives no rows; repeated rows
get equal verdicts, as a verdict follows from the text and its stratum; very
long texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwise.llm.common import bound_batches, saved, text_bytes

ALPHA = 0.05
DELTA = 0.05
#: Cutoffs of each rule, laxest first.
LADDERS = {
    "symbol_ratio": [2.5, 2, 1.5, 1.2, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "upper_ratio": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15],
    "bang_ratio": [1.5, 1.2, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.1, 0.05],
    "dup_line_ratio": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
}
WINDOW = 8
MIN_WORDS = 20
STRUCT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, symbol_ratio double, upper_ratio double, bang_ratio double, dup_line_ratio double"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SPACE = np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)
_SYMBOL = np.frombuffer(b"#*$%&|<>", np.uint8)


def repeat_words(words: list[bytes]) -> int:
    """Words inside windows of eight words that occur at least twice in the text."""
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    # Names of windows of 2, 4, 8 words: equal names, equal windows
    name, span = ids, 1
    while span < WINDOW:
        pair = name[:-span] * np.int64(n) + name[span:]
        _, name = np.unique(pair, return_inverse=True)
        span *= 2
        if len(name) and int(name.max()) + 1 == len(name):
            return 0  # all windows of this span differ, so all longer ones do
    twice = np.bincount(name)[name] > 1
    edge = np.zeros(n + 1, np.int64)
    edge[: n - WINDOW + 1] += twice
    edge[WINDOW:] -= twice
    return int((np.cumsum(edge)[:n] > 0).sum())


def measures(text: bytes) -> tuple:
    """The columns of ``STRUCT`` for one text."""
    words = text.split()
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = int(byte.sum() - byte[128:192].sum())
    symbols, n = int(byte[_SYMBOL].sum()), len(words)
    lines = [x for x in text.split(b"\n") if x.split()]
    dup = len(lines) - len(set(lines))
    upper, lower = int(byte[65:91].sum()), int(byte[97:123].sum())
    return (
        n, points - int(byte[_SPACE].sum()), symbols, dup, repeat_words(words),
        symbols / max(n, 1), upper / max(upper + lower, 1), int(byte[33]) / max(n, 1), dup / max(len(lines), 1),
    )


def measures_column(text: str = "text") -> Column:
    """struct of the columns of ``STRUCT``."""

    @F.pandas_udf(STRUCT)
    def measure_texts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in STRUCT.split(", ")]
        for texts in batches:
            yield pd.DataFrame([measures(t) for t in texts], columns=names)

    return measure_texts(text_bytes(text))


def upper_bound(k: int, n: int, delta: float) -> float:
    """Exact upper confidence bound of a binomial share: k of n seen, error ``delta``."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    log_choose = math.lgamma(n + 1) - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in i])
    lo, hi = k / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        terms = log_choose + i * math.log(max(p, 1e-300)) + (n - i) * math.log1p(-min(p, 1 - 1e-16))
        below = math.exp(min(0.0, terms.max() + math.log(np.exp(terms - terms.max()).sum())))
        lo, hi = (p, hi) if below > delta else (lo, p)
    return hi


def calibrate(measured: DataFrame, labels: DataFrame) -> dict[str, dict[str, float]]:
    """Certified cutoffs: stratum -> rule -> cutoff.

    ``measured`` has doc_id, stratum, h (hash of the text) and the ratios;
    ``labels`` doc_id and quality (1 good).  Only counts per stratum and cutoff reach the driver.
    """
    label = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q"))
        .groupBy("doc_id").agg(F.min("q").alias("q"), F.max("q").alias("q_most"))
        .where("q = 1 and q_most = 1").select("doc_id")
    )
    good = measured.select("doc_id", "stratum", "h", *LADDERS).join(label, "doc_id", "left_semi").dropDuplicates(["stratum", "h"])
    over = [F.sum((F.col(r) > c).cast("long")).alias(f"{r}_{i}") for r, cs in LADDERS.items() for i, c in enumerate(cs)]
    rows = good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *over).collect()
    share, error = ALPHA / len(LADDERS), DELTA / max(1, len(LADDERS) * len(rows))
    out: dict[str, dict[str, float]] = {}
    for r in rows:
        chosen = {}
        for rule, ladder in LADDERS.items():
            for i, cutoff in enumerate(ladder):
                if upper_bound(r[f"{rule}_{i}"], r["n"], error) > share:
                    break
                chosen[rule] = cutoff
        out[r["stratum"]] = chosen
    return out


def verdict(cutoffs: dict[str, dict[str, float]], stratum: Column, get) -> tuple[Column, Column]:
    """(base_failed, kept) from certified cutoffs; ``get(name)`` is the column of a measure."""
    base = (get("n_words") < MIN_WORDS) | (100 * get("n_repeat_words") > 30 * get("n_words"))
    reject = F.lit(False)
    for rule in LADDERS:
        pairs = [F.lit(x) for s, c in sorted(cutoffs.items()) if rule in c for x in (s, float(c[rule]))]
        if pairs:
            reject |= F.coalesce(get(rule) > F.create_map(*pairs)[stratum], F.lit(False))
    return base, ~base & ~reject


def stratum_column() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


def text_hash() -> Column:
    """Tells texts apart (64 bits; NULL as empty)."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def measure(docs: DataFrame) -> DataFrame:
    """Measures of every document, written once: doc_id, stratum, h and the columns of ``STRUCT``."""
    bound_batches(docs.sparkSession)
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), stratum_column().alias("stratum"), text_hash().alias("h"), measures_column().alias("m"))
    return saved(got.select("doc_id", "stratum", "h", "m.*"), "quality")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Measures, base_failed and kept for every document."""
    measured = measure(docs)
    base, kept = verdict(calibrate(measured, labels), F.col("stratum"), F.col)
    return measured.drop("h").withColumns({"base_failed": base, "kept": kept})
