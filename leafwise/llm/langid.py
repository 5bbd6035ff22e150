"""Language identification by the nearest of several centroids per language.

A text becomes a unit TF-IDF vector over hashed character n-grams (one to
three characters, letters lower-cased, everything else one blank).  Document
frequencies are counted over all labelled training rows; the centroids of a
language come from spherical k-means over a bounded, documented sample of its
rows.  A text takes the language of the centroid with the largest cosine and
is rejected when that cosine is below ``SLACK`` times what all but the share
``REJECT`` of the language's own training rows reach, counted over all of them.

Edge cases: NULL text, or one without a letter, is ``und`` with score 0 and
rejected; with no labelled row at all every text is ``und``; ties between
centroids go to the language first in order; very long texts are read whole;
an empty table gives no rows; repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwise.llm.common import bound_batches, text_bytes

#: Hashed n-gram features.
WIDTH = 8192
#: Labelled rows per language from which its centroids are fitted, about (chosen by a hash of id and text).
SAMPLE = 1000
CENTROIDS = 3
ROUNDS = 8
#: Share of a language's own training texts that rejection may cost.
REJECT = 0.001
#: Factor on that quantile: distance kept below it.
SLACK = 0.8
#: The quantile's rank is off by at most a row in so many.
RANKS = 100_000


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def counts(text: str) -> np.ndarray | None:
    """Hashed n-gram counts; None without a letter."""
    low = text.lower().encode("utf-32-le", "surrogatepass")
    code = np.frombuffer(low, np.uint32)
    if not len(code):
        return None
    letter = _letters()[code]
    if not letter.any():
        return None
    code = np.where(letter, code, 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each run of letters
    code = np.concatenate([[np.uint64(32)], code[keep], [np.uint64(32)]])
    total = np.zeros(WIDTH, np.int64)
    shift = np.uint64(64 - WIDTH.bit_length() + 1)
    h = code
    with np.errstate(over="ignore"):
        for n in (1, 2, 3):
            h = code if n == 1 else h[:-1] * np.uint64(1_000_003) + code[n - 1 :]
            total += np.bincount(((h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64), minlength=WIDTH)
    return total


def vector(text: str, idf: np.ndarray) -> np.ndarray | None:
    c = counts(text)
    if c is None:
        return None
    v = np.log1p(c) * idf
    return (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)


@dataclass
class Model:
    langs: list[str]
    #: Row of ``langs`` of each centroid.
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    #: Least accepted cosine per language.
    least: np.ndarray


def _df_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(WIDTH, np.int64)
    n = 0
    for pdf in batches:
        for t in pdf["text"]:
            c = counts(t.decode("utf-8", "replace"))
            if c is not None:
                total += c > 0
                n += 1
    if n:
        at = np.append(np.flatnonzero(total), WIDTH)
        yield pd.DataFrame({"feature": at, "df": np.append(total[at[:-1]], n)})


def _kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means; starts with the row nearest the mean, then the rows farthest from those taken."""
    first = x @ x.mean(axis=0)
    chosen = [int(first.argmax())]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[at == j].sum(axis=0) if (at == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def fit(train: DataFrame) -> Model:
    """Model from rows (id, text, lang) with lang not NULL."""
    bound_batches(train.sparkSession)
    rows = train.select(F.col("id"), text_bytes().alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null")
    df = rows.select("text").mapInPandas(_df_of, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).toPandas()
    if df.empty:
        return Model([], np.zeros(0, int), np.zeros((0, WIDTH), np.float32), np.ones(WIDTH, np.float32), np.zeros(0))
    seen = np.zeros(WIDTH + 1)
    seen[df["feature"]] = df["df"]
    idf = (np.log((1 + seen[WIDTH]) / (1 + seen[:WIDTH])) + 1).astype(np.float32)

    per_lang = rows.groupBy("lang").count().collect()  # one row per language
    rate = F.create_map(*[F.lit(x) for r in per_lang for x in (r["lang"], min(1.0, SAMPLE / r["count"]))])
    # by id and text, and of rows repeated whole one: no id and no copy brings its whole group into a task
    draw = F.pmod(F.xxhash64("id", "text", F.lit("langid")), F.lit(1_000_000)) / 1_000_000
    sample = rows.where(draw < rate[F.col("lang")]).dropDuplicates(["lang", "text"])

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [v for t in pdf["text"] if (v := vector(t.decode("utf-8", "replace"), idf)) is not None]
        if not got:
            return pd.DataFrame({"lang": [], "centroid": []})
        x = np.stack(got)
        c = _kmeans(x, CENTROIDS, ROUNDS)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": [r.astype(np.float32).tobytes() for r in c]})

    got = sample.groupBy("lang").applyInPandas(cluster, "lang string, centroid binary").toPandas()
    got = got.sort_values(["lang", "centroid"], kind="stable")
    langs = sorted(set(got["lang"]))
    model = Model(
        langs, got["lang"].map(langs.index).to_numpy(int),
        np.stack([np.frombuffer(c, np.float32) for c in got["centroid"]]) if langs else np.zeros((0, WIDTH), np.float32),
        idf, np.zeros(len(langs)),
    )
    cosines = rows.select("lang", own_cosine(model).alias("c"))
    least = cosines.groupBy("lang").agg(F.percentile_approx("c", REJECT, RANKS).alias("least")).collect()  # one row per language
    for r in least:
        if r["lang"] in langs:
            model.least[langs.index(r["lang"])] = r["least"] * SLACK
    return model


def own_cosine(model: Model) -> Column:
    """Largest cosine of a row's ``text`` (bytes) with a centroid of its own ``lang``; NULL without a letter."""

    @F.pandas_udf("double")
    def cosine(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = {x: model.centroids[model.owner == i] for i, x in enumerate(model.langs)}
        for texts, langs in batches:
            out = []
            for t, lang in zip(texts, langs):
                v = vector(t.decode("utf-8", "replace"), model.idf) if lang in own else None
                out.append(None if v is None else float((own[lang] @ v).max()))
            yield pd.Series(out, dtype="float64")

    return cosine("text", "lang")


def predict_column(model: Model, text: str = "text") -> Column:
    """struct(lang_pred, score, rejected) of a text column."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                v = vector(t.decode("utf-8", "replace"), model.idf) if len(model.langs) else None
                if v is None:
                    out.append(("und", 0.0, True))
                    continue
                cosine = model.centroids @ v
                best = int(cosine.argmax())
                own = model.owner[best]
                score = float(min(1.0, max(0.0, cosine[best])))
                out.append((model.langs[own], score, score < model.least[own]))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    return predict(text_bytes(text))
