"""Vector codes: every part of a vector is replaced by its nearest entry in a codebook of its position.

Nearest entries are found by an integer Walsh-Hadamard transform.  Parts and
entries are padded with zeros to a power of two ``n`` and transformed by
additions and subtractions; squared distances of the transforms are ``n``
times those of the parts.  The squared differences are summed in sequency
order (few sign changes first), and an entry leaves as soon as its sum exceeds
the full sum of the entry that looked best, so few entries are summed to the
end.  All arithmetic is in 64-bit integers: results are exact, ties go to the
lower index.

Codebooks are refined by rounds over all vectors; a round sends one row of
sums per task through the shuffle and (parts * entries * part length) totals
to the driver.

Edge cases: vectors that are NULL or hold NULL, NaN or infinity are left out;
starting entries are those of the smallest ids (NULL last, equal ids by their
components); with fewer vectors than entries there are as many entries as
vectors; a vector whose length differs from that of the smallest id's, or all
where that length does not divide into the parts, has a NULL code and error;
errors of NULL labels are summed together; an empty table gives no rows; rows
repeated whole count each; extra columns are ignored.  A component too large
for exact sums in a long raises an error (about 8,000 at the default scale).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwise.llm.common import attach_groups, saved
from leafwise.llm.vectors import finite, floored, list_of, summed

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Sequency steps after which the entry that looks best is summed to the end.
HEAD = 2


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the last axis (zero-padded to a power of two), rows in sequency order."""
    n = 1 << max(0, x.shape[-1] - 1).bit_length()
    y = np.zeros((*x.shape[:-1], n), np.int64)
    y[..., : x.shape[-1]] = x
    span = 1
    while span < n:
        pairs = y.reshape(*x.shape[:-1], n // (2 * span), 2, span)
        a, b = pairs[..., 0, :].copy(), pairs[..., 1, :]
        pairs[..., 0, :] += b
        pairs[..., 1, :] = a - b
        span *= 2
    return y[..., sequency(n)]


def sequency(n: int) -> np.ndarray:
    """Rows of the natural order by number of sign changes: bit-reversed Gray codes."""
    bits = n.bit_length() - 1
    gray = np.arange(n) ^ (np.arange(n) >> 1)
    return sum(((gray >> b) & 1) << (bits - 1 - b) for b in range(bits)) + np.zeros(n, np.int64)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest of ``entries`` for every part, exact; ties to the lower index."""
    x, e = hadamard(parts), hadamard(entries)
    n = e.shape[1]
    head = min(HEAD, n)
    sums = np.zeros((len(x), len(e)), np.int64)
    for s in range(head):
        sums += (x[:, s, None] - e[None, :, s]) ** 2
    best = sums.argmin(axis=1)
    bound = ((x - e[best]) ** 2).sum(axis=1)
    row, entry = np.nonzero(sums <= bound[:, None])
    total = sums[row, entry]
    for s in range(head, n):
        total = total + (x[row, s] - e[entry, s]) ** 2
        alive = total <= bound[row]
        row, entry, total = row[alive], entry[alive], total[alive]
    # pairs are in order of row and entry: the first least sum of a row has the lowest index
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
    least = np.minimum.reduceat(total, starts) if len(row) else total
    hits = np.flatnonzero(total == np.repeat(least, np.diff(np.r_[starts, len(row)])))
    first = hits[np.r_[True, row[hits][1:] != row[hits][:-1]]] if len(hits) else hits
    return entry[first], least // n


def limit(length: int) -> int:
    """Components below this keep the sums of the transforms within a long."""
    log = max(0, length - 1).bit_length()
    return 1 << ((62 - log) // 2 - log - 1)


def encode(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances [vector, part] for vectors [vector, part, component]."""
    got = [nearest(x[:, p], books[p]) for p in range(len(books))]
    return np.stack([g[0] for g in got], axis=1), np.stack([g[1] for g in got], axis=1)


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), parts, -1)


def _sums(books: np.ndarray):
    """One row per task: sums and counts of the parts that each entry is nearest to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, length = books.shape
        sums, counts = np.zeros((parts * entries, length), np.int64), np.zeros(parts * entries, np.int64)
        seen = False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            x = _matrix(batch.column("x"), parts)
            code, _ = encode(x, books)
            at = (code + np.arange(parts) * entries).ravel()
            np.add.at(sums, at, x.reshape(-1, length))
            np.add.at(counts, at, 1)
        if seen:
            yield pa.RecordBatch.from_arrays([list_of(sums.ravel(), pa.int64()), list_of(counts, pa.int64())], names=["sums", "counts"])

    return run


def train(rows: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after ``rounds`` rounds over ``rows`` (x array<long>); unused entries stay."""
    parts, entries, length = books.shape
    for _ in range(rounds):
        part = saved(rows.select("x").mapInArrow(_sums(books), "sums array<long>, counts array<long>"), "code_sums")
        sums, counts = summed(part, "sums"), summed(part, "counts")
        moved = books.copy()
        for at, n in counts.items():
            if n:
                moved[at // entries, at % entries] = [sums[at * length + i] // n for i in range(length)]
        if (moved == books).all():
            break
        books = moved
    return books


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Rows vec_id, label, code (bytes, one per part), error of all kept vectors, and the codebooks [part, entry, component]."""
    if entries > 256:
        raise ValueError("a code byte holds 256 entries at most")
    v = F.col(vector)
    named = vectors.where(finite(v)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).alias("label"), v.alias("v"))
    first = named.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).select(F.size("v")).first()
    none = np.zeros((parts, 0, 0), np.int64)
    blank = [F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")]
    length = first[0] // parts if first is not None and first[0] % parts == 0 else 0
    if not length:
        return named.select("vec_id", "label", *blank), none
    fits = F.size("v") == length * parts
    rows = saved(named.where(fits).select("vec_id", "label", floored(F.col("v"), scale, limit(length)).alias("x")), "code_vectors")
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    books = np.array([r["x"] for r in start], np.int64).reshape(-1, parts, length).transpose(1, 0, 2).copy()
    books = train(rows, books, rounds)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, error = encode(_matrix(batch.column("x"), parts), books)
                held = pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), held, pa.array(error.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    schema = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code binary, error long"
    out = rows.mapInArrow(code, schema)
    return out.unionByName(named.where(~fits).select("vec_id", "label", *blank)), books


def books_digest(books: np.ndarray) -> str:
    """sha256 of all entries' components by part, entry and position, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_report(found: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (summed over equal labels) and the codebooks' digest."""
    key = F.when(F.col("label").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("label").cast("string")))
    found = saved(found.withColumn("group", key), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)")).cast("long")
    groups = saved(found.groupBy("group").agg(total.alias("label_error"), F.count(F.lit(1)).alias("rows")), "code_labels")
    out = attach_groups(found, groups, "group", "rows", found.count())
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
