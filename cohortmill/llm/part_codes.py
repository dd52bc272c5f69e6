"""Compression of vectors to one code per part: codebooks of integer entries, distances by value dictionaries.

Components are integers, floor(scale * x). In an Arrow batch every dimension has a dictionary of its distinct integers; the
squared differences of each of them to all entries are tabulated once, so the distances of a part are gathers of table
rows by dictionary code, and adds. A batch bounds its dictionaries, so no table grows with the data.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .textbytes import bound_batches

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Squared differences of integers below this fit a long, summed over a part too; larger ones are counted in Python's integers.
_PLAIN = 1 << 24
#: Sums go to Spark as a multiple of 10^18 and the rest, so that neither can overflow.
_HALF = 10**18


def _integers(values: np.ndarray) -> np.ndarray:
    """Whole numbers as longs, or as Python's integers where one is large."""
    if values.size == 0 or np.abs(values).max() < _PLAIN:
        return values.astype(np.int64)
    return np.array([int(x) for x in values.reshape(-1)] + [None], object)[:-1].reshape(values.shape)


def floored(column: pa.Array, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of the vectors, rows x width."""
    if (np.asarray(column.value_lengths()) != width).any():
        raise ValueError(f"vectors must all have {width} components")
    return _integers(np.floor(np.asarray(column.flatten().cast(pa.float64())).reshape(len(column), width) * scale))


@dataclass
class Codebooks:
    """`entries`: parts x entries x components of a part, integers."""

    entries: np.ndarray
    scale: int = SCALE

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances), rows x parts: the nearest entry of each part, ties to the lower index."""
        parts, count, size = self.entries.shape
        kind = object if object in (vectors.dtype, self.entries.dtype) else np.int64
        entries, rows = self.entries.astype(kind), len(vectors)
        codes, errors = np.zeros((rows, parts), np.int64), np.zeros((rows, parts), kind)
        for p in range(parts):
            distance = np.zeros((rows, count), kind)
            for j in range(size):
                dictionary, at = np.unique(vectors[:, p * size + j].astype(kind), return_inverse=True)
                distance += ((dictionary[:, None] - entries[p, :, j][None, :]) ** 2)[at]
            codes[:, p] = distance.argmin(axis=1)
            errors[:, p] = distance[np.arange(rows), codes[:, p]]
        return codes, errors


def whole_vectors(df: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """Rows whose vector is there and holds finite numbers only, finite when scaled too."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) == float("inf")))
    return df.where(F.col(vector).isNotNull()).where(~bad)


def _sums(vectors: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[int, int]]:
    """(count, sum) of the parts assigned to each entry, by (part and entry, component): at most entries x width rows."""
    held = vectors.sparkSession.sparkContext.broadcast(books)
    parts, count, size = books.entries.shape

    def run(batches):
        totals, counts, cells = np.zeros((parts * count, size), object), np.zeros(parts * count, np.int64), np.arange(parts) * count
        for batch in batches:
            if not batch.num_rows:
                continue
            own = floored(batch.column(0), held.value.scale, held.value.width)
            codes = held.value.nearest(own)[0] + cells
            counts += np.bincount(codes.reshape(-1), minlength=parts * count)
            added = np.zeros((parts * count, size), own.dtype)
            np.add.at(added, codes.reshape(-1), own.reshape(-1, size))
            totals += added
        used = np.repeat(np.flatnonzero(counts), size)
        place = np.tile(np.arange(size), len(used) // max(size, 1))
        halves = [divmod(int(x), _HALF) for x in totals[used, place]]
        kind = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(place, pa.int32()), pa.array(counts[used], pa.int64()),
                                          *[pa.array([Decimal(h[k]) for h in halves], kind) for k in range(2)]],
                                         names=["cell", "place", "count", "high", "low"])

    partial = vectors.mapInArrow(run, "cell int, place int, count long, high decimal(38,0), low decimal(38,0)")
    rows = partial.groupBy("cell", "place").agg(F.sum("count").alias("count"), *[F.sum(F.col(h).cast("decimal(28,0)")).alias(h) for h in ("high", "low")]).collect()
    return {(r["cell"], r["place"]): (r["count"], int(r["high"]) * _HALF + int(r["low"])) for r in rows}


def fit_codebooks(df: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
                  rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks by `rounds` of assignment and means, from the vectors of the smallest keys; None where no vector is whole.

    Each round reads all vectors and brings back one sum for each component of each entry. Equal keys are taken in the
    vectors' order, null keys last. Vectors of different lengths, or of one that `parts` does not divide, are an error.
    """
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits, so 256 entries at most")
    bound_batches(df)
    whole = whole_vectors(df.select(F.col(key).alias("key"), F.col(vector).alias("vector")), "vector", scale)
    start = whole.orderBy(F.asc_nulls_last("key"), "vector").limit(entries).collect()
    if not start:
        return None
    width = len(start[0]["vector"])
    if width % parts or any(len(r["vector"]) != width for r in start):
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    first = _integers(np.floor(np.array([r["vector"] for r in start], np.float64) * scale))
    books = Codebooks(first.reshape(len(start), parts, width // parts).transpose(1, 0, 2).copy(), scale)
    for _ in range(rounds):
        wide = books.entries.astype(object)
        for (cell, place), (count, total) in _sums(whole.select("vector"), books).items():
            wide[cell // len(start), cell % len(start), place] = total // count
        books = Codebooks(_integers(wide), scale)
    return books


def encoded(df: DataFrame, books: Codebooks, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, label, code, error) of every whole vector; error is exact, as a decimal, and null beyond 38 digits."""
    held = df.sparkSession.sparkContext.broadcast(books)
    bound_batches(df)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                codes, errors = held.value.nearest(floored(batch.column(2), held.value.scale, held.value.width))
                exact = [int(x) for x in errors.sum(axis=1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)]),
                                                  pa.array([Decimal(x) if x < 10**38 else None for x in exact], pa.decimal128(38, 0))],
                                                 names=["key", "label", "code", "error"])

    rows = whole_vectors(df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector")), "vector", books.scale)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"key {kinds['key']}, label {kinds['label']}, code string, error decimal(38,0)")


def decoded(df: DataFrame, books: Codebooks, code: str = "code", into: str = "vector") -> DataFrame:
    """`df` with the vector that each code stands for, its entries' integers divided by the scale; null codes give null."""
    parts = books.entries.shape[0]
    table = F.array(*[F.array(*[F.array(*[F.lit(float(x) / books.scale) for x in e]) for e in part]) for part in books.entries])
    index = lambda p: F.conv(F.substring(F.col(code), 2 * p + 1, 2), 16, 10).cast("int")
    return df.withColumn(into, F.flatten(F.array(*[table[p][index(p)] for p in range(parts)])))


def part_codes(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **options) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256): each whole vector's code under the table's own codebooks.

    error: its squared distance summed over parts, label_error: the sum over rows of an equal label, nulls together; both
    are null beyond a long. Rows whose vector is null or holds null or non-finite components go, rows that repeat stay, and
    a null key is kept as it is. A table without whole vectors gives no rows; other columns play no part.
    """
    books = fit_codebooks(df, key, vector, **options)
    if books is None:
        books = Codebooks(np.zeros((options.get("parts", PARTS), 1, 0), np.int64))
    found = cut_lineage(encoded(df, books, key, vector, label))
    sums = found.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("_sum"))
    return found.join(sums, found["label"].eqNullSafe(sums["_label"])).select(
        F.col("key").alias(key), "code", F.col("error").try_cast("long").alias("error"), F.col("_sum").try_cast("long").alias("label_error"),
        F.lit(books.sha256()).alias("codebooks_sha256"))
