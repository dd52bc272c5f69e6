"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .textbytes import SOLID_BYTES, bound_batches, give_back, text_bytes, with_arrow_columns, word_chunks

#: Random features, kernel width over standardised statistics, ridge penalty per row, and rows that a fit may read.
FEATURES, WIDTH, PENALTY, MAX_LABELLED = 256, 4.0, 1e-4, 2_000_000
BINS, _PARTS = 1_024, 64
STATISTICS = ["log_bytes", "log_words", "bytes_per_word", "upper", "lower", "digit", "blank", "newline", "stop", "mark", "symbol",
              "beyond_ascii", "upper_latin", "distinct_words", "top_word", "repeated_next", "distinct_pairs", "distinct_lines"]
_code = np.arange(256)
_mark = np.isin(_code, [ord(c) for c in ".,;:'\"()-!?"])
_CLASSES = [(_code >= 0x41) & (_code <= 0x5A), (_code >= 0x61) & (_code <= 0x7A), (_code >= 0x30) & (_code <= 0x39), ~SOLID_BYTES,
            _code == 0x0A, np.isin(_code, [ord(c) for c in ".!?"]), _mark,
            (_code > 0x20) & (_code < 0x7F) & ~_mark & ~(((_code | 32) >= 0x61) & ((_code | 32) <= 0x7A)) & ~((_code >= 0x30) & (_code <= 0x39)),
            _code >= 0x80]
_KIND = np.zeros((256, len(_CLASSES)), np.int64)
for _i, _c in enumerate(_CLASSES):
    _KIND[_c, _i] = 1
_NEWLINE = np.ones(256, bool)
_NEWLINE[0x0A] = False


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text; nulls are like empty texts."""
    data, at = text_bytes(column)
    size = np.diff(at).astype(np.float64)
    out = np.zeros((len(size), len(STATISTICS)))
    for i in range(len(size)):  # counts of byte values, then of the classes they are in
        if size[i]:
            piece = data[at[i]:at[i + 1]]
            out[i, 3:12] = np.bincount(piece, minlength=256) @ _KIND
            after = piece[1:]
            out[i, 12] = np.count_nonzero((piece[:-1] == 0xC3) & (after >= 0x80) & (after <= 0x9E))
    out[:, 3:13] /= np.maximum(1, size)[:, None]
    for words in word_chunks(column, SOLID_BYTES):
        for i in range(words.hi - words.lo):
            own = words.hashes[words.first[i]:words.first[i + 1]]
            if n := len(own):
                row = out[words.lo + i]
                row[1] = n
                ordered = np.sort(own)
                ends = np.append(np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, n)
                row[13] = len(ends) / n
                row[14] = np.diff(ends, prepend=0).max() / n
                if n > 1:
                    row[15] = np.count_nonzero(own[1:] == own[:-1]) / (n - 1)
                    pairs = np.sort(own[1:] * np.uint64(3) + own[:-1])
                    row[16] = (1 + np.count_nonzero(pairs[1:] != pairs[:-1])) / (n - 1)
    for lines in word_chunks(column, _NEWLINE):
        for i in range(lines.hi - lines.lo):
            own = lines.hashes[lines.first[i]:lines.first[i + 1]]
            out[lines.lo + i, 17] = len(np.unique(own)) / len(own) if len(own) else 0
    out[:, 2] = np.log1p(size / np.maximum(1, out[:, 1]))
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(out[:, 1])
    return out


def with_statistics(docs: DataFrame, text: str = "text", into: str = "statistics", drop: tuple[str, ...] = ()) -> DataFrame:
    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        found = statistics(batch.column(batch.schema.get_field_index(text)))
        return [pa.ListArray.from_arrays(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32), found.ravel())]

    return with_arrow_columns(docs, [(into, T.ArrayType(T.DoubleType()))], make, drop)


@dataclass
class QualityModel:
    middle: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    #: Raw scores and the calibrated value from each on.
    steps: np.ndarray
    values: np.ndarray

    def features(self, found: np.ndarray) -> np.ndarray:
        clean = np.clip((found - self.middle) / self.scale, -6, 6)
        waves = np.cos(clean @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(found), 1))])

    def raw(self, found: np.ndarray) -> np.ndarray:
        return self.features(found) @ self.weights

    def score(self, found: np.ndarray) -> np.ndarray:
        return self.values[np.searchsorted(self.steps, self.raw(found), "right")]


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return np.asarray(column.flatten()).reshape(len(column), len(STATISTICS))


def _summed(rows: DataFrame, shape: tuple[int, ...], part) -> np.ndarray:
    """The sum over all batches of the array that `part(batch)` gives: by task, then over at most _PARTS rows."""
    bound_batches(rows)

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    found = rows.coalesce(_PARTS).mapInArrow(run, "total binary").toLocalIterator()
    return sum((np.frombuffer(r[0]).reshape(shape) for r in found), np.zeros(shape))


def isotonic(weight: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to `mean` in weighted squares: neighbours that fall are pooled."""
    pools: list[list[float]] = []
    for w, m in zip(weight, mean, strict=True):
        pools.append([m, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m2, w2, n2 = pools.pop()
            m1, w1, n1 = pools[-1]
            pools[-1] = [(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def fit_quality(labelled: DataFrame, calibrating: Column, statistics: str = "statistics", label: str = "label",
                seed: int = 5) -> QualityModel:
    """Fit on rows of statistics and a 0/1 label; rows where `calibrating` holds only calibrate.

    Beyond MAX_LABELLED rows a hash sample of that many is read. Two small sums over tasks reach the driver: moments
    and the normal equations of FEATURES + 1 unknowns, then a histogram of raw scores. Rows with a null label take no
    part; without rows every score is 0.5, with one class it is that class's share.
    """
    rows = cut_lineage(labelled.where(F.col(label).isNotNull() & F.col(statistics).isNotNull()).select(
        statistics, F.col(label).cast("double").alias("label"), calibrating.alias("late")))
    if (n := rows.count()) > MAX_LABELLED:
        rows = rows.where(F.pmod(F.xxhash64(statistics), F.lit(1 << 30)) < int((1 << 30) * MAX_LABELLED / n))
    d = len(STATISTICS)
    fitting = rows.where("not late")
    moments = _summed(fitting, (3, d), lambda b: np.stack([(m := _matrix(b, statistics)).sum(0), (m * m).sum(0), np.full(d, float(len(m)))]))
    seen = max(1.0, moments[2, 0])
    middle = moments[0] / seen
    scale = np.sqrt(np.maximum(moments[1] / seen - middle**2, 1e-12))
    draw = np.random.default_rng(seed)
    model = QualityModel(middle, np.maximum(scale, 1e-3), draw.normal(size=(d, FEATURES)) / WIDTH, draw.uniform(0, 2 * np.pi, FEATURES),
                         np.zeros(FEATURES + 1), np.zeros(0), np.full(1, 0.5))

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        x = model.features(_matrix(batch, statistics))
        return np.hstack([x.T @ x, (x.T @ np.asarray(batch.column(batch.schema.get_field_index("label"))))[:, None]])

    both = _summed(fitting, (FEATURES + 1, FEATURES + 2), equations)
    model.weights = np.linalg.solve(both[:, :-1] + PENALTY * seen * np.eye(FEATURES + 1), both[:, -1])
    edges = np.linspace(-0.5, 1.5, BINS - 1)

    def histogram(batch: pa.RecordBatch) -> np.ndarray:
        at = np.searchsorted(edges, model.raw(_matrix(batch, statistics)), "right")
        y = np.asarray(batch.column(batch.schema.get_field_index("label")))
        return np.stack([np.bincount(at, minlength=BINS), np.bincount(at, y, minlength=BINS)])

    counts = _summed(rows.where("late"), (2, BINS), histogram)
    if not counts[0].sum():
        counts = _summed(fitting, (2, BINS), histogram)
    held = np.flatnonzero(counts[0])
    if len(held):
        levels = isotonic(counts[0, held], counts[1, held] / counts[0, held])
        model.steps, model.values = edges[held[1:] - 1], np.clip(levels, 0, 1)
    return model


def scored(docs: DataFrame, model: QualityModel, statistics: str = "statistics", into: str = "score", drop: tuple[str, ...] = ()) -> DataFrame:
    """`docs` with the calibrated score of their statistics, from 0 to 1."""
    handed = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(handed.value.score(_matrix(batch, statistics)), pa.float64())]

    return with_arrow_columns(docs, [(into, T.DoubleType())], make, drop)


def text_scores(docs: DataFrame, model: QualityModel, text: str = "text") -> Column:
    """The calibrated score of each text as a column: only texts go to Python, and only scores come back."""
    bound_batches(docs)
    handed = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(column: pa.Array) -> pa.Array:
        found = pa.array(handed.value.score(statistics(column)), pa.float64())
        give_back()
        return found

    return score(F.col(text).cast("string"))
