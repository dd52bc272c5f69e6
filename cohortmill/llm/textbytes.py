"""Words of whole text columns, found and hashed on the UTF-8 bytes of an Arrow batch.

Every byte of a character outside ASCII is 0x80 or more, so word classes that treat all such characters alike can
be read off single bytes. Chunks keep the temporary arrays at a few MB, whatever the length of a text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CHUNK = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15

_ascii = np.arange(256)
LOWER = np.where((_ascii >= 0x41) & (_ascii <= 0x5A), _ascii + 32, _ascii).astype(np.uint8)
#: Letters and digits of ASCII, and every character outside ASCII.
WORD_BYTES = ((_ascii >= 0x30) & (_ascii <= 0x39)) | ((_ascii >= 0x61) & (_ascii <= 0x7A)) | (_ascii >= 0x80)
#: Everything but the six blanks of ASCII.
SOLID_BYTES = ~((_ascii == 0x20) | ((_ascii >= 0x09) & (_ascii <= 0x0D)))
_BYTE_VALUES = np.random.default_rng(20_011).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser: another seed gives another random order of the same values."""
    x = x + np.uint64((seed * MULTIPLIER + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers and their inverses modulo 2^64, kept for the worker's next chunk."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, CHUNK + 1)
        both = []
        for base in (MULTIPLIER, pow(MULTIPLIER, -1, 2**64)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _powers = (both[0], both[1])
    return _powers


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


@dataclass
class Words:
    """The words of rows lo to hi: row lo + i has words first[i] to first[i + 1]."""

    lo: int
    hi: int
    hashes: np.ndarray
    first: np.ndarray


def hashed_words(data: np.ndarray, cuts: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the bytes, and the number of words before each cut; no word crosses a cut."""
    data = LOWER[data]
    inside = solid[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = cuts[cuts < len(data)]
    begins[edges] = inside[edges]
    edges = cuts[cuts > 0] - 1
    ends[edges] = inside[edges]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    forth, back = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * forth[:len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[begins]) * back[begins]), np.searchsorted(begins, cuts)


def word_chunks(column: pa.Array | pa.ChunkedArray, solid: np.ndarray) -> Iterator[Words]:
    """All words of a text column, some rows at a time; a text longer than a chunk is read in pieces."""
    data, at = text_bytes(column)
    rows, lo = len(at) - 1, 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, "right")) - 1)
        if at[hi] - at[lo] <= CHUNK:
            hashes, first = hashed_words(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], solid)
        else:
            parts, begin = [], int(at[lo])
            while begin < at[hi]:
                end = min(begin + CHUNK, int(at[hi]))
                while end < at[hi]:  # a piece ends behind a blank, so that no word is cut
                    window = data[max(begin, end - 4096):end]
                    blanks = np.flatnonzero(~solid[LOWER[window]])
                    if len(blanks):
                        end = end - len(window) + int(blanks[-1]) + 1
                        break
                    end = min(end + 4096, int(at[hi]))
                parts.append(hashed_words(data[begin:end], np.array([0, end - begin]), solid)[0])
                begin = end
            hashes = np.concatenate(parts)
            first = np.array([0, len(hashes)])
        yield Words(lo, hi, hashes, first)
        lo = hi


SHINGLE = 5
_places = np.random.default_rng(77).integers(1, 2**63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: np.ndarray) -> np.ndarray:
    """One 64-bit value for each run of SHINGLE words; fewer words give one value for all of them, none give none."""
    n = SHINGLE
    if not len(words):
        return np.zeros(0, np.uint64)
    if len(words) < n:
        total = (words * _places[:len(words)]).sum(keepdims=True) + _places[n:] * np.uint64(len(words))
        return mixed(total, 2)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total += words[k:len(words) - n + 1 + k] * _places[k]
    return mixed(total, 1)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not glibc
    _trim = None


def give_back() -> None:
    """Hands the freed memory of Arrow and of the C library back, so that a reused worker doesn't keep a stage's peak."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


BATCH_BYTES = 8 << 20


def bound_batches(df: DataFrame) -> None:
    """Arrow batches end at BATCH_BYTES if the session names no bound of its own, so long texts can't fill a worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(df.sparkSession.conf.get(name, str(2**31 - 1)).rstrip("bB")) >= 2**31 - 1:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))


def with_arrow_columns(df: DataFrame, fields: list[tuple[str, T.DataType]], make: Callable[[pa.RecordBatch], list[pa.Array]],
                       drop: tuple[str, ...] = ()) -> DataFrame:
    """`df` and new columns that `make` computes for each Arrow batch.

    Columns of `df` named in `drop`, or like a new column, are not returned.
    """
    bound_batches(df)
    new = {name for name, _ in fields}
    kept = [f for f in df.schema.fields if f.name not in new and f.name not in drop]
    names = [f.name for f in kept]
    schema = T.StructType(kept + [T.StructField(name, kind, True) for name, kind in fields])
    added = [name for name, _ in fields]

    def run(batches):
        try:
            for batch in batches:
                if batch.num_rows:
                    columns = [batch.column(batch.schema.get_field_index(n)) for n in names] + make(batch)
                    yield pa.RecordBatch.from_arrays(columns, names=names + added)
        finally:
            give_back()

    return df.mapInArrow(run, schema)
