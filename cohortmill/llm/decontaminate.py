"""Benchmark decontamination: test windows are searched backward in an FM-index of each training shard."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .fmindex import FMIndex
from .textbytes import LOWER, WORD_BYTES, bound_batches, give_back, with_arrow_columns, word_chunks

#: Words of a window; words of a shard's index; words of a run (longer ones go on in the next, overlapping by a window
#: less one word, so ties in the suffix order stay short); benchmark text that one pass broadcasts.
WINDOW, SHARD_WORDS, RUN_WORDS, MAX_PASS_BYTES = 10, 1 << 20, 512, 64 << 20


@dataclass
class Phrases:
    """Distinct windows of a set of items. Word i of `words`, the sorted hashes, is symbol i + 1."""

    words: np.ndarray
    #: Windows by length: one row of symbols each, numbered on from `first`.
    by_length: list[tuple[np.ndarray, int]]
    #: Items of window w: owners[owner_at[w]:owner_at[w + 1]].
    owners: np.ndarray
    owner_at: np.ndarray
    items: list[str]
    shortest: int


def build_phrases(items: list[tuple[str, str]], window: int = WINDOW) -> Phrases | None:
    """Windows of (item id, text); an item of fewer words is one window, one without words has none."""
    found: dict[bytes, set[int]] = {}
    for chunk in word_chunks(pa.array([t for _, t in items], pa.string()), WORD_BYTES):
        for i in range(chunk.hi - chunk.lo):
            own = chunk.hashes[chunk.first[i]:chunk.first[i + 1]]
            size = min(window, len(own))
            for k in range(len(own) - size + 1 if size else 0):
                found.setdefault(own[k:k + size].tobytes(), set()).add(chunk.lo + i)
    if not found:
        return None
    keys = sorted(found, key=lambda x: (len(x), x))
    words = np.unique(np.concatenate([np.frombuffer(k, np.uint64) for k in keys]))
    by_length, lengths = [], np.array([len(k) // 8 for k in keys])
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        rows = np.stack([np.frombuffer(keys[i], np.uint64) for i in at])
        by_length.append((np.searchsorted(words, rows) + 1, int(at[0])))
    owners = [sorted(found[k]) for k in keys]
    return Phrases(words, by_length, np.concatenate([np.array(o, np.int64) for o in owners]),
                   np.concatenate([[0], np.cumsum([len(o) for o in owners])]), [x for x, _ in items], int(lengths.min()))


class Shard:
    """Runs of benchmark words of a shard's texts. A window holds no other word, so other words only part the runs."""

    def __init__(self, phrases: Phrases) -> None:
        self.phrases = phrases
        self.symbols: list[np.ndarray] = []
        self.run_row: list[int] = []
        self.run_word: list[int] = []
        self.run_at: list[int] = []
        self.size = 0

    def add(self, row: int, symbols: np.ndarray, word: int) -> None:
        step = RUN_WORDS - WINDOW + 1
        for k in range(0, max(1, len(symbols) - WINDOW + 1), step):
            part = symbols[k:k + RUN_WORDS]
            self.symbols.append(np.append(part, 0))
            self.run_row.append(row)
            self.run_word.append(word + k)
            self.run_at.append(self.size)
            self.size += len(part) + 1

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, first word, words, window) of every occurrence of every window."""
        empty = np.zeros(0, np.int64)
        if not self.size:
            return empty, empty, empty, empty
        index = FMIndex(np.concatenate(self.symbols).astype(np.int64))
        run_at, out = np.array(self.run_at), []
        for patterns, first in self.phrases.by_length:
            low, high = index.ranges(patterns)
            times = high - low
            which = np.repeat(np.arange(len(patterns)), times)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
            places = index.locate(rows)
            run = np.searchsorted(run_at, places, "right") - 1
            out.append((np.array(self.run_row)[run], np.array(self.run_word)[run] + places - run_at[run],
                        np.full(len(run), patterns.shape[1]), which + first))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _found(phrases: Phrases, column: pa.Array) -> tuple[np.ndarray, list[tuple]]:
    """Words of every row, and the hits of all shards of the column."""
    n_words, hits, shard = np.zeros(len(column), np.int64), [], Shard(phrases)
    for chunk in word_chunks(column, WORD_BYTES):
        n_words[chunk.lo:chunk.hi] = np.diff(chunk.first)
        spot = np.minimum(np.searchsorted(phrases.words, chunk.hashes), len(phrases.words) - 1)
        symbols = np.where(phrases.words[spot] == chunk.hashes, spot + 1, 0)
        cut = symbols == 0
        begins = ~cut
        begins[1:] &= cut[:-1]
        row_at = chunk.first[:-1][chunk.first[:-1] < len(symbols)]
        begins[row_at] = ~cut[row_at]
        ends = ~cut
        ends[:-1] &= cut[1:]
        last = chunk.first[1:][chunk.first[1:] > 0] - 1
        ends[last] = ~cut[last]
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        long = ends - begins >= phrases.shortest
        begins, ends = begins[long], ends[long]
        rows = np.searchsorted(chunk.first, begins, "right") - 1
        for begin, end, row in zip(begins.tolist(), ends.tolist(), rows.tolist(), strict=True):
            shard.add(chunk.lo + row, symbols[begin:end], begin - int(chunk.first[row]))
            if shard.size >= SHARD_WORDS:
                hits.append(shard.hits())
                shard = Shard(phrases)
    hits.append(shard.hits())
    return n_words, hits


def merged_spans(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each row in order, those that overlap or touch as one."""
    if not len(row):
        return row, begin, end
    order = np.lexsort((begin, row))
    row, begin, end = row[order], begin[order], end[order]
    reach = np.maximum.accumulate(end + row * np.int64(1 << 40)) - row * np.int64(1 << 40)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (begin[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return row[at], begin[at], reach[np.append(at[1:], len(row)) - 1]


_SPAN = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                       item_text: str = "text", max_pass_bytes: int = MAX_PASS_BYTES, drop: tuple[str, ...] = ()) -> DataFrame:
    """`docs` with n_words, spans and items of every row.

    spans: merged [begin, end) of words inside any occurrence of a benchmark window; items: ids, as text and sorted, of
    items with occurring windows, each once. Null and empty texts have no words; items with a null id give spans but no
    entry in items, ids that occur twice stand for all their texts. Empty tables give no rows or no hits. Columns of `docs` named like the
    new ones are replaced. A benchmark beyond `max_pass_bytes` is searched in several passes over the texts, each with
    a slice of the items that fits, so what is broadcast has a bound.
    """
    known, slices = _sliced(benchmark, item, item_text, max_pass_bytes)
    fields = [("n_words", T.LongType()), ("spans", _SPAN), ("items", T.ArrayType(T.StringType()))]
    out = docs.drop(*[n for n, _ in fields if n != text])
    for k in range(slices):
        phrases = _handed(known, slices, k)
        out = with_arrow_columns(out, fields, _search(phrases, text, k > 0), drop if k == slices - 1 else ())
        if k < slices - 1:
            out = cut_lineage(out)
    return out


def _sliced(benchmark: DataFrame, item: str, item_text: str, max_pass_bytes: int) -> tuple[DataFrame, int]:
    """(id, text) of the items that have a text, and the passes in which they are searched."""
    known = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item).cast("string").alias("id"), F.col(item_text).alias("text"))
    size = known.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    return known, -(-size // max_pass_bytes) or 1


def _handed(known: DataFrame, slices: int, k: int):
    """The phrases of slice k, sent to the tasks."""
    part = known if slices == 1 else known.where(F.pmod(F.xxhash64("id", "text"), F.lit(slices)) == k)
    return known.sparkSession.sparkContext.broadcast(build_phrases([tuple(r) for r in part.collect()]))


def without_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                 max_pass_bytes: int = MAX_PASS_BYTES) -> DataFrame:
    """Rows of `docs` whose text holds no benchmark window, all columns as they are; null and empty texts stay.

    Only texts go to Python and one flag a row comes back. A benchmark of several slices is searched slice by slice in one
    pass over the texts that the slices before have left.
    """
    bound_batches(docs)
    known, slices = _sliced(benchmark, item, item_text, max_pass_bytes)
    for k in range(slices):
        docs = docs.where(~_hit_flag(_handed(known, slices, k))(F.col(text).cast("string")))
    return docs


def _hit_flag(phrases):
    @F.arrow_udf(T.BooleanType())
    def hit(column: pa.Array) -> pa.Array:
        out = np.zeros(len(column), bool)
        if phrases.value is not None:
            for row, *_ in _found(phrases.value, column)[1]:
                out[row] = True
        give_back()
        return pa.array(out)

    return hit


def _search(phrases, text: str, again: bool):
    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        known = phrases.value
        column = batch.column(batch.schema.get_field_index(text))
        rows, begins, ends, item_rows, names = [], [], [], [], []
        if known is None:
            n_words = np.zeros(len(column), np.int64)
            for chunk in word_chunks(column, WORD_BYTES):
                n_words[chunk.lo:chunk.hi] = np.diff(chunk.first)
        else:
            n_words, hits = _found(known, column)
            for row, begin, size, window in hits:
                rows.append(row), begins.append(begin), ends.append(begin + size)
                pairs = np.unique(row * np.int64(1 << 32) + window)
                row, window = pairs >> 32, pairs & 0xFFFFFFFF
                times = known.owner_at[window + 1] - known.owner_at[window]
                which = np.repeat(known.owner_at[window], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                item_rows.append(np.repeat(row, times)), names.append(known.owners[which])
        items: list[set] = [set() for _ in range(len(column))]
        for owner, found in zip(item_rows, names, strict=True):
            for i, k in zip(owner.tolist(), found.tolist(), strict=True):
                if known.items[k] is not None:
                    items[i].add(known.items[k])
        if again:
            earlier = [batch.column(batch.schema.get_field_index(n)) for n in ("spans", "items")]
            for i, (spans, before) in enumerate(zip(earlier[0].to_pylist(), earlier[1].to_pylist(), strict=True)):
                items[i].update(before)
                if spans:
                    rows.append(np.full(len(spans), i)), begins.append(np.array([s["begin"] for s in spans])), ends.append(np.array([s["end"] for s in spans]))
        both = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (rows, begins, ends)]
        row, begin, end = merged_spans(*both)
        at = np.searchsorted(row, np.arange(len(column) + 1)).astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(begin), pa.array(end)], names=["begin", "end"]))
        return [pa.array(n_words), spans, pa.array([sorted(x) for x in items], pa.list_(pa.string()))]

    return make


def hit_words(spans: str = "spans") -> Column:
    """Words inside the spans."""
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])


def without_spans(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """`docs` with the span words cut out of the text, and with them what stands between the words of one span."""
    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        found = batch.column(batch.schema.get_field_index(spans)).to_pylist()
        return [pa.array([cut_words(t, s) for t, s in zip(batch.column(batch.schema.get_field_index(text)).to_pylist(), found, strict=True)], pa.string())]

    return with_arrow_columns(docs, [(text, T.StringType())], make).select(*docs.columns)


def cut_words(text: str | None, spans: list[dict]) -> str | None:
    if not text or not spans:
        return text
    data = text.encode()
    inside = WORD_BYTES[LOWER[np.frombuffer(data, np.uint8)]]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, last = [], 0
    for s in spans:
        out.append(data[last:begins[s["begin"]]])
        last = ends[s["end"] - 1]
    return b"".join([*out, data[last:]]).decode()
