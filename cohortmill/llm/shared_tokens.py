"""How many tokens of each set occur in another set too, counted over the whole corpus with a few bytes a token.

A task cuts its documents into cells. A cell sends each of its tokens once, as 48 bits of its hash: sorted, as
differences, byte planes and compressed, one blob for each stretch of hashes. Tokens that two sets of the cell hold are
known to be shared; the others carry their owner's number in the cell. Whoever gathers a stretch answers with the owners
of tokens that another cell sent too. Truncated hashes may take a token for shared that is not, never the reverse.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import SOLID_BYTES, bound_batches, give_back, mixed, shingles, word_chunks

CELL_TOKENS, CELL_ROWS, TOKEN_BITS, STRETCH_BYTES = 1 << 20, 60_000, 48, 8 << 20
_NOBODY = 0xFFFF


def text_sets(column: pa.Array):
    """(row, sorted distinct tokens) of every text, in order."""
    for chunk in word_chunks(column, SOLID_BYTES):
        for i in range(chunk.hi - chunk.lo):
            found = np.sort(shingles(chunk.hashes[chunk.first[i]:chunk.first[i + 1]]))
            if len(found) > 1:
                found = found[np.append(True, found[1:] != found[:-1])]
            yield chunk.lo + i, found


def packed(tokens: np.ndarray, owners: np.ndarray) -> bytes:
    """Sorted tokens and their owners' numbers in a compressed blob; its first four bytes are the count."""
    steps = np.diff(tokens, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T[:6]
    planes = np.ascontiguousarray(np.vstack([steps, owners.astype("<u2").view(np.uint8).reshape(-1, 2).T]))
    return len(tokens).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    planes = np.frombuffer(pa.decompress(blob[4:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :6] = planes[:6].T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64), np.ascontiguousarray(planes[6:].T).view("<u2").ravel()


class Cell:
    """Sets of neighbouring rows; a set that the cell has already is not taken again."""

    def __init__(self) -> None:
        self.sets: list[np.ndarray] = []
        self.n: list[int] = []
        self.marks: list[tuple[int, int]] = []
        self.seen: set[tuple[int, int]] = set()
        self.size = 0

    def add(self, tokens: np.ndarray) -> None:
        mark = (int(tokens.sum()), int(mixed(tokens, 9).sum()))
        again = mark in self.seen
        self.seen.add(mark)
        self.n.append(len(tokens))
        self.marks.append(mark)
        self.sets.append(tokens[:0] if again else tokens)
        self.size += len(self.sets[-1])

    def closed(self, bits: int) -> tuple[np.ndarray, list[bytes]]:
        """(shared tokens of each row that the cell knows by itself, one blob per stretch)."""
        tokens = np.concatenate([*self.sets, np.zeros(0, np.uint64)]) >> np.uint64(64 - TOKEN_BITS)
        owner = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[1:] != tokens[:-1]
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(tokens)))
        known = np.bincount(owner[np.repeat(times > 1, times)], minlength=len(self.sets))
        tokens, owner = tokens[at], np.where(times > 1, _NOBODY, owner[at])
        shift = np.uint64(TOKEN_BITS - bits)
        edges = np.searchsorted(tokens, np.arange(1 << bits, dtype=np.uint64) << shift)
        cuts = zip(edges, np.append(edges[1:], len(tokens)), strict=True)
        low = tokens & np.uint64((1 << int(shift)) - 1)
        return known, [packed(low[a:b], owner[a:b]) if b > a else b"" for a, b in cuts]


def shared_counts(docs: DataFrame) -> DataFrame:
    """(id, n, mark1, mark2, shared) of every row of `docs` (id, text).

    n: distinct shingles; the marks name the set; shared: how many of the shingles some other document's set holds, or
    a little more. Among equal sets of one cell only the first has a count. Reads the texts twice: for their bytes,
    which give the number of stretches, and for the sets. `docs` should be a table or checkpoint: its rows must come in
    one order if a task runs again.
    """
    bound_batches(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, math.ceil(math.log2(max(1, size / STRETCH_BYTES))))
    kind = docs.schema["id"].dataType
    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    info = [T.StructField("ids", T.ArrayType(kind)), T.StructField("n", ints), T.StructField("mark1", longs),
            T.StructField("mark2", longs), T.StructField("known", ints)]
    sent = T.StructType([T.StructField("stretch", T.IntegerType()), T.StructField("cell", T.LongType()), *info, T.StructField("blob", T.BinaryType())])
    answered = T.StructType([T.StructField("cell", T.LongType()), *info, T.StructField("owners", T.BinaryType())])

    def nothing(n: int, id_type: pa.DataType) -> list[pa.Array]:
        kinds = [pa.list_(id_type), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        return [pa.nulls(n, k) for k in kinds]

    def cells(batches):
        number = TaskContext.get().partitionId() << 32

        def close(cell: Cell, ids: pa.Array) -> pa.RecordBatch:
            nonlocal number
            number += 1
            known, blobs = cell.closed(bits)
            marks = np.array(cell.marks, np.uint64).reshape(-1, 2).view(np.int64)
            at = pa.array([0, len(ids)], pa.int32())
            own = [pa.ListArray.from_arrays(at, x) for x in (ids, pa.array(cell.n, pa.int32()), pa.array(marks[:, 0]), pa.array(marks[:, 1]),
                                                             pa.array(known, pa.int32()))]
            full = [i for i, b in enumerate(blobs) if b]
            columns = [pa.concat_arrays([a, b]) for a, b in zip(own, nothing(len(full), ids.type), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([number % (1 << bits), *full], pa.int32()), pa.array([number] * (1 + len(full)), pa.int64()),
                                               *columns, pa.array([None, *[blobs[i] for i in full]], pa.binary())], names=sent.names)

        for batch in batches:
            cell, lo = Cell(), 0
            for row, tokens in text_sets(batch.column(1)):
                cell.add(tokens)
                if cell.size >= CELL_TOKENS or len(cell.n) >= CELL_ROWS:
                    yield close(cell, batch.column(0).slice(lo, row + 1 - lo))
                    cell, lo = Cell(), row + 1
            if cell.n:
                yield close(cell, batch.column(0).slice(lo))
        give_back()

    def answer(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        told = table.filter(pa.compute.is_valid(table["ids"]))
        rest = table.filter(pa.compute.is_valid(table["blob"]))
        numbers = np.asarray(rest["cell"])
        parts = [unpacked(b.as_buffer().to_pybytes()) for b in (x for chunk in rest["blob"].chunks for x in chunk)]
        tokens = np.concatenate([*[p[0] for p in parts], np.zeros(0, np.uint64)])
        owners = np.concatenate([*[p[1] for p in parts], np.zeros(0, np.uint16)])
        sizes = [len(p[0]) for p in parts]
        del parts
        order = np.argsort(tokens)
        tokens = tokens[order]
        same = np.zeros(len(tokens) + 1, bool)
        same[1:-1] = tokens[1:] == tokens[:-1]
        shared = np.zeros(len(tokens), bool)
        shared[order] = same[1:] | same[:-1]
        shared &= owners != _NOBODY
        out = [owners[a - n:a][shared[a - n:a]].tobytes() for n, a in zip(sizes, np.cumsum(sizes, dtype=int), strict=True)]
        kinds = table.schema.field("ids").type.value_type
        columns = [pa.concat_arrays([*told[c].chunks, empty]) for c, empty in zip(answered.names[1:-1], nothing(len(out), kinds), strict=True)]
        return pa.Table.from_arrays([pa.concat_arrays([*told["cell"].chunks, pa.array(numbers, pa.int64())]), *columns,
                                     pa.array([None] * len(told) + out, pa.binary())], names=answered.names)

    def gathered(table: pa.Table) -> pa.Table:
        told = table.filter(pa.compute.is_valid(table["ids"])).slice(0, 1).combine_chunks()
        known = np.asarray(told["known"].combine_chunks().flatten()).astype(np.int64)
        for blob in table["owners"].drop_null():
            known += np.bincount(np.frombuffer(blob.as_buffer(), np.uint16), minlength=len(known))
        return pa.Table.from_arrays([*[told[c].combine_chunks().flatten() for c in ("ids", "n", "mark1", "mark2")], pa.array(known, pa.int32())],
                                    names=["id", "n", "mark1", "mark2", "shared"])

    out = T.StructType([T.StructField("id", kind), T.StructField("n", T.IntegerType()), T.StructField("mark1", T.LongType()),
                        T.StructField("mark2", T.LongType()), T.StructField("shared", T.IntegerType())])
    return (docs.select("id", "text").mapInArrow(cells, sent).groupBy("stretch").applyInArrow(answer, answered)
            .groupBy("cell").applyInArrow(gathered, out))
