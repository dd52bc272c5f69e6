"""Exact top-k inner products: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors are rotated onto the eigenvectors of the sum of their outer products, so the first coordinates carry most of
an inner product; the rest is at most the product of the lengths of what remains. Candidates are dealt by descending
length into groups of blocks. A first pass over the block of the longest vectors gives each query a score that its
result reaches at least; blocks, then pairs, whose bound is below it are skipped, and what is left is counted exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .textbytes import bound_batches

BLOCK, QUERY_BLOCK, GROUP, SCALE = 1_024, 512, 16_384, 1_024
#: Coordinates of the two partial sums, as a share of all.
PARTIAL = (0.25, 0.5)
_PARTS = 64
_LOWEST = -(2**63)


def integer_vectors(column: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors): floor(scale * x) of the rows that are not null and hold finite numbers only.

    Shorter vectors of a batch are filled with zeros; components stay inside the range of a long.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = column.flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64) if len(flat) else np.zeros(0)
    width = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(sizes), width))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out[owner, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    rows = np.flatnonzero(np.isfinite(out).all(axis=1) & np.asarray(column.is_valid()))
    return rows, np.clip(np.floor(out[rows] * scale), -(2.0**62), 2.0**62).astype(np.int64)


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))


def _packed(vectors: np.ndarray) -> list[bytes]:
    small = len(vectors) == 0 or np.abs(vectors).max() < 2**31
    return [v.tobytes() for v in (vectors.astype(np.int32) if small else vectors)]


def _unpacked(column: pa.Array, wide: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i in range(len(column)):
        v = np.frombuffer(column[i].as_buffer(), np.int64 if wide[i].as_py() else np.int32)
        out[i, :len(v)] = v
    return out


def _cleaned(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, length, width, wide, vector) of the rows that take part."""
    bound_batches(df)

    def run(batches):
        for batch in batches:
            rows, found = integer_vectors(batch.column(1))
            wide = np.abs(found).max(initial=0) >= 2**31
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(_lengths(found)),
                                              pa.array(np.full(len(rows), found.shape[1], np.int32)), pa.array(np.full(len(rows), wide)),
                                              pa.array(_packed(found), pa.binary())], names=["id", "length", "width", "wide", "vector"])

    return df.select(F.col(key).cast("long"), vector).mapInArrow(run, "id long, length double, width int, wide boolean, vector binary")


def _rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Eigenvectors, largest first, of the summed outer products: width x width numbers from each of _PARTS tasks."""
    if not width:
        return np.zeros((0, 0))

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = _unpacked(batch.column(0), batch.column(1), width).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    parts = rows.select("vector", "wide").coalesce(_PARTS).mapInArrow(run, "total binary").toLocalIterator()
    total = sum((np.frombuffer(r[0]).reshape(width, width) for r in parts), np.zeros((width, width)))
    return np.linalg.eigh(total / max(1.0, np.abs(total).max(initial=0)))[1][:, ::-1].copy()


def _blocks(rows: DataFrame, width: int, size: int) -> DataFrame:
    """(part, block, most, ids, vectors): blocks of a partition's rows in their order; most: the greatest length."""
    def run(batches):
        ids, vectors, part, block = [], [], None, 0

        def out(n):
            nonlocal block
            own, found = np.concatenate(ids), np.concatenate(vectors)
            block += 1
            ids[:], vectors[:] = [own[n:]], [found[n:]]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([_lengths(found[:n]).max()]),
                                               pa.array([own[:n].tobytes()], pa.binary()), pa.array([found[:n].tobytes()], pa.binary())],
                                              names=["part", "block", "most", "ids", "vectors"])

        for batch in batches:
            if batch.num_rows:
                part = batch.column(0)[0].as_py()
                ids.append(np.asarray(batch.column(1)))
                vectors.append(_unpacked(batch.column(2), batch.column(3), width))
                while sum(map(len, ids)) >= size:
                    yield out(size)
        if sum(map(len, ids)):
            yield out(size)

    numbered = rows.select(F.spark_partition_id().alias("part"), "id", "vector", "wide")
    return numbered.mapInArrow(run, "part int, block int, most double, ids binary, vectors binary")


class QueryBlock:
    """Queries of one block with the best rows found so far: scores and ids of at most k rows each."""

    def __init__(self, ids: bytes, vectors: bytes, floor: bytes | None, rotation: np.ndarray, k: int) -> None:
        self.ids = np.frombuffer(ids, np.int64)
        self.vectors = np.frombuffer(vectors, np.int64).reshape(len(self.ids), -1)
        self.floor = np.frombuffer(floor, np.float64).copy() if floor is not None else np.full(len(self.ids), -np.inf)
        self.turned = self.vectors @ rotation
        self.rotation, self.k = rotation, k
        self.lengths = _lengths(self.vectors)
        self.query, self.score, self.found = (np.zeros(0, np.int64) for _ in range(3))

    def search(self, ids: bytes, vectors: bytes) -> None:
        own = np.frombuffer(ids, np.int64)
        rows = np.frombuffer(vectors, np.int64).reshape(len(own), -1)
        lengths = _lengths(rows)
        slack = 1e-9 * self.lengths * lengths.max() + 1e-3
        live = np.flatnonzero(self.lengths * lengths.max() + slack >= self.floor)
        if not len(live):
            return
        turned, width = rows @ self.rotation, rows.shape[1]
        cuts = [max(1, int(width * share)) for share in PARTIAL] if width else []
        least = (self.floor - slack)[live]
        at = max([0, *cuts[:1]])
        head, rest = self.turned[live, :at], _lengths(self.turned[live, at:])
        bound = head @ turned[:, :at].T + rest[:, None] * _lengths(turned[:, at:])[None, :]
        a, b = np.nonzero(bound >= least[:, None])
        for at in cuts[1:]:
            rest_q, rest_r = _lengths(self.turned[live, at:]), _lengths(turned[:, at:])
            bound = self.turned[live, :at] @ turned[:, :at].T
            keep = bound[a, b] + rest_q[a] * rest_r[b] >= least[a]
            a, b = a[keep], b[keep]
        q = live[a]
        keep = self.ids[q] != own[b]
        q, b = q[keep], b[keep]
        self._take(q, own[b], exact_scores(self.vectors, rows, q, b))

    def _take(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        query, ids, scores = np.concatenate([self.query, query]), np.concatenate([self.found, ids]), np.concatenate([self.score, scores])
        order = np.lexsort((ids, ~scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        full = place == self.k - 1
        self.floor[query[full]] = np.maximum(self.floor[query[full]], scores[full].astype(np.float64))
        keep = place < self.k
        self.query, self.found, self.score = query[keep], ids[keep], scores[keep]


def exact_scores(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs; beyond the range of a long, its ends."""
    most = np.abs(queries).max(initial=0).astype(np.float64) * np.abs(rows).max(initial=0).astype(np.float64) * max(1, rows.shape[1])
    if most < 2.0**62:
        if len(q) * 4 > len(queries) * len(rows) and most < 2.0**52:
            return (queries.astype(np.float64) @ rows.astype(np.float64).T)[q, r].astype(np.int64)
        out = np.zeros(len(q), np.int64)
        for i in range(0, len(q), 1 << 14):
            out[i:i + (1 << 14)] = np.einsum("ij,ij->i", queries[q[i:i + (1 << 14)]], rows[r[i:i + (1 << 14)]])
        return out
    exact = ((queries[i].astype(object) * rows[j].astype(object)).sum() for i, j in zip(q, r, strict=True))
    return np.array([min(max(int(x), _LOWEST), 2**63 - 1) for x in exact], np.int64)


def top_inner_products(df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the highest inner products for each row where `queries` holds.

    Scores are integers (components become floor(1024 x)); ties go to the smaller key; fewer rows give all. Rows of the
    query's own key are no candidates. Vectors that are null or hold null, NaN or infinite components, and rows with a
    null key, take no part; shorter vectors count as filled up with zeros. A repeated row is a candidate, and a query,
    as often as it occurs. An empty table gives no rows.
    """
    clean = cut_lineage(_cleaned(df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(vector).alias("_vector"), queries.alias("_asks")), "_key", "_vector"))
    stats = clean.agg(F.max("width").alias("width"), F.count("*").alias("n")).first()
    width, groups = stats["width"] or 0, max(1, -(-stats["n"] // GROUP))
    asks = df.where(queries & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id")).distinct()
    spark = df.sparkSession
    rotation = spark.sparkContext.broadcast(_rotation(clean, width))
    ordered = clean.repartitionByRange(groups, F.desc("length"), F.asc("id")).sortWithinPartitions(F.desc("length"), F.asc("id"))
    candidates = cut_lineage(_blocks(ordered, width, BLOCK))
    asking = clean.join(asks, "id", "left_semi")
    parts = max(1, -(-asking.count() // QUERY_BLOCK))
    asked = cut_lineage(_blocks(asking.repartitionByRange(parts, F.desc("length"), F.asc("id")).sortWithinPartitions(F.desc("length"), F.asc("id")),
                                width, QUERY_BLOCK))
    head = candidates.orderBy(F.desc("most"), "part", "block").limit(1).select(F.col("ids").alias("c_ids"), F.col("vectors").alias("c_vectors"))

    def first_pass(batches):
        for batch in batches:
            floors = []
            for ids, vectors, c_ids, c_vectors in zip(*[batch.column(c).to_pylist() for c in ("ids", "vectors", "c_ids", "c_vectors")], strict=True):
                block = QueryBlock(ids, vectors, None, rotation.value, k)
                block.search(c_ids, c_vectors)
                floors.append(block.floor.tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("part", "block", "ids", "vectors")], pa.array(floors, pa.binary())],
                                             names=["part", "block", "ids", "vectors", "floor"])

    # One block of at most BLOCK vectors is sent to the query blocks.
    floored = cut_lineage(asked.crossJoin(F.broadcast(head)).select("part", "block", "ids", "vectors", "c_ids", "c_vectors").mapInArrow(
        first_pass, "part int, block int, ids binary, vectors binary, floor binary"))
    spread = floored.select(F.col("part").alias("q_part"), F.col("block").alias("q_block"), "ids", "vectors", "floor",
                            F.explode(F.sequence(F.lit(0), F.lit(max(0, candidates.agg(F.max("part")).first()[0] or 0)))).alias("part"))
    met = spread.join(candidates.select("part", "most", F.col("block").alias("c_block"), F.col("ids").alias("c_ids"), F.col("vectors").alias("c_vectors")), "part")

    def second_pass(batches):
        held: dict[tuple[int, int], QueryBlock] = {}
        for batch in batches:
            names = ("q_part", "q_block", "ids", "vectors", "floor", "c_ids", "c_vectors")
            for q_part, q_block, ids, vectors, floor, c_ids, c_vectors in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if (q_part, q_block) not in held:
                    held[q_part, q_block] = QueryBlock(ids, vectors, floor, rotation.value, k)
                held[q_part, q_block].search(c_ids, c_vectors)
        for (q_part, q_block), b in held.items():
            n = len(b.query)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, q_part, np.int32)), pa.array(np.full(n, q_block, np.int32)), pa.array(b.query),
                                              pa.array(b.ids[b.query]), pa.array(b.found), pa.array(b.score)],
                                             names=["q_part", "q_block", "place", "query_id", "vec_id", "score"])

    found = (met.select("q_part", "q_block", "ids", "vectors", "floor", "c_ids", "c_vectors")
             .mapInArrow(second_pass, "q_part int, q_block int, place long, query_id long, vec_id long, score long"))
    return _best(found, k)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q_part", "q_block", "place").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
