"""Near duplicates by min-max hashing: one permutation gives two signature values, its least and its greatest token.

Tokens are hashes of five-word shingles. Both values agree between two sets with a probability of their Jaccard
similarity, so half the permutations give a signature of full length, and since the two are drawn without replacement
from one order, the share of equal values varies less than that of as many minima. Bands of the signature propose pairs;
the share of equal values and the sizes drop what is far from the threshold; full sets confirm the rest.

In every bucket all documents are paired with one of them, so a bucket gives as many pairs as it has members. Documents of
a bucket that the confirmed links leave in different components are then compared in blocks, so no link is lost that a
bucket holds, and no pair inside a block becomes a row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .components import components
from .jaccard import _block_links
from .shared_tokens import text_sets
from .textbytes import bound_batches, mixed, with_arrow_columns

PERCENT, BAND_ROWS, MISS = 85, 4, 1e-9
#: Standard errors by which the share of equal values may fall below the threshold, and tokens of a block.
ERRORS, BLOCK_TOKENS = 6, 1 << 18


def band_count(percent: int, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    """Bands, an even number, of which two sets at the threshold share none with a probability of `miss` at most."""
    found = math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))
    return found + found % 2


def signatures(tokens: np.ndarray, first: np.ndarray, permutations: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest), each sets x permutations: of set i's tokens, first[i] to first[i + 1], under every permutation."""
    least = np.empty((len(first) - 1, permutations), np.uint64)
    greatest = np.empty_like(least)
    for k in range(permutations):
        order = mixed(tokens, 2_000 + k)
        least[:, k] = np.minimum.reduceat(order, first[:-1])
        greatest[:, k] = np.maximum.reduceat(order, first[:-1])
    return least, greatest


def _band_keys(values: np.ndarray, rows: int, seed: int) -> np.ndarray:
    """One key for each run of `rows` values; the number of the band is part of it."""
    keys = []
    for b in range(values.shape[1] // rows):
        key = np.full(len(values), seed + b, np.uint64)
        for k in range(rows):
            key = mixed(key ^ values[:, b * rows + k], 3)
        keys.append(key)
    return np.stack(keys, axis=1)


def sketched(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, n, mark1, mark2, bands, sketch) of (id, text): the set's size and identity, band keys, values cut to 16 bits."""
    permutations = bands // 2 * rows

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        count = batch.num_rows
        n, marks = np.zeros(count, np.int32), np.zeros((2, count), np.uint64)
        keys, sketches = np.zeros((count, bands), np.uint64), np.zeros((count, 2 * permutations), np.uint16)
        held, at, total = [], [], 0

        def settle():
            tokens, first = np.concatenate(held), np.concatenate([[0], np.cumsum([len(x) for x in held])])
            least, greatest = signatures(tokens, first, permutations)
            n[at] = np.diff(first)
            for k in range(2):
                marks[k, at] = np.add.reduceat(mixed(tokens, 1_000 + k), first[:-1])
            keys[at] = np.hstack([_band_keys(least, rows, 0), _band_keys(greatest, rows, bands)])
            sketches[at] = np.hstack([least, greatest]) & np.uint64(0xFFFF)

        for row, found in text_sets(batch.column(batch.schema.get_field_index("text"))):
            if len(found):
                held.append(found), at.append(row)
                total += len(found)
            if total >= BLOCK_TOKENS:
                settle()
                held, at, total = [], [], 0
        if held:
            settle()
        lists = pa.ListArray.from_arrays(np.arange(count + 1, dtype=np.int32) * bands, keys.reshape(-1).view(np.int64))
        return [pa.array(n), *[pa.array(m.view(np.int64)) for m in marks], lists, pa.array([s.tobytes() for s in sketches], pa.binary())]

    fields = [("n", T.IntegerType()), ("mark1", T.LongType()), ("mark2", T.LongType()), ("bands", T.ArrayType(T.LongType())), ("sketch", T.BinaryType())]
    return with_arrow_columns(docs, fields, make, ("text",))


def _near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow a link and whose signatures agree often enough."""
    sides = [nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in ("a", "b")]
    both = (pairs.join(sides[0], "a").join(sides[1], "b")
            .where(100 * F.least("n_a", "n_b").cast("long") >= percent * F.greatest("n_a", "n_b").cast("long")))

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        left, right = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(f"sketch_{x}")).to_pylist()), np.uint16)
                       .reshape(batch.num_rows, -1) for x in ("a", "b"))
        threshold = percent / 100
        error = math.sqrt(threshold * (1 - threshold) / left.shape[1])
        return [pa.array((left == right).mean(axis=1) >= threshold - ERRORS * error)]

    return with_arrow_columns(both, [("near", T.BooleanType())], make, ("sketch_a", "sketch_b")).where("near").select("a", "b")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, set): the sorted distinct tokens of each of `nodes`, from the whole text of its document of the smallest id."""
    bound_batches(docs)

    def run(batches):
        for batch in batches:
            parts = {"n": [], "mark1": [], "mark2": [], "set": []}
            for _, found in text_sets(batch.column(0)):
                parts["n"].append(len(found))
                for k in range(2):
                    parts[f"mark{k + 1}"].append(np.add.reduce(mixed(found, 1_000 + k)).view(np.int64))
                parts["set"].append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(parts["n"], pa.int32()), pa.array(parts["mark1"], pa.int64()),
                                              pa.array(parts["mark2"], pa.int64()), pa.array(parts["set"], pa.binary())], names=list(parts))

    wanted = nodes.select("node", "n", "mark1", "mark2", "id")
    texts = docs.join(wanted.select("id").distinct(), "id", "left_semi").select("text")
    found = texts.mapInArrow(run, "n int, mark1 long, mark2 long, set binary")
    return found.join(wanted, ["n", "mark1", "mark2"]).select("node", "set").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among the pairs (a, b), by the common tokens of their full sets."""
    both = pairs
    for x in ("a", "b"):
        both = both.join(sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}")), x)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        columns = [batch.column(batch.schema.get_field_index(f"set_{x}")) for x in ("a", "b")]
        linked = []
        for left, right in zip(*columns):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (left, right))
            same = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * same >= percent * (len(x) + len(y) - same))
        return [pa.array(linked, pa.bool_())]

    return with_arrow_columns(both, [("linked", T.BooleanType())], make, ("set_a", "set_b")).where("linked").select("a", "b")


def _block_pairs(left: DataFrame, percent: int, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join components among the documents of `left`, (key, node, n, component), that share a key.

    A document's home is the largest bucket of its own, and a home is dealt into blocks of about BLOCK_TOKENS tokens. Blocks
    that meet in a bucket are compared as wholes, each pair of blocks once.
    """
    members = left.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    homes = (left.join(members, "key").groupBy("node", "n", "component")
             .agg(F.max(F.struct("members", "key")).alias("home")).select("node", "n", "component", F.col("home.key").alias("home")))
    chunks = homes.groupBy("home").agg(F.ceil(F.sum(F.col("n").cast("long")) / BLOCK_TOKENS).alias("chunks"))
    dealt = cut_lineage(homes.join(chunks, "home").select(
        "node", "component", F.struct("home", F.pmod(F.xxhash64("node"), "chunks").alias("chunk")).alias("block")))
    met = left.join(dealt.select("node", "block"), "node").groupBy("key", "block").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"))
    x, y = (met.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("block", "lo", "hi")]) for side in ("x", "y"))
    pairs = (x.join(y, "key").where((F.col("block_x") <= F.col("block_y")) & (F.least("lo_x", "lo_y") != F.greatest("hi_x", "hi_y")))
             .select("block_x", "block_y").distinct())
    content = dealt.join(sets, "node").groupBy("block").agg(F.collect_list(F.struct(F.col("node").alias("id"), "component", "set")).alias("held"))
    both = (pairs.join(content.select(F.col("block").alias("block_x"), F.col("held").alias("x")), "block_x")
            .join(content.select(F.col("block").alias("block_y"), F.col("held").alias("y")), "block_y")
            .select((F.col("block_x") == F.col("block_y")).alias("same"), "x", "y"))
    bound_batches(both)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, a, b = _block_links(batch.column(1)[i].values, None if batch.column(0)[i].as_py() else batch.column(2)[i].values, percent)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a, pa.int64())), ids.take(pa.array(b, pa.int64()))], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT, rows: int = BAND_ROWS,
                miss: float = MISS) -> DataFrame:
    """(key, n_shingles, component_id, kept), one row per row of `docs`.

    n_shingles: size of the set of five-word shingles; shorter texts are one shingle, null and blank texts have none and
    stay alone. component_id: the smallest key that links of at least `percent` reach; a link at the threshold is missed
    with a probability of `miss` at most. kept: the row's key is its component's. Rows of equal sets, so repeated rows and
    exact copies too, are one node; of rows that share a key each is judged by its own text. A null key has a null component,
    is not kept and links nothing. An empty table gives no rows; other columns of `docs` play no part.
    """
    narrow = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    bands = band_count(percent, rows, miss)
    named = cut_lineage(sketched(narrow, bands, rows))
    nodes = cut_lineage(named.where("n > 0 AND id IS NOT NULL").groupBy("n", "mark1", "mark2")
                        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
                        .withColumn("node", F.monotonically_increasing_id()))
    buckets = nodes.select("node", "copies", F.explode("bands").alias("key"))
    pivots = (buckets.groupBy("key").agg(F.max(F.struct("copies", (-F.col("node")).alias("place"))).alias("pivot"), F.count(F.lit(1)).alias("members"))
              .where("members > 1").select("key", "members", (-F.col("pivot.place")).alias("pivot")))
    held = cut_lineage(buckets.join(pivots, "key").where("node <> pivot").select("key", "node", "pivot", "members"))
    pairs = cut_lineage(_near(held.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), nodes, percent))
    # What a bucket's members have not been compared with is each other, which takes three.
    some = held.where("members > 2").select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    sets = cut_lineage(_sets(narrow, nodes.join(some, "node", "left_semi")))
    links = cut_lineage(_confirmed(pairs, sets, percent))
    reached = components(links)
    left = (held.where("members > 2").select("key", "node").join(nodes.select("node", "n"), "node").join(reached, "node", "left")
            .select("key", "node", "n", F.coalesce("component", "node").alias("component")))
    open_keys = left.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    more = _block_pairs(cut_lineage(left.join(open_keys, "key")), percent, sets)
    reached = components(links.union(more))
    whole = nodes.join(reached, "node", "left").select("n", "mark1", "mark2", "id", F.coalesce("component", "node").alias("component"))
    least = whole.groupBy("component").agg(F.min("id").alias("least"))
    classes = whole.join(least, "component").select("n", "mark1", "mark2", "least")
    component = F.when(F.col("id").isNotNull(), F.coalesce("least", "id"))
    return (named.select("id", "n", "mark1", "mark2").join(classes, ["n", "mark1", "mark2"], "left")
            .select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False))))
