"""N-gram Jaccard join: pairs must share prefix tokens under several global orders before they are verified.

Tokens are hashes of five-word shingles. Two sets of Jaccard similarity t or more share a token among the first
n - ceil(t n) + 1 tokens of each, under any global order. Three orders are used: by a frequency class of the token
(rare first), then by one of three hashes. A link needs t n common tokens, so documents of which fewer tokens occur
elsewhere leave first; of the others, those without a shared prefix token under any of the orders.

Links are found by pivots: in every token's list all documents are paired with one of them, so a group of copies gives as
many pairs as it has members. What the links found so far leave in different components is compared block by block. So the
components are exact, while pairs inside a component are never enumerated.

A corpus may consist of near copies, whose prefix tokens and sets take several times the disk of its texts. So sets are
made from the texts where they are needed and not kept, one order's prefixes are on disk at a time, and what is shuffled
goes in passes of a bounded share of the corpus, each of which is over and cleared away before the next.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, freed
from .components import components
from .shared_tokens import shared_counts, text_sets
from .textbytes import bound_batches, give_back, mixed

PERCENT, ORDERS = 80, 3
#: Largest bit table of document ids that is broadcast, as a power of two of bits; tasks that sum one.
MAX_FILTER_BITS, _PARTS = 29, 16
#: Tokens counted in a task, reported by a task, and kept in the broadcast table of frequent tokens.
TASK_TOKENS, TASK_REPORT, MAX_FREQUENT = 1 << 20, 1 << 16, 1 << 20
_CLASS_STEPS = 4
#: Tokens of a block of documents that is compared with another as a whole.
BLOCK_TOKENS = 1 << 18
#: Tokens that a pass moves, as shares of the corpus' tokens: prefix tokens, tokens of texts, tokens of blocks. No pass is
#: made for less than LEAST_PASS tokens.
PREFIX_SHARE, TEXT_SHARE, BLOCK_SHARE, LEAST_PASS = 0.05, 0.4, 0.2, 1 << 22
#: Documents that are compared with one pivot in one place.
PIVOT_MEMBERS = 256


def prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1 if n else 0


def _token_reports(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(token, times) of tokens that a task saw in two sets or more; it drops the rarest where its table is full."""
    def run(sets):
        tokens, times, pending = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def merge():
            new, n = np.unique(np.concatenate(pending), return_counts=True)
            both = np.concatenate([tokens, new])
            order = np.argsort(both, kind="stable")
            both, counts = both[order], np.concatenate([times, n])[order]
            at = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
            kept, sums = both[at], np.add.reduceat(counts, at)
            if len(kept) > TASK_TOKENS:
                often = np.sort(np.argpartition(-sums, TASK_TOKENS // 2)[:TASK_TOKENS // 2])
                kept, sums = kept[often], sums[often]
            return kept, sums

        for _, found in sets:
            pending.extend(found)
            if sum(map(len, pending)) >= TASK_TOKENS // 2:
                tokens, times = merge()
                pending = []
        if pending:
            tokens, times = merge()
        often = np.flatnonzero(times >= 2)
        if len(often) > TASK_REPORT:
            often = often[np.argpartition(-times[often], TASK_REPORT)[:TASK_REPORT]]
        yield pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(times[often])], names=["token", "times"])

    return _from_sets(docs, ids, run, "token long, times long")


@dataclass
class TokenOrder:
    """Frequent tokens, sorted, and their frequency class; all other tokens are of class 0 and come first."""

    tokens: np.ndarray
    classes: np.ndarray
    near: np.ndarray

    def classes_of(self, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros(len(tokens), np.uint8)
        if len(self.tokens):
            maybe = np.flatnonzero(self.near[tokens >> np.uint64(40)])
            at = np.minimum(np.searchsorted(self.tokens, tokens[maybe]), len(self.tokens) - 1)
            same = self.tokens[at] == tokens[maybe]
            out[maybe[same]] = self.classes[at[same]]
        return out

    def prefix(self, tokens: np.ndarray, order: int, percent: int) -> np.ndarray:
        """Places in `tokens` of its prefix under this order."""
        size = prefix_length(len(tokens), percent)
        rank = (self.classes_of(tokens).astype(np.uint64) << np.uint64(56)) | (mixed(tokens, 100 + order) >> np.uint64(8))
        return np.argpartition(rank, size - 1)[:size] if size < len(tokens) else np.arange(len(tokens))


def token_order(reports: DataFrame, most: int = MAX_FREQUENT) -> TokenOrder:
    """The order's table from the tasks' reports: the frequent tokens down to the class at which `most` is kept."""
    counted = cut_lineage(reports.groupBy("token").agg(F.sum("times").alias("times"))
                          .withColumn("class", F.least(F.lit(250), F.floor(F.log2(F.col("times")) * _CLASS_STEPS)).cast("int")))
    held, lowest = 0, 251
    for r in sorted(counted.groupBy("class").count().collect(), key=lambda r: -r["class"]):
        held += r["count"]
        if held > most:
            break
        lowest = r["class"]
    found = counted.where(F.col("class") >= lowest).select("token", "class").toPandas()
    tokens = found["token"].to_numpy(np.int64).view(np.uint64)
    at = np.argsort(tokens)
    near = np.zeros(1 << 24, bool)
    near[tokens >> np.uint64(40)] = True
    return TokenOrder(tokens[at], found["class"].to_numpy(np.uint8)[at], near)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(at, np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64))


def _passes(tokens: int, total: int, share: float) -> int:
    """Passes in which so many tokens are moved in a corpus of `total`; in proportion to both, so as many at any size."""
    return max(1, min(math.ceil(tokens / (share * total)), math.ceil(tokens / LEAST_PASS))) if tokens else 1


def _of_pass(hashed: str | Column, passes: int, k: int) -> Column:
    return F.pmod(hashed, F.lit(passes)) == k


def _prefixes(docs: DataFrame, ids: DataFrame, order, percent: int, k: int) -> DataFrame:
    """(id, n, rare, known): prefix tokens of every set under order k.

    Those of no known frequency stand apart from those that several sets hold for sure.
    """
    def run(sets):
        for own, found in sets:
            rare, known = [], []
            for tokens in found:
                first = tokens[order.value.prefix(tokens, k, percent)]
                often = order.value.classes_of(first) > 0
                rare.append(first[~often]), known.append(first[often])
            yield pa.RecordBatch.from_arrays([own, pa.array([len(t) for t in found], pa.int32()), _lists(rare), _lists(known)], names=["id", "n", "rare", "known"])

    lists = T.ArrayType(T.LongType())
    return _from_sets(docs, ids, run, T.StructType([docs.schema["id"], T.StructField("n", T.IntegerType()), T.StructField("rare", lists), T.StructField("known", lists)]))


def _likely_ids(ids: DataFrame) -> np.ndarray:
    """A bit table of 16 bits an id, at most MAX_FILTER_BITS: two bits are set for every id's hash."""
    size = 1 << min(MAX_FILTER_BITS, max(16, (16 * ids.count()).bit_length()))

    def run(batches):
        table = np.zeros(size, bool)
        for batch in batches:
            for x in _bits(np.asarray(batch.column(0)), size):
                table[x] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(table).tobytes()], pa.binary())], names=["bits"])

    parts = ids.select(F.xxhash64("id").alias("h")).coalesce(_PARTS).mapInArrow(run, "bits binary").toLocalIterator()
    out = np.zeros(size // 8, np.uint8)
    for r in parts:
        out |= np.frombuffer(r[0], np.uint8)
    return out


def _bits(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    h = hashes.view(np.uint64)
    return (h % np.uint64(size)).astype(np.int64), ((h >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(size)).astype(np.int64)


def _likely(hashes: pa.Array, bits: np.ndarray) -> pa.Array:
    a, b = _bits(np.asarray(hashes), 8 * len(bits))
    there = (bits[a >> 3] >> (7 - (a & 7)).astype(np.uint8)) & (bits[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1
    return pa.array(there == 1)


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is in `ids`, and a few others: a bit table of bounded size spares the rest of the texts the way."""
    bits = docs.sparkSession.sparkContext.broadcast(_likely_ids(ids))
    bound_batches(docs)

    @F.arrow_udf(T.BooleanType())
    def likely(hashes: pa.Array) -> pa.Array:
        return _likely(hashes, bits.value)

    return docs.where("id IS NOT NULL").where(likely(F.xxhash64("id")))


def _from_sets(docs: DataFrame, ids: DataFrame, run, schema: T.StructType | str) -> DataFrame:
    """What `run` makes of (ids, sets), batch by batch, of the documents with words whose id is in `ids`, and of a few others."""
    bits = docs.sparkSession.sparkContext.broadcast(_likely_ids(ids))
    bound_batches(docs)

    def sets(batches):
        for batch in batches:
            batch = batch.filter(_likely(batch.column(2), bits.value))
            found = [tokens for _, tokens in text_sets(batch.column(1))] if batch.num_rows else []
            if any(map(len, found)):
                yield batch.column(0).filter(pa.array([len(t) > 0 for t in found])), [t for t in found if len(t)]

    def handed(batches):
        try:
            yield from run(sets(batches))
        finally:
            give_back()

    return docs.where("id IS NOT NULL").select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(handed, schema)


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set) of the documents with words whose id is in `ids`, and of a few others; made anew by every reader."""
    def run(sets):
        for own, found in sets:
            yield pa.RecordBatch.from_arrays([own, pa.array([t.tobytes() for t in found], pa.binary())], names=["id", "set"])

    return _from_sets(docs, ids, run, T.StructType([docs.schema["id"], T.StructField("set", T.BinaryType())]))


def _shared(prefixes: DataFrame, passes: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Two frames (id, t), of pass k: of each id's prefix tokens those not known that another id has too, and the known ones."""
    token = prefixes.select("id", F.explode("rare").alias("token"))
    known = prefixes.select("id", F.col("known").alias("t"))
    if passes > 1:
        token = token.where(_of_pass("token", passes, k))
        known = known.select("id", F.filter("t", lambda x: _of_pass(x, passes, k)).alias("t"))
    rare = (token.withColumn("held", F.count("*").over(Window.partitionBy("token"))).where("held > 1")
            .groupBy("id").agg(F.collect_list("token").alias("t")))
    return rare, known.where(F.size("t") > 0)


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    x, y = (x, y) if len(x) < len(y) else (y, x)
    same = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)) if len(x) else 0
    return same > 0 and 100 * same >= percent * (len(x) + len(y) - same)


def _common(pairs: DataFrame, docs: DataFrame, sizes: DataFrame, total: int, percent: int) -> DataFrame:
    """The links (a, b) among the pairs (pivot, member): exact counts of the sets' common tokens.

    Texts go to their pivots, and a pivot's own to every PIVOT_MEMBERS of its members; a pivot's set is made and held
    while its members pass by.
    """
    spark = docs.sparkSession
    places = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / PIVOT_MEMBERS).alias("places"))
    members = pairs.join(places, "pivot").select(F.col("member").alias("id"), "pivot", F.pmod(F.xxhash64("member"), "places").alias("place"), F.lit(1).alias("turn"))
    pivots = places.select(F.col("pivot").alias("id"), "pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("places") - 1)).alias("place"), F.lit(0).alias("turn"))
    way = cut_lineage(members.union(pivots))
    passes = _passes(way.join(sizes.groupBy("id").agg(F.max("n").alias("n")), "id").agg(F.sum("n")).first()[0], total, TEXT_SHARE)
    kind = docs.schema["id"].dataType

    def run(batches):
        key, held = None, []
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            turns, linked = np.asarray(batch.column(2)), []
            for row, tokens in text_sets(batch.column(4)):
                if keys[row] != key:
                    key, held = keys[row], []
                if not turns[row]:
                    held.append(tokens)
                elif any(_linked(x, tokens, percent) for x in held):
                    linked.append(row)
            at = pa.array(linked, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(3).take(at)], names=["a", "b"])
        held.clear()
        give_back()

    found = []
    for k in range(passes):
        some = way.where(_of_pass(F.xxhash64("pivot", "place"), passes, k))
        met = _texts_of(docs, some.select("id").distinct()).join(some, "id").select("pivot", "place", "turn", "id", "text")
        found.append(cut_lineage(met.repartition("pivot", "place").sortWithinPartitions("pivot", "place", "turn")
                                 .mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))))
        del met
        freed(spark)
    return reduce(DataFrame.union, found)


def _near(percent: int, x: str, y: str) -> Column:
    """Whether the sizes allow a link: the common tokens are among those of each set that occur elsewhere."""
    common = F.least(f"n_{x}", f"n_{y}", f"shared_{x}", f"shared_{y}").cast("long")
    return 100 * common >= percent * (F.col(f"n_{x}") + F.col(f"n_{y}") - common)


def _pairs(rows: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(pivot, member) of every token's list in `rows`, (id, share, t), whose sizes allow a link.

    The pivot of a list is the document with the largest share of tokens that occur elsewhere, which is the nearest to
    what the others were copied from.
    """
    rows = rows.select("id", "share", F.explode("t").alias("token"))
    pivots = rows.groupBy("token").agg(F.max(F.struct("share", "id")).alias("pivot")).select("token", F.col("pivot.id").alias("pivot"))
    pairs = rows.join(pivots, "token").where(F.col("id") != F.col("pivot")).select("pivot", F.col("id").alias("member")).distinct()
    for x in ("pivot", "member"):
        pairs = pairs.join(sizes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("shared").alias(f"shared_{x}")), x)
    return pairs.where(_near(percent, "pivot", "member")).select("pivot", "member").distinct()


def _all_of(passes: list[DataFrame]) -> DataFrame:
    """The rows of all passes, each once; those of a single one are so already."""
    return passes[0] if len(passes) == 1 else cut_lineage(reduce(DataFrame.union, passes).distinct())


def _meeting(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """Pairs that share a token in `lists`, (id, t)."""
    for x in ("pivot", "member"):
        pairs = pairs.join(lists.select(F.col("id").alias(x), F.col("t").alias(f"t_{x}")), x)
    return pairs.where(F.arrays_overlap("t_pivot", "t_member")).select("pivot", "member").distinct()


def similar_sets(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """(key, n_shingles, component_id), one row per row of `docs`.

    n_shingles: size of the set of five-word shingles; shorter texts are one shingle, null and blank texts have none and
    stay alone. component_id: the smallest key that links of at least `percent` reach. Texts of equal sets are one node,
    named by their smallest key, so rows of one key are one document. Rows with a null key have a null component; an
    empty table gives no rows. The texts are read several times, so `docs` should be a table or checkpoint.
    """
    narrow = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    named = cut_lineage(shared_counts(narrow))
    freed(docs.sparkSession)
    nodes = cut_lineage(named.where("n > 0 AND id IS NOT NULL").groupBy("n", "mark1", "mark2")
                        .agg(F.min("id").alias("node"), F.max("shared").alias("shared")))
    close = cut_lineage(nodes.where(100 * F.col("shared").cast("long") >= percent * F.col("n"))
                        .groupBy(F.col("node").alias("id")).agg(F.max("shared").alias("shared")))
    reached = components(_links(narrow, close, named.agg(F.sum("n")).first()[0] or 0, orders, percent))
    freed(docs.sparkSession)
    whole = (nodes.join(reached, nodes["node"] == reached["node"], "left")
             .select("n", "mark1", "mark2", F.coalesce("component", nodes["node"]).alias("component")))
    alone = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return (named.join(whole, ["n", "mark1", "mark2"], "left")
            .select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), alone.alias("component_id")))


def _links(docs: DataFrame, close: DataFrame, total: int, orders: int, percent: int) -> DataFrame:
    """Links (a, b) that join every two nodes of `close` (id, shared) which all links together would join.

    The orders are gone through from the last to the first. Documents without a shared prefix token under one are left
    out of the next.
    """
    spark, ids, later = docs.sparkSession, close.select("id"), []
    order = spark.sparkContext.broadcast(token_order(_token_reports(docs, ids)))
    for k in range(orders, 0, -1):
        prefixes = cut_lineage(_prefixes(docs, ids, order, percent, k))
        passes = _passes(prefixes.agg(F.sum(F.size("rare") + F.size("known"))).first()[0] or 0, total, PREFIX_SHARE)
        if k == 1:
            sizes = cut_lineage(prefixes.select("id", "n").distinct().join(close, "id").join(ids, "id", "left_semi"))
            shares = sizes.groupBy("id").agg(F.max(F.col("shared") / F.col("n")).alias("share"))
        lists = []
        for i in range(passes):
            found = _shared(prefixes, passes, i)
            if k == 1:
                found = [x.join(shares, "id").select("id", "share", "t") for x in found]
            else:  # 32 bits do to compare two documents
                found = [x.select("id", F.transform("t", lambda t: F.hash(t)).alias("t")) for x in found]
            lists.append(cut_lineage(reduce(DataFrame.union, found)))
            del found
            freed(spark)
        del prefixes
        if k > 1:
            ids = cut_lineage(reduce(DataFrame.union, [x.select("id") for x in lists]).distinct().join(ids, "id", "left_semi"))
            later.append(lists)
    pairs = []
    for rows in lists:
        pairs.append(cut_lineage(_pairs(rows, sizes, percent)))
        freed(spark)
    pairs = _all_of(pairs)
    while later:
        met = []
        for rows in later.pop():
            met.append(cut_lineage(_meeting(pairs, rows)))
            freed(spark)
        del rows
        pairs = _all_of(met)
        del met
        freed(spark)
    found = pairs.toDF("a", "b") if pairs.isEmpty() else _common(pairs, docs, sizes, total, percent)
    reached = components(found).withColumnRenamed("node", "id")
    held = cut_lineage(sizes.groupBy("id").agg(F.max("n").alias("n")).join(reached, "id", "left")
                       .select("id", "n", F.coalesce("component", "id").alias("component")))
    return found.union(_across(lists, held, docs, total, percent))


def _across(lists: list[DataFrame], held: DataFrame, docs: DataFrame, total: int, percent: int) -> DataFrame:
    """Links between documents of one token list that are in different components: as many as join what can be joined.

    Documents are dealt into blocks of about BLOCK_TOKENS tokens: those of a component together, single ones with the
    largest component of a list of theirs. Blocks that meet in a list with several components are compared as wholes,
    each pair of blocks once, so no pair of documents becomes a row, however large a group.
    """
    spark, kind = docs.sparkSession, docs.schema["id"].dataType
    links = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    own = []
    for part in lists:
        rows = part.join(held, "id").select("id", "component", F.explode("t").alias("token"))
        sizes = rows.groupBy("token", "component").agg(F.count("*").alias("members"))
        main = (sizes.groupBy("token").agg(F.max_by("component", F.struct("members", "component")).alias("main"), F.count("*").alias("parts"))
                .where("parts > 1").select("token", "main"))
        own.append(cut_lineage(rows.join(main, "token").groupBy("id").agg(F.min("main").alias("main"))))
        del rows, sizes, main
        freed(spark)
    own = cut_lineage(reduce(DataFrame.union, own).groupBy("id").agg(F.min("main").alias("main")))
    members = held.groupBy("component").agg(F.count("*").alias("members"))
    homes = (own.join(held, "id").join(members, "component")
             .select("id", "n", "component", F.when(F.col("members") > 1, F.col("component")).otherwise(F.col("main")).alias("home")))
    chunks = homes.groupBy("home").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).alias("chunks"))
    dealt = cut_lineage(homes.join(chunks, "home").select("id", "n", "component", F.struct("home", F.pmod(F.xxhash64("id"), "chunks").alias("chunk")).alias("block")))
    pairs = []
    for part in lists if not dealt.isEmpty() else []:
        met = (part.join(dealt, "id").select("block", "component", F.explode("t").alias("token")).groupBy("token", "block")
               .agg(F.min("component").alias("lo"), F.max("component").alias("hi")))
        token = Window.partitionBy("token")
        met = met.withColumn("least", F.min("lo").over(token)).withColumn("most", F.max("hi").over(token)).where("least <> most")
        x, y = (met.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("block", "lo", "hi")]) for side in ("x", "y"))
        pairs.append(cut_lineage(x.join(y, "token").where((F.col("block_x") <= F.col("block_y")) & (F.least("lo_x", "lo_y") != F.greatest("hi_x", "hi_y")))
                                 .select("block_x", "block_y").distinct()))
        del met, x, y
        freed(spark)
    if not pairs:
        return spark.createDataFrame([], links)
    pairs = _all_of(pairs)
    full = dealt.groupBy("block").agg(F.sum("n").alias("n"))
    moved = pairs.select(F.explode(F.array("block_x", "block_y")).alias("block")).join(full, "block").agg(F.sum("n")).first()[0] or 0
    passes = _passes(moved, total, BLOCK_SHARE)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, a, b = _block_links(batch.column(1)[i].values, None if batch.column(0)[i].as_py() else batch.column(2)[i].values, percent)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a, pa.int64())), ids.take(pa.array(b, pa.int64()))], names=["a", "b"])
        give_back()

    found = []
    for k in range(passes):
        some = pairs.where(_of_pass(F.xxhash64("block_x"), passes, k))
        blocks = some.select(F.explode(F.array("block_x", "block_y")).alias("block")).distinct()
        inside = cut_lineage(dealt.join(blocks, "block", "left_semi"))
        content = (inside.join(_sets_of(docs, inside.select("id")), "id").groupBy("block")
                   .agg(F.collect_list(F.struct("id", "component", "set")).alias("held")))
        both = (some.join(content.select(F.col("block").alias("block_x"), F.col("held").alias("x")), "block_x")
                .join(content.select(F.col("block").alias("block_y"), F.col("held").alias("y")), "block_y")
                .select((F.col("block_x") == F.col("block_y")).alias("same"), "x", "y"))
        bound_batches(both)
        found.append(cut_lineage(both.mapInArrow(run, links)))
        del inside, content, both
        freed(spark)
    return reduce(DataFrame.union, found)


def _block_links(x: pa.StructArray, y: pa.StructArray | None, percent: int) -> tuple[pa.Array, list[int], list[int]]:
    """(ids, a, b): links between documents of two blocks, or inside one, that join components not joined before."""
    rows = x if y is None else pa.concat_arrays([x, y])
    group = np.asarray(rows.field("component").dictionary_encode().indices)
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows.field("set")]
    sizes = np.array([len(s) for s in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    root = list(range(int(group.max()) + 1))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    a, b, largest = [], [], np.bincount(group).argmax()
    for i in np.flatnonzero(group != largest).tolist():
        lo, hi = np.searchsorted(tokens, sets[i], "left"), np.searchsorted(tokens, sets[i], "right")
        times = hi - lo
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)
        common = np.bincount(owner[at], minlength=len(sets))
        near = 100 * common >= percent * (sizes + sizes[i] - common)
        for j in np.flatnonzero(near & (group != group[i])).tolist():
            s, t = find(int(group[i])), find(int(group[j]))
            if s != t:
                root[s] = t
                a.append(i)
                b.append(j)
    return rows.field("id"), a, b
