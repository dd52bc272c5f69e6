"""The prefix trie of conversations: a node for each distinct sequence of first turns, with what sharing it would save.

A turn is two 64-bit hashes of its place, role and text, so texts never leave their scan; a sequence is the two running
sums of these. Nodes are counted with map-side partials. The trie is cut into fragments of at most FRAGMENT nodes: first
below the root, then, where a first turn is hot or a conversation long, below the deepest level that fits. Subtree totals
pass through the fragments by time-forward processing, one generation of fragments after the other, and the totals of
fragment tops are summed by parent before the next.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import ordered_sums, sequence_sums
from ..session import cut_lineage
from .forward_queue import BUDGET, fragment_totals
from .mixing import word_count
from .textbytes import bound_batches

FRAGMENT = 1 << 16
#: Ids of one joined piece of the text that a node's ends are hashed from; pieces are cut at multiples of it.
_PIECE = 1 << 14
_EMPTY = hashlib.sha256(b"").hexdigest()


def _sum_names(depth: Column, sum1: Column, sum2: Column) -> list[Column]:
    """The two halves of a sequence's name."""
    return [F.xxhash64(depth, sum1), F.xxhash64(sum2, depth, F.lit(7))]


def rebuilt_turns(turns: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """((c, pos, role_text hashes h1 and h2, words), (c)): the turns of every rebuilt conversation, and all of these.

    A conversation begins with the first h turns of the first of its group, h from its id's checksum, and goes on with its
    own turns behind its first h. `turns`: (conv_id, turn, h1, h2, words).
    """
    placed = sequence_sums(turns.withColumn("one", F.lit(1)), ["turn", "h1", "h2"], {"pos": "one"}, ["conv_id"])
    placed = cut_lineage(placed.select("conv_id", "pos", "h1", "h2", "words"))
    text = F.col("conv_id").cast("string")
    convs = placed.select("conv_id").distinct().select(F.col("conv_id").alias("c"), (F.crc32(text) % heads).alias("h"),
                                                       (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    # The head of a group has fewer than `heads` turns, so its list is bounded.
    first = (placed.where((F.col("conv_id") % group == 0) & (F.col("pos") < heads)).groupBy(F.col("conv_id").alias("base"))
             .agg(F.array_sort(F.collect_list(F.struct("pos", "h1", "h2", "words"))).alias("head")))
    planned = cut_lineage(convs.join(first, "base", "left").select("c", F.coalesce(F.slice("head", 1, F.col("h").cast("int")), F.array().cast(
        "array<struct<pos:bigint,h1:bigint,h2:bigint,words:bigint>>")).alias("head"), "h").withColumn("taken", F.size("head")))
    own = (placed.join(planned.select(F.col("c").alias("conv_id"), "h", "taken"), "conv_id").where("pos > h")
           .select(F.col("conv_id").alias("c"), (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "h1", "h2", "words"))
    shared = planned.select("c", F.explode("head").alias("t")).select("c", "t.pos", "t.h1", "t.h2", "t.words")
    return own.union(shared), planned.select("c")


def _sequences(members: DataFrame) -> DataFrame:
    """(c, depth, name1, name2, parent1, parent2, words, last): the node of each first-d-turns of each conversation."""
    turn = members.withColumns({"g1": F.xxhash64("pos", "h1").cast("decimal(20,0)"), "g2": F.xxhash64("h2", "pos").cast("decimal(20,0)"),
                                "one": F.lit(1)})
    sums = ordered_sums(turn, "pos", {"s1": "g1", "s2": "g2", "seen": "one"}, ["c"])
    before = [(F.col(s) - F.col(g)).cast("decimal(38,0)") for s, g in (("s1", "g1"), ("s2", "g2"))]
    here = [F.col(s).cast("decimal(38,0)") for s in ("s1", "s2")]
    name, parent = _sum_names(F.col("pos"), *here), _sum_names(F.col("pos") - 1, *before)
    return sums.select("c", F.col("pos").alias("depth"), name[0].alias("name1"), name[1].alias("name2"), parent[0].alias("parent1"),
                       parent[1].alias("parent2"), "words", (F.col("pos") == F.col("seen_total")).alias("last"))


def _fragments(nodes: DataFrame, sequences: DataFrame, most: int) -> tuple[DataFrame, int]:
    """(`nodes` with top1, top2 and generation, generations): no fragment of more than `most` nodes.

    The root is a fragment, and so is each first turn's subtree; a larger one keeps as many of its upper levels as fit, at
    least its top, and each node of the next level becomes the top of a fragment of the next generation.
    """
    ancestors = sequences.select(F.col("c").alias("conv_id"), F.col("depth").alias("cut"), F.col("name1").alias("top1"), F.col("name2").alias("top2"))
    deep = nodes.withColumn("cut", F.least("depth", F.lit(1))).join(ancestors, ["conv_id", "cut"], "left")
    found = cut_lineage(deep.withColumns({"top1": F.coalesce("top1", "name1"), "top2": F.coalesce("top2", "name2"), "generation": F.col("cut").cast("int")}).drop("cut"))
    done, last = [], 1
    while True:
        large = found.groupBy("top1", "top2").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > most).select("top1", "top2")
        large = cut_lineage(large)
        if large.isEmpty():
            break
        done.append(found.join(large, ["top1", "top2"], "left_anti"))
        found = found.join(large, ["top1", "top2"])
        levels = found.groupBy("top1", "top2", "depth").agg(F.count(F.lit(1)).alias("n"))
        upto = ordered_sums(levels, "depth", {"held": "n"}, ["top1", "top2"])
        # The first level that doesn't fit; the topmost has one node, which fits always.
        cuts = upto.where(F.col("held") > F.greatest(F.lit(most), F.lit(1))).groupBy("top1", "top2").agg(F.min("depth").alias("cut"))
        split = found.join(cuts, ["top1", "top2"])
        done.append(split.where("depth < cut").select(*found.columns))
        below = split.where("depth >= cut").drop("top1", "top2").join(ancestors, ["conv_id", "cut"])
        last += 1
        found = cut_lineage(below.withColumn("generation", F.lit(last)).select(*done[-1].columns))
    for part in done:
        found = found.unionByName(part)
    return cut_lineage(found), last


def _ends(sequences: DataFrame, turnless: DataFrame) -> DataFrame:
    """(name1, name2, ends_sha256) of the nodes at which conversations end.

    Ids are joined in pieces of bounded size in parallel, and the pieces of a node are hashed in order as they stream by.
    """
    ends = sequences.where("last").select("name1", "name2", "c").union(turnless)
    pieces = (ends.groupBy("name1", "name2", F.floor(F.col("c") / _PIECE).alias("piece"))
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids")))
    ordered = pieces.repartition("name1", "name2").sortWithinPartitions("name1", "name2", "piece")
    bound_batches(ordered)

    def run(batches):
        name, digest = None, None

        def told(rows):
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2])],
                                              names=["name1", "name2", "ends_sha256"])

        for batch in batches:
            out = []
            for name1, name2, ids in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                if (name1, name2) == name:
                    digest.update(b",")
                else:
                    if name is not None:
                        out.append((*name, digest.hexdigest()))
                    name, digest = (name1, name2), hashlib.sha256()
                digest.update(ids.encode())
            if out:
                yield told(out)
        if name is not None:
            yield told([(*name, digest.hexdigest())])

    return ordered.select("name1", "name2", "ids").mapInArrow(run, "name1 long, name2 long, ends_sha256 string")


def prefix_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                fragment: int = FRAGMENT, budget: int = BUDGET) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are rebuilt by `rebuilt_turns`, with turns in the order of `turn`, null first and equal ones by a
    hash of role and text. A null role or text is empty; a row with a null `conv` belongs to no conversation and takes no part; rows that
    repeat are turns of their own. A table without conversations gives no rows; other columns play no part.
    """
    content = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    turns = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.xxhash64(*content).alias("h1"),
        F.xxhash64(*reversed(content), F.lit(1)).alias("h2"), word_count(text).alias("words"))
    members, convs = rebuilt_turns(turns)
    sequences = cut_lineage(_sequences(members))
    root = [F.lit(0).cast("long"), *[F.lit(0).cast("decimal(38,0)")] * 2]
    root1, root2 = _sum_names(*root)
    nobody = F.lit(None).cast("long")
    below = sequences.groupBy("depth", "name1", "name2", "parent1", "parent2").agg(
        F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"))
    top = (convs.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
           .select(root[0].alias("depth"), root1.alias("name1"), root2.alias("name2"), nobody.alias("parent1"), nobody.alias("parent2"),
                   "conv_id", "n_convs", F.lit(0).cast("long").alias("words")))
    nodes = cut_lineage(top.union(below))
    children = nodes.where("depth > 0").groupBy(F.col("parent1").alias("name1"), F.col("parent2").alias("name2")).agg(F.count(F.lit(1)).alias("n_children"))
    valued = nodes.join(children, ["name1", "name2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    valued = valued.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "gain": (F.col("n_convs") - 1) * F.col("words")})
    dealt, last = _fragments(valued, sequences, fragment)
    totals, messages = None, None
    for generation in range(last, -1, -1):
        own = dealt.where(F.col("generation") == generation)
        if messages is not None:  # from the fragments that hang below these, all of the next generation
            own = own.join(messages, ["name1", "name2"], "left").withColumns(
                {c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "gain")})
        found = cut_lineage(fragment_totals(own, budget))
        messages = (found.where("is_top").groupBy(F.col("parent1").alias("name1"), F.col("parent2").alias("name2"))
                    .agg(F.sum("leaves").alias("more_leaves"), F.sum("gain").alias("more_gain")))
        done = found.select("name1", "name2", F.col("leaves").alias("n_leaves"), F.col("gain").alias("saved_tokens"))
        totals = done if totals is None else totals.union(done)
    turnless = convs.join(sequences.where("depth = 1").select("c"), "c", "left_anti").select(root1, root2, "c")
    parents = nodes.select(F.col("name1").alias("parent1"), F.col("name2").alias("parent2"), F.col("conv_id").alias("parent_conv_id"))
    return (dealt.select("name1", "name2", "parent1", "parent2", "conv_id", "depth", "n_convs", "n_children")
            .join(totals, ["name1", "name2"]).join(_ends(sequences, turnless), ["name1", "name2"], "left")
            .join(parents, ["parent1", "parent2"], "left")
            .select(F.col("conv_id").alias(conv), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256")))
