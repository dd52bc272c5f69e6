"""Exact selection of the first rows of a group in hash order, without ranking or moving rows.

The hash up to which exactly k rows of a group lie is found digit by digit: rows are counted by the first digits of their
hash, which takes map-side partials only, the bucket in which the k-th falls is kept, and its rows alone are counted by the
next digits. What follows is a filter on the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranks import hash_order

#: Hexadecimal digits of a step, so a group has 65,536 buckets at most, and digits of a hash.
STEP, DIGITS = 4, 32
#: Groups whose cuts are sent to every task; a cut is under 50 bytes beside the group's own columns.
SENT_GROUPS = 100_000


def hash_cuts(df: DataFrame, keys: Sequence[str], seed: int | str, groups: Sequence[str], wanted: Callable[[Column], Column],
              step: int = STEP) -> DataFrame:
    """(groups, cut, size): rows with `hash_order(seed, *keys) <= cut` are exactly `wanted(size)` of the group's rows.

    `size` is the number of the group's rows. Wanting none or less gives a cut below every hash, wanting more than there are
    one above. `keys` identify a row: rows of equal keys have one hash and go together. Null groups are groups.
    """
    names = [f"_g{i}" for i in range(len(groups))]
    rows = cut_lineage(df.select(*[F.col(g).alias(n) for g, n in zip(groups, names)], hash_order(seed, *keys).alias("_hash")))
    upto = Window.partitionBy(*names).orderBy("_head").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = rows.groupBy(*names, F.substring("_hash", 1, step).alias("_head")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = F.sum("_n").over(Window.partitionBy(*names))
    counted = counted.withColumn("size", sizes).withColumn("_left", wanted(F.col("size")).cast("long"))
    done, length = None, step
    while True:
        placed = counted.withColumn("_upto", F.sum("_n").over(upto))
        reached = F.min(F.when(F.col("_upto") >= F.col("_left"), F.struct("_head", "_n", "_upto"))).alias("_at")
        state = cut_lineage(placed.groupBy(*names, "size", "_left").agg(reached))
        whole = (F.col("_at._upto") == F.col("_left")) | (F.lit(length) >= DIGITS)
        # Hexadecimal digits end at f, so a head and a g is above every hash that begins with the head.
        cut = (F.when(F.col("_left") <= 0, F.lit("")).when(F.col("_at").isNull(), F.lit("g"))
               .when(whole, F.concat("_at._head", F.lit("g"))).alias("cut"))
        found = state.select(*names, cut, "size").where("cut IS NOT NULL")
        done = found if done is None else done.union(found)
        further = (state.where(cut.isNull()).select(
            *[F.col(n).alias(f"o{n}") for n in names], "size", F.col("_at._head").alias("_within"),
            (F.col("_left") - (F.col("_at._upto") - F.col("_at._n"))).alias("_left")))
        if further.isEmpty():
            break
        same = F.substring("_hash", 1, length) == F.col("_within")
        for n in names:
            same = same & F.col(n).eqNullSafe(F.col(f"o{n}"))
        length = min(DIGITS, length + step)
        counted = (rows.join(_sent(further), same).groupBy(*names, "size", "_left", F.substring("_hash", 1, length).alias("_head"))
                   .agg(F.count(F.lit(1)).alias("_n")))
    return done.select(*[F.col(n).alias(g) for n, g in zip(names, groups)], "cut", "size")


def _sent(cuts: DataFrame) -> DataFrame:
    """A table of one row per group, for every task where its measured size allows."""
    return F.broadcast(cuts) if cuts.limit(SENT_GROUPS + 1).count() <= SENT_GROUPS else cuts


def first_in_hash_order(df: DataFrame, keys: Sequence[str], seed: int | str, groups: Sequence[str], wanted: Callable[[Column], Column],
                        name: str) -> DataFrame:
    """Adds boolean `name`: whether the row is among the first `wanted(size)` of its group in hash order."""
    cuts = hash_cuts(df, keys, seed, groups, wanted).select(*[F.col(g).alias(f"_c{i}") for i, g in enumerate(groups)], F.col("cut").alias("_cut"))
    hashed = df.withColumn("_hash", hash_order(seed, *keys))
    same = F.lit(True)
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_c{i}"))
    return hashed.join(_sent(cuts), same).select(*df.columns, (F.col("_hash") <= F.col("_cut")).alias(name))
