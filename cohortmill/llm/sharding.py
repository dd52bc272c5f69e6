"""Shards of near equal bytes: a k-d tree over metadata, cut at distributed weighted medians."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .places import bucket_bits, placed

#: Largest weight, as a share of its node, that a cut may leave undivided.
TOLERANCE = 1e-4
_VALUE_BITS, _TEXT_BITS, _ROW_BITS, _DIGIT_BITS = 31, 16, 15, 13
_BITS = _VALUE_BITS + _TEXT_BITS + _ROW_BITS
_LEVELS_PER_CUT = 4


def _positions(df: DataFrame, dims: list[str], alike: Column, row: Column) -> DataFrame:
    """One 62-bit key per dimension: the value's place in the column's range, then hashes of the text and of the row.

    Text values stand at a hash of theirs, nulls and NaN at 0. Rows of one value and text stay side by side, and the
    row's hash divides even a value or text that holds most rows.
    """
    kinds = dict(df.dtypes)
    value = {d: (F.crc32(F.col(d)) if kinds[d] in ("string", "binary") else F.nanvl(F.col(d).cast("double"), F.lit(None).cast("double")))
             for d in dims}
    ends = df.agg(*[f(value[d].cast("double")).alias(f"{n}{i}") for i, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    keys = []
    for i, d in enumerate(dims):
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        wide = lo is not None and hi > lo
        spot = ((value[d].cast("double") - lo) / (hi - lo) * (2**_VALUE_BITS - 1)).cast("long") if wide else F.lit(0).cast("long")
        tied = F.pmod(alike, F.lit(2**_TEXT_BITS)) * 2**_ROW_BITS + F.pmod(row, F.lit(2**_ROW_BITS))
        keys.append(F.coalesce(spot, F.lit(0)) * 2**(_TEXT_BITS + _ROW_BITS) + tied)
    return df.withColumn("_keys", F.array(*keys))


def _small(spark: SparkSession, kinds: dict[str, pa.DataType], rows: list[dict]) -> DataFrame:
    """One row per node, from the driver's bookkeeping of the tree."""
    return spark.createDataFrame(pa.table({c: pa.array([r[c] for r in rows], kind) for c, kind in kinds.items()}))


def _medians(rows: DataFrame, nodes: list[dict]) -> dict[int, int]:
    """For each node, the key on its dimension below which about `part` of its weight lies.

    A node's key range is counted by 13 bits at a time until the weight left undivided is within TOLERANCE. One row per
    node comes back; the counts of a node are at most 8,192 rows of one window.
    """
    spark, cuts = rows.sparkSession, {}
    open_ = [{**n, "prefix": 0, "goal": n["weight"] * n["part"]} for n in nodes]
    used = 0
    while open_:
        step = min(_DIGIT_BITS, _BITS - used)
        shift = _BITS - used - step
        asked = _small(spark, {"node": pa.int32(), "dim": pa.int32(), "prefix": pa.int64(), "goal": pa.float64()}, open_)
        key = F.element_at("_keys", F.col("dim") + 1)
        counted = (rows.join(F.broadcast(asked), "node").where(F.shiftright(key, shift + step) == F.col("prefix"))
                   .groupBy("node", "goal", F.shiftright(key, shift).alias("digit")).agg(F.sum("weight").alias("held")))
        run = Window.partitionBy("node").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        found = (counted.withColumn("upto", F.sum("held").over(run)).where(F.col("upto") >= F.col("goal"))
                 .groupBy("node").agg(F.min(F.struct("digit", "upto", "held")).alias("hit")).select("node", "hit.*").collect())
        used += step
        by_node, again = {r["node"]: r for r in found}, []
        for n in open_:
            hit = by_node[n["node"]]
            before = n["goal"] - (hit["upto"] - hit["held"])
            if hit["held"] <= TOLERANCE * n["weight"] or used == _BITS:
                after = before * 2 >= hit["held"]
                cuts[n["node"]] = (hit["digit"] + after) << shift
            else:
                again.append({**n, "prefix": hit["digit"], "goal": before})
        open_ = again
    return cuts


def kd_shards(df: DataFrame, dims: list[str], weight: Column, target_bytes: int | None = None, shards: int | None = None,
              alike: Column | None = None, row: Column | None = None, into: str = "shard") -> DataFrame:
    """`df` with the shard of every row: leaves of a k-d tree whose weights come near total / shards.

    A node that stands for several shards is cut at the weighted quantile that parts them, along the dimension whose
    values in the node spread over the largest share of their range (the first one of equals). `shards` is given or
    the total weight divided by `target_bytes`. Nulls in a dimension count as its smallest value, null weights as 0; ties
    are divided by hashes (`alike`, then `row`). Empty tables give no rows; a column named like `into` is replaced, all
    others come along unread, whatever their names. Only key arrays, weights and one row per node are moved or collected;
    the rows themselves stay.
    """
    base = df.drop(into)
    alike = F.xxhash64(*dims) if alike is None else alike
    row = F.xxhash64(*base.columns) if row is None else row
    own = [f"_d{i}" for i in range(len(dims))]
    packed = base.select(F.struct(*base.columns).alias("_row"), *[F.col(d).alias(n) for d, n in zip(dims, own)],
                         F.coalesce(weight, F.lit(0)).cast("double").alias("_weight"), alike.alias("_alike"), row.alias("_which"))
    keyed = _positions(packed, own, F.col("_alike"), F.col("_which")).select("_row", "_keys", "_weight")
    rows = cut_lineage(keyed.select("_keys", F.col("_weight").alias("weight"), F.lit(0).alias("node")))
    total = rows.agg(F.sum("weight")).first()[0] or 0.0
    count = shards if shards is not None else max(1, round(total / max(1, target_bytes or 1)))
    level = {0: (0, count)}  # node: its first shard, number of shards
    final, cut_tables = {}, []
    while open_ := {n: v for n, v in level.items() if v[1] > 1}:
        final |= {n: v[0] for n, v in level.items() if v[1] == 1}
        spread = [F.max(F.shiftright(F.element_at("_keys", i + 1), _BITS - _VALUE_BITS))
                  - F.min(F.shiftright(F.element_at("_keys", i + 1), _BITS - _VALUE_BITS)) for i in range(len(dims))]
        seen = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("weight").alias("held"), F.array(*spread).alias("spread")).collect()}
        nodes = [{"node": n, "weight": seen[n]["held"], "part": (v[1] // 2) / v[1], "dim": max(range(len(dims)), key=lambda i, n=n: (seen[n]["spread"][i], -i))}
                 for n, v in open_.items() if n in seen]
        cuts = _medians(rows, nodes)
        table = _small(df.sparkSession, {"node": pa.int32(), "dim": pa.int32(), "cut": pa.int64()}, [{**n, "cut": cuts[n["node"]]} for n in nodes])
        cut_tables.append(table)
        rows = _descended(rows, table)
        if len(cut_tables) % _LEVELS_PER_CUT == 0:
            rows = cut_lineage(rows)
        level = {2 * n + 1: (first, k // 2) for n, (first, k) in open_.items()} | {2 * n + 2: (first + k // 2, k - k // 2) for n, (first, k) in open_.items()}
    final |= {n: v[0] for n, v in level.items()}
    out = keyed.withColumn("node", F.lit(0))
    for table in cut_tables:
        out = _descended(out, table)
    leaves = _small(df.sparkSession, {"node": pa.int32(), into: pa.int32()}, [{"node": n, into: s} for n, s in final.items()])
    return out.join(F.broadcast(leaves), "node", "left").select("_row.*", into)


def _descended(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows moved to the child node on their side of their node's cut; leaves keep theirs. One small row per node is sent."""
    names = [c for c in rows.columns if c != "node"]
    side = F.when(F.element_at("_keys", F.col("dim") + 1) >= F.col("cut"), 2).otherwise(1)
    return (rows.join(F.broadcast(table), "node", "left")
            .select(*names, F.when(F.col("cut").isNull(), F.col("node")).otherwise(2 * F.col("node") + side).alias("node")))


def with_slots(df: DataFrame, totals_of: DataFrame, order: list[str], shard: str = "shard", into: str = "slot") -> DataFrame:
    """`df` with each row's place in its shard, without gaps from 0, in the order of a hash of `order`.

    `totals_of` has the same rows; it is counted first. Rows alike in `order` take neighbouring places. A column named like
    `into` is replaced, all others come along unread.
    """
    own = [f"_o{i}" for i in range(len(order))]
    needed = lambda rows: [F.col(shard).alias("_shard"), *[F.col(c).alias(n) for c, n in zip(order, own)]]
    packed = df.drop(into)
    packed = packed.select(F.struct(*packed.columns).alias("_row"), *needed(packed))
    out = placed(packed, totals_of.select(*needed(totals_of)), "_shard", F.lit(1).cast("long"), own, bucket_bits(totals_of.count()), "_place")
    return out.select("_row.*", F.col("_place").alias(into))
