"""Global and per-group order: running sums, ranks, exact quantiles.

A window ordered over a whole table (or over one hot group) runs in a single task. The operators here split
such an order into value buckets: sum each bucket, turn the bucket sums into offsets (a window over at most
`buckets` rows per group), and run the real window inside (group, bucket). Every result is exact.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

ROWS_PER_TASK = 2_000_000
MAX_BUCKETS = 8_192


def _order(column: str, descending: bool) -> Column:
    return F.col(column).desc() if descending else F.col(column).asc()


def _with_running(df: DataFrame, order: list[Column], sums: dict[str, str], groups: list[str],
                  lead: Sequence[str]) -> DataFrame:
    ordered = Window.partitionBy(*groups).orderBy(*order)
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*groups)
    columns = {name: F.sum(source).over(running) for name, source in sums.items()}
    columns.update({f"{name}_total": F.sum(source).over(whole) for name, source in sums.items()})
    columns.update({f"next_{name}": F.lead(name).over(ordered) for name in lead})
    return df.withColumns(columns)


def ordered_sums(df: DataFrame, by: str, sums: dict[str, str], groups: Sequence[str] = (),
                 descending: bool = False, then: Sequence[str] = (), lead: Sequence[str] = (),
                 max_rows: int | None = None, rows_per_task: int = ROWS_PER_TASK, settled: bool = False) -> DataFrame:
    """Running sums of `sums` (new name -> column) in the order of numeric column `by`, then of `then`.

    Adds, per name, the inclusive running sum and `<name>_total`, the sum over the whole group; and per
    `lead` column `next_<column>`, its value on the following row (only without `then`). (groups, by, then)
    must be unique, and one value of `by` must carry few rows: aggregate to one row per value first.

    `max_rows` is for callers that can prove an upper bound on the rows of one group (for example scores
    rounded to 4 digits). Up to `rows_per_task` rows per group the plain window is used. Without a proven
    bound the input is computed once (unless it is `settled`, that is already materialised), its largest
    group is measured, and it is bucketed on its own quantiles when that group is larger.
    """
    groups, then, lead = list(groups), list(then), list(lead)
    if lead and then:
        raise ValueError("lead needs an order on one column")
    order = [_order(by, descending), *[F.col(c) for c in then]]
    if max_rows is None or max_rows > rows_per_task:
        df = df if settled else cut_lineage(df)
        sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
        largest, total = sizes.agg(F.max("_n"), F.sum("_n")).first()
    else:
        largest = total = max_rows
    if not total or largest <= rows_per_task:
        return _with_running(df, order, sums, groups, lead)

    buckets = min(MAX_BUCKETS, max(2, math.ceil(4 * total / rows_per_task)))
    cuts = df.approxQuantile(by, [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))
    splits = [-math.inf, *sorted({c for c in cuts if math.isfinite(c)}), math.inf]
    if len(splits) < 3:
        splits = [-math.inf, 0.0, math.inf]
    # Nulls come before all numbers and NaN after them, as in Spark's own order; Bucketizer keeps both in its last bucket.
    bucketed = Bucketizer(splits=splits, inputCol="_by", outputCol="_bucket", handleInvalid="keep").transform(
        df.withColumn("_by", F.col(by).cast("double"))).withColumn(
        "_bucket", F.when(F.col("_by").isNull(), -1.0).otherwise(F.col("_bucket"))).drop("_by")

    pick_first = F.max_by if descending else F.min_by
    head = [pick_first(F.struct(*lead), F.col(by)).alias("_head")] if lead else []
    return _over_buckets(bucketed, df.columns, order, sums, groups, _order("_bucket", descending), lead, head)


def _over_buckets(bucketed: DataFrame, columns: Sequence[str], order: list[Column], sums: dict[str, str],
                  groups: list[str], bucket_order: Column, lead: Sequence[str] = (),
                  head: Sequence[Column] = ()) -> DataFrame:
    """Running sums from bucket totals plus a window inside (group, bucket)."""
    # The sums of one hot (group, bucket) are pre-aggregated on the map side before this shuffle.
    totals = bucketed.groupBy(*groups, "_bucket").agg(
        *[F.sum(source).alias(f"_sum_{name}") for name, source in sums.items()], *head)
    along = Window.partitionBy(*groups).orderBy(bucket_order)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_bucket").alias("_b"),
        *[F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_before_{name}") for name in sums],
        *[F.sum(f"_sum_{name}").over(Window.partitionBy(*groups)).alias(f"_all_{name}") for name in sums],
        *([F.lead("_head").over(along).alias("_next_head")] if lead else []))
    same = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = {}
    for name, source in sums.items():
        added[name] = F.col(f"_before_{name}") + F.sum(source).over(running)
        added[f"{name}_total"] = F.col(f"_all_{name}")
    for name in lead:
        added[f"next_{name}"] = F.coalesce(F.lead(name).over(inside), F.col(f"_next_head.{name}"))
    return bucketed.join(offsets, same).select(*columns, *[c.alias(n) for n, c in added.items()])


def sequence_sums(df: DataFrame, order: Sequence[str], sums: dict[str, str], groups: Sequence[str] = (),
                  rows_per_task: int = ROWS_PER_TASK, max_buckets: int = 1_024) -> DataFrame:
    """`ordered_sums` for an ascending order on columns of any type; nulls in the order come first.

    Beyond `rows_per_task` rows in a group, the bucket limits are order keys of a small sample; they only
    decide where the buckets are cut, so the result does not depend on them. Rows that are equal in the whole
    order are told apart by their place in the checkpointed input, so even a third of all rows with one order
    key is cut into buckets.
    """
    groups, order = list(groups), list(order)
    df = cut_lineage(df)
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    largest, total = sizes.agg(F.max("_n"), F.sum("_n")).first()
    if not total or largest <= rows_per_task:
        return _with_running(df, [F.col(c).asc() for c in order], sums, groups, [])
    columns = df.columns
    df = df.withColumn("_place", F.monotonically_increasing_id())
    order = [*order, "_place"]
    by = [F.col(c).asc() for c in order]
    buckets = min(max_buckets, max(2, math.ceil(4 * total / rows_per_task)))
    sample = df.select(*order).sample(min(1.0, 50 * buckets / total), seed=1).dropna().orderBy(*order).collect()
    cuts = [sample[(i * len(sample)) // buckets] for i in range(1, buckets)] if sample else []
    cuts = list(dict.fromkeys(tuple(c) for c in cuts))
    bucket = F.lit(0)
    if cuts:
        key = F.struct(*order)
        texts = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in order]))
        typed = T.ArrayType(T.StructType([T.StructField(c, df.schema[c].dataType) for c in order]))
        # One text literal, which Spark parses once when it folds constants.
        limits = lambda rows: F.from_json(F.lit(json.dumps([dict(zip(order, map(str, r))) for r in rows])),
                                          texts).cast(typed)
        below = lambda some: F.size(F.filter(some, lambda limit: limit <= key))
        # Find the block of limits first, then the limit inside the block.
        width = max(1, math.isqrt(len(cuts)))
        block = below(limits(cuts[width - 1::width]))
        inside = below(F.slice(limits(cuts), block * width + 1, F.lit(width)))
        bucket = block * width + F.when(block * width < len(cuts), inside).otherwise(0)
    return _over_buckets(df.withColumn("_bucket", bucket), columns, by, sums, groups, F.col("_bucket").asc())


def hash_order(seed: int | str, *keys: str) -> Column:
    """A fixed pseudo-random text per row: `md5(key:key:seed)`. Same bytes in any SQL engine."""
    return F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def hash_rank(df: DataFrame, keys: Sequence[str], seed: int | str, groups: Sequence[str] = (),
              name: str = "hash_rank") -> DataFrame:
    """Rank 1..n in `hash_order` within `groups`, with `<name>_total` the group size. `keys` identify a row.

    The hash is uniform, so its first six characters make 16.7 million even buckets in every group, however hot, in two
    levels of 4,096: no boundaries to look for, and no window holds more than 4,096 counts or 1/16.7 million of a group.
    """
    groups = list(groups)
    hashed = df.withColumns({"_hash": hash_order(seed, *keys)}).withColumns(
        {"_first": F.substring("_hash", 1, 3), "_second": F.substring("_hash", 4, 3)})
    offsets = _hash_offsets(hashed, groups, name).select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_first").alias("_a"), F.col("_second").alias("_b"),
        "_before", f"{name}_total")
    same = (F.col("_first") == F.col("_a")) & (F.col("_second") == F.col("_b"))
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*groups, "_first", "_second").orderBy("_hash", *keys)
    return hashed.join(offsets, same).select(
        *df.columns, (F.col("_before") + F.row_number().over(inside)).alias(name), f"{name}_total")


def _hash_offsets(hashed: DataFrame, groups: list[str], name: str) -> DataFrame:
    """Rows of the group before each (_first, _second) bucket as `_before`, and `<name>_total`."""
    upto = lambda keys, column: F.coalesce(F.sum(column).over(
        Window.partitionBy(*keys).orderBy("_last").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    second = hashed.groupBy(*groups, "_first", "_second").agg(F.count(F.lit(1)).alias("_n")).withColumn("_last", F.col("_second"))
    first = second.groupBy(*groups, "_first").agg(F.sum("_n").alias("_n")).withColumn("_last", F.col("_first"))
    first = first.withColumns({"_lead": upto(groups, "_n"), f"{name}_total": F.sum("_n").over(Window.partitionBy(*groups))})
    first = first.select(*[F.col(g).alias(f"_f{i}") for i, g in enumerate(groups)], F.col("_first").alias("_f"), "_lead", f"{name}_total")
    same = F.col("_first") == F.col("_f")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_f{i}"))
    return (second.withColumn("_inner", upto([*groups, "_first"], "_n")).join(first, same)
            .withColumn("_before", F.col("_lead") + F.col("_inner")))


def score_rank(df: DataFrame, score: str, keys: Sequence[str], seed: int | str = 0, groups: Sequence[str] = (),
               descending: bool = True, name: str = "score_rank",
               rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rank 1..n by `score`, ties in `hash_order`, with `<name>_total` the group size.

    Rows are first counted per (score, hash prefix), which spreads a score shared by a third of the table
    over 4,096 cells; the cells are ranked by `ordered_sums` and the rows inside their cell.
    """
    groups = list(groups)
    hashed = df.withColumn("_hash", hash_order(seed, *keys)).withColumn("_cell", F.substring("_hash", 1, 3))
    cells = hashed.groupBy(*groups, score, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    ranked = ordered_sums(cells, score, {"_seen": "_n"}, groups, descending, then=["_cell"],
                          rows_per_task=rows_per_task)
    offsets = ranked.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col(score).alias("_s"),
        F.col("_cell").alias("_c"), (F.col("_seen") - F.col("_n")).alias("_before"),
        F.col("_seen_total").alias(f"{name}_total"))
    same = F.col(score).eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c"))
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*groups, score, "_cell").orderBy("_hash", *keys)
    return hashed.join(offsets, same).select(
        *df.columns, (F.col("_before") + F.row_number().over(inside)).alias(name), f"{name}_total")


def decile(rank: str, size: str, bins: int = 10) -> Column:
    """Equal-count bin 1..bins of a first-occurrence rank, right-closed at the interpolated quantiles."""
    r, n = F.col(rank), F.col(size)
    return F.when(n <= 1, F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.floor(((r - 1) * bins + n - 2) / F.greatest(n - 1, F.lit(1))))).cast("long")


def exact_quantiles(df: DataFrame, value: str, quantiles: dict[str, float], groups: Sequence[str] = (),
                    max_rows: int | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Exact interpolated quantiles per group, plus `n`, the count of non-null values.

    Equal values are counted on the map side; the counted values are then put in order by `ordered_sums`, so
    a group of any size never has to sit in one aggregation buffer, as it would in `percentile`.
    """
    groups = list(groups)
    counted = (df.where(F.col(value).isNotNull()).groupBy(*groups, value)
               .agg(F.count(F.lit(1)).alias("_n")))
    seen = ordered_sums(counted, value, {"_seen": "_n"}, groups, max_rows=max_rows, rows_per_task=rows_per_task)
    first, last, size = F.col("_seen") - F.col("_n"), F.col("_seen") - 1, F.col("_seen_total")
    picks, results = [], []
    for name, q in quantiles.items():
        at = (size - 1) * F.lit(q)
        for side, position in (("low", F.floor(at)), ("high", F.ceil(at))):
            picks.append(F.max(F.when(position.between(first, last), F.col(value).cast("double")))
                         .alias(f"_{name}_{side}"))
        results.append((name, f"_{name}_low", f"_{name}_high", q))
    found = seen.groupBy(*groups).agg(F.max("_seen_total").alias("n"), *picks)
    fraction = lambda q: (F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q))
    return found.select(*groups, "n", *[
        F.when(F.col(low) == F.col(high), F.col(low)).otherwise(F.col(low) + (F.col(high) - F.col(low)) * fraction(q)).alias(name)
        for name, low, high, q in results])
