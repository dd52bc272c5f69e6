"""Places of rows in a fixed pseudorandom order inside each group, without one task for a group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one window sorts, on average.
ROWS_PER_BUCKET = 50_000


def bucket_bits(rows: int) -> int:
    """Bits of the hash that name a bucket; the places do not depend on it."""
    return max(6, math.ceil(math.log2(max(1, rows) / ROWS_PER_BUCKET)))


def placed(df: DataFrame, totals_of: DataFrame, group: str, weight: Column, order: list[str], bits: int, into: str) -> DataFrame:
    """`df` with the sum of `weight` over all rows of its group that come before, in the order of a hash of `order`.

    `totals_of` has the same rows and `group`, `order` and what `weight` needs; it is read for the sums. A bucket is a
    stretch of hashes: sums of the buckets before come from a window over at most 2^bits rows a group, the rest from a
    window inside the bucket. Rows alike in `order` are alike to the caller.
    """
    key = F.xxhash64(*order)
    bucket = F.shiftrightunsigned(key, 64 - bits)
    before = (totals_of.groupBy(group, bucket.alias("_bucket")).agg(F.sum(weight).alias("_sum"))
              .withColumn("_before", F.sum("_sum").over(Window.partitionBy(group).orderBy("_bucket")) - F.col("_sum"))
              .select(F.col(group).alias("_group"), F.col("_bucket").alias("_at"), "_before"))
    keyed = df.withColumn("_key", key).withColumn("_bucket", bucket)
    inside = Window.partitionBy(group, "_bucket").orderBy("_key", *order)
    counted = (keyed.withColumn("_inside", F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - weight)
               .join(before, (F.col(group) == F.col("_group")) & (F.col("_bucket") == F.col("_at"))))
    return counted.withColumn(into, F.col("_before") + F.col("_inside")).drop("_key", "_bucket", "_inside", "_group", "_at", "_before")
