"""Joins with the checks their callers rely on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class JoinCheckError(ValueError):
    """A key that should be unique or matched is not."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).count().where(F.col("count") > 1)


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    found = duplicate_keys(df, keys).limit(5).collect()
    if found:
        raise JoinCheckError(f"{what} has duplicate keys {list(keys)}, for example {[tuple(r) for r in found]}")


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join after checking that the keys are unique on both sides."""
    require_unique(left, keys, "left side")
    require_unique(right, keys, "right side")
    return left.join(right, list(keys), "left")


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys), list(keys), "left_anti")


def many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], require_match: bool = True) -> DataFrame:
    """Left join after checking that the right keys are unique and, optionally, that every left row matches."""
    require_unique(right, keys, "right side")
    if require_match:
        missing = unmatched(left, right, keys).select(*keys).limit(5).collect()
        if missing:
            raise JoinCheckError(f"rows without a match, for example {[tuple(r) for r in missing]}")
    return left.join(right, list(keys), "left")


def with_indicator(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
                   name: str = "_merge") -> DataFrame:
    """Left or full join with a column that says `both`, `left_only` or `right_only`."""
    marked_left = left.withColumn("_in_left", F.lit(True))
    marked_right = right.withColumn("_in_right", F.lit(True))
    joined = marked_left.join(marked_right, list(keys), how)
    tag = (F.when(F.col("_in_left") & F.col("_in_right"), "both")
           .when(F.col("_in_left"), "left_only").otherwise("right_only"))
    return joined.withColumn(name, tag).drop("_in_left", "_in_right")


def lookup(df: DataFrame, dictionary: DataFrame, keys: Sequence[str], defaults: dict[str, object]) -> DataFrame:
    """Left join to a dictionary table; missing entries take the default of their column."""
    return df.join(dictionary, list(keys), "left").fillna(defaults)


def among(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys occur in `ids`."""
    return df.join(ids.select(*keys), list(keys), "left_semi")


def not_among(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys do not occur in `ids`; null keys are kept, unlike with SQL `NOT IN`."""
    return df.join(ids.select(*keys), list(keys), "left_anti")


def require_disjoint(left: DataFrame, right: DataFrame, key: str, what: str) -> None:
    shared = left.select(key).intersect(right.select(key)).limit(10).collect()
    if shared:
        raise JoinCheckError(f"{what} overlap in {key}: {[r[0] for r in shared]}")


def stack(*frames: DataFrame) -> DataFrame:
    """Union by name; a column that one frame lacks is null there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def require_qualified(requested: DataFrame, qualified: DataFrame, key: str) -> DataFrame:
    """The qualified rows of the requested ids; ids that do not qualify raise."""
    missing = not_among(requested.select(key).distinct(), qualified, [key]).limit(10).collect()
    if missing:
        raise JoinCheckError(f"requested {key} do not qualify: {[r[0] for r in missing]}")
    return among(qualified, requested, [key])
