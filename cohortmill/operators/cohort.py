"""Picking one encounter per subject, splitting and thinning a cohort."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import epoch_micros
from .cuts import first_in_hash_order, hash_cuts
from .joins import require_disjoint, stack
from .ranks import hash_order, hash_rank


def normal_ids(df: DataFrame, *columns: str) -> DataFrame:
    """Ids to whole numbers; rows with an id that is not a number are dropped."""
    return df.withColumns({c: F.col(c).try_cast("long") for c in columns}).dropna(subset=list(columns))


# One row per subject is always an aggregation with map-side partials, never a window, so that a subject
# with a third of all encounters costs its scan and nothing more.

def _time_order(ts: str, tie: str, latest: bool) -> Column:
    """What `min_by` needs to find the earliest or latest row, ties by `tie` ascending; `tie` may be of any ordered type."""
    if not latest:
        return F.struct(ts, tie)
    return F.struct(F.col(ts).isNull(), -epoch_micros(ts), F.col(tie).isNull(), F.col(tie))


def first_non_null(df: DataFrame, subject: str, ts: str, tie: str, columns: Sequence[str],
                   latest: bool = False) -> DataFrame:
    """Per subject and column, the earliest (or latest) value that is not null; columns may come from
    different rows. Rows at the same time are ordered by `tie`, ascending."""
    order, pick = _time_order(ts, tie, latest), F.min_by
    return df.where(F.col(subject).isNotNull()).groupBy(subject).agg(
        *[pick(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns])


def one_row(df: DataFrame, subject: str, ts: str, tie: str, latest: bool = True) -> DataFrame:
    """The latest (or earliest) whole row per subject, nulls included; ties by `tie`, ascending."""
    others = [c for c in df.columns if c != subject]
    best = df.groupBy(subject).agg(F.min_by(F.struct(*others), _time_order(ts, tie, latest)).alias("_row"))
    return best.select(subject, *[F.col(f"_row.{c}").alias(c) for c in others])


def first_time(df: DataFrame, keys: Sequence[str], ts: str, name: str) -> DataFrame:
    return df.where(F.col(ts).isNotNull()).groupBy(*keys).agg(F.min(ts).alias(name))


def stack_cases(cases: DataFrame, controls: DataFrame, label: str, disjoint: Sequence[str] = ()) -> DataFrame:
    """Cases (label 1) over controls (label 0), after checking that the `disjoint` keys do not overlap."""
    for key in disjoint:
        require_disjoint(cases, controls, key, "cases and controls")
    return stack(cases.withColumn(label, F.lit(1)), controls.withColumn(label, F.lit(0)))


def row_id(df: DataFrame, keys: Sequence[str], name: str = "row_id") -> DataFrame:
    """A stable row key made of the identifying columns, the same on every run and partitioning.

    256 bits of a hash of the keys with their lengths, so different rows can't be expected to meet in one key.
    """
    parts = [F.coalesce(F.concat(F.length(c.cast("string")), F.lit(":"), c.cast("string")), F.lit("-")) for c in map(F.col, keys)]
    return df.withColumn(name, F.sha2(F.concat_ws("|", *parts), 256))


# Splits. Rows are ordered by md5(key:seed), so a split does not depend on partitioning or row order.

def in_share(seed: int | str, share: float, *keys: str) -> Column:
    """True for a fixed `share` of the keys, in expectation."""
    if share <= 0 or share >= 1:
        return F.lit(share >= 1)
    # The share of the first 32 bits, as before, carried on over the whole hash.
    return hash_order(seed, *keys) < F.lit(f"{int(share * 16 ** 8) << 96:032x}")


def holdout_split(df: DataFrame, keys: Sequence[str], share: float = 0.2, seed: int = 42,
                  name: str = "cohort_split") -> DataFrame:
    """`test` for a share of the rows, else `train`. Stratified in expectation; no shuffle."""
    return df.withColumn(name, F.when(in_share(seed, share, *keys), "test").otherwise("train"))


def stratified_split(df: DataFrame, keys: Sequence[str], label: str, share: float = 0.2, seed: int = 42,
                     name: str = "cohort_split") -> DataFrame:
    """`test` for exactly `floor(share * n + 0.5)` rows of every label."""
    picked = first_in_hash_order(df, keys, seed, [label], lambda size: F.floor(F.lit(share) * size + 0.5), "_test")
    return picked.withColumn(name, F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def subject_labels(df: DataFrame, subject: str, label: str) -> DataFrame:
    return df.groupBy(subject).agg(F.max(label).alias(label))


def grouped_split(df: DataFrame, subject: str, label: str, share: float = 0.2, seed: int = 42,
                  name: str = "cohort_split") -> DataFrame:
    """All rows of a subject on one side; subjects stratified exactly by their highest label."""
    sides = stratified_split(subject_labels(df, subject, label), [subject], label, share, seed, name)
    return df.join(sides.select(subject, name), subject, "left")


def hard_controls(df: DataFrame, label: str, split: str, kind: str, kinds: Sequence[str], place: str,
                  places: Sequence[str]) -> DataFrame:
    """Drop training controls whose encounter kind and place are both outside the listed sets."""
    hard = F.coalesce(F.col(kind).isin(list(kinds)), F.lit(False)) | F.coalesce(F.col(place).isin(list(places)),
                                                                               F.lit(False))
    return df.where(~((F.col(split) == "train") & (F.col(label) == 0)) | hard)


def downsample_controls(df: DataFrame, keys: Sequence[str], label: str, ratio: float, split: str | None = None,
                        seed: int = 42) -> DataFrame:
    """Keep `ratio` training controls per training case, the first in hash order; other rows all stay.

    Only the training controls are hashed and cut; every row is then judged by a filter. `ratio` 0 keeps no training
    control, and one of more controls than there are keeps them all. Rows without a label or split stay.
    """
    training = (F.col(split) == "train") if split else F.lit(True)
    control = F.coalesce(training & (F.col(label) == 0), F.lit(False))
    cases = df.agg(F.count_if(training & (F.col(label) == 1))).first()[0]
    cut = hash_cuts(df.where(control), keys, seed, [], lambda size: F.lit(math.floor(cases * ratio))).select("cut").first()
    if cut is None:
        return df
    return df.where(~control | (hash_order(seed, *keys) <= F.lit(cut["cut"])))


def cv_folds(df: DataFrame, keys: Sequence[str], label: str, folds: int = 5, seed: int = 42,
             name: str = "fold") -> DataFrame:
    """Fold 1..k, stratified exactly: rank in hash order within the label, modulo k."""
    ranked = hash_rank(df, keys, seed, [label], "_rank")
    return ranked.withColumn(name, (F.col("_rank") - 1) % folds + 1).drop("_rank", "_rank_total")


# Encounter kinds and places of the hard-control filter.
HARD_CONTROL_KINDS = ["EW EMER.", "URGENT", "DIRECT EMER.", "EU OBSERVATION", "OBSERVATION ADMIT"]
HARD_CONTROL_PLACES = ["EMERGENCY ROOM", "WALK-IN/SELF REFERRAL", "TRANSFER FROM HOSPITAL", "CLINIC REFERRAL"]
