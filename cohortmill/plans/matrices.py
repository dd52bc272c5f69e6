"""Feature matrices and scoring frames as single plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DRUG_GROUPS, joined_text
from ..operators import matrix as x
from ..operators.joins import many_to_one, one_to_one
from ..operators.windows import (CLINICAL_DIFFERENCES, CLINICAL_RATIOS, add_interval_measures, add_ratios, attach,
                                 measurement_features, windowed_features)
from ..session import cut_lineage
from ..sources.readers import ECG_COLUMNS, LABS, VITALS
from .notes import drug_features


@dataclass
class EventFeatures:
    """A long event table and the items to take from it."""
    events: DataFrame
    names: Mapping
    item: str = "itemid"
    value: str = "valuenum"
    ts: str = "charttime"


def raw_matrix(spine: DataFrame, sources: Sequence[EventFeatures], on: Sequence[str], row_key: str, start: str, end: str,
               stats: Sequence[str] = ("first",), ecg: DataFrame | None = None, orders: DataFrame | None = None,
               order_text: Column | None = None, drug_groups: Mapping | None = None,
               bin_seconds: int = 86_400) -> DataFrame:
    """Spine with the features of every source. The spine is computed once, since every source joins it; each
    source is reduced to one row per spine row before it is attached, so all attaching joins are on the row key."""
    out = spine = cut_lineage(spine)
    for source in sources:
        wide = windowed_features(source.events, spine, on, row_key, source.ts, start, end, source.item, source.value,
                                 source.names, stats, bin_seconds)
        out = attach(out, wide, row_key)
    if ecg is not None:
        measured = add_interval_measures(ecg, "qrs_onset", "t_end", "rr_interval")
        wide = measurement_features(measured, spine, on, row_key, "ecg_time", start, end,
                                    [*ECG_COLUMNS, "qt_interval", "qtc_bazett"], stats, "ecg_", bin_seconds)
        out = attach(out, wide, row_key)
    if orders is not None:
        text = joined_text("drug", "formulary_drug_cd", "route") if order_text is None else order_text
        groups = DRUG_GROUPS if drug_groups is None else drug_groups
        drugs = drug_features(orders, spine.select(row_key, *[c for c in (*on, "hadm_id") if c in spine.columns and c != row_key],
                                                   start, end), [c for c in (*on, "hadm_id") if c in spine.columns],
                              row_key, "starttime", start, end, text, groups, bin_seconds=bin_seconds)
        out = out.join(drugs.select(row_key, *[c for c in drugs.columns if c.startswith("med_")]), row_key, "left")
    return add_ratios(out, CLINICAL_RATIOS, CLINICAL_DIFFERENCES)


def clinical_matrix(spine: DataFrame, vitals: DataFrame, labs: DataFrame, ecg: DataFrame | None = None,
                    orders: DataFrame | None = None, stats: Sequence[str] = ("first",), row_key: str = "subject_id") -> DataFrame:
    return raw_matrix(spine, [EventFeatures(vitals, VITALS), EventFeatures(labs, LABS)], ["subject_id"], row_key,
                      "index_time", "feature_window_end", stats, ecg, orders)


@dataclass
class MatrixRules:
    """How a raw matrix becomes a model matrix."""
    keys: Sequence[str]
    label: str
    split: str = "cohort_split"
    categories: Sequence[str] = ()
    ignore: Sequence[str] = ()
    require_count: str | None = None
    row_threshold: float = 0.95
    column_threshold: float = 0.80
    leakage: Sequence[str] = ()
    drop: Sequence[str] = ()
    keep: Sequence[str] = ()
    preset: str | None = None
    presets: Mapping[str, Sequence[str]] = field(default_factory=lambda: x.FEATURE_PRESETS)
    encode: bool = False


# Feature columns that tell about test ordering.
LEAKAGE_COLUMNS = [
    "ddimer_min", "ddimer_max", "ddimer_mean", "troponin_t_min", "troponin_t_max", "troponin_t_mean",
    "troponin_i_min", "troponin_i_max", "troponin_i_mean", "crp_min", "crp_max", "crp_mean",
    "fibrinogen_min", "fibrinogen_max", "fibrinogen_mean", "ddimer_median", "troponin_t_median",
    "troponin_i_median", "crp_median", "fibrinogen_median",
]


def model_matrix(raw: DataFrame, rules: MatrixRules) -> tuple[DataFrame, list[str]]:
    """(matrix with keys, split, label and features; feature names).

    In order: measurement filter, row missingness over the numeric features, leakage columns, column
    missingness on training rows, missing categories, configured drops, the fixed feature set.
    """
    fixed = {*rules.keys, rules.label, rules.split, *rules.ignore}
    categories = [c for c in rules.categories if c in raw.columns]
    features = [c for c in raw.columns if c not in fixed and c not in categories]
    out = x.has_measurement(raw, rules.require_count) if rules.require_count else raw
    # The checks and the column decisions below are jobs of their own, so the raw matrix is computed once here.
    out = cut_lineage(x.drop_sparse_rows(out, features, rules.row_threshold))
    x.require_both_splits(out, rules.split)
    features = [f for f in features if f not in set(rules.leakage)]
    train = out.where(F.col(rules.split) == "train")
    features = x.dense_columns(train, features, rules.column_threshold)
    ids = [*rules.keys, rules.split, rules.label]
    out = out.select(*ids, *categories, *features)
    # Only categories that stay as they are get one for nulls; a null has 0 in all encoded columns.
    out = x.one_hot(out, rules.split, categories) if rules.encode else x.fill_categories(out, categories)
    out = x.drop_present(out, [c for c in rules.drop if c not in ids])
    out = x.fixed_features(out, ids, rules.keep, rules.preset, rules.presets)
    return out, [c for c in out.columns if c not in ids]


def scoring_frame(predictions: DataFrame, matrix: DataFrame, labels: DataFrame, keys: Sequence[str],
                  group: Column | None = None) -> DataFrame:
    """Predictions with the matrix row and the reviewed labels of the same key, and a display group."""
    joined = one_to_one(predictions, matrix, keys)
    joined = many_to_one(joined, labels, keys, require_match=False)
    return joined.withColumn("phenotype_group", group) if group is not None else joined
