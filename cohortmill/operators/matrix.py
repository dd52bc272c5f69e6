"""From a raw feature table to a model matrix: completeness, missingness, columns, categories, scaling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranks import exact_quantiles, sequence_sums


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no rows left: {what}")
    return df


def require_both_splits(df: DataFrame, split: str) -> DataFrame:
    if df.select(split).where(F.col(split).isin("train", "test")).distinct().count() < 2:
        raise ValueError("expected rows in both the train and the test split")
    return df


def has_measurement(df: DataFrame, count: str) -> DataFrame:
    """Rows whose in-window measurement count is above zero; no count means none."""
    if count not in df.columns:
        raise ValueError(f"{count} is missing from the matrix")
    return df.where(F.coalesce(F.col(count).try_cast("double"), F.lit(0.0)) > 0)


def complete(required: Sequence[str], one_of: Sequence[Sequence[str]] = ()) -> Column:
    """All `required` columns present, and all columns of at least one set in `one_of`."""
    def all_present(columns):
        mask = F.lit(True)
        for c in columns:
            mask = mask & F.col(c).isNotNull()
        return mask
    mask = all_present(required)
    if one_of:
        either = F.lit(False)
        for columns in one_of:
            either = either | all_present(columns)
        mask = mask & either
    return mask


# The two completeness rules of the vital signs.
CORE_VITALS = dict(required=["heart_rate_first", "resp_rate_first"],
                   one_of=[["nibp_sys_first", "nibp_dias_first"], ["abp_sys_first", "abp_dias_first"]])
HEART_AND_BREATH = dict(required=["heart_rate_first", "resp_rate_first"])


def filter_complete(df: DataFrame, required: Sequence[str], one_of: Sequence[Sequence[str]] = ()) -> DataFrame:
    absent = [c for c in [*required, *[c for s in one_of for c in s]] if c not in df.columns]
    if absent:
        raise ValueError(f"completeness columns are missing: {absent}")
    return df.where(complete(required, one_of))


def completeness_counts(df: DataFrame, split: str, label: str, mask: Column) -> DataFrame:
    """Per split: rows and cases before, after and removed by a completeness mask."""
    case = F.col(label) == 1
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows_before"), F.count_if(mask).alias("rows_after"),
        F.count_if(~mask).alias("rows_removed"), F.count_if(case).alias("cases_before"),
        F.count_if(case & mask).alias("cases_after"), F.count_if(case & ~mask).alias("cases_removed"))


def null_share(columns: Sequence[str]) -> Column:
    flags = [F.col(c).isNull().cast("int") for c in columns]
    return sum(flags[1:], flags[0]) / F.lit(len(columns))


def drop_sparse_rows(df: DataFrame, features: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """Rows whose share of null features is at most the threshold."""
    return df.where(null_share(features) <= threshold)


def column_null_rates(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, null_rate), from one aggregation over all columns."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in features])
    return rates.unpivot([], list(features), "feature", "null_rate")


def dense_columns(train: DataFrame, features: Sequence[str], threshold: float = 0.80) -> list[str]:
    """Features whose null rate on the training rows is at most the threshold; apply the list to both splits."""
    rates = {r["feature"]: r["null_rate"] for r in column_null_rates(train, features).collect()}
    return [c for c in features if rates[c] is not None and rates[c] <= threshold]


def drop_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in columns if c in df.columns])


def fixed_features(df: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), preset: str | None = None,
                   presets: Mapping[str, Sequence[str]] = {}) -> DataFrame:
    """Project to a named or given feature list; both at once, an unknown name or a missing column raises."""
    if keep and preset:
        raise ValueError("give either a feature list or a preset, not both")
    if preset:
        if preset not in presets:
            raise ValueError(f"unknown preset: {preset}")
        keep = presets[preset]
    if not keep:
        return df
    absent = [c for c in keep if c not in df.columns]
    if absent:
        raise ValueError(f"features missing from the matrix: {absent}")
    return df.select(*keys, *keep)


# The named feature sets.
FEATURE_PRESETS = {
    "medication_tol0p01": [
        "med_vasodilator_any", "med_beta_blocker_count", "med_vasopressor_any", "encounter_urgency",
        "med_anticoagulant_count", "lactate_median", "platelets_median", "inr_median", "med_opioid_analgesic_count",
        "bun_median", "hemoglobin_median", "med_statin_any", "med_antiplatelet_any", "ecg_count", "hematocrit_median",
        "race", "glucose_median", "wbc_median", "potassium_median", "alt_median", "calcium_total_median",
        "sodium_median", "bicarbonate_median", "magnesium_median", "phosphate_median", "creatinine_median",
        "ecg_t_end_median", "ecg_qrs_onset_median", "ecg_qrs_end_median", "ecg_qtc_bazett_median",
        "ecg_t_axis_median", "med_nonopioid_analgesic_count", "ecg_p_axis_median", "gender", "ecg_p_onset_median",
    ],
    "labs_only_pre_tmux_tol0p01": [
        "encounter_urgency", "lactate_median", "platelets_median", "index_age", "wbc_median",
        "ecg_qt_interval_median", "bun_median", "race", "magnesium_median", "anion_gap_median", "creatinine_median",
        "marital_status", "sodium_median", "ecg_qtc_bazett_median", "ecg_qrs_axis_median", "phosphate_median",
        "bicarbonate_median", "ecg_p_axis_median", "potassium_median", "ecg_qrs_onset_median",
    ],
}


def categorical_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind == "string"]


def fill_categories(df: DataFrame, columns: Sequence[str], missing: str = "MISSING") -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in columns})


def category_dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, code): the distinct values of all given rows, train and test together, numbered in text order."""
    values = df.select(F.col(column).alias("_value")).distinct().withColumn("_one", F.lit(1).cast("long"))
    ranked = sequence_sums(values, ["_value"], {"_upto": "_one"})
    return ranked.select(F.col("_value").alias(column), (F.col("_upto") - 1).alias(f"{column}_code"))


def category_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls to a category of their own, then the position of each value in the sorted list, as `<c>_code`.

    The lists stay on the executors, so a column may have any number of values.
    """
    out = filled = fill_categories(df, columns)
    for c in columns:
        out = out.join(category_dictionary(filled, c), c, "left")
    return out.select(*df.columns, *[f"{c}_code" for c in columns])


def one_hot(df: DataFrame, split: str, columns: Sequence[str]) -> DataFrame:
    """0/1 columns `<column>_<value>` for the training values except the first in order.

    Test rows with a value unseen in training are 0 everywhere. Every value becomes a column, however many there are;
    `category_codes` gives one column of codes, which suits long lists.
    """
    train = df.where(F.col(split) == "train")
    added = {}
    for c in columns:
        values = sorted(r[0] for r in train.select(c).where(F.col(c).isNotNull()).distinct().collect())
        for v in values[1:]:
            added[f"{c}_{v}"] = F.coalesce((F.col(c) == v).cast("int"), F.lit(0))
    return df.withColumns(added).drop(*columns)


def one_hot_slots(df: DataFrame, split: str, columns: Sequence[str]) -> DataFrame:
    """(column, value, slot): the training values of each column except its first in order, numbered through all columns."""
    train = df.where(F.col(split) == "train")
    values = None
    for k, c in enumerate(columns):
        own = train.where(F.col(c).isNotNull()).select(F.lit(k).alias("k"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value")).distinct()
        values = own if values is None else values.union(own)
    first = values.groupBy("k").agg(F.min("value").alias("value"))
    later = values.join(first, ["k", "value"], "left_anti").withColumn("_one", F.lit(1).cast("long"))
    return sequence_sums(later, ["k", "value"], {"_upto": "_one"}).select("column", "value", (F.col("_upto") - 1).alias("slot"))


def one_hot_vector(df: DataFrame, split: str, columns: Sequence[str], into: str = "encoded") -> tuple[DataFrame, DataFrame]:
    """(`df` with one sparse vector of the columns' 0/1 values, the slots): `one_hot` for columns of any number of values.

    The values stay in a table that is joined to the rows; only the number of slots reaches the driver. The first value of a
    column, a null and a test value unseen in training have 0 in all of its slots. Slots are as `one_hot_slots` numbers them.
    """
    slots = cut_lineage(one_hot_slots(df, split, columns))
    sizes = {r["column"]: r["count"] for r in slots.groupBy("column").count().collect()}
    out, numbers, before = df, [], 0
    for k, c in enumerate(columns):
        if c not in sizes:  # one training value or none has no slot
            continue
        number, size = f"_slot{k}", sizes[c]
        own = slots.where(F.col("column") == c).select(F.col("value").alias(f"{number}_value"), (F.col("slot") - before).alias(number))
        # Rows without a slot are given the one behind the column's last, which the encoder drops.
        out = (out.join(own, F.col(c).cast("string") == F.col(f"{number}_value"), "left").drop(f"{number}_value")
               .withColumn(number, F.coalesce(F.col(number), F.lit(size)).cast("double")))
        numbers.append((number, size))
        before += size
    if not numbers:
        return df.withColumn(into, array_to_vector(F.array().cast("array<double>"))).drop(*columns), slots
    names = [n for n, _ in numbers]
    shape = df.sparkSession.createDataFrame([tuple(float(size) for _, size in numbers)], names)
    encoder = OneHotEncoder(inputCols=names, outputCols=[f"{n}_vector" for n in names], dropLast=True).fit(shape)
    assembler = VectorAssembler(inputCols=[f"{n}_vector" for n in names], outputCol=into)
    return assembler.transform(encoder.transform(out)).drop(*names, *[f"{n}_vector" for n in names], *columns), slots


def clipped_scale(df: DataFrame, column: str, name: str, low: float = 0.05, high: float = 0.95,
                  max_rows: int | None = None) -> DataFrame:
    """Min-max scaling between two quantiles, clipped to [0, 1].

    If these coincide, the extremes are used; if those coincide too, every value becomes 0.5. Nulls stay null, NaN becomes
    null and counts nowhere.
    """
    number = F.col(column).cast("double")
    number = F.when(~F.isnan(number), number)
    limits = exact_quantiles(df.where(number.isNotNull()), column, {"lo": low, "hi": high, "least": 0.0, "most": 1.0}, max_rows=max_rows).first()
    if limits is None or limits["n"] is None:
        return df.withColumn(name, F.lit(None).cast("double"))
    close = lambda a, b: abs(a - b) <= 1e-8 + 1e-5 * abs(b)
    lo, hi = limits["lo"], limits["hi"]
    if close(lo, hi):
        lo, hi = limits["least"], limits["most"]
    if close(lo, hi):
        return df.withColumn(name, F.when(number.isNotNull(), F.lit(0.5)))
    clipped = F.when(number < lo, lo).when(number > hi, hi).otherwise(number)
    return df.withColumn(name, F.when(number.isNotNull(), (clipped - lo) / (hi - lo)))


def minmax_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every column to [0, 1] over all rows; a constant column becomes 0.5, NaN becomes null and counts nowhere."""
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c))
    limits = df.agg(*[f(number(c)).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    scaled = {}
    for c in columns:
        lo, hi = limits[f"lo_{c}"], limits[f"hi_{c}"]
        scaled[c] = F.lit(None).cast("double") if lo is None else (
            F.when(number(c).isNotNull(), F.lit(0.5)) if lo == hi else (number(c) - lo) / (hi - lo))
    return df.withColumns(scaled)


def feature_family(name: str, families: Sequence[tuple[str, str, str]], default: str = "other") -> Column:
    """Family of a feature name: the first (kind, text, family) rule that fits; kind is prefix, suffix or name."""
    tests = {"prefix": F.col(name).startswith, "suffix": F.col(name).endswith, "name": lambda t: F.col(name) == t}
    ladder = None
    for kind, text, family in families:
        test = tests[kind](text)
        ladder = F.when(test, family) if ladder is None else ladder.when(test, family)
    return ladder.otherwise(default)


def family_counts(features: DataFrame, name: str, families: Sequence[tuple[str, str, str]]) -> DataFrame:
    return features.groupBy(feature_family(name, families).alias("family")).agg(F.count(F.lit(1)).alias("n"))
