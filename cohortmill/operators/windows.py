"""Interval joins of event tables to a spine, and the features reduced from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import WINDOW_HOURS, epoch_micros, window_end
from ..session import cut_lineage
from .ranks import ROWS_PER_TASK, exact_quantiles

DAY = 86_400
STATS = ("min", "max", "mean", "first", "median", "count")


def _bin(column: str, seconds: int) -> Column:
    if seconds % DAY == 0:
        return F.floor(F.unix_date(F.col(column).cast("date")) / (seconds // DAY))
    return F.floor(epoch_micros(column) / (seconds * 1_000_000))


def interval_join(events: DataFrame, spine: DataFrame, on: Sequence[str], ts: str, start: str, end: str,
                  bin_seconds: int = DAY, hours: int = WINDOW_HOURS) -> DataFrame:
    """Events whose `ts` lies in the closed interval [start, end] of a spine row with the same `on` keys.

    A null end is an open window, which ends `hours` after its start, and is returned as that time.

    Both sides also match on a time bin: a spine row is repeated for the bins its window touches (two for a
    window of one bin), an event has exactly one bin, so every match is found once. An event therefore only
    meets the spine rows near it, not all rows of its subject, and a hot subject is spread over its bins.
    Spark broadcasts the spine when its size allows. Otherwise it is a shuffle join in which adaptive
    execution can split a skewed bin, since no later step reuses its partitioning.

    Choose `bin_seconds` near the usual window length.
    """
    on = list(on)
    bins = (spine.withColumn(end, window_end(start, hours, end)).where((F.col(start) <= F.col(end)))
            .withColumn("_bin", F.explode(F.sequence(_bin(start, bin_seconds), _bin(end, bin_seconds)))))
    keyed = events.where(F.col(ts).isNotNull()).withColumn("_bin", _bin(ts, bin_seconds))
    left = keyed.alias("event")
    right = bins.alias("spine")
    same = F.col("event._bin") == F.col("spine._bin")
    for key in on:
        same = same & (F.col(f"event.{key}") == F.col(f"spine.{key}"))
    inside = F.col(f"event.{ts}").between(F.col(f"spine.{start}"), F.col(f"spine.{end}"))
    return left.join(right, same & inside, "inner").select(
        *[F.col(f"event.{c}") for c in events.columns],
        *[F.col(f"spine.{c}") for c in spine.columns if c not in on])


def named_items(events: DataFrame, item: str, names: Mapping, value: str | None = None,
                feature: str = "feature") -> DataFrame:
    """Keep the listed items, add their feature name, and drop rows whose value is not a number.

    The item list is a plain `IN` filter, which reaches the Parquet scan.
    """
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    kept = events.where(F.col(item).isin(list(names))).withColumn(feature, lookup[F.col(item)])
    if value:
        kept = kept.withColumn(value, F.col(value).try_cast("double"))
        kept = kept.where(F.col(value).isNotNull() & ~F.isnan(value))
    return kept


def _stat(stat: str, value: str, ts: str) -> Column:
    if stat == "min":
        return F.min(value)
    if stat == "max":
        return F.max(value)
    if stat == "mean":
        return F.avg(value)
    if stat == "count":
        return F.count(value)
    if stat == "first":
        # Earliest in the window; events at the same time are ordered by value.
        return F.min_by(value, F.struct(ts, value))
    raise ValueError(f"unknown statistic: {stat}")


def windowed_features(events: DataFrame, spine: DataFrame, on: Sequence[str], row_key: str, ts: str, start: str,
                      end: str, item: str, value: str, names: Mapping, stats: Sequence[str] = ("first",),
                      bin_seconds: int = DAY, rows_per_task: int = ROWS_PER_TASK,
                      median_max_rows: int | None = None) -> DataFrame:
    """One row per `row_key` with in-window events, one `<feature>_<stat>` column per name and statistic.

    Statistics: min, max, mean, first, count (one partial/final aggregation, then a pivot over the known
    names) and median (exact, any group size). Rows without any event are absent: left join back.
    """
    unknown = set(stats) - set(STATS)
    if unknown:
        raise ValueError(f"unknown statistics: {sorted(unknown)}")
    keyed = named_items(events, item, names, value).select(*on, ts, "feature", value)
    windows = spine.select(*dict.fromkeys([*on, row_key, start, end]))
    joined = interval_join(keyed, windows, on, ts, start, end, bin_seconds)
    features = list(dict.fromkeys(names.values()))
    simple = [s for s in stats if s != "median"]
    if simple and "median" in stats:
        joined = cut_lineage(joined)  # two reductions follow; scan and join the events once
    wide = None
    if simple:
        cells = joined.groupBy(row_key, "feature").agg(*[_stat(s, value, ts).alias(s) for s in simple])
        wide = _spread(cells, row_key, features, simple)
    if "median" in stats:
        cells = exact_quantiles(joined, value, {"median": 0.5}, [row_key, "feature"],
                                max_rows=median_max_rows, rows_per_task=rows_per_task)
        medians = _spread(cells, row_key, features, ["median"])
        wide = medians if wide is None else wide.join(medians, row_key, "full")
    return wide.select(row_key, *[f"{f}_{s}" for f in features for s in stats])


def _spread(cells: DataFrame, row_key: str, features: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """One row per (row, feature) to one row per row key; the feature list is known, so no extra job."""
    pivoted = cells.groupBy(row_key).pivot("feature", list(features)).agg(*[F.first(s).alias(s) for s in stats])
    if len(stats) == 1:
        for f in features:
            pivoted = pivoted.withColumnRenamed(f, f"{f}_{stats[0]}")
    return pivoted


def measurement_features(measures: DataFrame, spine: DataFrame, on: Sequence[str], row_key: str, ts: str,
                         start: str, end: str, columns: Sequence[str], stats: Sequence[str] = ("first",),
                         prefix: str = "", bin_seconds: int = DAY, rows_per_task: int = ROWS_PER_TASK,
                         median_max_rows: int | None = None) -> DataFrame:
    """The same for a wide table with one row per measurement, plus `<prefix>count`, the in-window rows.

    `first` takes the earliest row as a whole: its nulls stay null. Rows at the same time are ordered by
    their values. NaN in a measurement is a null.
    """
    floats = {c for c, kind in measures.dtypes if kind in ("double", "float")}
    kept = measures.select(*on, ts, *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else c for c in columns])
    windows = spine.select(*dict.fromkeys([*on, row_key, start, end]))
    joined = interval_join(kept, windows, on, ts, start, end, bin_seconds)
    if "median" in stats:
        joined = cut_lineage(joined)  # two reductions follow; scan and join the measurements once
    aggs = [F.count(F.lit(1)).alias(f"{prefix}count")]
    if "first" in stats:
        aggs.append(F.min_by(F.struct(*columns), F.struct(ts, *columns)).alias("_first"))
    for stat in ("min", "max", "mean"):
        if stat in stats:
            aggs += [_stat(stat, c, ts).alias(f"{prefix}{c}_{stat}") for c in columns]
    wide = joined.groupBy(row_key).agg(*aggs)
    if "first" in stats:
        wide = wide.withColumns({f"{prefix}{c}_first": F.col(f"_first.{c}") for c in columns}).drop("_first")
    if "median" in stats:
        long = joined.unpivot([row_key], list(columns), "feature", "value")
        cells = exact_quantiles(long, "value", {"median": 0.5}, [row_key, "feature"],
                                max_rows=median_max_rows, rows_per_task=rows_per_task)
        medians = _spread(cells, row_key, columns, ["median"])
        for c in columns:
            medians = medians.withColumnRenamed(f"{c}_median", f"{prefix}{c}_median")
        wide = wide.join(medians, row_key, "left")
    return wide.select(row_key, f"{prefix}count", *[f"{prefix}{c}_{s}" for c in columns for s in stats])


def add_interval_measures(measures: DataFrame, onset: str, end: str, rr: str, interval: str = "qt_interval",
                          corrected: str = "qtc_bazett") -> DataFrame:
    """`end - onset`, and the same over the square root of the beat length in seconds, null if that is <= 0."""
    beat = F.when(F.col(rr) > 0, F.col(rr) / 1000)
    return (measures.withColumn(interval, F.col(end) - F.col(onset))
            .withColumn(corrected, F.col(interval) / F.sqrt(beat)))


def qualified_visits(visits: DataFrame, measures: DataFrame, on: Sequence[str], row_key: str, ts: str, start: str,
                     end: str, bin_seconds: int = DAY) -> DataFrame:
    """Visits with at least one in-window measurement, with its first time and the count."""
    windows = visits.select(*dict.fromkeys([*on, row_key, start, end]))
    found = (interval_join(measures.select(*on, ts), windows, on, ts, start, end, bin_seconds)
             .groupBy(row_key).agg(F.min(ts).alias("first_time"), F.count(F.lit(1)).alias("n_in_window")))
    return visits.join(found, row_key, "inner")


def add_ratios(matrix: DataFrame, ratios: Mapping[str, tuple[str, str]] = {},
               differences: Mapping[str, tuple[str, str]] = {}) -> DataFrame:
    """Derived columns, each only if both inputs exist. A zero denominator gives null."""
    have = set(matrix.columns)
    added = {name: F.try_divide(F.col(a), F.col(b)) for name, (a, b) in ratios.items() if {a, b} <= have}
    added |= {name: F.col(a) - F.col(b) for name, (a, b) in differences.items() if {a, b} <= have}
    return matrix.withColumns(added) if added else matrix


# The derived clinical columns.
CLINICAL_RATIOS = {
    "shock_index_first": ("heart_rate_first", "abp_sys_first"),
    "bun_creat_ratio": ("bun_mean", "creatinine_mean"),
}
CLINICAL_DIFFERENCES = {"pulse_pressure_mean": ("abp_sys_mean", "abp_dias_mean")}


def attach(spine: DataFrame, features: DataFrame, row_key: str, fill: Mapping[str, object] | None = None) -> DataFrame:
    """Left join of features back to the spine, optionally filling columns of rows without events."""
    joined = spine.join(features, row_key, "left")
    return joined.fillna(dict(fill)) if fill else joined


def scan_audit(events: DataFrame, spine: DataFrame, on: Sequence[str], row_key: str, ts: str, start: str,
               end: str, bin_seconds: int = DAY) -> DataFrame:
    """(metric, n): event rows of cohort members, event-window matches, and spine rows with any match."""
    members = spine.select(*on).distinct()
    matched = events.join(members, list(on), "left_semi").agg(
        F.lit("cohort_rows").alias("metric"), F.count(F.lit(1)).alias("n"))
    windows = spine.select(*dict.fromkeys([*on, row_key, start, end]))
    per_row = (interval_join(events.select(*on, ts), windows, on, ts, start, end, bin_seconds)
               .groupBy(row_key).agg(F.count(F.lit(1)).alias("n")))
    inside = per_row.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in_window"),
                         F.count(F.lit(1)).alias("rows_with_any")).unpivot([], ["rows_in_window", "rows_with_any"],
                                                                           "metric", "n")
    return matched.unionByName(inside)
