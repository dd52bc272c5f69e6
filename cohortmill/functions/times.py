"""Index times, feature windows and other date arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The window length in hours and the tags of the index-time rule.
WINDOW_HOURS = 24
TAG_EARLY = "edregtime"
TAG_MAIN = "admittime"
TAG_LATE = "admittime_edregtime_after_admit"


def lenient_timestamp(column: str, fmt: str | None = None) -> Column:
    """Text to timestamp, null where it does not parse."""
    return F.try_to_timestamp(F.col(column), F.lit(fmt)) if fmt else F.col(column).try_cast("timestamp_ntz")


def index_time(main: str, early: str, use_early: bool = True) -> Column:
    """The early time where it is present and not after the main time, else the main time."""
    if not use_early:
        return F.col(main)
    return F.when(F.col(early) <= F.col(main), F.col(early)).otherwise(F.col(main))


def index_time_source(main: str, early: str, use_early: bool = True) -> Column:
    """Which time `index_time` took: early, main, or main because the early one came after it."""
    if not use_early:
        return F.lit(TAG_MAIN)
    return (F.when(F.col(early) <= F.col(main), F.lit(TAG_EARLY))
            .when(F.col(early) > F.col(main), F.lit(TAG_LATE)).otherwise(F.lit(TAG_MAIN)))


def plus_hours(column: str, hours: int) -> Column:
    return F.col(column) + F.make_dt_interval(F.lit(0), F.lit(hours))


def window_end(start: str, hours: int = WINDOW_HOURS, known_end: str | None = None) -> Column:
    """`start` + hours, or `known_end` where that is not null."""
    default = plus_hours(start, hours)
    return F.coalesce(F.col(known_end), default) if known_end else default


def age_at(start: str, anchor_age: str, anchor_year: str) -> Column:
    return F.col(anchor_age) + (F.year(F.col(start)) - F.col(anchor_year))


def censor_windows(spine: DataFrame, start: str, proxy: str, label: str, source: str,
                   hours: int = WINDOW_HOURS) -> DataFrame:
    """End a case's window at its proxy time, which counts from `start` at the earliest.

    Adds `feature_window_end`, `proxy_time` and `proxy_source`; controls and rows without proxy keep the
    default end and null proxies.
    """
    censored = (F.col(label) == 1) & F.col(proxy).isNotNull()
    bounded = F.when(censored, F.greatest(F.col(proxy), F.col(start)))
    return spine.withColumns({
        "feature_window_end": F.least(window_end(start, hours), bounded),
        "proxy_time": bounded,
        "proxy_source": F.when(censored, F.lit(source)),
    })


def censor_audit(censored: DataFrame, start: str, label: str) -> DataFrame:
    """One row: cases, cases with a proxy, and those whose proxy is at or before the start."""
    return censored.agg(
        F.count_if(F.col(label) == 1).alias("cases"),
        F.count_if(F.col("proxy_time").isNotNull()).alias("censored"),
        F.count_if(F.col("proxy_time") == F.col(start)).alias("at_or_before_start"))


def micros_between(start: Column, end: Column) -> Column:
    """Microseconds from start to end as wall-clock times, whatever the session time zone."""
    span = end.cast("timestamp_ntz") - start.cast("timestamp_ntz")
    part = lambda unit: F.extract(F.lit(unit), span)
    whole = (part("DAY").cast("long") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return whole * 60_000_000 + (part("SECOND") * 1_000_000).cast("long")


def epoch_micros(column: str) -> Column:
    return micros_between(F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(column))


def hours_between(start: str, end: str) -> Column:
    """Float hours from start to end, fractions of a second included."""
    return micros_between(F.col(start), F.col(end)) / F.lit(3_600_000_000.0)


def synthetic_key(prefix: str, subject: str, ts: str) -> Column:
    """`PREFIX_subject_yyyyMMddHHmm`, the key of a visit that has no admission."""
    return F.concat_ws("_", F.lit(prefix), F.col(subject).cast("string"), F.date_format(F.col(ts), "yyyyMMddHHmm"))


def right_closed_band(column: str, edges: list[float], labels: list[str]) -> Column:
    """Label of the interval (edge, next edge] that holds the value; null outside all of them."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per interval is needed")
    value, band = F.col(column), None
    for low, high, label in zip(edges, edges[1:], labels):
        inside = (value > low) & (value <= high)
        band = F.when(inside, label) if band is None else band.when(inside, label)
    return band


# Band edges and labels of the subgroup and timing reports. An age of 55 falls in "<55".
AGE_EDGES, AGE_LABELS = [0, 55, 65, 75, 200], ["<55", "55-64", "65-74", "75+"]
TIMING_EDGES, TIMING_LABELS = [-0.001, 2, 6, 12, 24], ["0-2h", "2-6h", "6-12h", "12-24h"]
