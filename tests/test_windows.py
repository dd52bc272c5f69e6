"""Interval joins and windowed features on hand-made rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cohortmill.functions import times
from cohortmill.operators import windows as w

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)
HOUR = dt.timedelta(hours=1)
SPINE = "row_id long, subject long, lo timestamp_ntz, hi timestamp_ntz"
EVENTS = "subject long, ts timestamp_ntz, item long, value double"
KEYS = dict(on=["subject"], row_key="row_id", ts="ts", start="lo", end="hi")


def test_window_is_closed_on_both_ends(spark, rows):
    spine = spark.createDataFrame([(1, 1, T0, T0 + 24 * HOUR)], SPINE)
    second = dt.timedelta(seconds=1)
    at = [T0 - second, T0, T0 + second, T0 + 24 * HOUR, T0 + 24 * HOUR + second, None]
    events = spark.createDataFrame([(1, t, 1, float(i)) for i, t in enumerate(at)], EVENTS)
    out = w.interval_join(events, spine, ["subject"], "ts", "lo", "hi")
    assert [r[0] for r in rows(out, "value")] == [1.0, 2.0, 3.0]


@pytest.mark.parametrize("bin_seconds", [600, 86_400, 86_400 * 400])
def test_interval_join_equals_brute_force(spark, bin_seconds):
    rng = random.Random(5)
    when = lambda: T0 + dt.timedelta(minutes=rng.randrange(-20_000, 20_000))
    spine = []
    for i in range(60):
        lo = when()
        spine.append((i, 1 if i % 3 == 0 else rng.randrange(5), lo, lo + dt.timedelta(minutes=rng.randrange(0, 3000))))
    spine.append((60, 1, T0, T0 - HOUR))  # an empty window
    spine.append((61, 1, None, T0))
    events = [(1 if i % 3 == 0 else rng.randrange(5), when(), 1, float(i)) for i in range(900)]
    got = w.interval_join(spark.createDataFrame(events, EVENTS), spark.createDataFrame(spine, SPINE), ["subject"], "ts",
                          "lo", "hi", bin_seconds)
    want = sorted((e[3], s[0]) for e in events for s in spine
                  if e[0] == s[1] and s[2] is not None and s[2] <= e[1] <= s[3])
    assert sorted((r["value"], r["row_id"]) for r in got.select("value", "row_id").collect()) == want


def test_times_before_1970(spark, rows):
    early = dt.datetime(1969, 12, 31, 23, 0, 0)
    spine = spark.createDataFrame([(1, 1, early, early + 2 * HOUR)], SPINE)
    events = spark.createDataFrame([(1, early + i * HOUR, 1, float(i)) for i in range(-1, 4)], EVENTS)
    out = w.interval_join(events, spine, ["subject"], "ts", "lo", "hi", 3600)
    assert [r[0] for r in rows(out, "value")] == [0.0, 1.0, 2.0]


def test_features_ties_nulls_and_unknown_items(spark):
    spine = spark.createDataFrame([(1, 1, T0, T0 + HOUR), (2, 1, T0 + HOUR, T0 + 2 * HOUR), (3, 9, T0, T0 + HOUR)], SPINE)
    events = spark.createDataFrame([
        (1, T0, 10, 5.0), (1, T0, 10, 3.0), (1, T0 + HOUR, 10, 9.0), (1, T0, 11, None), (1, T0, 11, float("nan")),
        (1, T0, 99, 1.0)], EVENTS)
    stats = ["min", "max", "mean", "first", "median", "count"]
    out = w.windowed_features(events, spine, item="item", value="value", names={10: "a", 11: "b"}, stats=stats, **KEYS)
    got = {r["row_id"]: r.asDict() for r in out.collect()}
    assert set(got) == {1, 2}
    # The event on the shared edge belongs to both windows; equal times go by value.
    assert [got[1][f"a_{s}"] for s in stats] == [3.0, 9.0, pytest.approx(17 / 3), 3.0, 5.0, 3]
    assert [got[2][f"a_{s}"] for s in stats] == [9.0, 9.0, 9.0, 9.0, 9.0, 1]
    assert got[1]["b_first"] is None
    attached = w.attach(spine, out, "row_id").where("row_id = 3").first()
    assert attached["a_first"] is None


def test_text_values_are_coerced(spark):
    spine = spark.createDataFrame([(1, 1, T0, T0 + HOUR)], SPINE)
    events = spark.createDataFrame([(1, T0, 10, "n/a"), (1, T0, 10, "2.5")],
                                   "subject long, ts timestamp_ntz, item long, value string")
    out = w.windowed_features(events, spine, item="item", value="value", names={10: "a"}, stats=["first"], **KEYS)
    assert out.first()["a_first"] == 2.5


def test_first_measurement_is_a_whole_row(spark):
    spine = spark.createDataFrame([(1, 1, T0, T0 + HOUR)], SPINE)
    ecg = spark.createDataFrame([(1, T0, None, 4.0), (1, T0 + HOUR, 1.0, 5.0)],
                                "subject long, ts timestamp_ntz, x double, y double")
    r = w.measurement_features(ecg, spine, columns=["x", "y"], stats=["first", "mean", "median"], prefix="e_", **KEYS).first()
    assert (r["e_x_first"], r["e_y_first"], r["e_count"]) == (None, 4.0, 2)
    assert (r["e_x_mean"], r["e_y_median"]) == (1.0, 4.5)


def test_corrected_interval_needs_a_positive_beat(spark):
    df = spark.createDataFrame([(100.0, 500.0, 1000.0), (100.0, 500.0, 0.0), (100.0, 500.0, -5.0), (100.0, 500.0, None)],
                               "onset double, t_end double, rr double")
    got = [(r["qt_interval"], r["qtc_bazett"]) for r in w.add_interval_measures(df, "onset", "t_end", "rr").collect()]
    assert got == [(400.0, 400.0), (400.0, None), (400.0, None), (400.0, None)]


def test_ratios_only_for_existing_inputs(spark):
    df = spark.createDataFrame([(80.0, 0.0), (80.0, 100.0)], "heart_rate_first double, abp_sys_first double")
    out = w.add_ratios(df, w.CLINICAL_RATIOS, w.CLINICAL_DIFFERENCES)
    assert [r["shock_index_first"] for r in out.collect()] == [None, 0.8]
    assert "bun_creat_ratio" not in out.columns


def test_index_time_rule(spark):
    df = spark.createDataFrame([(T0, None), (T0, T0 - HOUR), (T0, T0), (T0, T0 + HOUR), (None, None), (None, T0)],
                               "main timestamp_ntz, early timestamp_ntz")
    got = [(r[0], r[1]) for r in df.select(times.index_time("main", "early"), times.index_time_source("main", "early")).collect()]
    assert got == [(T0, times.TAG_MAIN), (T0 - HOUR, times.TAG_EARLY), (T0, times.TAG_EARLY), (T0, times.TAG_LATE),
                   (None, times.TAG_MAIN), (None, times.TAG_MAIN)]
    off = df.select(times.index_time("main", "early", False), times.index_time_source("main", "early", False)).collect()
    assert [r[0] for r in off] == [T0, T0, T0, T0, None, None] and {r[1] for r in off} == {times.TAG_MAIN}


def test_censoring(spark):
    day = 24 * HOUR
    df = spark.createDataFrame([
        (1, 1, T0, T0 - HOUR), (2, 1, T0, T0 + HOUR), (3, 1, T0, T0 + 48 * HOUR), (4, 0, T0, T0 + HOUR), (5, 1, T0, None)],
        "id long, label int, start timestamp_ntz, proxy timestamp_ntz")
    out = times.censor_windows(df, "start", "proxy", "label", "report")
    got = {r["id"]: (r["feature_window_end"], r["proxy_time"], r["proxy_source"]) for r in out.collect()}
    assert got == {1: (T0, T0, "report"), 2: (T0 + HOUR, T0 + HOUR, "report"), 3: (T0 + day, T0 + 48 * HOUR, "report"),
                   4: (T0 + day, None, None), 5: (T0 + day, None, None)}
    assert tuple(times.censor_audit(out, "start", "label").first()) == (4, 3, 1)


def test_bands_are_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (55.0,), (55.5,), (65.0,), (200.0,), (201.0,), (None,)], "age double")
    got = [r[0] for r in df.select(times.right_closed_band("age", times.AGE_EDGES, times.AGE_LABELS)).collect()]
    assert got == [None, "<55", "55-64", "55-64", "75+", None, None]


def test_same_answer_for_any_number_of_partitions(spark):
    rng = random.Random(1)
    spine = spark.createDataFrame([(i, i % 4, T0, T0 + 24 * HOUR) for i in range(20)], SPINE)
    events = spark.createDataFrame([(0 if i % 3 == 0 else rng.randrange(4), T0 + dt.timedelta(minutes=rng.randrange(2000)),
                                     rng.randrange(3), float(rng.randrange(100))) for i in range(600)], EVENTS)
    found = []
    for n in ("1", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out = w.windowed_features(events, spine, item="item", value="value", names={0: "a", 1: "b", 2: "c"},
                                  stats=["first", "median"], **KEYS)
        found.append(sorted(map(str, out.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]


def test_hot_subject_in_a_shuffle_join(spark):
    """Without broadcast joins, so the sort-merge path is the one that runs."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        spine = spark.createDataFrame([(i, i % 3, T0, T0 + 24 * HOUR) for i in range(30)], SPINE)
        events = spark.range(3000).select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).cast("long").alias("subject"),
            F.lit(T0).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("item"), F.col("id").cast("double").alias("value"))
        out = w.windowed_features(events, spine, item="item", value="value", names={1: "a"}, stats=["count", "max"], **KEYS)
        got = {r["row_id"]: (r["a_count"], r["a_max"]) for r in out.collect()}
        want = [i for i in range(3000) if (0 if i % 3 == 0 else i % 7) == 0]
        assert got[0] == (len(want), float(max(want)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_skewed_bins_are_split_at_run_time(spark):
    """With a third of the events in one subject and bin, adaptive execution splits that join partition."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB", "spark.sql.shuffle.partitions": "32",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
                "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        events = spark.range(0, 300_000, 1, 16).select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.xxhash64("id") % 5000).cast("long").alias("subject"),
            (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") % 60).cast("int"))).alias("ts"),
            (F.col("id") % 2).alias("item"), (F.xxhash64("id") / 7).alias("value"))
        subjects = events.select("subject").distinct()
        spine = subjects.select(F.col("subject").alias("row_id"), "subject", F.lit(T0).cast("timestamp_ntz").alias("lo"),
                                F.lit(T0 + HOUR).cast("timestamp_ntz").alias("hi"))
        out = w.windowed_features(events, spine, item="item", value="value", names={0: "a", 1: "b"}, stats=["count", "max"], **KEYS)
        n = F.col("a_count") + F.coalesce("b_count", F.lit(0))
        totals = out.agg(F.sum(F.coalesce("a_count", F.lit(0)) + F.coalesce("b_count", F.lit(0))), F.max("a_max"), F.max(n))
        assert tuple(totals.collect()[0])[::2] == (300_000, events.where("subject = 0").count())
        assert "skew=true" in totals._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
