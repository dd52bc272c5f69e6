"""Interval joins and windowed features on the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import (TIMING_EDGES, TIMING_LABELS, age_at, censor_audit, censor_windows, hours_between,
                               index_time, index_time_source, plus_hours, right_closed_band, synthetic_key,
                               window_end)
from ..operators import windows as w
from .common import EVENT_TYPES, SPINE_SQL, event_spine, query, rounded, table

TYPES = list(EVENT_TYPES)
KEYS = dict(on=["user_id"], row_key="user_id", ts="ts", start="index_time", end="window_end")
JOINED_SQL = SPINE_SQL + """,
j AS (SELECT s.user_id, s.index_time, s.label, e.ts, e.event_type, e.value
      FROM events e JOIN spine s ON e.user_id = s.user_id AND e.ts BETWEEN s.index_time AND s.window_end)"""


def wide_sql(*stats: str) -> str:
    """One column per event type and statistic over `j`."""
    forms = {
        "min": "min(value)", "max": "max(value)", "mean": "round(avg(value), 6)", "count": "count(value)",
        "first": "arg_min(value, row(ts, value))", "median": "round(median(value), 6)"}
    parts = []
    for t in TYPES:
        for s in stats:
            expr = forms[s]
            where = f" FILTER (WHERE event_type = '{t}')"
            if expr.startswith("round("):
                expr = f"round({expr[6:-4]}{where}, 6)"
            else:
                expr += where
            parts.append(f'{expr} AS {t}_{s}')
    return ", ".join(parts)


def features(spark, sf, stats):
    return w.windowed_features(table(spark, sf, "events"), event_spine(spark, sf), item="event_type",
                               value="value", names=EVENT_TYPES, stats=stats, **KEYS)


@query("first_value_features", f"""WITH {JOINED_SQL}, f AS (
  SELECT user_id, {wide_sql('first')} FROM j GROUP BY user_id)
SELECT s.user_id, s.index_time, s.window_end, s.label, f.* EXCLUDE (user_id)
FROM spine s LEFT JOIN f ON s.user_id = f.user_id""")
def first_value_features(spark, sf):
    return w.attach(event_spine(spark, sf), features(spark, sf, ["first"]), "user_id")


OPEN_SQL = SPINE_SQL + """,
ends AS (SELECT user_id, index_time, CASE WHEN user_id % 3 = 0 THEN index_time + INTERVAL 6 HOUR END AS window_end FROM spine),
j AS (SELECT s.user_id, e.ts, e.event_type, e.value FROM events e JOIN ends s ON e.user_id = s.user_id
      AND e.ts BETWEEN s.index_time AND coalesce(s.window_end, s.index_time + INTERVAL 24 HOUR))"""


def open_spine(spark, sf):
    """The spine with an end of its own, six hours on, for a third of its rows, and none for the others."""
    ends = F.when(F.col("user_id") % 3 == 0, plus_hours("index_time", 6))
    return event_spine(spark, sf).withColumn("window_end", ends)


@query("features_with_open_window", f"WITH {OPEN_SQL} SELECT user_id, {wide_sql('first', 'mean', 'max')} FROM j GROUP BY user_id")
def features_with_open_window(spark, sf):
    out = w.windowed_features(table(spark, sf, "events"), open_spine(spark, sf), item="event_type", value="value", names=EVENT_TYPES,
                              stats=["first", "mean", "max"], **KEYS)
    return rounded(out, *[f"{t}_mean" for t in TYPES])


@query("stat_features", f"WITH {JOINED_SQL} SELECT user_id, {wide_sql('min', 'max', 'mean')} FROM j GROUP BY user_id")
def stat_features(spark, sf):
    return rounded(features(spark, sf, ["min", "max", "mean"]), *[f"{t}_mean" for t in TYPES])


@query("stat_and_first_features",
       f"WITH {JOINED_SQL} SELECT user_id, {wide_sql('min', 'max', 'mean', 'first')} FROM j GROUP BY user_id")
def stat_and_first_features(spark, sf):
    return rounded(features(spark, sf, ["min", "max", "mean", "first"]), *[f"{t}_mean" for t in TYPES])


@query("median_features", f"WITH {JOINED_SQL} SELECT user_id, {wide_sql('median')} FROM j GROUP BY user_id")
def median_features(spark, sf):
    return rounded(features(spark, sf, ["median"]), *[f"{t}_median" for t in TYPES])


@query("median_features_bucketed",
       f"WITH {JOINED_SQL} SELECT user_id, {wide_sql('median')} FROM j GROUP BY user_id")
def median_features_bucketed(spark, sf):
    """The same through the bucketed order, which takes over beyond `rows_per_task` rows."""
    wide = w.windowed_features(table(spark, sf, "events"), event_spine(spark, sf), item="event_type",
                               value="value", names=EVENT_TYPES, stats=["median"], rows_per_task=3, **KEYS)
    return rounded(wide, *[f"{t}_median" for t in TYPES])


@query("event_counts", f"""WITH {JOINED_SQL} SELECT s.user_id, coalesce(c.n, 0) AS n_events
FROM spine s LEFT JOIN (SELECT user_id, count(*) AS n FROM j GROUP BY user_id) c ON s.user_id = c.user_id""")
def event_counts(spark, sf):
    joined = w.interval_join(table(spark, sf, "events").select("user_id", "ts"), event_spine(spark, sf),
                             ["user_id"], "ts", "index_time", "window_end")
    counts = joined.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"))
    return w.attach(event_spine(spark, sf).select("user_id"), counts, "user_id", {"n_events": 0})


@query("interval_join_rows", f"WITH {JOINED_SQL} SELECT user_id, ts, event_type, value, index_time FROM j")
def interval_join_rows(spark, sf):
    joined = w.interval_join(table(spark, sf, "events"), event_spine(spark, sf), ["user_id"], "ts",
                             "index_time", "window_end")
    return joined.select("user_id", "ts", "event_type", "value", "index_time")


# Several windows per subject: every order opens one of 200 days, and features stay with their order.
ORDER_SPINE_SQL = """
spine AS (SELECT o_orderkey, o_custkey, o_orderdate AS index_time, o_orderdate + INTERVAL 4800 HOUR AS window_end
          FROM orders WHERE o_orderpriority = '1-URGENT'),
ship AS (SELECT o.o_custkey, l.l_shipdate, l.l_linenumber, l.l_quantity, l.l_extendedprice, l.l_orderkey
         FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
j AS (SELECT s.o_orderkey, s.index_time, p.l_shipdate, p.l_linenumber, p.l_quantity, p.l_extendedprice
      FROM ship p JOIN spine s ON p.o_custkey = s.o_custkey AND p.l_shipdate BETWEEN s.index_time AND s.window_end)"""
ORDER_HOURS = 4800


def order_spine(spark, sf):
    urgent = table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    return urgent.select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("index_time"),
                         window_end("o_orderdate", ORDER_HOURS).alias("window_end"))


def shipments(spark, sf):
    owners = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return (table(spark, sf, "lineitem").join(owners, F.col("l_orderkey") == F.col("o_orderkey"))
            .select("o_custkey", "l_orderkey", "l_shipdate", "l_linenumber", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax"))


BY_ORDER = dict(on=["o_custkey"], row_key="o_orderkey", ts="l_shipdate", start="index_time", end="window_end",
                bin_seconds=ORDER_HOURS * 3600)


@query("first_features_by_encounter", f"""WITH {ORDER_SPINE_SQL}
SELECT o_orderkey, """ + ", ".join(
    f"arg_min(l_quantity, row(l_shipdate, l_quantity)) FILTER (WHERE l_linenumber = {i}) AS line_{i}_first"
    for i in (1, 2, 3)) + " FROM j WHERE l_linenumber IN (1, 2, 3) GROUP BY o_orderkey")
def first_features_by_encounter(spark, sf):
    return w.windowed_features(shipments(spark, sf), order_spine(spark, sf), item="l_linenumber",
                               value="l_quantity", names={i: f"line_{i}" for i in (1, 2, 3)},
                               stats=["first"], **BY_ORDER)


MEASURES = ["l_quantity", "l_extendedprice"]
MEASURE_FIRST = ", ".join(
    f"arg_min({c}, row(l_shipdate, l_quantity, l_extendedprice)) AS m_{c}_first" for c in MEASURES)
MEASURE_STATS = ", ".join(
    f"min({c}) AS m_{c}_min, max({c}) AS m_{c}_max, round(avg({c}), 6) AS m_{c}_mean" for c in MEASURES)


@query("measurement_first", f"""WITH {ORDER_SPINE_SQL}
SELECT o_orderkey, count(*) AS m_count, {MEASURE_FIRST} FROM j GROUP BY o_orderkey""")
def measurement_first(spark, sf):
    return w.measurement_features(shipments(spark, sf), order_spine(spark, sf), columns=MEASURES,
                                  stats=["first"], prefix="m_", **BY_ORDER)


@query("measurement_stats", f"""WITH {ORDER_SPINE_SQL}
SELECT o_orderkey, count(*) AS m_count, {MEASURE_STATS} FROM j GROUP BY o_orderkey""")
def measurement_stats(spark, sf):
    wide = w.measurement_features(shipments(spark, sf), order_spine(spark, sf), columns=MEASURES,
                                  stats=["min", "max", "mean"], prefix="m_", **BY_ORDER)
    return rounded(wide, *[f"m_{c}_mean" for c in MEASURES])


@query("measurement_median", f"""WITH {ORDER_SPINE_SQL}
SELECT o_orderkey, count(*) AS m_count, """ + ", ".join(
    f"round(median({c}), 4) AS m_{c}_median" for c in MEASURES) + " FROM j GROUP BY o_orderkey")
def measurement_median(spark, sf):
    wide = w.measurement_features(shipments(spark, sf), order_spine(spark, sf), columns=MEASURES,
                                  stats=["median"], prefix="m_", **BY_ORDER)
    return rounded(wide, *[f"m_{c}_median" for c in MEASURES], digits=4)


@query("qualified_visits", f"""WITH {ORDER_SPINE_SQL}
SELECT o_orderkey, o_custkey, s.index_time, window_end, first_time, n_in_window FROM spine s
JOIN (SELECT o_orderkey, min(l_shipdate) AS first_time, count(*) AS n_in_window FROM j GROUP BY o_orderkey) f
USING (o_orderkey)""")
def qualified_visits(spark, sf):
    return w.qualified_visits(order_spine(spark, sf), shipments(spark, sf), **BY_ORDER)


@query("scan_audit", f"""WITH {ORDER_SPINE_SQL}
SELECT 'cohort_rows' AS metric, count(*) AS n FROM ship WHERE o_custkey IN (SELECT o_custkey FROM spine)
UNION ALL SELECT 'rows_in_window', count(*) FROM j
UNION ALL SELECT 'rows_with_any', count(DISTINCT o_orderkey) FROM j""")
def scan_audit(spark, sf):
    return w.scan_audit(shipments(spark, sf), order_spine(spark, sf), **BY_ORDER)


@query("interval_measures", """SELECT l_orderkey, l_partkey, l_linenumber, l_quantity,
  l_extendedprice - l_quantity AS qt_interval,
  round((l_extendedprice - l_quantity) / sqrt(CASE WHEN l_quantity - 10 > 0 THEN (l_quantity - 10) / 1000 END), 4)
    AS qtc_bazett FROM lineitem""")
def interval_measures(spark, sf):
    lines = (table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
                                                 "l_extendedprice")
             .withColumn("beat", F.col("l_quantity") - 10))
    out = w.add_interval_measures(lines, "l_quantity", "l_extendedprice", "beat").drop("beat", "l_extendedprice")
    return rounded(out, "qtc_bazett", digits=4)


@query("ratio_features", f"""WITH {JOINED_SQL}, f AS (SELECT user_id, {wide_sql('first')} FROM j GROUP BY user_id)
SELECT user_id, round(click_first / nullif(view_first, 0), 6) AS click_view_ratio,
       round(click_first - error_first, 6) AS click_error_gap FROM f""")
def ratio_features(spark, sf):
    wide = w.add_ratios(features(spark, sf, ["first"]), {"click_view_ratio": ("click_first", "view_first"),
                                                         "absent": ("click_first", "no_such_column")},
                        {"click_error_gap": ("click_first", "error_first")})
    return rounded(wide.select("user_id", "click_view_ratio", "click_error_gap"),
                   "click_view_ratio", "click_error_gap")


# Index time: the first shipment of an order stands in for the early time, the order date for the main one.
ADMISSIONS_SQL = """
early AS (SELECT l_orderkey, min(l_shipdate) AS early FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey),
adm AS (SELECT o_orderkey, o_custkey, o_orderdate AS main, early,
               CASE WHEN early <= o_orderdate THEN early ELSE o_orderdate END AS index_time
        FROM orders LEFT JOIN early ON o_orderkey = l_orderkey)"""


def admissions(spark, sf):
    early = (table(spark, sf, "lineitem").where(F.col("l_linenumber") <= 2)
             .groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("early")))
    return (table(spark, sf, "orders").join(early, "o_orderkey", "left")
            .select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("main"), "early")
            .withColumn("index_time", index_time("main", "early")))


@query("index_time_choice", f"""WITH {ADMISSIONS_SQL}
SELECT o_orderkey, index_time, CASE WHEN early <= main THEN 'edregtime'
  WHEN early > main THEN 'admittime_edregtime_after_admit' ELSE 'admittime' END AS index_time_source,
  index_time + INTERVAL 24 HOUR AS window_end, CAST(40 + year(index_time) - 1995 AS BIGINT) AS index_age FROM adm
WHERE 40 + year(index_time) - 1995 >= 42""")
def index_time_choice(spark, sf):
    rows = admissions(spark, sf).withColumns({"anchor_age": F.lit(40), "anchor_year": F.lit(1995)})
    return (rows.select("o_orderkey", "index_time", index_time_source("main", "early").alias("index_time_source"),
                        plus_hours("index_time", 24).alias("window_end"),
                        age_at("index_time", "anchor_age", "anchor_year").cast("long").alias("index_age"))
            .where(F.col("index_age") >= 42))


CENSOR_SQL = """
proxy AS (SELECT l_orderkey, min(l_shipdate) AS proxy FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey),
base AS (SELECT o_orderkey, o_orderdate AS index_time, CAST(o_orderstatus = 'F' AS INTEGER) AS label, proxy
         FROM orders LEFT JOIN proxy ON o_orderkey = l_orderkey),
c AS (SELECT o_orderkey, index_time, label,
        CASE WHEN label = 1 AND proxy IS NOT NULL THEN greatest(proxy, index_time) END AS proxy_time,
        CASE WHEN label = 1 AND proxy IS NOT NULL
             THEN least(index_time + INTERVAL 4800 HOUR, greatest(proxy, index_time))
             ELSE index_time + INTERVAL 4800 HOUR END AS feature_window_end FROM base)"""


def censored(spark, sf):
    proxy = (table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R")
             .groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("proxy")))
    base = (table(spark, sf, "orders").join(proxy, "o_orderkey", "left")
            .select("o_orderkey", F.col("o_orderdate").alias("index_time"),
                    (F.col("o_orderstatus") == "F").cast("int").alias("label"), "proxy"))
    return censor_windows(base, "index_time", "proxy", "label", "returned_shipment", ORDER_HOURS)


@query("censored_window", f"""WITH {CENSOR_SQL} SELECT o_orderkey, feature_window_end, proxy_time,
  CASE WHEN proxy_time IS NOT NULL THEN 'returned_shipment' END AS proxy_source FROM c""")
def censored_window(spark, sf):
    return censored(spark, sf).select("o_orderkey", "feature_window_end", "proxy_time", "proxy_source")


@query("censor_audit", f"""WITH {CENSOR_SQL} SELECT count(*) FILTER (WHERE label = 1) AS cases,
  count(proxy_time) AS censored, count(*) FILTER (WHERE proxy_time = index_time) AS at_or_before_start FROM c""")
def censor_audit_counts(spark, sf):
    return censor_audit(censored(spark, sf), "index_time", "label")


@query("default_window_end", """SELECT event_id,
  coalesce(CASE WHEN event_type = 'click' THEN ts + INTERVAL 1 HOUR END, ts + INTERVAL 24 HOUR) AS window_end
FROM events""")
def default_window_end(spark, sf):
    known = table(spark, sf, "events").withColumn(
        "known", F.when(F.col("event_type") == "click", plus_hours("ts", 1)))
    return known.select("event_id", window_end("ts", 24, "known").alias("window_end"))


@query("hours_to_first", f"""WITH {JOINED_SQL}, f AS (
  SELECT user_id, min(index_time) AS index_time, min(ts) FILTER (WHERE event_type = 'click') AS first_time
  FROM j GROUP BY user_id),
h AS (SELECT user_id, epoch_us(first_time - index_time) / 3600000000.0 AS hours FROM f)
SELECT user_id, round(hours, 6) AS hours, CASE WHEN hours > -0.001 AND hours <= 2 THEN '0-2h'
  WHEN hours > 2 AND hours <= 6 THEN '2-6h' WHEN hours > 6 AND hours <= 12 THEN '6-12h'
  WHEN hours > 12 AND hours <= 24 THEN '12-24h' END AS timing_bin FROM h""")
def hours_to_first(spark, sf):
    joined = w.interval_join(table(spark, sf, "events"), event_spine(spark, sf), ["user_id"], "ts",
                             "index_time", "window_end")
    firsts = joined.groupBy("user_id").agg(
        F.min("index_time").alias("index_time"),
        F.min(F.when(F.col("event_type") == "click", F.col("ts"))).alias("first_time"))
    hours = firsts.withColumn("hours", hours_between("index_time", "first_time"))
    return rounded(hours.select("user_id", "hours", right_closed_band("hours", TIMING_EDGES, TIMING_LABELS)
                                .alias("timing_bin")), "hours")


@query("synthetic_key", """SELECT event_id,
  'ED_' || user_id || '_' || strftime(ts, '%Y%m%d%H%M') AS visit_key FROM events WHERE event_type = 'signup'""")
def synthetic_keys(spark, sf):
    signups = table(spark, sf, "events").where(F.col("event_type") == "signup")
    return signups.select("event_id", synthetic_key("ED", "user_id", "ts").alias("visit_key"))


@query("hours_filter", """WITH f AS (SELECT user_id, min(ts) AS t0 FROM events GROUP BY user_id),
h AS (SELECT event_id, epoch_us(ts - t0) / 3600000000.0 AS hours FROM events JOIN f USING (user_id))
SELECT event_id, round(hours, 6) AS hours FROM h WHERE hours BETWEEN 0 AND 24""")
def hours_filter(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    starts = events.groupBy("user_id").agg(F.min("ts").alias("t0"))
    hours = events.join(starts, "user_id").withColumn("hours", hours_between("t0", "ts"))
    return rounded(hours.where(F.col("hours").between(0, 24)).select("event_id", "hours"), "hours")
