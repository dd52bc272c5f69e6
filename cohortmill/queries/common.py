"""Shared pieces of the registered queries: table access and a registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a query function under `name`, and its SQL."""
    def add(function):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# The event spine: the first purchase of every user opens a 24-hour window. Users whose first purchase is on
# the first day stand in for the cases.
EVENT_TYPES = {t: t for t in ["click", "error", "purchase", "signup", "view"]}

SPINE_SQL = """
spine AS (
  SELECT user_id, min(ts) AS index_time, min(ts) + INTERVAL 24 HOUR AS window_end,
         CAST(min(ts) < TIMESTAMP '2024-01-02 00:00:00' AS INTEGER) AS label
  FROM events WHERE event_type = 'purchase' GROUP BY user_id)"""


def event_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.times import window_end
    first = (table(spark, sf_dir, "events").where((F.col("event_type") == "purchase") & F.col("user_id").isNotNull())
             .groupBy("user_id").agg(F.min("ts").alias("index_time")))
    return (first.withColumn("window_end", window_end("index_time"))
            .withColumn("label", (F.col("index_time") < F.expr("timestamp_ntz'2024-01-02 00:00:00'")).cast("int")))
