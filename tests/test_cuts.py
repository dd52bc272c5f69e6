import hashlib

import pytest
from pyspark.sql import functions as F

from cohortmill.operators.cohort import downsample_controls, stratified_split
from cohortmill.operators.cuts import first_in_hash_order, hash_cuts
from cohortmill.operators.ranks import hash_rank


def rows_of(spark, n=300):
    return spark.createDataFrame([(i, None if i % 11 == 0 else "hot" if i % 3 else "cold") for i in range(n)], "k long, g string").repartition(4)


@pytest.mark.parametrize("step", [1, 4])
def test_cut_takes_the_rows_that_the_rank_takes(spark, step):
    """A step of one digit needs several passes."""
    df = rows_of(spark)
    cuts = hash_cuts(df, ["k"], 7, ["g"], lambda size: F.floor(size * 0.37), step).collect()
    ranked = hash_rank(df, ["k"], 7, ["g"]).collect()
    assert {r["g"] for r in cuts} == {None, "hot", "cold"}
    for c in cuts:
        own = [r for r in ranked if r["g"] == c["g"]]
        assert c["size"] == len(own)
        taken = {r["k"] for r in own if hashlib.md5(f"{r['k']}:7".encode()).hexdigest() <= c["cut"]}
        assert taken == {r["k"] for r in own if r["hash_rank"] <= int(len(own) * 0.37)}


def test_cuts_for_none_all_and_no_rows(spark):
    df = rows_of(spark, 30)
    count = lambda wanted: first_in_hash_order(df, ["k"], 1, ["g"], wanted, "x").where("x").count()
    assert count(lambda size: F.lit(0)) == 0 and count(lambda size: F.lit(-3)) == 0
    assert count(lambda size: size) == 30 and count(lambda size: size + 5) == 30
    assert count(lambda size: F.lit(1)) == 3
    assert hash_cuts(df.limit(0), ["k"], 1, ["g"], lambda size: size).collect() == []


def test_equal_keys_go_together(spark):
    df = spark.createDataFrame([(1,)] * 5 + [(2,)] * 5, "k long")
    taken = hash_cuts(df, ["k"], 1, [], lambda size: F.lit(3)).first()
    assert df.where(F.md5(F.concat_ws(":", F.col("k").cast("string"), F.lit("1"))) <= taken["cut"]).count() == 5


def test_split_moves_no_rows(spark):
    """The rows of a split are only filtered: no exchange stands above their scan."""
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    split = stratified_split(df, ["k"], "y", 0.25)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan.split("BroadcastExchange")[0]
    assert {(r["y"], r["n"]) for r in split.where("cohort_split = 'test'").groupBy("y").agg(F.count("*").alias("n")).collect()} == {(0, 225), (1, 25)}


def test_downsampling_keeps_all_but_training_controls(spark):
    rows = [(i, int(i % 10 == 0), "test" if i % 4 == 0 else "train") for i in range(400)] + [(900, None, "train"), (901, 0, None)]
    df = spark.createDataFrame(rows, "k long, y int, s string")
    kept = downsample_controls(df, ["k"], "y", 2.0, "s")
    cases = sum(1 for _, y, s in rows if y == 1 and s == "train")
    assert kept.where("y = 0 AND s = 'train'").count() == 2 * cases
    assert kept.count() == len(rows) - sum(1 for _, y, s in rows if y == 0 and s == "train") + 2 * cases
    assert downsample_controls(df.where("y = 1"), ["k"], "y", 2.0, "s").count() == 40
