"""Ordered sums, ranks and quantiles against plain Python, through the plain and the bucketed path."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortmill.operators import ranks


def skewed(n=3000, seed=3):
    """A third of the rows in one group, a third of them with one value."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        group = "hot" if i % 3 == 0 else f"g{rng.randrange(20)}"
        value = 7.5 if rng.random() < 1 / 3 else round(rng.gauss(0, 50), 2)
        out.append((i, group, value))
    return out


@pytest.mark.parametrize("rows_per_task", [10 ** 6, 50])
@pytest.mark.parametrize("descending", [False, True])
def test_ordered_sums_match_cumsum(spark, rows_per_task, descending):
    pdf = pd.DataFrame(skewed(), columns=["id", "g", "v"]).groupby(["g", "v"], as_index=False).size()
    df = spark.createDataFrame(pdf)
    got = ranks.ordered_sums(df, "v", {"c": "size"}, ["g"], descending, lead=["size"],
                             rows_per_task=rows_per_task).toPandas()
    want = pdf.sort_values("v", ascending=not descending)
    want = want.assign(c=want.groupby("g")["size"].cumsum(), c_total=want.groupby("g")["size"].transform("sum"),
                       next_size=want.groupby("g")["size"].shift(-1))
    both = got.merge(want, on=["g", "v"], suffixes=("", "_w"))
    assert len(both) == len(pdf)
    assert (both.c == both.c_w).all() and (both.c_total == both.c_total_w).all()
    assert both.next_size.fillna(-1).equals(both.next_size_w.fillna(-1))


@pytest.mark.parametrize("rows_per_task", [10 ** 6, 40])
def test_sequence_sums_on_text_order(spark, rows_per_task):
    pdf = pd.DataFrame([(g, str(i % 37), i, f"n{i}", 1) for i, (_, g, _) in enumerate(skewed(900))],
                       columns=["g", "seq", "t", "id", "one"])
    got = ranks.sequence_sums(spark.createDataFrame(pdf), ["seq", "t", "id"], {"no": "one"}, ["g"],
                              rows_per_task=rows_per_task).toPandas()
    want = pdf.sort_values(["seq", "t", "id"]).assign(no=lambda d: d.groupby("g").cumcount() + 1)
    both = got.merge(want, on="id")
    assert len(both) == 900 and (both.no_x == both.no_y).all()


def test_sequence_sums_with_many_copies(spark):
    """A third of the rows are copies in every column; all of them get a number of their own."""
    pdf = pd.DataFrame([("g", "same", 1) if i % 3 == 0 else ("g", f"k{i:05}", 1) for i in range(3000)],
                       columns=["g", "seq", "one"])
    got = ranks.sequence_sums(spark.createDataFrame(pdf), ["seq"], {"no": "one"}, ["g"], rows_per_task=100).toPandas()
    assert sorted(got.no) == list(range(1, 3001))
    assert got.sort_values("no").seq.is_monotonic_increasing


@pytest.mark.parametrize("rows_per_task", [10 ** 6, 30])
def test_exact_quantiles_match_numpy(spark, rows_per_task):
    data = skewed()
    df = spark.createDataFrame(data, "id long, g string, v double")
    got = {r["g"]: r for r in ranks.exact_quantiles(
        df, "v", {"q1": 0.25, "q2": 0.5, "q3": 0.9}, ["g"], rows_per_task=rows_per_task).collect()}
    for g, part in pd.DataFrame(data, columns=["id", "g", "v"]).groupby("g"):
        assert got[g]["n"] == len(part)
        for name, q in (("q1", 25), ("q2", 50), ("q3", 90)):
            assert got[g][name] == pytest.approx(np.percentile(part.v, q))


def test_quantiles_skip_nulls_and_have_no_empty_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 4.0), ("b", None)], "g string, v double")
    out = ranks.exact_quantiles(df, "v", {"m": 0.5}, ["g"]).collect()
    assert [(r["g"], r["n"], r["m"]) for r in out] == [("a", 2, 2.5)]


def test_hash_rank_is_a_permutation_and_ignores_partitioning(spark):
    df = spark.createDataFrame(skewed(), "id long, g string, v double")
    one = {r["id"]: r["hash_rank"] for r in ranks.hash_rank(df.coalesce(1), ["id"], 42, ["g"]).collect()}
    many = {r["id"]: r["hash_rank"] for r in ranks.hash_rank(df.repartition(17), ["id"], 42, ["g"]).collect()}
    assert one == many
    hot = sorted(one[i] for i, g, _ in skewed() if g == "hot")
    assert hot == list(range(1, len(hot) + 1))


@pytest.mark.parametrize("rows_per_task", [10 ** 6, 100])
def test_score_rank_with_a_hot_score(spark, rows_per_task):
    data = skewed(1500)
    df = spark.createDataFrame(data, "id long, g string, v double")
    got = ranks.score_rank(df, "v", ["id"], rows_per_task=rows_per_task).toPandas().sort_values("score_rank")
    assert got.score_rank.tolist() == list(range(1, 1501))
    assert got.v.is_monotonic_decreasing


@pytest.mark.parametrize("n", [1, 2, 10, 13, 97, 100])
def test_decile_close_to_qcut(spark, n):
    df = spark.range(1, n + 1).withColumn("n", F.lit(n))
    got = [r[0] for r in df.orderBy("id").select(ranks.decile("id", "n")).collect()]
    assert got == sorted(got)
    if n >= 10:
        want = (pd.qcut(pd.Series(range(1, n + 1)), 10, labels=False) + 1).tolist()
        assert sum(a != b for a, b in zip(got, want)) <= 1
