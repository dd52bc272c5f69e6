"""Nulls, NaN, infinities and extremes: one result whatever the path."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cohortmill.functions import codes as k
from cohortmill.operators import audit, cohort, matrix, metrics, models, ranks

SCORES = [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0, 1.5, 1.5, 2.0, -3.0, None, float("nan")]


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate(SCORES)], "id long, v double")


def place(v):
    return (0, 0.0) if v is None else (2, 0.0) if math.isnan(v) else (1, v)


@pytest.mark.parametrize("rows_per_task", [2, 1_000])
@pytest.mark.parametrize("descending", [True, False])
def test_score_rank_of_odd_scores(scores, rows_per_task, descending):
    got = ranks.score_rank(scores, "v", ["id"], descending=descending, rows_per_task=rows_per_task).orderBy("score_rank").collect()
    assert [r.score_rank for r in got] == list(range(1, len(SCORES) + 1)) and {r.score_rank_total for r in got} == {len(SCORES)}
    order = [place(r.v) for r in got]
    assert order == sorted(order, reverse=descending)


@pytest.mark.parametrize("rows_per_task", [2, 1_000])
def test_quantiles_with_nan(scores, rows_per_task):
    got = ranks.exact_quantiles(scores, "v", {"least": 0.0, "mid": 0.5, "most": 1.0}, rows_per_task=rows_per_task).first()
    assert got.n == 10 and got.least == float("-inf") and got.mid == 1.5 and math.isnan(got.most)


def test_hash_rank_has_two_levels(spark):
    df = spark.range(5_000).withColumn("g", F.when(F.col("id") % 3 == 0, "a"))
    got = ranks.hash_rank(df, ["id"], 7, ["g"]).withColumn("h", ranks.hash_order(7, "id")).collect()
    for g in ("a", None):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.h)
        assert [r.hash_rank for r in own] == list(range(1, len(own) + 1)) and {r.hash_rank_total for r in own} == {len(own)}


def test_metrics_share_their_rows(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, None), (None, 0.7), (0, float("nan")), (1, 0.2), (0, 0.1)], "y int, s double")
    at = metrics.metrics_at(df, "y", "s", {"half": 0.5}).first()
    assert (at.tp, at.fp, at.fn, at.tn) == (1, 1, 1, 1)
    assert {r["class"]: r.support for r in metrics.class_report(df, "y", "s", 0.5).collect()}["accuracy"] == 4
    errors = metrics.error_counts(df, "y", "s", 0.5, F.lit("x"), F.lit("z")).collect()
    assert sorted((r.error, r.n) for r in errors) == [("False negative", 1), ("False positive", 1)]


def test_latest_row_with_text_ties(spark):
    day = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, day, "b", 1), (1, day, "a", 2), (1, None, "0", 3), (1, day - dt.timedelta(1), "a", 4), (2, None, "q", 5)],
                               "s long, t timestamp_ntz, tie string, v int")
    assert {r.s: r.v for r in cohort.one_row(df, "s", "t", "tie").collect()} == {1: 2, 2: 5}
    assert {r.s: r.v for r in cohort.first_non_null(df, "s", "t", "tie", ["v"], latest=True).collect()} == {1: 2, 2: 5}


def test_shares_at_their_ends(spark):
    df = spark.range(500)
    for share, n in ((1.0, 500), (0.0, 0), (2.0, 500)):
        assert df.where(cohort.in_share(1, share, "id")).count() == n
    assert 60 < df.where(cohort.in_share(1, 0.2, "id")).count() < 140


def test_row_ids_differ(spark):
    df = spark.createDataFrame([("a", "b:c"), ("a:b", "c"), ("a", None), (None, "a"), ("a", "-"), ("a|1:b", "c")], "x string, y string")
    assert cohort.row_id(df, ["x", "y"]).select("row_id").distinct().count() == 6


def test_splits_are_looked_for_by_name(spark):
    df = spark.createDataFrame([(s,) for s in ("a", "b", "c", "test", "train")], "split string")
    assert matrix.require_both_splits(df, "split") is df
    with pytest.raises(ValueError):
        matrix.require_both_splits(df.where("split <> 'test'"), "split")


def test_one_hot_of_many_values(spark):
    df = spark.range(2_100).select(F.lit("train").alias("split"), F.format_string("%05d", "id").alias("k"))
    assert len(matrix.one_hot(df, "split", ["k"]).columns) == 2_100


def test_categories_beyond_the_default_bins(spark):
    df = spark.range(400).select(F.format_string("k%d", F.col("id") % 90).alias("k"), (F.col("id") % 2).cast("int").alias("y"))
    fitted = models.fit(df, ["k"], "y", {"maxIter": 1, "maxDepth": 2})
    assert fitted.score(df.withColumn("k", F.lit("unseen"))).count() == 400


def test_overlap_of_text_ids(spark):
    left, right = (spark.createDataFrame([(x,) for x in ids], "k string") for ids in (["ED_1", "2", None], ["2", "3"]))
    got = audit.overlap_summary(left, right, ["k"]).first()
    assert sorted(v for v in got.asDict().values() if isinstance(v, int)) == [1, 1, 1, 2, 2]


def test_code_keys(spark):
    df = spark.createDataFrame([("44100", 9), ("44100", 10), ("I7101", 10), (None, 9), ("44100", None), ("R0789", 10), ("R0789", 9)], "c string, v int")
    got = df.select(k.exact_code("c", "v", k.TARGET_CODES), k.any_group("c", "v", k.SIMILAR_CONTROL_GROUPS), k.code_prefix("c", "v", {9: []})).collect()
    assert [r[0] for r in got] == [True, False, True, False, False, False, False]
    assert [r[1] for r in got] == [False] * 5 + [True, False] and not any(r[2] for r in got)


def test_nan_is_no_value(spark):
    from cohortmill.operators import audit as a
    from cohortmill.operators import matrix as x
    from cohortmill.operators import metrics as m
    from cohortmill.operators.windows import measurement_features
    nan = float("nan")
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, nan), (1, None), (2, nan)], "g int, v double")
    assert [tuple(r) for r in m.median_by_group(df, "v", "g").collect()] == [(1, 2, 2.0)]
    assert [tuple(r) for r in a.distributions(df, "g", ["v"]).collect()] == [(1, "v", 2, 2.0, 1.0)]
    assert [tuple(r) for r in a.usage_summary(df, ["v"]).select("counter", "total", "n", "median").collect()] == [("v", 4.0, 2, 2.0)]
    assert sorted(map(str, (r["s"] for r in x.clipped_scale(df, "v", "s", 0, 1).collect()))) == ["0.0", "1.0", "None", "None", "None"]
    assert sorted(map(str, (r["v"] for r in x.minmax_scale(df, ["v"]).collect()))) == ["0.0", "1.0", "None", "None", "None"]
    times = "timestamp_ntz'2024-01-01 0{}:00:00'"
    measures = df.selectExpr("g", times.format(1) + " AS ts", "v")
    spine = spark.range(1, 3).selectExpr("cast(id AS int) AS g", times.format(0) + " AS lo", times.format(2) + " AS hi")
    got = measurement_features(measures, spine, ["g"], "g", "ts", "lo", "hi", ["v"], ["max", "mean", "median"]).orderBy("g").collect()
    assert [tuple(r) for r in got] == [(1, 4, 3.0, 2.0, 2.0), (2, 1, None, None, None)]
    open_end = spine.selectExpr("g", "lo", "cast(NULL AS timestamp_ntz) AS hi")
    assert measurement_features(measures, open_end, ["g"], "g", "ts", "lo", "hi", ["v"], ["max"]).count() == 2


def test_vector_of_many_values(spark):
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    from cohortmill.operators.matrix import one_hot, one_hot_vector
    rows = spark.range(100_000).selectExpr("id", "CASE WHEN id % 10 = 9 THEN 'test' ELSE 'train' END AS s", "concat('v', id) AS w", "concat('k', id % 3) AS k")
    out, slots = one_hot_vector(rows, "s", ["w", "k"])
    assert slots.count() == 90_000 - 1 + 2
    size = out.agg(F.max(F.expr("0"))).first()  # the rows come through whole
    assert size[0] == 0 and out.count() == 100_000
    small = spark.createDataFrame([("train", "a", "p"), ("train", "b", "q"), ("train", None, "r"), ("test", "b", "z"), ("train", "c", "q")], "s string, k string, w string")
    vector, slots = one_hot_vector(small.withColumn("id", F.monotonically_increasing_id()), "s", ["k", "w"])
    names = [f"{r['column']}_{r['value']}" for r in slots.orderBy("slot").collect()]
    plain = one_hot(small, "s", ["k", "w"])
    assert names == [c for c in plain.columns if c != "s"]
    assert sorted(tuple(map(int, r["v"])) for r in vector.select(vector_to_array("encoded").alias("v")).collect()) == sorted(tuple(r[c] for c in names) for r in plain.collect())
    none, slots = one_hot_vector(small.select("s", F.lit("same").alias("k")), "s", ["k"])
    assert slots.count() == 0 and {len(r["encoded"]) for r in none.collect()} == {0}


def test_lookup_reads_the_folders_of_its_subjects(spark, tmp_path):
    from pyspark.sql import functions as F

    from cohortmill.sources import materialize as s
    events = spark.range(2000).selectExpr("id % 100 AS who", "timestamp_ntz'2024-01-01' AS ts", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS item", "id AS v")
    events.write.parquet(str(tmp_path / "source"))
    source = spark.read.parquet(str(tmp_path / "source"))
    held = [s.lookup_table(spark, str(tmp_path / "root"), "t", source, [str(tmp_path / "source")], "who", "item", "ts", ["a", "b"], folders=32) for _ in range(2)]
    assert held[0].inputFiles() == held[1].inputFiles()
    wanted = spark.createDataFrame([(3,), (3,), (8,), (None,)], "who long")
    found = s.events_of(held[1], wanted, "who", "item", ["a"], folders=32)
    assert found.columns == ["who", "ts", "item", "v"]
    assert sorted((r["who"], r["v"]) for r in found.collect()) == sorted((i % 100, i) for i in range(2000) if i % 100 in (3, 8) and i % 2 == 0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "subject_folder" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0] and "In(item" in plan or "EqualTo(item" in plan
    read = held[1].where(F.col(s.FOLDER).isin([r[0] for r in wanted.dropna().select(s._folder("who", 32)).distinct().collect()]))
    assert 0 < read.select(F.input_file_name()).distinct().count() <= 2 * 4
    assert s.events_of(held[1], wanted.where("who < 0"), "who", "item", ["a"], folders=32).count() == 0
