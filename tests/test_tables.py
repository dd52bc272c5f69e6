"""Audits, matrix rules, materialised tables, models and the query registry."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortmill.operators import audit as a
from cohortmill.operators import cohort as c
from cohortmill.operators import matrix as x
from cohortmill.operators import models as ml
from cohortmill.plans import matrices as pm
from cohortmill.queries.catalog import ORACLES, QUERIES
from cohortmill.sources import materialize as s
from cohortmill.sources import readers

SF = "/root/testdata/sf0.001"


def test_item_names(spark):
    df = spark.createDataFrame([(1, "Heart Rate", 1), (2, "heart--rate", 2), (3, "24h Urine", 3), (4, "", 4), (5, " (B)", 5)],
                               "item long, label string, place int")
    got = {r["item"]: r["feature_name"] for r in a.feature_names(df, "label", "item", "place").collect()}
    assert got == {1: "heart_rate", 2: "heart_rate_2", 3: "lab_24h_urine", 4: "lab_4", 5: "b"}


def test_leakage_columns(spark):
    prevalence = spark.createDataFrame([(50915, 9), (51221, 8)], "item long, observed long")
    labels = spark.createDataFrame([(50915, "D-Dimer")], "item long, label_text string")
    top = a.top_items(prevalence, "item", 5, labels, a.ORDERING_SENSITIVE_ITEMS)
    assert a.leakage_columns(top) == ["d_dimer_first"]
    assert [r["feature_name"] for r in top.orderBy("prevalence_rank").collect()] == ["d_dimer", "itemid_51221"]


def test_crosstab_and_frequencies(spark, rows):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", True), (None, True)], "k string, f boolean")
    assert ("All", "All", 3) in rows(a.crosstab(df, "k", "f")) and ("a", "All", 2) in rows(a.crosstab(df, "k", "f"))
    assert rows(a.frequencies(df, "k")) == [(None, 1, 25.0), ("a", 2, 50.0), ("b", 1, 25.0)]


def test_joined_values_in_parts(spark):
    df = spark.createDataFrame([("a", v) for v in ["x"] * 50 + ["yy"] * 3 + ["b"]] + [("c", "z"), ("d", None)], "k string, v string")
    whole = {r["k"]: r["t"] for r in a.joined_values(df, ["k"], "v", "t", " | ", distinct=False).collect()}
    assert whole == {"a": " | ".join(["b"] + ["x"] * 50 + ["yy"] * 3), "c": "z"}
    parts = a.joined_values(df, ["k"], "v", "t", " | ", False, part_chars=40).where("k = 'a'").orderBy("part_no").collect()
    assert len(parts) > 3 and " | ".join(r["t"] for r in parts) == whole["a"]
    assert max(len(r["t"]) for r in parts) <= 80
    once = {r["k"]: r["t"] for r in a.joined_values(df, ["k"], "v", "t").collect()}
    assert once == {"a": "b|x|yy", "c": "z"}


def test_histogram_closes_the_last_bin(spark, rows):
    df = spark.createDataFrame([(0.0,), (0.99,), (1.0,), (24.0,), (24.1,), (None,)], "v double")
    assert rows(a.histogram(df, "v", 0, 24, 24)) == [(1, 2), (2, 1), (24, 1)]


def test_missingness_thresholds(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 2.0, 3.0), (4, None, None)], "id long, p double, q double")
    assert {r["id"] for r in x.drop_sparse_rows(df, ["p", "q"], 0.5).collect()} == {1, 3}
    assert x.dense_columns(df, ["p", "q"], 0.5) == ["p"]
    with pytest.raises(ValueError):
        x.filter_complete(df, ["absent"])


def test_fixed_features(spark):
    df = spark.createDataFrame([(1, 2, 3)], "id int, p int, q int")
    assert x.fixed_features(df, ["id"], ["q"]).columns == ["id", "q"]
    for bad in (dict(keep=["z"]), dict(keep=["p"], preset="s", presets={"s": ["q"]}), dict(preset="none")):
        with pytest.raises(ValueError):
            x.fixed_features(df, ["id"], **bad)
    assert [len(v) for v in x.FEATURE_PRESETS.values()] == [35, 20]


def test_clipped_scale(spark):
    same = spark.createDataFrame([(1.0,), (1.0,), (None,)], "v double")
    assert [r["z"] for r in x.clipped_scale(same, "v", "z").collect()] == [0.5, 0.5, None]
    spread = spark.range(101).select(F.col("id").cast("double").alias("v"))
    got = [r["z"] for r in x.clipped_scale(spread, "v", "z").orderBy("v").collect()]
    assert got[0] == 0 and got[5] == 0 and got[50] == pytest.approx(0.5) and got[95] == 1 and got[100] == 1


def test_one_hot_and_codes(spark):
    df = spark.createDataFrame([(1, "train", "b"), (2, "train", "a"), (3, "test", "c"), (4, "test", None), (5, "train", "d")],
                               "id long, cohort_split string, k string")
    wide = x.one_hot(df, "cohort_split", ["k"])
    assert set(wide.columns) == {"id", "cohort_split", "k_b", "k_d"}
    assert tuple(wide.where("id = 3").select("k_b", "k_d").first()) == (0, 0)
    coded = {r["id"]: r["k_code"] for r in x.category_codes(df, ["k"]).collect()}
    assert coded == {4: 0, 2: 1, 1: 2, 3: 3, 5: 4}


def test_clinical_matrix(spark):
    t0 = dt.datetime(2024, 1, 1)
    spine = spark.createDataFrame([(1, t0, t0 + dt.timedelta(days=1), 1)],
                                  "subject_id long, index_time timestamp_ntz, feature_window_end timestamp_ntz, label int")
    events = "subject_id long, charttime timestamp_ntz, itemid long, valuenum double"
    vitals = spark.createDataFrame([(1, t0, 220045, 90.0), (1, t0, 220050, 120.0)], events)
    labs = spark.createDataFrame([(1, t0, 50813, 2.0)], events)
    ecg = spark.createDataFrame([(1, t0, *[1000.0, 1.0, 2.0, 100.0, 200.0, 500.0, 1.0, 1.0, 1.0])],
                                ", ".join(["subject_id long", "ecg_time timestamp_ntz", *[f"{c} double" for c in readers.ECG_COLUMNS]]))
    row = pm.clinical_matrix(spine, vitals, labs, ecg).first()
    assert row["shock_index_first"] == 0.75 and row["lactate_first"] == 2.0 and row["ecg_qtc_bazett_first"] == 400.0
    assert row["ecg_count"] == 1 and row["crp_first"] is None
    drugs = spark.createDataFrame([(1, 7, t0, "Esmolol", None, "IV"), (1, 8, t0, "esmolol", None, None)],
                                  "subject_id long, hadm_id long, starttime timestamp_ntz, drug string, formulary_drug_cd string, route string")
    with_orders = pm.clinical_matrix(spine.withColumn("hadm_id", F.lit(7).cast("long")), vitals, labs, orders=drugs).first()
    assert (with_orders["med_beta_blocker_count"], with_orders["med_statin_any"]) == (1, 0)


def test_signatures():
    base = s.signature({"a": [1, 2], "b": {"x", "y"}}, "d")
    assert base == s.signature({"b": {"y", "x"}, "a": [2, 1]}, "d")
    assert base != s.signature({"a": [1, 3], "b": {"x", "y"}}, "d") and base != s.signature({"a": [1, 2], "b": {"x", "y"}}, "e")
    with pytest.raises(ValueError):
        s.safe_name("a; drop")


def test_tables_are_reused_until_something_changes(spark, tmp_path):
    source = tmp_path / "source"
    spark.range(5).select("id", F.lit("a").alias("k")).write.parquet(str(source))
    calls = []

    def build():
        calls.append(1)
        return spark.read.parquet(str(source))

    make = lambda config: s.feature_matrix(spark, str(tmp_path / "kept"), "m", build, config, [str(source)])
    assert make({"v": 1}).count() == 5 and make({"v": 1}).count() == 5 and len(calls) == 1
    make({"v": 2})
    assert len(calls) == 2
    spark.range(5, 8).select("id", F.lit("a").alias("k")).write.mode("append").parquet(str(source))
    assert make({"v": 2}).count() == 8 and len(calls) == 3


def test_csv_source(spark, tmp_path):
    folder = tmp_path / "adm"
    folder.mkdir()
    (folder / "a.csv").write_text(
        "extra,hadm_id,subject_id,admittime,edregtime,admission_type,admission_location,race,insurance,marital_status\n"
        "z,10,1,2024-01-01 10:00:00,,URGENT,ER,\"A, B\",M,\n"
        "z,ED_1,2,2024-01-01 10:00:00,,URGENT,ER,X,M,\n"
        "z,11,3,not a time,2024-01-01 09:00:00,URGENT,ER,X,M,S\n")
    got = readers.admissions(spark, str(folder)).orderBy("hadm_id").collect()
    assert [(r["subject_id"], r["hadm_id"], r["admittime"], r["race"]) for r in got] == [
        (1, 10, dt.datetime(2024, 1, 1, 10), "A, B"), (3, 11, None, "X")]
    with pytest.raises(ValueError):
        readers.patients(spark, str(folder))


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "y_true int, y_probability double")
    paths = s.write_reports({"predictions": df}, str(tmp_path), "r1", "main model")
    back = spark.read.option("header", True).csv(paths["predictions"]).first()
    assert paths["predictions"].endswith("r1_main_model_predictions") and back["model_label"] == "main model"


def training(spark):
    rows = spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 7).alias("noise"),
                                   F.when(F.col("id") % 11 != 0, F.col("id") % 2 * 3 + F.col("id") % 3).alias("signal"))
    return c.stratified_split(rows, ["id"], "label", 0.3)


def test_models_find_the_signal(spark):
    df = training(spark)
    train, test = df.where("cohort_split = 'train'"), df.where("cohort_split = 'test'")
    fast = {"maxIter": 3, "maxDepth": 3}
    model = ml.fit(train, ["noise", "signal"], "label", fast)
    assert ml.evaluate(model, test)["average_precision"] > 0.8
    found = model.importance()
    assert found["signal"] > found["noise"]
    table = {r["feature"]: r["importance"] for r in ml.permutation_importance(model, test, ["id"], ["noise", "signal"], "label").collect()}
    assert table["signal"] > table["noise"]
    kept, log = ml.backward_elimination(train, test, ["noise", "signal"], "label", {"maxIter": 20}, "linear", minimum=1, tolerance=0.05)
    assert "signal" in kept and log.count() == 2 and log.where("dropped = 'noise'").count() == 1


def test_shadows_keep_all_values(spark):
    df = training(spark)
    out = ml.with_shadows(df, ["id"], ["noise"], 7)
    assert out.count() == 400
    assert sorted(r[0] for r in out.select("shadow__noise").collect()) == sorted(r[0] for r in df.select("noise").collect())
    assert out.where("noise <> shadow__noise").count() > 200


def test_sweep_keeps_failures(spark):
    out = ml.sweep({"good": lambda: spark.createDataFrame([(0.5,)], "ap double"), "bad": lambda: 1 / 0}, spark)
    got = {r["variant"]: (r["status"], r["ap"]) for r in out.collect()}
    assert got == {"good": ("ok", 0.5), "bad": ("failed", None)}


SOME = ["first_value_features", "median_features_bucketed", "code_cohort_similar_controls", "list_cohort", "grouped_split",
        "overlap_summary", "top_items_named", "threshold_table_bucketed", "calibration_bucketed", "bootstrap_ap", "combine_notes",
        "json_validate_split", "raw_matrix", "event_table_roundtrip"]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 150


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    import tools.check as check
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLES[name])
    want = check.rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
