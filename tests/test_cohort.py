"""Code lists, one row per subject, checked joins, splits, spines."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortmill.functions import codes as k
from cohortmill.operators import cohort as c
from cohortmill.operators import joins as j
from cohortmill.plans import spines

T0 = dt.datetime(2024, 1, 1)
DAY = dt.timedelta(days=1)


def test_code_rules(spark, rows):
    df = spark.createDataFrame([("1", "441.00", "9"), ("2", "i71.01", "10"), ("3", "441.00", "10"), ("4", None, "9"),
                                ("x", "441", "9"), ("6", "4410", "9"), ("7", "r07.4", "10"), ("8", "441", "n/a")],
                               "adm string, code string, version string")
    out = k.prepare_codes(df, "adm", "code", "version")
    marked = out.select("adm", k.exact_code("code_norm", "version", k.TARGET_CODES),
                        k.any_group("code_norm", "version", k.SIMILAR_CONTROL_GROUPS))
    assert rows(marked) == [(1, True, False), (2, True, False), (3, False, False), (6, False, False), (7, False, True),
                            (8, False, False)]
    assert rows(k.group_counts(out, "adm", "code_norm", "version", k.SIMILAR_CONTROL_GROUPS)) == [("chest_pain", 1, 1)]


def test_first_non_null_mixes_rows_and_one_row_does_not(spark):
    df = spark.createDataFrame([(1, 10, T0, None), (1, 11, T0 + DAY, "b"), (2, 12, T0, None), (None, 13, T0, "z")],
                               "subject long, adm long, ts timestamp_ntz, race string")
    mixed = {r["subject"]: (r["adm"], r["race"]) for r in c.first_non_null(df, "subject", "ts", "adm", ["adm", "race"]).collect()}
    assert mixed == {1: (10, "b"), 2: (12, None)}
    whole = {r["subject"]: (r["adm"], r["race"]) for r in c.one_row(df.where("subject > 0"), "subject", "ts", "adm", False).collect()}
    assert whole == {1: (10, None), 2: (12, None)}
    latest = {r["subject"]: r["adm"] for r in c.one_row(df.where("subject > 0"), "subject", "ts", "adm").collect()}
    assert latest == {1: 11, 2: 12}


def test_equal_times_go_by_key(spark):
    df = spark.createDataFrame([(1, 7, T0), (1, 5, T0), (1, 6, T0)], "subject long, adm long, ts timestamp_ntz")
    for latest in (False, True):
        assert c.one_row(df, "subject", "ts", "adm", latest).first()["adm"] == 5


def test_join_checks(spark, rows):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "id long, l string")
    right = spark.createDataFrame([(1, "x")], "id long, r string")
    twice = right.union(right)
    assert rows(j.one_to_one(left, right, ["id"])) == [(1, "a", "x"), (2, "b", None)]
    for check in (lambda: j.one_to_one(left, twice, ["id"]), lambda: j.one_to_one(left.union(left), right, ["id"]),
                  lambda: j.many_to_one(left, right, ["id"]), lambda: j.require_disjoint(left, right, "id", "lists"),
                  lambda: j.require_qualified(left, right, "id")):
        with pytest.raises(j.JoinCheckError):
            check()
    assert rows(j.many_to_one(left.union(left), right, ["id"], require_match=False)).count((1, "a", "x")) == 2
    assert rows(j.with_indicator(left, right, ["id"]), "id", "_merge") == [(1, "both"), (2, "left_only")]


def test_anti_join_keeps_null_keys(spark, rows):
    left = spark.createDataFrame([(1,), (None,)], "id long")
    assert rows(j.not_among(left, spark.createDataFrame([(1,), (None,)], "id long"), ["id"])) == [(None,)]


def labelled(spark, n=500):
    return spark.range(n).select("id", (F.col("id") % 3).alias("subject"), (F.col("id") % 5 == 0).cast("int").alias("label"))


def test_splits(spark):
    df = labelled(spark)
    split = c.stratified_split(df, ["id"], "label")
    shares = {r["label"]: r["n"] for r in split.where("cohort_split = 'test'").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert shares == {0: 80, 1: 20}
    again = c.stratified_split(df.repartition(13), ["id"], "label")
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, again.collect()))
    grouped = c.grouped_split(df.withColumn("subject", F.col("id") % 50), "subject", "label")
    assert grouped.groupBy("subject").agg(F.count_distinct("cohort_split").alias("n")).where("n > 1").isEmpty()


def test_downsample_and_folds(spark):
    df = c.holdout_split(labelled(spark), ["id"])
    out = c.downsample_controls(df, ["id"], "label", 2, "cohort_split")
    count = lambda d, where: d.where(where).count()
    cases = count(df, "cohort_split = 'train' and label = 1")
    assert count(out, "cohort_split = 'train' and label = 0") == 2 * cases
    assert count(out, "cohort_split = 'test'") == count(df, "cohort_split = 'test'")
    assert count(out, "label = 1") == count(df, "label = 1")
    everything = c.downsample_controls(df, ["id"], "label", 1000, "cohort_split")
    assert everything.count() == 500
    folds = c.cv_folds(labelled(spark), ["id"], "label").groupBy("label", "fold").count().collect()
    assert {(r["label"], r["count"]) for r in folds} == {(0, 80), (1, 20)}


def test_code_defined_spine(spark):
    adm = spark.createDataFrame([
        (1, 10, T0, "x"), (1, 11, T0 + DAY, None), (2, 20, T0, "y"), (2, 21, T0 + DAY, "z"), (3, 30, T0, "w"), (4, 40, T0, "v")],
        "subject long, adm long, ts timestamp_ntz, race string")
    codes = k.prepare_codes(spark.createDataFrame([
        ("11", "441", 9), ("10", "441.0", 9), ("20", "R07.1", 10), ("21", "Z99", 10), ("30", "R07", 10), ("30", "441", 9),
        ("40", "M54.5", 10)], "adm string, code string, version int"), "adm", "code", "version")
    people = spark.createDataFrame([(1, 50, 2020), (2, 60, 2020), (3, 60, 2020), (4, 10, 2020)],
                                   "subject long, anchor_age int, anchor_year int")
    listed = adm.where("subject = 1")
    args = ("subject", "adm", "ts", k.TARGET_CODES)
    spine = spines.code_defined_spine(adm, codes, people, listed, *args, k.SIMILAR_CONTROL_GROUPS, ["race"])
    got = {r["subject"]: (r["adm"], r["label"], r["race"], r["index_age"]) for r in spine.collect()}
    # 1: the coded admission, no race there. 2: its similar admission although a later one exists.
    # 3: similar but also a target code, so not eligible. 4: too young.
    assert got == {1: (11, 1, None, 54), 2: (20, 0, "y", 64)}
    loose = spines.code_defined_spine(adm, codes, people, listed, *args, None, ["race"])
    assert {r["subject"]: r["adm"] for r in loose.where("label = 0").collect()} == {2: 21, 3: 30}


def test_list_defined_spine_checks(spark):
    adm = spark.createDataFrame([(1, 10, T0), (1, 11, T0 + DAY), (2, 20, T0)], "subject long, adm long, ts timestamp_ntz")
    people = spark.createDataFrame([(1, 50, 2020), (2, 60, 2020)], "subject long, anchor_age int, anchor_year int")
    build = lambda cases, controls: spines.list_defined_spine(cases, controls, adm, people, "subject", "adm", "ts")
    out = build(adm.where("subject = 1"), adm.where("subject = 2"))
    assert out.count() == 3 and out.select("cohort_row_id").distinct().count() == 3
    with pytest.raises(j.JoinCheckError):
        build(adm.where("adm = 10"), adm.where("adm = 11"))
    with pytest.raises(j.JoinCheckError):
        build(adm.where("subject = 1").withColumn("adm", F.col("adm") + 500), adm.where("subject = 2"))


def test_a_listed_admission_needs_its_time(spark):
    from cohortmill.operators.joins import JoinCheckError
    from cohortmill.plans.spines import list_spine_from_raw
    lists = [spark.createDataFrame(rows, "s string, h string") for rows in ([("1", "10"), ("x", "11")], [("2", "20")])]
    people = spark.createDataFrame([(1, 40, 2020), (2, 50, 2020)], "s long, anchor_age int, anchor_year int")
    good = [("1", "10", "2020-01-02 00:00:00", "2020-01-01 20:00:00"), ("2", "20", "2020-02-02 00:00:00", None), ("3", "30", "never", None), ("y", "1", None, None)]
    run = lambda rows: list_spine_from_raw(*lists, spark.createDataFrame(rows, "s string, h string, main string, early string"), people, "s", "h", "main", "early")
    got = {r["s"]: (r["index_time_source"], str(r["index_time"]), r["proxy_time"]) for r in run(good).collect()}
    assert got == {1: ("edregtime", "2020-01-01 20:00:00", None), 2: ("admittime", "2020-02-02 00:00:00", None)}
    for rows, what in ((good[1:], "without a match"), ([("1", "10", "soon", None), *good[1:]], "without main"), ([good[0], *good], "duplicate")):
        with pytest.raises(JoinCheckError, match=what):
            run(rows)


def test_spine_guards(spark):
    from cohortmill.plans.spines import SpineOptions, code_defined_spine
    day = lambda d: dt.datetime(2020, 1, d)
    adm = spark.createDataFrame([(s, h, day(d), kind, "P") for s, h, d, kind in [(1, 10, 1, "A"), (2, 20, 2, "B"), (3, 30, 3, "B")]],
                                "s long, h long, t timestamp_ntz, kind string, place string")
    codes = lambda rows: spark.createDataFrame(rows, "h long, code_norm string, version int")
    people = spark.createDataFrame([(k, 40, 2020) for k in (1, 2, 3)], "s long, anchor_age int, anchor_year int")
    run = lambda rows, similar=None, adm=adm, **o: code_defined_spine(adm, codes(rows), people, None, "s", "h", "t", {9: ["X1"]}, similar, ["kind", "place"],
                                                                       options=SpineOptions(**o))
    target, like, other = (10, "X1", 9), (20, "Y1", 9), (30, "Z", 9)
    similar = {"g": {9: ["Y"]}}
    assert {r["s"]: r["label"] for r in run([target, like, other], similar).collect()} == {1: 1, 2: 0}
    for rows, kwargs, what in (([like], {}, "no admission has a target code"), ([target, other], {"similar": similar}, "no admission has a similar code"),
                               ([target, like], {"similar": similar, "adm": adm.where("s = 1")}, "no admission of a subject without a case"),
                               ([target, like], {"similar": similar, "adm": adm.where("s <> 2")}, "no control has a similar admission"),
                               ([target, like], {"one_split": True, "hard_controls": ("kind", ["C"], "place", ["Q"])}, "removed every training control")):
        with pytest.raises(ValueError, match=what):
            run(rows, **kwargs)
    kept = run([target], one_split=True, hard_controls=("kind", ["B"], "place", []), control_ratio=1)
    assert sorted(r["label"] for r in kept.collect()) == [0, 1] and {r["cohort_split"] for r in kept.collect()} == {"train"}
