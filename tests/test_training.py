import random

import pytest
from pyspark.sql import functions as F

from cohortmill.operators import models as ml
from cohortmill.operators.permute import _key_array, independent_copies, lending_places, permuted, round_keys
from cohortmill.operators.ranks import hash_rank
from cohortmill.plans.training import TrainingRules, train_and_evaluate, with_roles
from cohortmill.queries.jobs import labelled_documents, sides


@pytest.mark.parametrize("size", [1, 2, 7, 100, 1000])
def test_permutation_of_any_size(spark, size):
    maps = [[r[0] for r in spark.range(size).orderBy("id").select(permuted(F.col("id"), F.lit(size), _key_array(round_keys(k)))).collect()] for k in "ab"]
    assert all(sorted(m) == list(range(size)) for m in maps)
    assert size < 7 or maps[0] != maps[1]


def test_large_numbers_are_permuted_one_to_one(spark):
    start, size = 5_000_000_000_000, 7_000_000_000_001
    found = [r[0] for r in spark.range(start, start + 2000).select(permuted(F.col("id"), F.lit(size), _key_array(round_keys("x")))).collect()]
    assert len(set(found)) == 2000 and all(0 <= x < size for x in found)


@pytest.mark.parametrize("start, size", [(0, 1), (0, 2), (0, 501), (5_000_000_000_000, 7_000_000_000_001)])
def test_lending_places_run_a_permutation_backwards(spark, start, size):
    keys = [round_keys(k) for k in "ab"]
    found = spark.range(start, min(size, start + 501)).select("id", lending_places(F.col("id"), F.lit(size), keys).alias("x"))
    back = found.select("id", *[permuted(F.col("x")[i], F.lit(size), _key_array(k)).alias(f"p{i}") for i, k in enumerate(keys)])
    assert all(r["p0"] == r["id"] == r["p1"] for r in back.collect())


def test_copies_of_a_repeat_are_made_once(spark, monkeypatch):
    """A fit reads its rows several times and gets them held."""
    seen, fit = [], ml.fit
    monkeypatch.setattr(ml, "fit", lambda df, *a: seen.append(df.is_cached) or fit(df, *a))
    rows = matrix(spark)
    report, repeats = ml.shadow_filter(rows.where("cohort_split = 'train'"), rows.where("cohort_split = 'test'"), ["k"], ["x", "noise"], "y",
                                       {"maxIter": 2, "maxDepth": 2}, repeats=2)
    assert seen == [True, True] and repeats.count() == 2 and {r["feature"] for r in report.collect()} == {"x", "noise"}


def test_texts_are_read_once_for_both_sides(spark, tmp_path):
    texts = ["", "a", "One two\n\n TWO 12 \u0663 é𝔸 ", None, "x\ry 7\n"] + [f"Doc {i}" for i in range(15)]
    docs = [(i, t, "en", None if t is None else len(t)) for i, t in enumerate(texts) if t != ""]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d[0], d[0] % 2, 0) for d in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    train, test = sides(spark, str(tmp_path))
    assert train.count() + test.count() == len(docs) and train.inputFiles() == test.inputFiles() == []
    got = {r["doc_id"]: r for r in labelled_documents(spark, str(tmp_path)).collect()}
    for i, t, _, _ in docs:
        want = (None, None, None) if t is None else (t.count("\n"), sum(x in "0123456789" for x in t), sum("A" <= x <= "Z" for x in t) / len(t))
        assert (got[i]["n_lines"], got[i]["n_digits"], got[i]["share_upper"]) == want


def test_copies_are_independent_and_keep_their_values(spark):
    rows = [(i, float(i), float(i), None if i % 5 == 0 else f"w{i % 7}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, a double, b double, w string, i int").repartition(5)
    got = independent_copies(df, ["k"], ["a", "b", "w", "i"], 3).orderBy("k").collect()
    assert [tuple(r)[:5] for r in got] == rows
    for c in ("a", "b", "w", "i"):
        assert sorted(str(r[c]) for r in got) == sorted(str(r[f"shadow__{c}"]) for r in got)
    assert sum(r["shadow__a"] == r["shadow__b"] for r in got) < 10  # equal columns, copies of their own
    assert sum(r["shadow__a"] == r["a"] for r in got) < 10
    assert [r["shadow__a"] for r in got] != [r["shadow__a"] for r in independent_copies(df, ["k"], ["a"], 4).orderBy("k").collect()]


def test_copies_take_the_value_at_the_permuted_place(spark):
    df = spark.createDataFrame([(i, i * i) for i in range(50)], "k long, v long")
    places = {r["k"]: r["hash_rank"] - 1 for r in hash_rank(df, ["k"], 9).collect()}
    at = {p: k for k, p in places.items()}
    keys = round_keys("9:v")

    def target(x, n):
        for shift, a, b, c in keys:
            partner = (shift - x) % n
            m = max(x, partner)
            if (m % 2_147_483_647 * a % 2_147_483_647 + m // 2_147_483_647 % 2_147_483_647 * b % 2_147_483_647 + c) % 2_147_483_647 % 2:
                x = partner
        return x
    for r in independent_copies(df, ["k"], ["v"], 9).collect():
        assert r["shadow__v"] == at[target(places[r["k"]], 50)] ** 2


def matrix(spark, flip=False):
    draw = random.Random(4)
    rows = []
    for i in range(600):
        y = int(draw.random() < 0.3)
        x = y + draw.gauss(0, 1)
        split = "test" if i % 5 == 0 else "train"
        rows.append((i, split, 1 - y if flip and split == "test" else y, x, draw.gauss(0, 1), draw.choice(["p", "q", None])))
    return spark.createDataFrame(rows, "k long, cohort_split string, y int, x double, noise double, w string").repartition(3)


RULES = TrainingRules(["k"], "y", ["x", "noise", "w"], grid=[{"maxIter": 5}, {"maxIter": 5, "regParam": 0.5}], learner="linear", minimum=1, tolerance=0.02)


def test_threshold_comes_from_the_validation_rows_alone(spark):
    """Other labels in the holdout change neither settings nor features nor the threshold; its own rows give the threshold."""
    a, b = (train_and_evaluate(matrix(spark, flip), RULES) for flip in (False, True))
    assert (a.threshold, a.params, a.features) == (b.threshold, b.params, b.features)
    roles = {r["k"]: r["role"] for r in with_roles(matrix(spark), RULES).collect()}
    seen = {r["k"]: r["y_probability"] for r in a.validation.collect()}
    assert set(seen) == {k for k, r in roles.items() if r == "validation"} and a.threshold in seen.values()
    assert {r["k"] for r in a.predictions.collect()} == {k for k, r in roles.items() if r == "holdout"}
    assert "x" in a.features and len(a.features) + len(a.dropped) == 3
    row = a.summary.first()
    assert row["selected_threshold"] == a.threshold and row["train_rows"] == 480 and row["holdout_rows"] == 120
    assert row["selected_tp"] + row["selected_fp"] + row["selected_fn"] + row["selected_tn"] == 120
    # The model that gives the holdout scores has seen all training rows, the one behind the threshold has not.
    assert a.model.score(matrix(spark).where("cohort_split = 'train'"), ["k"]).where(F.col("k").isin(list(seen))).select("y_probability").first()[0] not in seen.values()


def test_roles_need_both_classes(spark):
    with pytest.raises(ValueError, match="cases and controls"):
        train_and_evaluate(matrix(spark).withColumn("y", F.when(F.col("cohort_split") == "train", F.col("y")).otherwise(0)), RULES)
    with pytest.raises(ValueError, match="both the train and the test"):
        train_and_evaluate(matrix(spark).where("cohort_split = 'train'"), RULES)
