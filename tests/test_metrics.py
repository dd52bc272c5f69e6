"""Metric tables against plain definitions."""

import itertools
import random

import pytest

from cohortmill.operators import metrics as m


def sample(n=400, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        score = 0.5 if i % 3 == 0 else round(min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * y, 0.2))), 2)
        out.append((i, y, score))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "id long, y int, s double")


def precision_recall(data):
    total = sum(y for _, y, _ in data)
    points = []
    for t in sorted({s for *_, s in data}, reverse=True):
        hit = [y for _, y, s in data if s >= t]
        points.append((t, sum(hit) / len(hit), sum(hit) / total))
    return points


CASES = {
    "mixed": sample(), "perfect": [(i, int(i > 5), i / 10) for i in range(10)], "tied": [(i, i % 2, 0.5) for i in range(9)],
    "reversed": [(i, int(i < 3), i / 10) for i in range(7)],
}


@pytest.mark.parametrize("rows_per_task", [10 ** 6, 5])
@pytest.mark.parametrize("name", CASES)
def test_summary_scores(spark, name, rows_per_task):
    data = CASES[name]
    got = m.summary_scores(frame(spark, data), "y", "s", rows_per_task=rows_per_task).first()
    pos, neg = [s for _, y, s in data if y], [s for _, y, s in data if not y]
    auc = sum((a > b) + (a == b) / 2 for a, b in itertools.product(pos, neg)) / (len(pos) * len(neg))
    ap = area = before = 0.0
    precision_before = 1.0
    for _, p, r in precision_recall(data):
        ap += (r - before) * p
        area += (r - before) * (p + precision_before) / 2
        before, precision_before = r, p
    assert got["roc_auc"] == pytest.approx(auc)
    assert got["average_precision"] == pytest.approx(ap)
    assert got["pr_auc_trapezoidal"] == pytest.approx(area)
    assert 0 <= got["average_precision"] <= 1


def test_one_class_gives_nulls(spark):
    got = m.summary_scores(frame(spark, [(1, 1, 0.2), (2, 1, 0.4)]), "y", "s").first()
    assert got["average_precision"] is None and got["roc_auc"] is None


@pytest.mark.parametrize("rows_per_task", [10 ** 6, 7])
def test_threshold_table(spark, rows_per_task):
    data = [*sample(), (9001, None, 0.3), (9002, 1, None)]
    got = {r["threshold"]: r for r in m.threshold_table(frame(spark, data), "y", "s", rows_per_task=rows_per_task).collect()}
    known = [d for d in data if None not in d]
    assert set(got) == {s for *_, s in known}
    for t, r in got.items():
        tp = sum(y == 1 and s >= t for _, y, s in known)
        fp = sum(y == 0 and s >= t for _, y, s in known)
        assert (r["tp"], r["fp"]) == (tp, fp)
        assert r["tp"] + r["fp"] + r["fn"] + r["tn"] == len(known)
        assert r["flagged_pct"] == pytest.approx(sum(s == t for *_, s in known) / len(known))


@pytest.mark.parametrize("rows_per_task", [10 ** 6, 4])
def test_roc_curve_drops_points_inside_lines(spark, rows_per_task):
    data = [(i, y, s) for i, (y, s) in enumerate([(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6), (0, 0.5), (1, 0.4), (0, 0.3)])]
    got = sorted((r[0], r[1]) for r in m.roc_curve(frame(spark, data), "y", "s", rows_per_task=rows_per_task).collect())
    third = 1 / 3
    want = [(0, 0), (0, 0.25), (0, 0.75), (2 * third, 0.75), (2 * third, 1), (1, 1)]
    assert got == [(pytest.approx(a), pytest.approx(b)) for a, b in want]


def test_thresholds(spark):
    data = sample()
    df = frame(spark, data)
    best = max(((2 * p * r / (p + r) if p + r else 0), -t) for t, p, r in precision_recall(data))
    assert m.best_threshold(df, "y", "s").first()[0] == pytest.approx(-best[1])
    reached = max((p, -t) for t, p, r in precision_recall(data) if r >= 0.8)
    assert m.best_threshold(df, "y", "s", "target_recall", 0.8).first()[0] == pytest.approx(-reached[1])
    points = {r["rule"]: r for r in m.operating_points(df, "y", "s", 0.5, fp_budgets=[0, 10]).collect()}
    assert points["recall>=0.80"]["recall"] >= 0.8 and points["fp<=10"]["fp"] <= 10
    assert points["default_0.5"]["tp"] == sum(y for _, y, s in data if s >= 0.5)


def test_undefined_rates_are_zero(spark):
    r = m.metrics_at(frame(spark, [(1, 0, 0.1), (2, 1, 0.2)]), "y", "s", {"none": 0.9}).first()
    assert (r["precision"], r["recall"], r["f1"], r["tn"], r["fn"]) == (0.0, 0.0, 0.0, 1, 1)


@pytest.mark.parametrize("name", ["mixed", "tied"])
def test_calibration_covers_every_row(spark, name):
    data = CASES[name]
    got = m.calibration(frame(spark, data), "y", "s", ["id"]).collect()
    assert sum(r["n"] for r in got) == len(data)
    assert sum(r["n"] * r["observed"] for r in got) == pytest.approx(sum(y for _, y, _ in data))
    assert all(0 <= r["ci_low"] <= r["observed"] <= r["ci_high"] <= 1 for r in got)
    if name == "mixed":
        assert {r["n"] for r in got} == {40}


def test_review_workload(spark):
    data = sample()
    got = m.review_workload(frame(spark, data), "y", "s", ["id"], [0.001, 0.1, 0.5, 1.0]).collect()
    assert [r["k"] for r in got] == [1, 40, 200, 400]
    assert all(r["tp"] + r["fp"] == r["k"] for r in got)
    assert got[-1]["sensitivity"] == 1.0
    ordered = sorted(data, key=lambda d: -d[2])
    low = sum(y for _, y, s in data if s > ordered[199][2])
    assert low <= got[2]["tp"] <= sum(y for _, y, s in data if s >= ordered[199][2])


def test_decision_curve(spark):
    data = sample()
    got = m.decision_curve(frame(spark, data), "y", "s", (0.1, 0.5, 5)).orderBy("threshold").collect()
    n, share = len(data), sum(y for _, y, _ in data) / len(data)
    for r in got:
        t = r["threshold"]
        tp = sum(y for _, y, s in data if s >= t)
        fp = sum(1 - y for _, y, s in data if s >= t)
        assert r["model"] == pytest.approx(tp / n - fp / n * t / (1 - t))
        assert r["treat_all"] == pytest.approx(share - (1 - share) * t / (1 - t))


def test_bootstrap_interval_holds_the_point(spark):
    df = frame(spark, sample(2000))
    a = m.bootstrap_interval(df, "y", "s", reps=60).first()
    b = m.bootstrap_interval(df.repartition(11), "y", "s", reps=60).first()
    assert a == b
    assert a["ci_low"] < a["average_precision"] < a["ci_high"]
    assert a["ci_high"] - a["ci_low"] < 0.2


@pytest.mark.parametrize("count", [0, 3, 20, 500, 40_000])
def test_poisson_draws_have_the_distribution_of_the_count(spark, count):
    from pyspark.sql import functions as F
    draws = [r[0] for r in spark.range(3000).select(m.poisson_draws(F.lit(count).cast("long"), [F.col("id")])).collect()]
    mean = sum(draws) / len(draws)
    var = sum((d - mean) ** 2 for d in draws) / len(draws)
    assert abs(mean - count) <= 4 * (count / 3000) ** 0.5 + 1e-9
    assert var == pytest.approx(count, rel=0.15, abs=1e-9)


def test_small_poisson_draws_follow_the_probabilities(spark):
    import math
    from collections import Counter
    from pyspark.sql import functions as F
    found = Counter(r[0] for r in spark.range(20_000).select(m.poisson_draws(F.lit(5).cast("long"), [F.col("id")])).collect())
    for k in range(12):
        share = math.exp(-5) * 5 ** k / math.factorial(k)
        assert abs(found[k] / 20_000 - share) <= 4 * math.sqrt(share / 20_000)


def test_resamples_do_not_depend_on_the_buckets_of_scores(spark):
    df = frame(spark, sample(300))
    runs = [sorted((r["replicate"], r["average_precision"]) for r in m.bootstrap_replicates(df, "y", "s", reps=12, bucket_scores=b).collect())
            for b in (4_096, 7)]
    assert [k for k, _ in runs[0]] == list(range(1, 13))
    assert [v for _, v in runs[0]] == pytest.approx([v for _, v in runs[1]])


def test_scores_that_nearly_agree_are_drawn_apart(spark):
    """Scores nearer than 1e-9 are cells of their own: their draws differ in some resample."""
    rows = [(1, 1, 0.5), (2, 0, 0.5 + 1e-12), (3, 1, 0.5 - 1e-12), (4, 0, 0.1)]
    found = {r[0] for r in m.bootstrap_replicates(frame(spark, rows), "y", "s", reps=60).select("average_precision").collect()}
    assert len(found) > 5


def test_class_report(spark):
    got = {r["class"]: r for r in m.class_report(frame(spark, [(1, 1, 0.9), (2, 1, 0.1), (3, 0, 0.8), (4, 0, 0.2), (5, 0, 0.3)]),
                                                 "y", "s", 0.5).collect()}
    assert got["1"]["precision"] == 0.5 and got["1"]["recall"] == 0.5 and got["0"]["support"] == 3
    assert got["accuracy"]["precision"] == pytest.approx(0.6)
    assert got["weighted avg"]["recall"] == pytest.approx(0.6)
