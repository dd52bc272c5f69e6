"""Evaluation of a score against a binary outcome."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import AGE_EDGES, AGE_LABELS, right_closed_band
from ..operators import audit as a
from ..operators import metrics as m
from ..operators.ranks import decile, score_rank
from .common import query, rounded, table

# Outcome: a finished order. Score: made from the price, in steps of 0.0001, with many ties.
SCORED_SQL = """
p AS (SELECT o_orderkey, o_custkey, CAST(o_orderstatus = 'F' AS INTEGER) AS y,
             CAST(round(o_totalprice) AS BIGINT) % 5003 AS raw, o_orderpriority, o_orderdate FROM orders),
s AS (SELECT *, (raw * 2 - (raw % 7) * 3 * (1 - y) + 30) / 20000.0::DOUBLE AS score FROM p)"""
BOUND = 20_001


def scored(spark, sf):
    p = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        (F.round("o_totalprice").cast("long") % 5003).alias("raw"), "o_orderpriority", "o_orderdate")
    points = F.col("raw") * 2 - (F.col("raw") % 7) * 3 * (1 - F.col("y")) + 30
    return p.withColumn("score", points / F.lit(20000.0))


def cum_sql(groups=""):
    part = f"PARTITION BY {groups}" if groups else ""
    cols = f"{groups}, " if groups else ""
    return f"""
g AS (SELECT {cols}score AS threshold, sum(y)::BIGINT AS positives, count(*) AS flagged FROM s GROUP BY {cols}score),
c AS (SELECT *, sum(positives) OVER ({part} ORDER BY threshold DESC)::BIGINT AS tp,
             sum(flagged) OVER ({part} ORDER BY threshold DESC)::BIGINT AS seen,
             sum(positives) OVER ({part})::BIGINT AS pos, sum(flagged) OVER ({part})::BIGINT AS n FROM g),
t AS (SELECT *, seen - tp AS fp, pos - tp AS fn, n - pos - (seen - tp) AS tn, tp / seen AS "precision",
             CASE WHEN pos > 0 THEN tp / pos ELSE 0 END AS recall,
             coalesce((n - pos - (seen - tp)) / nullif(n - pos, 0), 0) AS specificity,
             2 * tp / (seen + pos) AS f1 FROM c)"""


RATES = ["precision", "recall", "specificity", "f1", "flagged_pct"]
TABLE_SQL = f"""WITH {SCORED_SQL}, {cum_sql()}
SELECT round(threshold, 6) AS threshold, positives, flagged, tp, fp, fn, tn, round("precision", 6) AS "precision",
  round(recall, 6) AS recall, round(specificity, 6) AS specificity, round(f1, 6) AS f1,
  round(flagged / n, 6) AS flagged_pct FROM t"""


@query("threshold_table", TABLE_SQL)
def threshold_table(spark, sf):
    return rounded(m.threshold_table(scored(spark, sf), "y", "score", max_rows=BOUND), "threshold", *RATES)


@query("threshold_table_bucketed", TABLE_SQL)
def threshold_table_bucketed(spark, sf):
    """The same through the bucketed order that takes over for many distinct scores."""
    return rounded(m.threshold_table(scored(spark, sf), "y", "score", rows_per_task=1000), "threshold", *RATES)


AP = 'sum(positives / pos * "precision")'
TRAPEZOID = """sum(positives / pos * ("precision" + CASE WHEN seen = flagged THEN 1 ELSE (tp - positives) /
  nullif(seen - flagged, 0) END) / 2)"""
AUC = "sum(positives * (tn + (flagged - positives) / 2)) / (max(pos) * (max(n) - max(pos)))"


@query("average_precision", f"WITH {SCORED_SQL}, {cum_sql()} SELECT round({AP}, 6) AS average_precision FROM t")
def average_precision(spark, sf):
    return rounded(m.average_precision(scored(spark, sf), "y", "score", max_rows=BOUND), "average_precision")


@query("roc_auc", f"WITH {SCORED_SQL}, {cum_sql()} SELECT round({AUC}, 6) AS roc_auc FROM t")
def roc_auc(spark, sf):
    return rounded(m.roc_auc(scored(spark, sf), "y", "score", max_rows=BOUND), "roc_auc")


@query("summary_scores_by_group", f"""WITH {SCORED_SQL}, {cum_sql('o_orderpriority')}
SELECT o_orderpriority, max(n) AS n, max(pos) AS positives, round({AP}, 6) AS average_precision,
       round({TRAPEZOID}, 6) AS pr_auc_trapezoidal, round({AUC}, 6) AS roc_auc FROM t GROUP BY o_orderpriority""")
def summary_scores_by_group(spark, sf):
    out = m.summary_scores(scored(spark, sf), "y", "score", ["o_orderpriority"])
    return rounded(out, "average_precision", "pr_auc_trapezoidal", "roc_auc")


@query("pr_curve", f"""WITH {SCORED_SQL}, {cum_sql()} SELECT round(recall, 6) AS recall,
  round("precision", 6) AS "precision", round(threshold, 6) AS threshold FROM t UNION ALL SELECT 0.0, 1.0, NULL""")
def pr_curve(spark, sf):
    return rounded(m.pr_curve(scored(spark, sf), "y", "score", max_rows=BOUND), "recall", "precision", "threshold")


ROC_SQL = f"""WITH {SCORED_SQL}, {cum_sql()}, w AS (SELECT *, lead(positives) OVER (ORDER BY threshold DESC) AS np,
  lead(flagged - positives) OVER (ORDER BY threshold DESC) AS nn FROM t)
SELECT round(fp / (n - pos), 6) AS false_positive_rate, round(tp / pos, 6) AS true_positive_rate,
       round(threshold, 6) AS threshold FROM w
WHERE seen = flagged OR np IS NULL OR np <> positives OR nn <> flagged - positives
UNION ALL SELECT 0.0, 0.0, 'inf'::DOUBLE"""


@query("roc_curve", ROC_SQL)
def roc_curve(spark, sf):
    return rounded(m.roc_curve(scored(spark, sf), "y", "score", max_rows=BOUND), "false_positive_rate",
                   "true_positive_rate", "threshold")


@query("roc_curve_bucketed", ROC_SQL)
def roc_curve_bucketed(spark, sf):
    return rounded(m.roc_curve(scored(spark, sf), "y", "score", rows_per_task=500), "false_positive_rate",
                   "true_positive_rate", "threshold")


@query("best_f1_threshold", f"""WITH {SCORED_SQL}, {cum_sql()}
SELECT round(arg_max(threshold, row(round(f1, 12), -threshold)), 6) AS threshold FROM t""")
def best_f1_threshold(spark, sf):
    return rounded(m.best_threshold(scored(spark, sf), "y", "score", max_rows=BOUND), "threshold")


@query("target_recall_threshold", f"""WITH {SCORED_SQL}, {cum_sql()}
SELECT round(arg_max(threshold, row("precision", -threshold)), 6) AS threshold FROM t WHERE recall >= 0.6""")
def target_recall_threshold(spark, sf):
    return rounded(m.best_threshold(scored(spark, sf), "y", "score", "target_recall", 0.6, max_rows=BOUND), "threshold")


AT_SQL = """a AS (SELECT rule, r.threshold, count(*) FILTER (WHERE score >= r.threshold AND y = 1) AS tp,
  count(*) FILTER (WHERE score >= r.threshold AND y = 0) AS fp, count(*) FILTER (WHERE score < r.threshold AND y = 1) AS fn,
  count(*) FILTER (WHERE score < r.threshold AND y = 0) AS tn, count(*) AS n FROM s, rules r GROUP BY ALL)
SELECT rule, round(threshold, 6) AS threshold, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision",
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + fp) / n, 6) AS flagged_pct FROM a"""


@query("metrics_at_threshold", f"""WITH {SCORED_SQL}, rules AS (SELECT * FROM (VALUES ('low', 0.1::DOUBLE), ('half', 0.5),
  ('none', 2.0)) v(rule, threshold)), {AT_SQL}""")
def metrics_at_threshold(spark, sf):
    out = m.metrics_at(scored(spark, sf), "y", "score", {"low": 0.1, "half": 0.5, "none": 2.0})
    return rounded(out, "threshold", *RATES)


@query("operating_points", f"""WITH {SCORED_SQL}, {cum_sql()},
rules AS (SELECT 'validation_f1' AS rule, arg_max(threshold, row(round(f1, 12), -threshold)) AS threshold FROM t
  UNION ALL SELECT 'default_0.5', 0.5
  UNION ALL SELECT 'recall>=' || r, arg_max(threshold, row("precision", threshold)) FROM t,
    (VALUES ('0.80'), ('0.60'), ('0.40'), ('0.20')) v(r) WHERE recall >= r::DOUBLE GROUP BY r
  UNION ALL SELECT 'fp<=' || b, arg_max(threshold, row(recall, "precision", threshold)) FROM t,
    (VALUES (10), (25), (50), (100)) v(b) WHERE fp <= b GROUP BY b), {AT_SQL}""")
def operating_points(spark, sf):
    rows = scored(spark, sf)
    best = m.best_threshold(rows, "y", "score", max_rows=BOUND).first()["threshold"]
    return rounded(m.operating_points(rows, "y", "score", best, max_rows=BOUND), "threshold", *RATES)


@query("class_report", f"""WITH {SCORED_SQL}, k AS (SELECT count(*) FILTER (WHERE y = 1 AND score >= 0.2) AS tp,
  count(*) FILTER (WHERE y = 0 AND score >= 0.2) AS fp, count(*) FILTER (WHERE y = 1 AND score < 0.2) AS fn,
  count(*) FILTER (WHERE y = 0 AND score < 0.2) AS tn FROM s),
b AS (SELECT '0' AS class, tn / (tn + fn) AS "precision", tn / (tn + fp) AS recall,
        2 * tn / (2 * tn + fn + fp) AS f1, tn + fp AS support, tn AS hit FROM k
      UNION ALL SELECT '1', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn, tp FROM k),
u AS (SELECT class, "precision", recall, f1, support FROM b
      UNION ALL SELECT 'macro avg', avg("precision"), avg(recall), avg(f1), sum(support)::BIGINT FROM b
      UNION ALL SELECT 'weighted avg', sum("precision" * support) / sum(support), sum(recall * support) / sum(support),
        sum(f1 * support) / sum(support), sum(support)::BIGINT FROM b
      UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support),
        sum(support)::BIGINT FROM b)
SELECT class, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM u""")
def class_report(spark, sf):
    return rounded(m.class_report(scored(spark, sf), "y", "score", 0.2), "precision", "recall", "f1")


RANKED_SQL = """ranked AS (SELECT *, row_number() OVER (ORDER BY score {way}, md5(o_orderkey || ':0'), o_orderkey) AS r,
  count(*) OVER () AS total FROM s)"""
CALIBRATION_SQL = f"""{RANKED_SQL.format(way='ASC')},
d AS (SELECT greatest(1, ((r - 1) * 10 + total - 2) // (total - 1))::BIGINT AS decile, count(*) AS n,
             avg(score) AS mean_predicted, avg(y) AS observed FROM ranked GROUP BY 1)"""
CALIBRATION_OUT = """SELECT decile, n, round(mean_predicted, 6) AS mean_predicted, round(observed, 6) AS observed,
  round(greatest(0, observed - 1.96 * sqrt(observed * (1 - observed) / n)), 6) AS ci_low,
  round(least(1, observed + 1.96 * sqrt(observed * (1 - observed) / n)), 6) AS ci_high FROM d"""


@query("calibration", f"WITH {SCORED_SQL}, {CALIBRATION_SQL} {CALIBRATION_OUT}")
def calibration(spark, sf):
    return rounded(m.calibration(scored(spark, sf), "y", "score", ["o_orderkey"]), "mean_predicted", "observed",
                   "ci_low", "ci_high")


@query("calibration_bucketed", f"WITH {SCORED_SQL}, {CALIBRATION_SQL} {CALIBRATION_OUT}")
def calibration_bucketed(spark, sf):
    return rounded(m.calibration(scored(spark, sf), "y", "score", ["o_orderkey"], rows_per_task=2000),
                   "mean_predicted", "observed", "ci_low", "ci_high")


@query("score_deciles", f"""WITH {SCORED_SQL}, {RANKED_SQL.format(way='ASC')} SELECT o_orderkey, r AS score_rank,
  greatest(1, ((r - 1) * 10 + total - 2) // (total - 1))::BIGINT AS decile FROM ranked""")
def score_deciles(spark, sf):
    ranked = score_rank(scored(spark, sf), "score", ["o_orderkey"], descending=False)
    return ranked.select("o_orderkey", "score_rank", decile("score_rank", "score_rank_total").alias("decile"))


@query("ece", f"""WITH {SCORED_SQL}, {CALIBRATION_SQL}
SELECT round(sum(abs(observed - mean_predicted) * n) / sum(n), 6) AS ece FROM d""")
def ece(spark, sf):
    return rounded(m.ece(scored(spark, sf), "y", "score", ["o_orderkey"]), "ece")


GRID_SQL = "grid AS (SELECT CASE WHEN i = 99 THEN 0.5::DOUBLE ELSE 0.01::DOUBLE + i * ((0.5::DOUBLE - 0.01::DOUBLE) / 99) END AS t FROM range(100) r(i))"


@query("decision_curve", f"""WITH {SCORED_SQL}, {GRID_SQL}, k AS (SELECT t, count(*) FILTER (WHERE y = 1 AND score >= t) AS tp,
  count(*) FILTER (WHERE y = 0 AND score >= t) AS fp, count(*) AS n, avg(y) AS share FROM s, grid GROUP BY t)
SELECT round(t, 6) AS threshold, round(tp / n - fp / n * (t / (1 - t)), 6) AS model,
       round(share - (1 - share) * (t / (1 - t)), 6) AS treat_all, 0.0::DOUBLE AS treat_none FROM k""")
def decision_curve(spark, sf):
    return rounded(m.decision_curve(scored(spark, sf), "y", "score"), "threshold", "model", "treat_all")


@query("topk_workload", f"""WITH {SCORED_SQL}, {RANKED_SQL.format(way='DESC')},
shares AS (SELECT * FROM (VALUES (0.01::DOUBLE), (0.02), (0.05), (0.10)) v(top_percent)),
k AS (SELECT top_percent, greatest(1, ceil(max(total) * top_percent))::BIGINT AS k, sum(y) AS p FROM ranked, shares
      GROUP BY top_percent),
h AS (SELECT top_percent, k, max(p) AS p, count(*) FILTER (WHERE y = 1 AND r <= k) AS tp FROM ranked, k GROUP BY 1, 2)
SELECT top_percent, k, tp, k - tp AS fp, round(tp / p, 6) AS sensitivity, round(tp / k, 6) AS ppv FROM h""")
def topk_workload(spark, sf):
    return rounded(m.review_workload(scored(spark, sf), "y", "score", ["o_orderkey"]), "sensitivity", "ppv")


def bootstrap_sql(groups: str = "", reps: int = 400) -> str:
    """Resamples of the score counts `g` (groups, threshold, positives, flagged) as table `ap` (groups, replicate, v)."""
    by, lead = (f"{groups}, ", "PARTITION BY " + groups) if groups else ("", "")
    text = "".join(f" || ':' || {c.strip()}" for c in groups.split(",")) if groups else ""
    return f"""
lam AS (SELECT lv, pow(2, lv) AS mean, greatest(0, floor(pow(2, lv) - 12 * sqrt(pow(2, lv)) - 12))::BIGINT AS lo FROM range(0, 15) r(lv)),
cdf AS (SELECT lv, lo, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY lv ORDER BY k) AS c
        FROM lam, LATERAL (SELECT unnest(range(lo, ceil(mean + 12 * sqrt(mean) + 30)::BIGINT + 1)) AS k)),
placed AS (SELECT *, sum(flagged) OVER ({lead} ORDER BY threshold DESC)::BIGINT AS seen FROM g),
sides AS (SELECT {by}replicate, seen, side, CASE side WHEN 'p' THEN positives ELSE flagged - positives END::BIGINT AS n
          FROM placed, range(1, {reps + 1}) r(replicate), (VALUES ('p'), ('n')) v(side)),
pieces AS (SELECT {by}replicate, seen, side, unnest(list_concat(list_filter(range(0, 14), lambda b: (n >> b) & 1 = 1), range(14, 14 + (n >> 14)))) AS i FROM sides),
us AS (SELECT *, least(i, 14) AS lv, (('0x' || substr(md5('42:' || replicate{text} || ':' || seen || ':' || side || ':' || i), 1, 13))::BIGINT + 0.5)
       / 4503599627370496.0::DOUBLE AS u FROM pieces),
draws AS (SELECT {by}replicate, seen, side, sum(coalesce(t.k + 1, greatest(0, floor(pow(2, us.lv) - 12 * sqrt(pow(2, us.lv)) - 12))::BIGINT))::BIGINT AS x
          FROM us ASOF LEFT JOIN cdf t ON us.lv = t.lv AND us.u >= t.c GROUP BY ALL),
cells AS (SELECT {by}replicate, seen, coalesce(sum(x) FILTER (WHERE side = 'p'), 0) AS p, sum(x) AS n FROM draws GROUP BY ALL),
bc AS (SELECT *, sum(p) OVER (PARTITION BY {by}replicate ORDER BY seen) AS tp, sum(n) OVER (PARTITION BY {by}replicate ORDER BY seen) AS m,
         sum(p) OVER (PARTITION BY {by}replicate) AS pos, sum(n) OVER (PARTITION BY {by}replicate) AS total FROM cells),
ap AS (SELECT {by}replicate, CASE WHEN max(pos) > 0 AND max(total) > max(pos) THEN sum(CASE WHEN m > 0 THEN p / pos * (tp / m) ELSE 0 END) END AS v
       FROM bc GROUP BY {by}replicate)"""


# Coarse scores of a few hundred values, so that cells are large and both forms of the draw occur.
COARSE_SQL = "s AS (SELECT y, raw % 150 / 150.0::DOUBLE + y * 0.1::DOUBLE AS score FROM p)"


def coarse(spark, sf):
    return scored(spark, sf).withColumn("score", (F.col("raw") % 150) / F.lit(150.0) + F.col("y") * F.lit(0.1))


BOOTSTRAP_SQL = f"""WITH {SCORED_SQL.split('s AS')[0]} {COARSE_SQL}, {cum_sql()}, {bootstrap_sql()}
SELECT max(n) AS n, max(pos) AS positives, round({AP}, 6) AS average_precision,
       round((SELECT quantile_cont(v, 0.025) FROM ap), 6) AS ci_low,
       round((SELECT quantile_cont(v, 0.975) FROM ap), 6) AS ci_high FROM t"""


@query("bootstrap_ap", BOOTSTRAP_SQL)
def bootstrap_ap(spark, sf):
    out = m.bootstrap_interval(coarse(spark, sf), "y", "score", max_rows=400)
    return rounded(out, "average_precision", "ci_low", "ci_high")


@query("bootstrap_ap_400", BOOTSTRAP_SQL)
def bootstrap_ap_400(spark, sf):
    """The same with no bound on the distinct scores, so through the measured path."""
    out = m.bootstrap_interval(coarse(spark, sf), "y", "score")
    return rounded(out, "average_precision", "ci_low", "ci_high")


@query("subgroup_ap", f"""WITH {SCORED_SQL.split('s AS')[0]}
s0 AS (SELECT *, (raw * 2 - (raw % 7) * 3 * (1 - y) + 30) / 20000.0::DOUBLE AS score, year(o_orderdate)::VARCHAR AS yr,
  CASE WHEN o_custkey % 90 > 0 AND o_custkey % 90 <= 55 THEN '<55' WHEN o_custkey % 90 > 55 AND o_custkey % 90 <= 65
  THEN '55-64' WHEN o_custkey % 90 > 65 AND o_custkey % 90 <= 75 THEN '65-74' WHEN o_custkey % 90 > 75 THEN '75+' END AS band
  FROM p),
s AS (SELECT y, score, 'yr' AS domain, yr AS subgroup FROM s0 UNION ALL
      SELECT y, score, 'band', coalesce(band, 'missing') FROM s0),
best AS (SELECT domain, subgroup FROM (SELECT domain, subgroup, count(*) AS n FROM s GROUP BY ALL)
         QUALIFY row_number() OVER (PARTITION BY domain ORDER BY n DESC, subgroup) <= 5), {cum_sql('domain, subgroup')}
SELECT domain, subgroup, max(n) AS n, max(pos) AS positives, round({AP}, 6) AS average_precision
FROM t SEMI JOIN best USING (domain, subgroup) GROUP BY ALL HAVING max(n) >= 40 AND max(pos) >= 3""")
def subgroup_ap(spark, sf):
    rows = scored(spark, sf).withColumns({
        "yr": F.year("o_orderdate").cast("string"), "age": F.col("o_custkey") % 90})
    rows = rows.withColumn("band", right_closed_band("age", AGE_EDGES, AGE_LABELS))
    return rounded(m.subgroup_scores(rows, "y", "score", ["yr", "band"]), "average_precision")


@query("subgroup_ap_interval", f"""WITH {SCORED_SQL.split('s AS')[0]}
s0 AS (SELECT *, raw % 150 / 150.0::DOUBLE + y * 0.1::DOUBLE AS score FROM p),
s1 AS (SELECT y, score, 'yr' AS domain, year(o_orderdate)::VARCHAR AS subgroup FROM s0 UNION ALL
       SELECT y, score, 'o_orderpriority', o_orderpriority FROM s0),
sized AS (SELECT domain, subgroup, count(*) AS n, sum(y) AS p FROM s1 GROUP BY ALL),
best AS (SELECT domain, subgroup FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, subgroup) AS k FROM sized)
         WHERE k <= 5 AND n >= 40 AND p >= 3),
s AS (SELECT s1.* FROM s1 SEMI JOIN best USING (domain, subgroup)), {cum_sql('domain, subgroup')}, {bootstrap_sql('domain, subgroup')},
limits AS (SELECT domain, subgroup, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM ap GROUP BY ALL),
points AS (SELECT domain, subgroup, max(n) AS n, max(pos) AS positives, {AP} AS ap FROM t GROUP BY ALL)
SELECT domain, subgroup, n, positives, round(ap, 6) AS average_precision, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high
FROM points JOIN limits USING (domain, subgroup)""")
def subgroup_ap_interval(spark, sf):
    rows = coarse(spark, sf).withColumn("yr", F.year("o_orderdate").cast("string"))
    out = m.subgroup_scores(rows, "y", "score", ["yr", "o_orderpriority"], reps=400, max_rows=400)
    return rounded(out, "average_precision", "ci_low", "ci_high")


@query("timing_bins", f"""WITH {SCORED_SQL.split('s AS')[0]} s0 AS (SELECT *,
  (raw * 2 - (raw % 7) * 3 * (1 - y) + 30) / 20000.0::DOUBLE AS score, raw % 30 AS hours FROM p),
s AS (SELECT y, score, CASE WHEN hours <= 2 THEN '0-2h' WHEN hours <= 6 THEN '2-6h' WHEN hours <= 12 THEN '6-12h'
  ELSE '12-24h' END AS timing_bin FROM s0 WHERE hours <= 24), {cum_sql('timing_bin')}
SELECT timing_bin, max(n) AS n, max(pos) AS positives, round({AP}, 6) AS average_precision, round({AUC}, 6) AS roc_auc
FROM t GROUP BY timing_bin""")
def timing_bins(spark, sf):
    from ..functions.times import TIMING_EDGES, TIMING_LABELS
    rows = scored(spark, sf).withColumn("hours", F.col("raw") % 30)
    rows = rows.withColumn("timing_bin", right_closed_band("hours", TIMING_EDGES, TIMING_LABELS))
    out = m.summary_scores(rows.where(F.col("timing_bin").isNotNull()), "y", "score", ["timing_bin"])
    return rounded(out.drop("pr_auc_trapezoidal"), "average_precision", "roc_auc")


@query("score_histogram", f"""WITH {SCORED_SQL} SELECT y, least(floor(score * 24 / 0.6::DOUBLE)::BIGINT + 1, 24) AS bin,
  count(*) AS n FROM s WHERE score BETWEEN 0 AND 0.6 GROUP BY ALL""")
def score_histogram(spark, sf):
    return a.histogram(scored(spark, sf), "score", 0, 0.6, 24, ["y"])


@query("error_review", f"""WITH {SCORED_SQL} SELECT CASE WHEN y = 0 THEN 'False positive' ELSE 'False negative' END AS error,
  CASE WHEN y = 0 THEN o_orderpriority ELSE 'Year ' || year(o_orderdate) END AS category, count(*) AS n
FROM s WHERE (score >= 0.3) <> (y = 1) GROUP BY ALL""")
def error_review(spark, sf):
    return m.error_counts(scored(spark, sf), "y", "score", 0.3, F.col("o_orderpriority"),
                          F.concat(F.lit("Year "), F.year("o_orderdate")))


@query("score_median_by_group", f"""WITH {SCORED_SQL} SELECT o_orderpriority, count(*) AS n,
  round(median(score), 6) AS median FROM s GROUP BY o_orderpriority""")
def score_median_by_group(spark, sf):
    return rounded(m.median_by_group(scored(spark, sf), "score", "o_orderpriority", max_rows=BOUND), "median")


@query("model_comparison", f"""WITH {SCORED_SQL}, {cum_sql()}, {CALIBRATION_SQL},
cut AS (SELECT count(*) FILTER (WHERE y = 1 AND score >= 0.3) AS tp, count(*) FILTER (WHERE score >= 0.3) AS hit FROM s)
SELECT 'price' AS model, 'low' AS leakage_risk, max(n) AS holdout_rows, max(pos) AS holdout_positive,
  round({AP}, 6) AS average_precision, round({AUC}, 6) AS roc_auc, round((SELECT tp / hit FROM cut), 6) AS selected_precision,
  round((SELECT tp FROM cut) / max(pos), 6) AS selected_recall,
  (SELECT round(sum(abs(observed - mean_predicted) * n) / sum(n), 6) FROM d) AS ece FROM t""")
def model_comparison(spark, sf):
    out = m.model_comparison({"price": (scored(spark, sf), "low")}, "y", "score", ["o_orderkey"], {"price": 0.3}, BOUND)
    return rounded(out, "average_precision", "roc_auc", "selected_precision", "selected_recall", "ece")
