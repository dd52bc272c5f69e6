"""Exact evaluation of a binary score: threshold tables, curves, calibration, decision curves, bootstrap.

Everything starts from `score_counts`, one row per distinct score with its positives and rows, reduced on the
map side. The cumulative counts come from `ordered_sums`, so no step sorts the predictions in one task.
`max_rows` is an optional proven bound on the number of distinct scores in a group, for example 10,001 for
scores in [0, 1] rounded to 4 digits; with it no size check is run.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranks import ROWS_PER_TASK, decile, exact_quantiles, hash_rank, ordered_sums

# Recall targets, false-positive budgets, review shares and the decision grid.
RECALL_TARGETS = [0.80, 0.60, 0.40, 0.20]
FP_BUDGETS = [10, 25, 50, 100]
REVIEW_SHARES = [0.01, 0.02, 0.05, 0.10]
DECISION_GRID = (0.01, 0.50, 100)


def known_rows(df: DataFrame, y: str, score: str) -> DataFrame:
    """Rows with an outcome and a score that is a number: those that every metric is taken over."""
    return df.where(F.col(y).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))


def score_counts(df: DataFrame, y: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Rows (`flagged`) and positives per distinct score; rows without score or outcome are left out."""
    return known_rows(df, y, score).groupBy(*groups, F.col(score).cast("double").alias("threshold")).agg(
        F.sum(F.col(y).cast("long")).alias("positives"), F.count(F.lit(1)).alias("flagged"))


def cumulative(counts: DataFrame, groups: Sequence[str] = (), lead: Sequence[str] = (), max_rows: int | None = None,
               rows_per_task: int = ROWS_PER_TASK, settled: bool = False) -> DataFrame:
    """Score counts with `tp` and `seen` at or above each score, and the group totals."""
    return ordered_sums(counts, "threshold", {"tp": "positives", "seen": "flagged"}, groups, descending=True,
                        lead=lead, max_rows=max_rows, rows_per_task=rows_per_task, settled=settled)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _rates(df: DataFrame) -> DataFrame:
    """precision, recall, specificity and f1 from tp, fp, fn, tn; 0 where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.withColumns({
        "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "specificity": _ratio(tn, tn + fp),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn)})


def threshold_table(df: DataFrame, y: str, score: str, groups: Sequence[str] = (), max_rows: int | None = None,
                    rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Confusion counts and rates at every distinct score. `flagged_pct` is that score's own share of rows."""
    cum = cumulative(score_counts(df, y, score, groups), groups, max_rows=max_rows, rows_per_task=rows_per_task)
    fp = F.col("seen") - F.col("tp")
    table = cum.select(
        *groups, "threshold", "positives", "flagged", "tp", fp.alias("fp"), (F.col("tp_total") - F.col("tp")).alias("fn"),
        (F.col("seen_total") - F.col("tp_total") - fp).alias("tn"),
        (F.col("flagged") / F.col("seen_total")).alias("flagged_pct"))
    return _rates(table)


def _points(df, y, score, groups, max_rows, rows_per_task):
    """Per distinct score: precision and recall there and at the next higher score (0 and 1 at the start)."""
    cum = cumulative(score_counts(df, y, score, groups), groups, max_rows=max_rows, rows_per_task=rows_per_task)
    before_tp, before = F.col("tp") - F.col("positives"), F.col("seen") - F.col("flagged")
    return cum.withColumns({
        "precision": F.col("tp") / F.col("seen"), "recall": F.try_divide(F.col("tp"), F.col("tp_total")),
        "precision_before": F.coalesce(F.try_divide(before_tp, before), F.lit(1.0)),
        "gain": F.try_divide(F.col("positives"), F.col("tp_total")),
        "negatives": F.col("flagged") - F.col("positives"),
        "negatives_below": (F.col("seen_total") - F.col("tp_total")) - (F.col("seen") - F.col("tp"))})


def summary_scores(df: DataFrame, y: str, score: str, groups: Sequence[str] = (), max_rows: int | None = None,
                   rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """n, positives, average precision, trapezoidal PR area and ROC area per group, in one pass over the counts.

    Average precision adds recall gains times the precision at the score. ROC area counts, per positive,
    the negatives below it and half of those at the same score. Both are null when a class is missing.
    """
    points = _points(df, y, score, groups, max_rows, rows_per_task)
    negatives_total = F.max("seen_total") - F.max("tp_total")
    both = (F.max("tp_total") > 0) & (negatives_total > 0)
    pairs = F.sum(F.col("positives") * (F.col("negatives_below") + F.col("negatives") / 2))
    return points.groupBy(*groups).agg(
        F.max("seen_total").alias("n"), F.max("tp_total").alias("positives"),
        F.when(both, F.sum(F.col("gain") * F.col("precision"))).alias("average_precision"),
        F.when(both, F.sum(F.col("gain") * (F.col("precision") + F.col("precision_before")) / 2))
        .alias("pr_auc_trapezoidal"),
        F.when(both, F.try_divide(pairs, F.max("tp_total") * negatives_total)).alias("roc_auc"))


def average_precision(df: DataFrame, y: str, score: str, groups: Sequence[str] = (), **bounds) -> DataFrame:
    return summary_scores(df, y, score, groups, **bounds).select(*groups, "average_precision")


def roc_auc(df: DataFrame, y: str, score: str, groups: Sequence[str] = (), **bounds) -> DataFrame:
    return summary_scores(df, y, score, groups, **bounds).select(*groups, "roc_auc")


def pr_curve(df: DataFrame, y: str, score: str, max_rows: int | None = None,
             rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(recall, precision, threshold) at every distinct score, and the end point (0, 1) without threshold."""
    points = _points(df, y, score, [], max_rows, rows_per_task).select("recall", "precision", "threshold")
    end = df.sparkSession.range(1).select(F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"),
                                          F.lit(None).cast("double").alias("threshold"))
    return points.unionByName(end)


def roc_curve(df: DataFrame, y: str, score: str, max_rows: int | None = None,
              rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """ROC points from (0, 0) at threshold infinity, without the points inside a straight line.

    A point is inside a line when the next score adds the same positives and negatives as its own.
    """
    counts = score_counts(df, y, score).withColumn("negatives", F.col("flagged") - F.col("positives"))
    cum = cumulative(counts, lead=["positives", "negatives"], max_rows=max_rows, rows_per_task=rows_per_task)
    first = F.col("seen") == F.col("flagged")
    last = F.col("next_positives").isNull()
    bend = (F.col("next_positives") != F.col("positives")) | (F.col("next_negatives") != F.col("negatives"))
    negatives = F.col("seen_total") - F.col("tp_total")
    points = cum.where(first | last | bend).select(
        F.try_divide(F.col("seen") - F.col("tp"), negatives).alias("false_positive_rate"),
        F.try_divide(F.col("tp"), F.col("tp_total")).alias("true_positive_rate"), "threshold")
    start = df.sparkSession.range(1).select(
        F.lit(0.0).alias("false_positive_rate"), F.lit(0.0).alias("true_positive_rate"),
        F.lit(float("inf")).alias("threshold"))
    return start.unionByName(points)


def metrics_at(df: DataFrame, y: str, score: str, rules: Mapping[str, float]) -> DataFrame:
    """One row per named threshold with confusion counts and rates, all from one pass over the predictions."""
    case = F.col(y) == 1
    aggs = [F.count_if(case).alias("_p"), F.count(F.lit(1)).alias("_n")]
    for i, threshold in enumerate(rules.values()):
        hit = F.col(score) >= F.lit(float(threshold))
        aggs += [F.count_if(hit & case).alias(f"_tp{i}"), F.count_if(hit).alias(f"_hit{i}")]
    counts = known_rows(df, y, score).agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(float(threshold)).alias("threshold"),
                 F.col(f"_tp{i}").alias("tp"), (F.col(f"_hit{i}") - F.col(f"_tp{i}")).alias("fp"),
                 (F.col("_p") - F.col(f"_tp{i}")).alias("fn"),
                 (F.col("_n") - F.col("_p") - F.col(f"_hit{i}") + F.col(f"_tp{i}")).alias("tn"),
                 _ratio(F.col(f"_hit{i}"), F.col("_n")).alias("flagged_pct"))
        for i, (rule, threshold) in enumerate(rules.items())])
    out = _rates(counts.select(F.inline(rows)))
    return out.select("rule", "threshold", "precision", "recall", "specificity", "f1", "flagged_pct", "tp", "fp", "fn",
                      "tn")


def best_threshold(df: DataFrame, y: str, score: str, metric: str = "f1", target_recall: float = 0.80,
                   max_rows: int | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """One row: the threshold of the highest F1 (lowest threshold on ties), or, for `target_recall`, of the
    highest precision that still reaches the recall, if any does."""
    table = threshold_table(df, y, score, max_rows=max_rows, rows_per_task=rows_per_task)
    f1 = F.round(F.col("f1"), 12)
    by_f1 = F.max_by("threshold", F.struct(f1, -F.col("threshold")))
    if metric == "f1":
        return table.agg(by_f1.alias("threshold"))
    if metric != "target_recall":
        raise ValueError(f"unknown metric: {metric}")
    reaches = F.col("recall") >= target_recall
    by_recall = F.max_by("threshold", F.when(reaches, F.struct("precision", -F.col("threshold"))))
    return table.agg(F.coalesce(by_recall, by_f1).alias("threshold"))


def operating_points(df: DataFrame, y: str, score: str, selected: float, recall_targets=RECALL_TARGETS,
                     fp_budgets=FP_BUDGETS, max_rows: int | None = None,
                     rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Metrics at the selected threshold, at 0.5, at the best threshold per recall target (precision, then
    threshold) and per false-positive budget (recall, precision, then threshold). Rules nothing meets are
    left out.

    The targets are read off the rows that are scored here: use it to report, not to choose.
    """
    table = threshold_table(df, y, score, max_rows=max_rows, rows_per_task=rows_per_task)
    picks = []
    for target in recall_targets:
        order = F.when(F.col("recall") >= target, F.struct("precision", "threshold"))
        picks.append((f"recall>={target:.2f}", F.max_by("threshold", order)))
    for budget in fp_budgets:
        order = F.when(F.col("fp") <= budget, F.struct("recall", "precision", "threshold"))
        picks.append((f"fp<={budget}", F.max_by("threshold", order)))
    found = table.agg(*[pick.alias(rule) for rule, pick in picks]).first() if picks else ()
    rules = {"validation_f1": selected, "default_0.5": 0.5}
    rules |= {rule: t for (rule, _), t in zip(picks, found) if t is not None}
    return metrics_at(df, y, score, rules)


def class_report(df: DataFrame, y: str, score: str, threshold: float) -> DataFrame:
    """Precision, recall, f1 and support of both classes, their plain and weighted mean, and the accuracy."""
    case, hit = F.col(y) == 1, F.col(score) >= threshold
    counts = known_rows(df, y, score).agg(F.count_if(case & hit).alias("tp"), F.count_if(~case & hit).alias("fp"),
                    F.count_if(case & ~hit).alias("fn"), F.count_if(~case & ~hit).alias("tn"))
    sides = counts.select(F.inline(F.array(
        F.struct(F.lit("0").alias("class"), F.col("tn").alias("tp"), F.col("fn").alias("fp"), F.col("fp").alias("fn"),
                 F.col("tp").alias("tn")),
        F.struct(F.lit("1").alias("class"), "tp", "fp", "fn", "tn"))))
    per_class = _rates(sides).withColumn("support", F.col("tp") + F.col("fn"))
    names = ["precision", "recall", "f1"]
    total = F.sum("support")
    means = per_class.agg(
        *[F.avg(c).alias(f"m_{c}") for c in names], *[_ratio(F.sum(F.col(c) * F.col("support")), total).alias(f"w_{c}")
                                                      for c in names],
        _ratio(F.sum("tp"), total).alias("acc"), total.alias("support"))
    pick = lambda name, p: F.struct(F.lit(name).alias("class"), *[F.col(f"{p}_{c}").alias(c) for c in names], "support")
    overall = means.select(F.inline(F.array(
        pick("macro avg", "m"), pick("weighted avg", "w"),
        F.struct(F.lit("accuracy").alias("class"), *[F.col("acc").alias(c) for c in names], "support"))))
    return per_class.select("class", *names, "support").unionByName(overall)


def _tied_rows(df: DataFrame, y: str, score: str, keys: Sequence[str], scores: Sequence[float],
               seed: int | str) -> DataFrame:
    """The rows of the given scores with `_place`, their rank in hash order among the rows of their score."""
    rows = df.where(F.col(y).isNotNull() & F.col(score).cast("double").isin([float(s) for s in scores]))
    rows = rows.select(*keys, F.col(y).cast("long").alias("_y"), F.col(score).cast("double").alias("_score"))
    return hash_rank(rows, keys, seed, ["_score"], "_place")


def _by_score(values: Mapping[float, int]) -> Column:
    ladder = None
    for value, number in values.items():
        hit = F.col("_score") == F.lit(float(value))
        ladder = F.when(hit, number) if ladder is None else ladder.when(hit, number)
    return ladder


def calibration(df: DataFrame, y: str, score: str, keys: Sequence[str], bins: int = 10, seed: int | str = 0,
                rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Per equal-count bin of the score: n, mean score, observed rate and its 1.96-standard-error bounds in
    [0, 1]. Equal scores are ordered by the hash of the row keys.

    Scores whose rows all fall in one bin are added up from the score counts. Only the rows of a score that a
    bin limit cuts, at most `bins - 1` scores, are ranked.
    """
    counts = cut_lineage(score_counts(df, y, score))
    cum = cumulative(counts, rows_per_task=rows_per_task, settled=True)
    total = F.col("seen_total")
    placed = cum.withColumns({"_low": total - F.col("seen") + 1, "_high": total - F.col("seen") + F.col("flagged")})
    placed = placed.withColumns({"_from": decile("_low", "seen_total", bins), "_to": decile("_high", "seen_total", bins)})
    table = placed.where(F.col("_from") == F.col("_to")).groupBy(F.col("_from").alias("decile")).agg(
        F.sum("flagged").alias("n"), F.sum("positives").alias("_p"),
        F.sum(F.col("threshold") * F.col("flagged")).alias("_s"))
    cut = placed.where(F.col("_from") != F.col("_to")).select("threshold", "_low", "seen_total").collect()
    if cut:
        ranked = _tied_rows(df, y, score, keys, [r["threshold"] for r in cut], seed).withColumns({
            "_rank": F.col("_place") - 1 + _by_score({r["threshold"]: r["_low"] for r in cut}),
            "_n": F.lit(cut[0]["seen_total"])})
        table = table.unionByName(ranked.groupBy(decile("_rank", "_n", bins).alias("decile")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("_y").alias("_p"), F.sum("_score").alias("_s")))
    out = table.groupBy("decile").agg(F.sum("n").alias("n"), (F.sum("_s") / F.sum("n")).alias("mean_predicted"),
                                      (F.sum("_p") / F.sum("n")).alias("observed"))
    half = 1.96 * F.sqrt(F.greatest(F.col("observed") * (1 - F.col("observed")), F.lit(0.0)) / F.col("n"))
    return out.withColumns({"ci_low": F.greatest(F.lit(0.0), F.col("observed") - half),
                            "ci_high": F.least(F.lit(1.0), F.col("observed") + half)})


def ece(df: DataFrame, y: str, score: str, keys: Sequence[str], bins: int = 10, seed: int | str = 0,
        rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Expected calibration error: mean gap of observed and predicted over the bins, weighted by rows."""
    table = calibration(df, y, score, keys, bins, seed, rows_per_task)
    gap = F.abs(F.col("observed") - F.col("mean_predicted"))
    return table.agg(F.try_divide(F.sum(gap * F.col("n")), F.sum("n")).alias("ece"))


def even_grid(low: float, high: float, n: int) -> list[float]:
    step = (high - low) / (n - 1)
    return [low + i * step for i in range(n - 1)] + [high]


def decision_curve(df: DataFrame, y: str, score: str, grid: tuple[float, float, int] = DECISION_GRID) -> DataFrame:
    """Net benefit of the score, of treating all and of treating none, at evenly spaced thresholds.

    Every row is counted in the cell of the highest grid threshold it reaches; the counts at a threshold are
    then sums over at most n + 1 cells. No pair of row and threshold is formed.
    """
    levels = even_grid(*grid)
    case = F.col(y).cast("long")
    ladder = F.array(*[F.lit(t) for t in levels])
    counted = score_counts(df, y, score)
    reached = F.size(F.filter(ladder, lambda t: t <= F.col("threshold"))).cast("long")
    cells = counted.groupBy(reached.alias("_cell")).agg(F.sum("positives").alias("p"), F.sum("flagged").alias("n"))
    steps = df.sparkSession.range(0, len(levels) + 1).withColumnRenamed("id", "_cell")
    filled = steps.join(cells, "_cell", "left").fillna(0, ["p", "n"])
    upward = Window.orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    sums = filled.select("_cell", F.sum("p").over(upward).alias("tp"), F.sum("n").over(upward).alias("hit"),
                         F.sum("p").over(everything).alias("cases"), F.sum("n").over(everything).alias("total"))
    t = F.element_at(ladder, F.col("_cell").cast("int"))
    odds = t / (1 - t)
    share = F.try_divide(F.col("cases"), F.col("total"))
    return sums.where(F.col("_cell") > 0).select(
        t.alias("threshold"),
        (F.try_divide(F.col("tp"), F.col("total"))
         - F.try_divide(F.col("hit") - F.col("tp"), F.col("total")) * odds).alias("model"),
        (share - (1 - share) * odds).alias("treat_all"), F.lit(0.0).alias("treat_none"))


def review_workload(df: DataFrame, y: str, score: str, keys: Sequence[str], shares: Sequence[float] = REVIEW_SHARES,
                    seed: int | str = 0, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """For the top share of rows by score: k, tp, fp, sensitivity and PPV. k is at least 1, rounded up.

    Everything above the score at place k comes from the score counts; only the rows of that one score per
    share are ranked, and only if k falls inside them.
    """
    counts = cut_lineage(score_counts(df, y, score))
    cum = cumulative(counts, rows_per_task=rows_per_task, settled=True)
    before = F.col("seen") - F.col("flagged")
    k = lambda share: F.greatest(F.lit(1), F.ceil(F.col("seen_total") * F.lit(share)))
    edge = lambda share: F.max(F.when((F.col("seen") >= k(share)) & (before < k(share)), F.struct(
        k(share).alias("k"), "threshold", "tp", "seen", before.alias("before"),
        (F.col("tp") - F.col("positives")).alias("tp_before"))))
    found = cum.agg(F.max("tp_total"), *[edge(share) for share in shares]).first()
    edges = [(share, e) for share, e in zip(shares, found[1:]) if e is not None]
    inside = {e["threshold"] for _, e in edges if e["k"] < e["seen"]}
    if inside:
        ranked = _tied_rows(df, y, score, keys, sorted(inside), seed)
        extra = ranked.agg(*[F.count_if(
            (F.col("_y") == 1) & (F.col("_score") == F.lit(e["threshold"])) & (F.col("_place") <= e["k"] - e["before"]))
            .alias(f"_x{i}") for i, (_, e) in enumerate(edges)])
    else:
        extra = df.sparkSession.range(1)
    rows = []
    for i, (share, e) in enumerate(edges):
        tp = F.col(f"_x{i}") + e["tp_before"] if e["k"] < e["seen"] else F.lit(e["tp"])
        rows.append(F.struct(
            F.lit(share).alias("top_percent"), F.lit(e["k"]).cast("long").alias("k"), tp.cast("long").alias("tp"),
            (e["k"] - tp).cast("long").alias("fp"), F.try_divide(tp, F.lit(found[0])).alias("sensitivity"),
            (tp / e["k"]).alias("ppv")))
    if not rows:
        raise ValueError("there are no scored rows")
    return extra.select(F.inline(F.array(*rows)))


# Bootstrap. A resample draws every row a Poisson(1) number of times, so the rows of one (score, outcome) cell together
# are drawn Poisson(count) times. A count is split into powers of two, whose draws are independent and add up to its own;
# each is one inversion of its distribution function. So every draw is exact, and the cost depends on the distinct scores.

#: Largest power of two with a table of its own; larger counts take several draws of it. Scores of a bucket.
POISSON_TOP, BUCKET_SCORES = 14, 4_096
#: Resamples that a task draws of a bucket.
TASK_RESAMPLES = 8


def _uniform(*parts: Column) -> Column:
    """A fixed number in (0, 1) of 52 bits per combination of parts, the same in any engine that has md5."""
    text = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(text, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2 ** 52))


def poisson_table(mean: int) -> tuple[int, list[float]]:
    """(first, cumulative shares): of Poisson(mean) from `first` on, as far as 12 standard deviations reach."""
    wide = 12 * math.sqrt(mean)
    first, last = max(0, math.floor(mean - wide - 12)), math.ceil(mean + wide + 30)
    return first, list(accumulate(math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(first, last + 1)))


def _poisson_draw(u: Column, mean: int) -> Column:
    """Poisson(mean) by inversion at u: a binary search in the table, which Spark reads from one literal."""
    first, table = poisson_table(mean)
    shares = F.from_json(F.lit(json.dumps(table)), "array<double>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(table).bit_length()))])
    search = lambda x: F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(shares, at + step - 1) <= x, at + step).otherwise(at))
    # As the element of an array u is computed once, not at each step.
    return F.get(F.transform(F.array(u), search), F.lit(0)) + first


def poisson_draws(count: Column, parts: Sequence[Column]) -> Column:
    """Poisson(count) for any count, one draw for each of its binary digits and for each whole power above the tables."""
    total = F.lit(0).cast("long")
    for b in range(POISSON_TOP):
        odd = F.floor(count / F.lit(1 << b)) % 2 == 1
        total = total + F.when(odd, _poisson_draw(_uniform(*parts, F.lit(b)), 1 << b)).otherwise(0)
    whole = F.floor(count / F.lit(1 << POISSON_TOP))
    rest = F.aggregate(F.sequence(F.lit(POISSON_TOP).cast("long"), whole + POISSON_TOP - 1), F.lit(0).cast("long"),
                       lambda found, i: found + _poisson_draw(_uniform(*parts, i), 1 << POISSON_TOP))
    return (total + F.when(whole > 0, rest).otherwise(0)).cast("long")


def _over_score_buckets(cells: DataFrame, first: DataFrame, drawn, names: Sequence[str], unit: Sequence[str], inside) -> DataFrame:
    """Rows of (names, replicate, p_all, n_all, p, tp, n) for groups of several buckets: sums first, then the draws again."""
    sums = first.groupBy(*unit, "replicate").agg(F.sum("p").alias("p"), F.sum(F.col("p") + F.col("q")).alias("n"))
    above = Window.partitionBy(*names, "replicate").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*names, "replicate")
    offsets = sums.select(*unit, F.struct(
        "replicate", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("p", "n")],
        F.sum("p").over(whole).alias("p_all"), F.sum("n").over(whole).alias("n_all")).alias("at"))
    lists = offsets.groupBy(*unit).agg(F.collect_list("at").alias("resamples"))  # TASK_RESAMPLES entries
    same = F.lit(True)
    for c in unit:
        same = same & F.col(f"cells.{c}").eqNullSafe(F.col(f"lists.{c}"))
    second = cells.alias("cells").join(lists.alias("lists"), same).select(
        *[F.col(f"cells.{c}").alias(c) for c in unit], "positives", "flagged", "seen", "place", F.explode("resamples").alias("at"))
    again = drawn(second.withColumn("replicate", F.col("at.replicate")))
    tp = F.col("at.p_above") + F.sum("p").over(inside)
    n = F.col("at.n_above") + F.sum(F.col("p") + F.col("q")).over(inside)
    return again.select(*names, "replicate", "at.p_all", "at.n_all", "p", tp.alias("tp"), n.alias("n"))


def bootstrap_replicates(df: DataFrame, y: str, score: str, groups: Sequence[str] = (), reps: int = 400, seed: int = 42,
                         max_rows: int | None = None, rows_per_task: int = ROWS_PER_TASK,
                         bucket_scores: int = BUCKET_SCORES) -> DataFrame:
    """Average precision of `reps` resamples per group; null where a resample has one class only.

    Scores are numbered downward and cut into buckets of `bucket_scores`. Only the counts are shuffled, by bucket and a few
    resamples each, which are drawn inside their task. A first pass sums each (bucket, resample), running sums over the
    buckets give what lies above each, and a second pass draws the same numbers again and adds the areas; where no group has
    a second bucket one pass does. So no task holds more than a bucket's scores at a time, however many scores a group has. The cell's own key is its number of rows at or
    above it, which differs between any two scores.
    """
    groups = list(groups)
    counts = score_counts(df, y, score, groups).withColumn("_one", F.lit(1))
    placed = ordered_sums(counts, "threshold", {"seen": "flagged", "place": "_one"}, groups, descending=True, max_rows=max_rows,
                          rows_per_task=rows_per_task)
    names = [f"_g{i}" for i in range(len(groups))]
    cells = cut_lineage(placed.select(*[F.col(g).alias(n) for g, n in zip(groups, names)], "positives", "flagged", "seen", "place",
                                      F.floor((F.col("place") - 1) / bucket_scores).alias("bucket")))
    unit = [*names, "bucket", "chunk"]
    several = not cells.where("bucket > 0").isEmpty()
    cells = cells.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // TASK_RESAMPLES)))).repartition(*unit)
    own = F.sequence(F.col("chunk") * TASK_RESAMPLES + 1, F.least(F.lit(reps), (F.col("chunk") + 1) * TASK_RESAMPLES))

    def drawn(rows: DataFrame) -> DataFrame:
        parts = [F.lit(seed), F.col("replicate"), *[F.col(n) for n in names], F.col("seen")]
        negatives = F.col("flagged") - F.col("positives")
        return rows.withColumns({"p": poisson_draws(F.col("positives"), [*parts, F.lit("p")]), "q": poisson_draws(negatives, [*parts, F.lit("n")])})

    first = drawn(cells.withColumn("replicate", F.explode(own)))
    inside = Window.partitionBy(*unit, "replicate").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if several:
        areas = _over_score_buckets(cells, first, drawn, names, unit, inside)
    else:  # a group's resample is whole in its task, so its sums need no pass of their own
        here = Window.partitionBy(*unit, "replicate")
        drawn_rows = F.col("p") + F.col("q")
        areas = first.select(*names, "replicate", F.sum("p").over(here).alias("p_all"), F.sum(drawn_rows).over(here).alias("n_all"), "p",
                             F.sum("p").over(inside).alias("tp"), F.sum(drawn_rows).over(inside).alias("n"))
    both = (F.max("p_all") > 0) & (F.max("n_all") > F.max("p_all"))
    found = areas.groupBy(*names, "replicate").agg(F.when(both, F.sum(
        F.try_divide(F.col("p"), F.col("p_all")) * F.try_divide(F.col("tp"), F.col("n")))).alias("average_precision"))
    return found.select(*[F.col(n).alias(g) for n, g in zip(names, groups)], "replicate", "average_precision")


def bootstrap_interval(df: DataFrame, y: str, score: str, groups: Sequence[str] = (), reps: int = 400, seed: int = 42,
                       max_rows: int | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Average precision per group with its 95 % bootstrap interval; groups with one class have nulls."""
    point = summary_scores(df, y, score, groups, max_rows, rows_per_task)
    reps_df = bootstrap_replicates(df, y, score, groups, reps, seed, max_rows, rows_per_task)
    # `reps` values per group at most, so the plain percentile is safe here.
    limits = reps_df.groupBy(*groups).agg(F.percentile("average_precision", F.lit(0.025)).alias("ci_low"),
                                          F.percentile("average_precision", F.lit(0.975)).alias("ci_high"))
    columns = [*groups, "n", "positives", "average_precision"]
    if groups:
        return point.select(columns).join(limits, list(groups), "left").select(*columns, "ci_low", "ci_high")
    low, high = limits.select("ci_low").scalar(), limits.select("ci_high").scalar()
    return point.select(columns).withColumns({"ci_low": low, "ci_high": high})


def subgroup_scores(df: DataFrame, y: str, score: str, domains: Sequence[str], top: int = 5, min_rows: int = 40,
                    min_cases: int = 3, missing: str = "missing", reps: int = 0, max_rows: int | None = None,
                    rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Average precision per subgroup: the `top` most frequent values of each domain that have enough rows
    and cases, with the bootstrap interval when `reps` is given."""
    long = df.select(F.col(y).cast("long").alias("_y"), F.col(score).cast("double").alias("_s"),
                     *[F.coalesce(F.col(d).cast("string"), F.lit(missing)).alias(d) for d in domains]).unpivot(
        ["_y", "_s"], list(domains), "domain", "subgroup")
    groups = ["domain", "subgroup"]
    counts = score_counts(long, "_y", "_s", groups)
    # The frequent values come from the same counts, so the predictions are read once.
    sizes = counts.groupBy(*groups).agg(F.sum("flagged").alias("_n"))
    place = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("_n"), "subgroup"))
    wanted = sizes.withColumn("_place", place).where(F.col("_place") <= top).select(*groups)
    points = scores_from_counts(counts.join(wanted, groups, "left_semi"), groups, max_rows, rows_per_task)
    large = points.where((F.col("n") >= min_rows) & (F.col("positives") >= min_cases))
    if not reps:
        return large.select(*groups, "n", "positives", "average_precision")
    kept = long.join(large.select(*groups), groups, "left_semi")
    return bootstrap_interval(kept, "_y", "_s", groups, reps, max_rows=max_rows, rows_per_task=rows_per_task)


def scores_from_counts(counts: DataFrame, groups: Sequence[str], max_rows: int | None = None,
                       rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """n, positives and average precision from an existing score-count table."""
    cum = cumulative(counts, groups, max_rows=max_rows, rows_per_task=rows_per_task)
    both = (F.max("tp_total") > 0) & (F.max("seen_total") > F.max("tp_total"))
    return cum.groupBy(*groups).agg(
        F.max("seen_total").alias("n"), F.max("tp_total").alias("positives"),
        F.when(both, F.sum(F.try_divide(F.col("positives"), F.col("tp_total")) * F.col("tp") / F.col("seen")))
        .alias("average_precision"))


def error_counts(df: DataFrame, y: str, score: str, threshold: float, fp_category: Column,
                 fn_category: Column) -> DataFrame:
    """False positives and false negatives counted by their categories."""
    hit, case = F.col(score) >= threshold, F.col(y) == 1
    kind = F.when(hit & ~case, "False positive").when(~hit & case, "False negative")
    category = F.when(hit & ~case, fp_category).otherwise(fn_category)
    return (known_rows(df, y, score).select(kind.alias("error"), category.alias("category")).where(F.col("error").isNotNull())
            .groupBy("error", "category").agg(F.count(F.lit(1)).alias("n")))


def median_by_group(df: DataFrame, score: str, group: str, max_rows: int | None = None,
                    rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Median score per group, of scores that are numbers."""
    numbers = df.where(~F.isnan(F.col(score).cast("double")))
    return exact_quantiles(numbers, score, {"median": 0.5}, [group], max_rows=max_rows, rows_per_task=rows_per_task)


def model_comparison(runs: Mapping[str, tuple[DataFrame, str]], y: str, score: str, keys: Sequence[str],
                     threshold: Mapping[str, float], max_rows: int | None = None) -> DataFrame:
    """One row per model: summary scores, precision and recall at its threshold, calibration error, and a
    free-text risk tag. `runs` maps the model name to (predictions, tag)."""
    out = None
    for name, (predictions, tag) in runs.items():
        scores = summary_scores(predictions, y, score, max_rows=max_rows)
        at = metrics_at(predictions, y, score, {name: threshold[name]})
        row = scores.select(
            F.lit(name).alias("model"), F.lit(tag).alias("leakage_risk"), F.col("n").alias("holdout_rows"),
            F.col("positives").alias("holdout_positive"), "average_precision", "roc_auc",
            at.select("precision").scalar().alias("selected_precision"),
            at.select("recall").scalar().alias("selected_recall"),
            ece(predictions, y, score, keys).scalar().alias("ece"))
        out = row if out is None else out.unionByName(row)
    return out
