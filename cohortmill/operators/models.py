"""Classifiers as Spark jobs: fit, search, cross-validate, eliminate, compare.

Learners are Spark's own; scores of other tree libraries are not reproduced. Every metric is the exact one of
`metrics`. The search loops run on the driver, each step is a distributed fit on a cached matrix.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import summary_scores
from .permute import independent_copies
from .ranks import exact_quantiles

# The two settings of the parameter grid, in the terms of Spark's boosted trees.
GRID = [{"maxIter": 300, "maxDepth": 3, "stepSize": 0.05, "subsamplingRate": 0.85, "minInstancesPerNode": 5},
        {"maxIter": 500, "maxDepth": 2, "stepSize": 0.03, "subsamplingRate": 0.90, "minInstancesPerNode": 10}]
LEARNERS = {"boosted": GBTClassifier, "forest": RandomForestClassifier, "linear": LogisticRegression}
SEED = 42


@contextmanager
def held(*frames: DataFrame):
    """Frames kept in memory and on disk while a search runs over them."""
    for frame in frames:
        frame.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield frames
    finally:
        for frame in frames:
            frame.unpersist()


def case_weight(train: DataFrame, label: str) -> float:
    """Negatives per positive; both classes must be there."""
    cases, controls = train.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    if not cases or not controls:
        raise ValueError("training rows need cases and controls")
    return controls / cases


def split_columns(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    kinds = dict(df.dtypes)
    return [f for f in features if kinds[f] != "string"], [f for f in features if kinds[f] == "string"]


class Fitted:
    """A fitted pipeline with the names behind its feature vector."""

    def __init__(self, pipeline, names: list[tuple[str, str]], label: str):
        self.pipeline, self.names, self.label = pipeline, names, label

    def score(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """`keep`, `y_true` and `y_probability` per row."""
        scored = self.pipeline.transform(_prepared(df, [n for n, _ in self.names]))
        return scored.select(*keep, F.col(self.label).cast("int").alias("y_true"),
                             vector_to_array("probability")[1].alias("y_probability"))

    def importance(self) -> dict[str, float]:
        """Importance per feature; that of a missing-value flag counts for its feature."""
        model = self.pipeline.stages[-1]
        values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
        out: dict[str, float] = {}
        for i, (name, _) in enumerate(self.names):
            out[name] = out.get(name, 0.0) + abs(float(values[i]))
        return out


def _prepared(df: DataFrame, names: Iterable[str]) -> DataFrame:
    numbers, words = split_columns(df, list(dict.fromkeys(names)))
    return df.withColumns({
        **{f"_{n}_missing": F.col(n).isNull().cast("double") for n in numbers},
        **{n: F.col(n).cast("double") for n in numbers},
        **{w: F.coalesce(F.col(w), F.lit("MISSING")) for w in words}})


def fit(train: DataFrame, features: Sequence[str], label: str, params: Mapping = {}, learner: str = "boosted",
        seed: int = SEED) -> Fitted:
    """Weighted classifier: numbers are imputed by their median beside a missing flag, words are indexed in
    alphabetical order, cases weigh as much as controls in total."""
    weighted = _prepared(train, features).withColumn(
        "_weight", F.when(F.col(label) == 1, case_weight(train, label)).otherwise(1.0)).withColumn(
        label, F.col(label).cast("double"))
    numbers, words = split_columns(train, features)
    stages, inputs, names = [], [], []
    if numbers:
        stages.append(Imputer(strategy="median", inputCols=numbers, outputCols=[f"_{n}_filled" for n in numbers]))
        for n in numbers:
            inputs += [f"_{n}_filled", f"_{n}_missing"]
            names += [(n, "value"), (n, "missing")]
    if words:
        stages.append(StringIndexer(inputCols=words, outputCols=[f"_{w}_code" for w in words],
                                    stringOrderType="alphabetAsc", handleInvalid="keep"))
        inputs += [f"_{w}_code" for w in words]
        names += [(w, "value") for w in words]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="_features"))
    settings = dict(featuresCol="_features", labelCol=label, weightCol="_weight", **params)
    if learner != "linear":
        # A split on a category needs a bin for each of its values, the one for unseen values included.
        sizes = _prepared(train, words).agg(*[F.count_distinct(w).alias(w) for w in words]).first() if words else []
        settings["maxBins"] = max(settings.get("maxBins", 64), *[n + 2 for n in sizes], 2)
        settings["seed"] = seed
    stages.append(LEARNERS[learner](**settings))
    return Fitted(Pipeline(stages=stages).fit(weighted), names, label)


def evaluate(fitted: Fitted, df: DataFrame) -> dict[str, float]:
    return summary_scores(fitted.score(df), "y_true", "y_probability").first().asDict()


def _table(df: DataFrame, rows: Sequence[Mapping], schema: str) -> DataFrame:
    """A small result table of a search: one row per model that was fitted."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    return df.sparkSession.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def grid_search(train: DataFrame, validation: DataFrame, features: Sequence[str], label: str, grid: Sequence[Mapping],
                learner: str = "boosted") -> tuple[Fitted, DataFrame]:
    """The setting of the highest average precision on the validation rows, and the table of all."""
    best, best_ap, rows = None, -math.inf, []
    with held(train, validation):
        for i, params in enumerate(grid, start=1):
            model = fit(train, features, label, params, learner)
            found = evaluate(model, validation)["average_precision"]
            rows.append({"candidate": i, "params_json": json.dumps(params, sort_keys=True),
                         "validation_average_precision": found})
            if best is None or (found is not None and found > best_ap):
                best, best_ap = model, -math.inf if found is None else found
    return best, _table(train, rows, "candidate int, params_json string, validation_average_precision double")


FOLD_ROW = ("run_id string, model_label string, fold int, train_rows bigint, validation_rows bigint, "
            "validation_positive bigint, validation_prevalence double, average_precision double, "
            "pr_auc_trapezoidal double, roc_auc double")


def cross_validate(df: DataFrame, fold: str, features: Sequence[str], label: str, params: Mapping = {},
                   learner: str = "boosted", run_id: str = "run", model_label: str = "model") -> DataFrame:
    """One row per fold of column `fold`: sizes and scores on the rows left out."""
    rows = []
    with held(df):
        folds = sorted(r[0] for r in df.select(fold).distinct().collect())
        total = df.count()
        for f in folds:
            model = fit(df.where(F.col(fold) != f), features, label, params, learner, SEED + int(f))
            s = evaluate(model, df.where(F.col(fold) == f))
            rows.append({"run_id": run_id, "model_label": model_label, "fold": int(f), "train_rows": total - s["n"],
                         "validation_rows": s["n"], "validation_positive": s["positives"],
                         "validation_prevalence": s["positives"] / s["n"], **{
                             k: s[k] for k in ("average_precision", "pr_auc_trapezoidal", "roc_auc")}})
    return _table(df, rows, FOLD_ROW)


def importance_table(df: DataFrame, fitted: Fitted) -> DataFrame:
    rows = [{"feature": k, "importance": v} for k, v in fitted.importance().items()]
    return _table(df, rows, "feature string, importance double")


def backward_elimination(train: DataFrame, validation: DataFrame, features: Sequence[str], label: str,
                         params: Mapping = {}, learner: str = "boosted", minimum: int = 40, tolerance: float = 0.01,
                         protected: Sequence[str] = (), passes: int | None = None) -> tuple[list[str], DataFrame]:
    """Drop, pass by pass, the feature whose absence scores best on the validation rows.

    Stops at `minimum` features, when only protected ones are left, after `passes`, or when the best removal
    costs more than `tolerance`. Returns the best subset seen (the smaller one on equal scores) and the log.
    """
    def ap(names):
        return evaluate(fit(train, names, label, params, learner), validation)["average_precision"] or 0.0

    with held(train, validation):
        current, score = list(features), ap(list(features))
        best, best_score = list(current), score
        log = [{"step": 0, "dropped": None, "features": len(current), "average_precision": score}]
        step = 0
        while len(current) > max(1, minimum) and (passes is None or step < passes):
            trials = [(ap([c for c in current if c != f]), f) for f in current if f not in protected]
            if not trials:
                break
            step += 1
            trial_score, dropped = max(trials, key=lambda t: t[0])
            if trial_score < score - tolerance:
                break
            current, score = [c for c in current if c != dropped], trial_score
            same = abs(score - best_score) <= 1e-8 + 1e-5 * abs(best_score)
            if score > best_score or (same and len(current) < len(best)):
                best, best_score = list(current), score
            log.append({"step": step, "dropped": dropped, "features": len(current), "average_precision": score})
    return best, _table(train, log, "step int, dropped string, features int, average_precision double")


def with_shadows(df: DataFrame, keys: Sequence[str], features: Sequence[str], seed: int) -> DataFrame:
    """Adds `shadow__<feature>`: the feature's values on other rows, each feature by a permutation of its own."""
    return independent_copies(df, keys, features, seed)


def shadow_filter(train: DataFrame, validation: DataFrame, keys: Sequence[str], features: Sequence[str], label: str,
                  params: Mapping = {}, learner: str = "boosted", repeats: int = 5, keep: float = 0.80,
                  reject: float = 0.20, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """How often a feature is more important than the best of the permuted copies: (report, repeat table)."""
    rows, runs = [], []
    with held(train, validation):
        for repeat in range(1, repeats + 1):
            at = seed + 1009 * repeat
            names = [*features, *[f"shadow__{f}" for f in features]]
            # A fit reads its rows several times; the copies are made once.
            with held(with_shadows(train, keys, features, at)) as (shadowed,):
                model = fit(shadowed, names, label, params, learner, at)
            found = model.importance()
            shadows = sorted(found[f"shadow__{f}"] for f in features)
            place = 0.95 * (len(shadows) - 1)
            low = shadows[math.floor(place)]
            p95 = low + (shadows[math.ceil(place)] - low) * (place - math.floor(place))
            ap = evaluate(model, with_shadows(validation, keys, features, at))["average_precision"]
            runs.append({"repeat": repeat, "seed": at, "feature_count": len(features),
                         "shadow_max_importance": shadows[-1], "shadow_mean_importance": sum(shadows) / len(shadows),
                         "shadow_p95_importance": p95, "validation_average_precision_with_shadows": ap})
            rows += [{"repeat": repeat, "feature": f, "real_importance": found[f], "shadow_max": shadows[-1],
                      "shadow_p95": p95} for f in features]
    raw = _table(train, rows, "repeat int, feature string, real_importance double, shadow_max double, shadow_p95 double")
    return (shadow_summary(raw, keep, reject), _table(
        train, runs, "repeat int, seed int, feature_count int, shadow_max_importance double, "
        "shadow_mean_importance double, shadow_p95_importance double, "
        "validation_average_precision_with_shadows double"))


def shadow_summary(raw: DataFrame, keep: float = 0.80, reject: float = 0.20) -> DataFrame:
    """Per feature over the repeats: importances, hits against the shadow maximum, and a verdict."""
    hit = F.col("real_importance") > F.col("shadow_max")
    medians = exact_quantiles(raw, "real_importance", {"median_real_importance": 0.5}, ["feature"]).drop("n")
    out = raw.groupBy("feature").agg(
        F.avg("real_importance").alias("mean_real_importance"),
        F.max("real_importance").alias("max_real_importance"), F.avg("shadow_max").alias("mean_shadow_max_importance"),
        F.avg("shadow_p95").alias("mean_shadow_p95_importance"), F.count_if(hit).alias("hit_count"),
        F.avg(hit.cast("double")).alias("hit_rate"),
        F.avg(F.col("real_importance") - F.col("shadow_max")).alias("mean_importance_minus_shadow_max"),
        F.count(F.lit(1)).alias("shadow_filter_repeats")).join(medians, "feature", "left")
    status = F.when(F.col("hit_rate") <= reject, "reject").when(F.col("hit_rate") >= keep, "keep").otherwise("tentative")
    return out.withColumn("shadow_filter_status", status)


def drop_set_comparison(train: DataFrame, holdout: DataFrame, features: Sequence[str], label: str,
                        drop_sets: Mapping[str, Sequence[str]], params: Mapping = {}, learner: str = "boosted") -> DataFrame:
    """Holdout scores of the full model and of one model per set of dropped features, with the differences."""
    rows, base = [], None
    with held(train, holdout):
        for name, dropped in {"all_features": (), **drop_sets}.items():
            kept = [f for f in features if f not in set(dropped)]
            s = evaluate(fit(train, kept, label, params, learner), holdout)
            base = base or s
            rows.append({"model": name, "feature_count": len(kept), "average_precision": s["average_precision"],
                         "roc_auc": s["roc_auc"], "average_precision_change":
                             s["average_precision"] - base["average_precision"]})
    return _table(train, rows, "model string, feature_count int, average_precision double, roc_auc double, "
                               "average_precision_change double")


def permutation_importance(fitted: Fitted, df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str,
                           seed: int = SEED) -> DataFrame:
    """Fall of the average precision when one feature is taken from other rows."""
    rows = []
    shadowed = with_shadows(df, keys, features, seed)
    with held(shadowed):
        base = evaluate(fitted, shadowed)["average_precision"]
        for f in features:
            swapped = shadowed.withColumn(f, F.col(f"shadow__{f}"))
            rows.append({"feature": f, "importance": base - evaluate(fitted, swapped)["average_precision"]})
    return _table(df, rows, "feature string, importance double")


def mean_absolute(contributions: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean absolute value per contribution column, as (feature, mean_abs)."""
    means = contributions.agg(*[F.avg(F.abs(c)).alias(c) for c in columns])
    return means.unpivot([], list(columns), "feature", "mean_abs")


def run_summary(train: DataFrame, holdout: DataFrame, fitted: Fitted, threshold: float, features: Sequence[str],
                run_id: str, model_label: str, params: Mapping = {}, validation_ap: float | None = None,
                dropped: Sequence[str] = (), cv: DataFrame | None = None) -> DataFrame:
    """`summary_of_scores` of a fitted model's scores on the holdout rows."""
    return summary_of_scores(train, fitted.label, fitted.score(holdout), threshold, features, run_id, model_label, params, validation_ap, dropped, cv)


def summary_of_scores(train: DataFrame, label: str, scored: DataFrame, threshold: float, features: Sequence[str], run_id: str,
                      model_label: str, params: Mapping = {}, validation_ap: float | None = None, dropped: Sequence[str] = (),
                      cv: DataFrame | None = None) -> DataFrame:
    """One row about a run: sizes, scores, metrics at the chosen threshold and at 0.5, settings, CV means."""
    from .audit import mean_and_sd
    from .metrics import metrics_at
    s = summary_scores(scored, "y_true", "y_probability")
    at = metrics_at(scored, "y_true", "y_probability", {"selected": threshold, "default": 0.5})
    selected = at.where(F.col("rule") == "selected")
    sizes = train.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("p"))
    n, p = sizes.select("n").scalar(), sizes.select("p").scalar()
    row = s.select(
        F.lit(run_id).alias("run_id"), F.lit(model_label).alias("model_label"), n.alias("train_rows"),
        p.alias("train_positive"), F.try_divide(p, n).alias("train_prevalence"), F.col("n").alias("holdout_rows"),
        F.col("positives").alias("holdout_positive"), F.try_divide(F.col("positives"), F.col("n")).alias("holdout_prevalence"),
        F.lit(float(threshold)).alias("selected_threshold"),
        *[selected.select(c).scalar().alias(f"selected_{c}") for c in ("precision", "recall", "specificity", "f1", "tp",
                                                                       "fp", "fn", "tn")],
        at.where(F.col("rule") == "default").select("f1").scalar().alias("default_threshold_f1"),
        F.col("average_precision").alias("holdout_average_precision"),
        F.col("pr_auc_trapezoidal").alias("holdout_pr_auc_trapezoidal"), F.col("roc_auc").alias("holdout_roc_auc"),
        F.lit(validation_ap).cast("double").alias("best_validation_average_precision"),
        F.lit(json.dumps(params, sort_keys=True)).alias("best_params_json"), F.lit(len(features)).alias("feature_count"),
        F.lit(len(dropped)).alias("rfe_dropped_feature_count"), F.lit(json.dumps(list(dropped))).alias("rfe_dropped_features_json"))
    if cv is not None:
        scores = ["average_precision", "pr_auc_trapezoidal", "roc_auc"]
        means = mean_and_sd(cv, scores)
        row = row.withColumns({"cv_folds": cv.agg(F.count(F.lit(1))).scalar(), **{
            f"cv_{c}": means.select(c).scalar() for x in scores for c in (f"{x}_mean", f"{x}_sd")}})
    return row


def sweep(variants: Mapping[str, Callable[[], DataFrame]], spark) -> DataFrame:
    """Run each variant (a function to a one-row result); a failing one gives a row with its error."""
    out = None
    for name, run in variants.items():
        try:
            row = run().withColumns({"variant": F.lit(name), "status": F.lit("ok"), "error": F.lit(None).cast("string")})
        except Exception as error:  # a sweep goes on after any failure, and says so in its row
            row = spark.createDataFrame([(name, "failed", f"{type(error).__name__}: {error}"[:500])],
                                        "variant string, status string, error string")
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out
