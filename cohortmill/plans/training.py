"""The training job: settings, features and threshold are chosen inside the training rows, the holdout is only reported.

The training rows are cut into fit and validation rows, exactly stratified. Every candidate is fitted on the fit rows and
judged on the validation rows; so is every subset of the elimination. The threshold comes from the validation scores of the
chosen subset's model, which has seen the fit rows alone. Then the model is fitted once more on all training rows, and its
holdout scores are computed once and feed all holdout tables.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators import models as ml
from ..operators.cohort import cv_folds, stratified_split
from ..operators.matrix import require_both_splits
from ..session import cut_lineage


@dataclass
class TrainingRules:
    """How a model matrix becomes a model. `minimum` None keeps all features, `folds` and `shadows` 0 leave these reports out."""
    keys: Sequence[str]
    label: str
    features: Sequence[str]
    split: str = "cohort_split"
    validation_share: float = 0.2
    grid: Sequence[Mapping] = field(default_factory=lambda: ml.GRID)
    learner: str = "boosted"
    minimum: int | None = None
    tolerance: float = 0.01
    protected: Sequence[str] = ()
    passes: int | None = None
    metric: str = "f1"
    target_recall: float = 0.80
    folds: int = 0
    shadows: int = 0
    drop_sets: Mapping[str, Sequence[str]] = field(default_factory=dict)
    run_id: str = "run"
    model_label: str = "main"
    seed: int = ml.SEED


@dataclass
class TrainingRun:
    """What the job found. `roles` has a row per role (fit, validation, holdout); tables that were not asked for are None."""
    model: ml.Fitted
    params: Mapping
    features: list[str]
    dropped: list[str]
    threshold: float
    roles: DataFrame
    candidates: DataFrame
    elimination: DataFrame | None
    validation: DataFrame
    predictions: DataFrame
    operating_points: DataFrame
    pr_curve: DataFrame
    roc_curve: DataFrame
    importance: DataFrame
    summary: DataFrame
    folds: DataFrame | None
    shadow_report: DataFrame | None
    shadow_repeats: DataFrame | None
    drop_sets: DataFrame | None


def with_roles(rows: DataFrame, rules: TrainingRules, name: str = "role") -> DataFrame:
    """Adds the role of a row: `holdout` outside the training split, else `fit` or `validation`, computed once.

    Rows without a label have no role in a fit or a score and are left out.
    """
    require_both_splits(rows, rules.split)
    rows = cut_lineage(rows.select(*dict.fromkeys([*rules.keys, rules.split, rules.label, *rules.features])).where(F.col(rules.label).isNotNull()))
    train = rows.where(F.col(rules.split) == "train")
    parts = stratified_split(train, rules.keys, rules.label, rules.validation_share, rules.seed, name)
    parts = parts.withColumn(name, F.when(F.col(name) == "test", "validation").otherwise("fit"))
    holdout = rows.where(F.col(rules.split) == "test").withColumn(name, F.lit("holdout"))
    return cut_lineage(parts.unionByName(holdout))


def train_and_evaluate(rows: DataFrame, rules: TrainingRules) -> TrainingRun:
    """Run the job on a matrix with the columns that `rules` name. Both splits, and cases and controls in each role, must be there."""
    keys, label = list(rules.keys), rules.label
    parts = with_roles(rows, rules)
    fit, validation, holdout = (parts.where(F.col("role") == r) for r in ("fit", "validation", "holdout"))
    train = parts.where(F.col("role") != "holdout")
    roles = cut_lineage(parts.groupBy("role").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(label) == 1).alias("positive")))
    for r in ("fit", "validation", "holdout"):
        found = roles.where(F.col("role") == r).first()
        if found is None or not 0 < found["positive"] < found["rows"]:
            raise ValueError(f"the {r} rows need cases and controls")

    features = list(rules.features)
    chosen, candidates = ml.grid_search(fit, validation, features, label, rules.grid, rules.learner)
    candidates = candidates.select(F.lit(rules.run_id).alias("run_id"), F.lit(rules.model_label).alias("model_label"), *candidates.columns)
    best = candidates.orderBy(F.desc_nulls_last("validation_average_precision"), "candidate").first()
    params = json.loads(best["params_json"])
    elimination, dropped = None, []
    if rules.minimum is not None:
        kept, elimination = ml.backward_elimination(fit, validation, features, label, params, rules.learner, rules.minimum, rules.tolerance,
                                                    rules.protected, rules.passes)
        dropped = [f for f in features if f not in set(kept)]
        if dropped:
            features, chosen = kept, ml.fit(fit, kept, label, params, rules.learner)
    # `chosen` was fitted on the fit rows only, so these scores are out of sample.
    scores = cut_lineage(chosen.score(validation, keys))
    threshold = m.best_threshold(scores, "y_true", "y_probability", rules.metric, rules.target_recall).first()["threshold"]
    validation_ap = m.average_precision(scores, "y_true", "y_probability").first()["average_precision"]

    shadow_report = shadow_repeats = None
    if rules.shadows:
        shadow_report, shadow_repeats = ml.shadow_filter(fit, validation, keys, features, label, params, rules.learner, rules.shadows, seed=rules.seed)
    model = ml.fit(train, features, label, params, rules.learner)
    predictions = cut_lineage(model.score(holdout, keys))
    folds = None
    if rules.folds:
        folds = ml.cross_validate(cv_folds(train, keys, label, rules.folds, rules.seed), "fold", features, label, params, rules.learner,
                                  rules.run_id, rules.model_label)
    compared = ml.drop_set_comparison(train, holdout, features, label, rules.drop_sets, params, rules.learner) if rules.drop_sets else None
    summary = ml.summary_of_scores(train, label, predictions, threshold, features, rules.run_id, rules.model_label, params, validation_ap, dropped, folds)
    return TrainingRun(
        model, params, features, dropped, threshold, roles, candidates, elimination, scores, predictions,
        m.operating_points(predictions, "y_true", "y_probability", threshold), m.pr_curve(predictions, "y_true", "y_probability"),
        m.roc_curve(predictions, "y_true", "y_probability"), ml.importance_table(train, model), summary, folds, shadow_report, shadow_repeats,
        compared)
