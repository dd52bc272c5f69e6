"""Queries of the operators that score every text: quality and language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .langid import fit_languages, fold, predicted_languages
from .quality import QualityModel, fit_quality, scored, with_statistics
from .registry import query, table

#: A document passes as good from this score on.
QUALITY_CUT = 0.3


def quality_model(documents: DataFrame, labels: DataFrame, key: str = "doc_id") -> QualityModel:
    """Fit on `documents` (key and statistics) with the labels of folds 1 to 4; fold 4 calibrates."""
    known = labels.select(F.col(key), F.col("quality").alias("label")).where(F.col("label").isNotNull())
    training = documents.where(fold(key) != 0).select(key, "statistics").join(known, key)
    return fit_quality(training, fold(key) == 4)


def scored_documents(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, score), one row per row of `documents`, whose texts are read once."""
    found = cut_lineage(with_statistics(documents.select("doc_id", "text"), drop=("text",)))
    return scored(found, quality_model(found, table(spark, sf_dir, "labels")), drop=("statistics",))


@query("op4_quality_scores")
def op4_quality_scores(spark, sf_dir):
    return (scored_documents(spark, table(spark, sf_dir, "documents"), sf_dir)
            .select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted")))


@query("op9_language_mixtures")
def op9_language_mixtures(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs.where(fold() != 0))
    return (predicted_languages(docs.select("doc_id", "text"), model, drop=("text",))
            .select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", "lang_set"))
