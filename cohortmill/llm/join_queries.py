"""Queries of the joins and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from .jaccard import similar_sets
from .registry import query, table
from .topk import top_inner_products

_TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""


@query("op5_top_inner_products", _TOP_SQL)
def op5_top_inner_products(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_inner_products(vectors, F.col("vec_id") % 100 == 0)


@query("op6_ngram_jaccard")
def op6_ngram_jaccard(spark, sf_dir):
    return similar_sets(table(spark, sf_dir, "documents").select("doc_id", "text"))
