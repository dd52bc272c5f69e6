"""Queries of the operators that judge urls, mix sources and cut shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import cut_lineage
from .mixing import taken_words
from .registry import query, table
from .sharding import kd_shards, with_slots
from .urls import judge_urls

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]
MIX_WEIGHTS = [5.0, 2.0, 1.0]
SHARDS, SHARD_DIMS = 8, ["n_chars", "lang", "source"]

_URL_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
split AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path FROM parts),
rules(rule_host, rule_path, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, path,
  (SELECT arg_max(rule_host || rule_path, length(rule_host || rule_path)) FROM rules
   WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS rule,
  coalesce((SELECT arg_max(action, length(rule_host || rule_path)) FROM rules
   WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)), 'allow') AS verdict
FROM split"""


@query("op8_url_filter", _URL_SQL)
def op8_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules, drop=("url",))


@query("op10_source_mix")
def op10_source_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return taken_words(docs, MIX_WEIGHTS).select("doc_id", "size", "source_size", "target", "taken")


@query("op2_kd_shards")
def op2_kd_shards(spark, sf_dir):
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    docs = cut_lineage(table(spark, sf_dir, "documents").select("doc_id", *SHARD_DIMS, size.alias("size"),
                                                                 F.crc32("text").alias("text_crc32")))
    sharded = kd_shards(docs, SHARD_DIMS, F.col("size"), shards=SHARDS, alike=F.xxhash64("text_crc32", "size"),
                        row=F.xxhash64("doc_id"))
    return (with_slots(sharded, sharded, ["doc_id", "text_crc32"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))
