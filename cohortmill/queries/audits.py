"""Audits: counts, missingness, cross-tabs, agreement, item prevalence, ranked reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as a
from ..operators import matrix as x
from ..operators.cohort import holdout_split
from ..operators.windows import interval_join
from .cohorts import (CASES_SQL, CODES_SQL, EXACT_SQL, HALF, TARGETS, ADM_SQL, admissions, coded_cases, codes)
from ..functions.codes import exact_code
from .common import SPINE_SQL, event_spine, query, rounded, table
from .features import JOINED_SQL, TYPES, features, wide_sql

MATRIX_SQL = f"""{JOINED_SQL}, f AS (SELECT user_id, {wide_sql('first')} FROM j GROUP BY user_id),
m AS (SELECT s.user_id, s.label, f.* EXCLUDE (user_id), CASE WHEN {HALF.format(key='s.user_id')} THEN 'test'
      ELSE 'train' END AS cohort_split FROM spine s LEFT JOIN f ON s.user_id = f.user_id)"""
FIRSTS = [f"{t}_first" for t in TYPES]


def matrix(spark, sf):
    wide = event_spine(spark, sf).join(features(spark, sf, ["first"]), "user_id", "left")
    return holdout_split(wide.drop("index_time", "window_end"), ["user_id"])


@query("split_counts", f"""WITH {MATRIX_SQL} SELECT cohort_split, count(*) AS rows_total,
  count(*) FILTER (WHERE label = 1) AS cases, count(*) FILTER (WHERE label = 0) AS controls,
  round(avg(label), 6) AS prevalence FROM m GROUP BY cohort_split""")
def split_counts(spark, sf):
    return rounded(a.split_counts(matrix(spark, sf), "cohort_split", "label"), "prevalence")


def null_rows(extra="", t=0.1):
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(avg(({c} IS NULL)::INT) FILTER (WHERE label = 0), 6)
      AS control_null_rate, round(avg(({c} IS NULL)::INT) FILTER (WHERE label = 1), 6) AS case_null_rate,
      round(abs(avg(({c} IS NULL)::INT) FILTER (WHERE label = 0) - avg(({c} IS NULL)::INT) FILTER (WHERE label = 1)), 6)
      AS gap, abs(avg(({c} IS NULL)::INT) FILTER (WHERE label = 0) - avg(({c} IS NULL)::INT) FILTER (WHERE label = 1))
      >= {t} AS warn{extra.format(c=c)} FROM m""" for c in FIRSTS)


@query("null_rate_by_label", f"WITH {MATRIX_SQL} {null_rows()}")
def null_rate_by_label(spark, sf):
    return rounded(a.null_rates_by_label(matrix(spark, sf), "label", FIRSTS, 0.1), "control_null_rate", "case_null_rate",
                   "gap")


@query("leakage_audit", f"""WITH {MATRIX_SQL} {null_rows(", (SELECT avg(({c} IS NULL)::INT) FROM m) <= 0.45 AS survived", 0.5)}""")
def leakage_audit(spark, sf):
    rows = matrix(spark, sf)
    kept = x.dense_columns(rows, FIRSTS, 0.45)
    return rounded(a.null_rates_by_label(rows, "label", FIRSTS, 0.5, kept), "control_null_rate", "case_null_rate", "gap")


@query("family_availability", f"""WITH {MATRIX_SQL}, k AS (SELECT label, 'web' AS feature_family,
  (avg((click_first IS NULL)::INT) + avg((view_first IS NULL)::INT)) / 2 AS missing FROM m GROUP BY label
  UNION ALL SELECT label, 'other', (avg((error_first IS NULL)::INT) + avg((signup_first IS NULL)::INT)) / 2 FROM m
  GROUP BY label)
SELECT label, feature_family, round(missing, 6) AS missing_fraction, round(1 - missing, 6) AS observed_fraction FROM k""")
def family_availability(spark, sf):
    out = a.family_availability(matrix(spark, sf), "label", {
        "web": ["click_first", "view_first", "not_there"], "other": ["error_first", "signup_first"]})
    return rounded(out, "missing_fraction", "observed_fraction")


@query("label_distributions", " UNION ALL ".join(f"""SELECT CAST(l_returnflag = 'R' AS INT) AS label, '{c}' AS feature,
  count({c}) AS n, round(median({c}), 6) AS median, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr
  FROM lineitem GROUP BY 1""" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def label_distributions(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    return rounded(a.distributions(lines, "label", ["l_quantity", "l_extendedprice", "l_discount"]), "median", "iqr")


@query("null_density", f"""WITH {MATRIX_SQL} SELECT round(sum({' + '.join(f'({c} IS NULL)::INT' for c in FIRSTS)})
  / (count(*) * {len(FIRSTS)}), 6) AS null_density FROM m""")
def null_density(spark, sf):
    return rounded(a.null_density(matrix(spark, sf), FIRSTS), "null_density")


@query("freq_table", f"""WITH {ADM_SQL} SELECT kind, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM adm), 6)
  AS percent FROM adm GROUP BY kind""")
def freq_table(spark, sf):
    return rounded(a.frequencies(admissions(spark, sf), "kind"), "percent")


@query("crosstab_cube", f"""WITH {ADM_SQL} SELECT CASE WHEN grouping(kind) = 1 THEN 'All' ELSE kind END AS kind,
  CASE WHEN grouping(place) = 1 THEN 'All' ELSE place END AS place, count(*) AS n FROM adm
  WHERE kind IS NOT NULL AND place IS NOT NULL GROUP BY CUBE (kind, place)""")
def crosstab_cube(spark, sf):
    return a.crosstab(admissions(spark, sf), "kind", "place")


REVIEW_SQL = f"""{CODES_SQL}, {ADM_SQL}, reviewed AS (SELECT o_custkey, o_orderkey, coalesce(kind, 'none') AS kind,
  place = 'F' AND o_totalprice > 200000 IS TRUE AS confirmed FROM adm),
prior AS (SELECT DISTINCT o_custkey, o_orderkey FROM adm WHERE o_orderkey IN (SELECT adm FROM codes WHERE {EXACT_SQL}))"""
REVIEW_SQL = REVIEW_SQL.replace("place = 'F' AND o_totalprice > 200000 IS TRUE", "coalesce(place = 'F' AND o_totalprice > 200000, false)")


def reviewed(spark, sf):
    return admissions(spark, sf).select(
        "o_custkey", "o_orderkey", F.coalesce("kind", F.lit("none")).alias("kind"),
        F.coalesce((F.col("place") == "F") & (F.col("o_totalprice") > 200000), F.lit(False)).alias("confirmed"))


def agreement(spark, sf):
    marked = codes(spark, sf).select("o_orderkey", "version", "code_norm",
                                     exact_code("code_norm", "version", TARGETS).alias("is_target"))
    titles = marked.select("version", "code_norm", F.concat(F.lit("Title of "), F.col("code_norm")).alias("title")).distinct()
    return a.agreement_audit(coded_cases(spark, sf).select("o_custkey", "o_orderkey"), reviewed(spark, sf), marked, titles,
                             "o_custkey", "o_orderkey", "confirmed", "kind")


def overlap_sql(key):
    return f"""SELECT '{key}' AS key, count(DISTINCT p) AS left_ids, count(DISTINCT y) AS right_ids,
  count(DISTINCT p) FILTER (WHERE y IS NOT NULL) AS "both", count(DISTINCT p) FILTER (WHERE y IS NULL) AS left_only,
  count(DISTINCT y) FILTER (WHERE p IS NULL) AS right_only FROM (SELECT DISTINCT {key} AS p FROM prior) a
  FULL JOIN (SELECT DISTINCT {key} AS y FROM reviewed WHERE confirmed) b ON p = y"""


@query("overlap_summary", f"WITH {REVIEW_SQL} {overlap_sql('o_custkey')} UNION ALL {overlap_sql('o_orderkey')}")
def overlap_summary(spark, sf):
    return agreement(spark, sf)["overlap"]


@query("labels_of_coded", f"""WITH {REVIEW_SQL} SELECT coalesce(r.kind, '<missing>') AS kind, count(*) AS n,
  round(count(*) * 100.0 / (SELECT count(*) FROM prior), 6) AS percent FROM prior LEFT JOIN reviewed r
  USING (o_custkey, o_orderkey) GROUP BY 1""")
def labels_of_coded(spark, sf):
    return rounded(agreement(spark, sf)["labels_of_coded"], "percent")


TARGET_LIST_SQL = f"""tc AS (SELECT adm AS o_orderkey, string_agg(DISTINCT code, '|' ORDER BY code) AS target_codes
  FROM codes WHERE {EXACT_SQL} GROUP BY adm)"""


@query("confirmed_by_code", f"""WITH {REVIEW_SQL}, {TARGET_LIST_SQL}, z AS (SELECT confirmed::VARCHAR AS confirmed,
  (target_codes IS NOT NULL)::VARCHAR AS has_target FROM reviewed LEFT JOIN tc USING (o_orderkey))
SELECT CASE WHEN grouping(confirmed) = 1 THEN 'All' ELSE confirmed END AS confirmed, CASE WHEN grouping(has_target) = 1
  THEN 'All' ELSE has_target END AS has_target, count(*) AS n FROM z GROUP BY CUBE (confirmed, has_target)""")
def confirmed_by_code(spark, sf):
    return agreement(spark, sf)["confirmed_by_code"]


@query("coded_not_confirmed", f"""WITH {REVIEW_SQL} SELECT o_custkey, o_orderkey, kind, confirmed FROM prior
  LEFT JOIN reviewed USING (o_custkey, o_orderkey) WHERE NOT coalesce(confirmed, false)""")
def coded_not_confirmed(spark, sf):
    return agreement(spark, sf)["coded_not_confirmed"]


@query("confirmed_not_coded", f"""WITH {REVIEW_SQL} SELECT * FROM reviewed r WHERE confirmed AND NOT EXISTS (
  SELECT 1 FROM prior p WHERE p.o_custkey = r.o_custkey AND p.o_orderkey = r.o_orderkey)""")
def confirmed_not_coded(spark, sf):
    return agreement(spark, sf)["confirmed_not_coded"]


@query("confirmed_without_code", f"""WITH {REVIEW_SQL}, {TARGET_LIST_SQL}
SELECT o_custkey, o_orderkey, kind, confirmed, CAST(NULL AS VARCHAR) AS target_codes, false AS has_target FROM reviewed
WHERE confirmed AND o_orderkey NOT IN (SELECT o_orderkey FROM tc)""")
def confirmed_without_code(spark, sf):
    return agreement(spark, sf)["confirmed_without_code"]


@query("code_without_confirmation", f"""WITH {REVIEW_SQL}, {TARGET_LIST_SQL}
SELECT o_custkey, o_orderkey, kind, confirmed, target_codes, true AS has_target FROM reviewed JOIN tc USING (o_orderkey)
WHERE NOT confirmed""")
def code_without_confirmation(spark, sf):
    return agreement(spark, sf)["code_without_confirmation"]


@query("top_other_codes", f"""WITH {REVIEW_SQL}, {TARGET_LIST_SQL}, without AS (SELECT o_orderkey FROM reviewed
  WHERE confirmed AND o_orderkey NOT IN (SELECT o_orderkey FROM tc))
SELECT version, code AS code_norm, count(DISTINCT adm) AS admissions, 'Title of ' || code AS title FROM codes
WHERE NOT ({EXACT_SQL}) AND adm IN (SELECT o_orderkey FROM without) GROUP BY ALL ORDER BY admissions DESC, version, code LIMIT 50""")
def top_other_codes(spark, sf):
    return agreement(spark, sf)["top_other_codes"]


SUBJECT_SQL = """subj AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS admissions,
  count(*) FILTER (WHERE confirmed) AS confirmed_rows, string_agg(DISTINCT kind, '|' ORDER BY kind) AS labels,
  bool_or(confirmed) AS any_confirmed, o_custkey IN (SELECT o_custkey FROM prior) AS in_prior FROM reviewed
  GROUP BY o_custkey)"""


@query("subject_summary", f"WITH {REVIEW_SQL}, {SUBJECT_SQL} SELECT * FROM subj")
def subject_summary(spark, sf):
    return agreement(spark, sf)["subjects"]


@query("subjects_by_prior", f"""WITH {REVIEW_SQL}, {SUBJECT_SQL}, z AS (SELECT in_prior::VARCHAR AS in_prior,
  any_confirmed::VARCHAR AS any_confirmed FROM subj) SELECT CASE WHEN grouping(in_prior) = 1 THEN 'All' ELSE in_prior END
  AS in_prior, CASE WHEN grouping(any_confirmed) = 1 THEN 'All' ELSE any_confirmed END AS any_confirmed, count(*) AS n
  FROM z GROUP BY CUBE (in_prior, any_confirmed)""")
def subjects_by_prior(spark, sf):
    return agreement(spark, sf)["subjects_by_prior"]


@query("joined_codes", f"WITH {CODES_SQL}, {TARGET_LIST_SQL} SELECT *, 0 AS part_no FROM tc")
def joined_codes(spark, sf):
    target = codes(spark, sf).where(exact_code("code_norm", "version", TARGETS))
    return a.joined_values(target, ["o_orderkey"], "code_norm", "target_codes")


@query("joined_values_with_copies", """SELECT l_orderkey, 0 AS part_no, string_agg(l_returnflag, ' | ' ORDER BY l_returnflag) AS flags
FROM lineitem GROUP BY l_orderkey""")
def joined_values_with_copies(spark, sf):
    return a.joined_values(table(spark, sf, "lineitem"), ["l_orderkey"], "l_returnflag", "flags", " | ", distinct=False)


@query("distinct_counts", "SELECT count(DISTINCT o_custkey) AS o_custkey, count(DISTINCT o_orderpriority) AS o_orderpriority FROM orders")
def distinct_counts(spark, sf):
    return a.distinct_counts(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"])


@query("mean_and_sd", """SELECT p_type, round(avg(p_retailprice), 6) AS p_retailprice_mean,
  round(stddev_samp(p_retailprice), 6) AS p_retailprice_sd, round(avg(p_size), 6) AS p_size_mean,
  round(stddev_samp(p_size), 6) AS p_size_sd FROM part GROUP BY p_type""")
def mean_and_sd(spark, sf):
    out = a.mean_and_sd(table(spark, sf, "part"), ["p_retailprice", "p_size"], ["p_type"])
    return rounded(out, "p_retailprice_mean", "p_retailprice_sd", "p_size_mean", "p_size_sd")


@query("attrition", f"""WITH {CODES_SQL}, {ADM_SQL}, {CASES_SQL}
SELECT 1 AS step_no, 'admissions' AS step, count(*) AS n FROM adm UNION ALL
SELECT 2, 'coded admissions', count(*) FROM adm WHERE o_orderkey IN (SELECT adm FROM codes WHERE {EXACT_SQL}) UNION ALL
SELECT 3, 'subjects', count(DISTINCT o_custkey) FROM cases""")
def attrition(spark, sf):
    hits = coded_cases(spark, sf)
    return a.attrition([("admissions", admissions(spark, sf)), ("coded admissions", hits),
                        ("subjects", hits.select("o_custkey").distinct())])


@query("yield_shares", """SELECT u.category, u.n, round(u.n / b, 6) AS share_of_base FROM (
  SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS b, count(*) FILTER (WHERE l_returnflag = 'R' AND l_tax = 0) AS u1,
         count(*) FILTER (WHERE l_quantity > 45) AS u2 FROM lineitem),
  LATERAL (SELECT 'no tax' AS category, u1 AS n UNION ALL SELECT 'large', u2) u""")
def yield_shares(spark, sf):
    returned = F.col("l_returnflag") == "R"
    return rounded(a.yields(table(spark, sf, "lineitem"), returned, {
        "no tax": returned & (F.col("l_tax") == 0), "large": F.col("l_quantity") > 45}), "share_of_base")


@query("class_weight", """SELECT round(count(*) FILTER (WHERE toxic = 0) / count(*) FILTER (WHERE toxic = 1), 6)
  AS case_weight FROM labels""")
def class_weight(spark, sf):
    return rounded(a.class_weight(table(spark, sf, "labels"), "toxic"), "case_weight")


@query("fitted_histogram", """WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT least(floor((value - lo) * 30 / (hi - lo))::BIGINT + 1, 30) AS bin, count(*) AS n FROM events, r GROUP BY 1""")
def fitted_histogram(spark, sf):
    return a.fitted_histogram(table(spark, sf, "events"), "value")


# Usage counters: the number in props as input, the length of props as output.
@query("usage_summary", " UNION ALL ".join(f"""SELECT '{n}' AS counter, sum(v)::DOUBLE AS total, count(v) AS n,
  round(quantile_cont(v, 0.25), 6) AS q25, round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75
  FROM (SELECT ({e})::DOUBLE AS v FROM events)""" for n, e in
    (("usage_input_tokens", "json_extract(props, '$.k')::BIGINT"), ("usage_output_tokens", "length(event_type)"))))
def usage_summary(spark, sf):
    rows = table(spark, sf, "events").select(
        F.get_json_object("props", "$.k").alias("usage_input_tokens"),
        F.length("event_type").alias("usage_output_tokens"))
    return rounded(a.usage_summary(rows, ["usage_input_tokens", "usage_output_tokens"]), "q25", "median", "q75")


@query("throughput", """SELECT count(*) FILTER (WHERE event_type <> 'error') AS parsed,
  count(*) FILTER (WHERE event_type = 'error') AS errors,
  round(epoch_us(max(ts) - min(ts)) / 3600000000.0, 6) AS elapsed_hours,
  round(count(*) FILTER (WHERE event_type <> 'error') / (epoch_us(max(ts) - min(ts)) / 3600000000.0), 6) AS parsed_per_hour
FROM events""")
def throughput(spark, sf):
    return rounded(a.throughput(table(spark, sf, "events"), F.col("event_type") != "error", "ts", "ts"), "elapsed_hours",
                   "parsed_per_hour")


# Items: the number in props is the item id, seen inside each user's window.
ITEM_SQL = f"""{JOINED_SQL.replace('e.value', "json_extract(e.props, '$.k')::BIGINT AS item")},
obs AS (SELECT DISTINCT user_id, item, label FROM j),
tot AS (SELECT count(*) AS total, sum(label)::BIGINT AS cases, count(*) - sum(label)::BIGINT AS controls FROM spine),
cnt AS (SELECT item, count(*) AS observed, sum(label)::BIGINT AS case_observed, (count(*) - sum(label))::BIGINT AS control_observed
        FROM obs GROUP BY item),
prev AS (SELECT item, observed, case_observed, control_observed, total AS total_rows, cases AS total_cases,
  controls AS total_controls, round(observed / total, 6) AS overall_prevalence, round(case_observed / cases, 6) AS case_prevalence,
  round(control_observed / controls, 6) AS control_prevalence FROM cnt, tot)"""


def prevalence(spark, sf):
    events = table(spark, sf, "events").select("user_id", "ts", F.get_json_object("props", "$.k").cast("long").alias("item"))
    spine = event_spine(spark, sf)
    observed = interval_join(events, spine, ["user_id"], "ts", "index_time", "window_end")
    out = a.item_prevalence(observed, spine, "user_id", "item", "label")
    return rounded(out, "overall_prevalence", "case_prevalence", "control_prevalence")


@query("item_prevalence", f"""WITH {ITEM_SQL} SELECT *, row_number() OVER (ORDER BY observed DESC, item) AS prevalence_rank
  FROM prev""")
def item_prevalence(spark, sf):
    return a.rank_items(prevalence(spark, sf), "item")


# Item labels that collide, start with a digit, are empty or missing.
LABELS_SQL = """labels_ AS (SELECT range AS item, CASE WHEN range % 7 = 0 THEN '' WHEN range % 7 = 1 THEN '24h Urine--' || (range % 2)
  ELSE 'Item Name (' || (range % 5) || ')' END AS label_text FROM range(100) WHERE range % 11 <> 0)"""


def item_labels(spark, sf):
    items = (table(spark, sf, "events").select(F.get_json_object("props", "$.k").cast("long").alias("item")).distinct()
             .where(F.col("item") % 11 != 0))
    text = (F.when(F.col("item") % 7 == 0, "")
            .when(F.col("item") % 7 == 1, F.concat(F.lit("24h Urine--"), F.col("item") % 2))
            .otherwise(F.concat(F.lit("Item Name ("), F.col("item") % 5, F.lit(")"))))
    return items.select("item", text.alias("label_text"))


NAMED_SQL = f"""top AS (SELECT *, row_number() OVER (ORDER BY observed DESC, item) AS prevalence_rank FROM prev
  ORDER BY observed DESC, item LIMIT 20),
lab AS (SELECT top.*, coalesce(label_text, 'itemid_' || item) AS label_text FROM top LEFT JOIN labels_ USING (item)),
base AS (SELECT *, trim(regexp_replace(lower(label_text), '[^a-z0-9]+', '_', 'g'), '_') AS b0 FROM lab),
b AS (SELECT *, CASE WHEN b0 = '' THEN 'lab_' || item WHEN regexp_matches(b0, '^[0-9]') THEN 'lab_' || b0 ELSE b0 END AS b1
      FROM base),
named AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY b1 ORDER BY prevalence_rank) > 1 THEN b1 || '_' || item
                    ELSE b1 END AS feature_name FROM b)"""


@query("top_items_named", f"""WITH {ITEM_SQL}, {LABELS_SQL}, {NAMED_SQL}
SELECT item, observed, prevalence_rank, label_text, feature_name, feature_name || '_first' AS model_column,
  item IN (3, 14, 50) AS ordering_sensitive FROM named""")
def top_items_named(spark, sf):
    out = a.top_items(prevalence(spark, sf), "item", 20, item_labels(spark, sf), [3, 14, 50])
    return out.select("item", "observed", "prevalence_rank", "label_text", "feature_name", "model_column",
                      "ordering_sensitive")


@query("leaderboard", """SELECT p_brand, round(avg(p_retailprice), 6) AS ap, max(p_size)::BIGINT AS size, count(*) AS n FROM part
GROUP BY p_brand""")
def leaderboard(spark, sf):
    runs = table(spark, sf, "part").groupBy("p_brand").agg(
        F.round(F.avg("p_retailprice"), 6).alias("ap"), F.max("p_size").cast("long").alias("size"),
        F.count(F.lit(1)).alias("n"))
    return a.leaderboard(runs, {"ap": True, "size": True, "n": True, "p_brand": False})


@query("extremes", """SELECT * FROM (SELECT s_suppkey, s_acctbal, 'highest' AS side FROM supplier
  ORDER BY s_acctbal DESC, s_suppkey LIMIT 7) UNION ALL SELECT * FROM (SELECT s_suppkey, s_acctbal, 'lowest' FROM supplier
  ORDER BY s_acctbal, s_suppkey LIMIT 7)""")
def extremes(spark, sf):
    return a.extremes(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey", 7)


FLOW_SQL = """c AS (SELECT lang AS side, source AS label, count(*) AS n FROM documents GROUP BY 1, 2),
top AS (SELECT label FROM c GROUP BY label ORDER BY sum(n) DESC, label LIMIT 7),
k AS (SELECT side, CASE WHEN label IN (SELECT label FROM top) THEN label ELSE 'Other' END AS label, sum(n)::BIGINT AS n
      FROM c GROUP BY ALL)"""


@query("top_labels_other", f"WITH {FLOW_SQL} SELECT side, label, n FROM k")
def top_labels_other(spark, sf):
    counts = table(spark, sf, "documents").groupBy(F.col("lang").alias("side"), F.col("source").alias("label")).agg(
        F.count(F.lit(1)).alias("n"))
    return a.keep_top_labels(counts, "side", "label")


@query("flow_counts", f"WITH {FLOW_SQL} SELECT side AS lang, label AS source, sum(n)::BIGINT AS n FROM k GROUP BY CUBE (side, label)")
def flow_counts(spark, sf):
    return a.flow_counts(table(spark, sf, "documents"), "lang", "source")


@query("top_values", """WITH l AS (SELECT 'source' AS domain, source AS subgroup FROM documents UNION ALL
  SELECT 'lang', coalesce(nullif(lang, 'en'), 'missing') FROM documents), c AS (SELECT domain, subgroup, count(*) AS n FROM l GROUP BY ALL)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY domain ORDER BY n DESC, subgroup) <= 3""")
def top_values(spark, sf):
    docs = table(spark, sf, "documents").select("source", F.nullif("lang", F.lit("en")).alias("lang"))
    return a.top_values(docs, ["source", "lang"], 3)


# Matrix cleaning.

@query("has_measurement", f"""WITH {JOINED_SQL}, c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS n FROM j
  GROUP BY user_id) SELECT user_id, n AS view_count FROM c WHERE n > 0""")
def has_measurement(spark, sf):
    wide = features(spark, sf, ["count"]).select("user_id", "view_count")
    return x.has_measurement(wide, "view_count")


CORE = "click_first IS NOT NULL AND ((view_first IS NOT NULL AND error_first IS NOT NULL) OR signup_first IS NOT NULL)"
RULE = dict(required=["click_first"], one_of=[["view_first", "error_first"], ["signup_first"]])


@query("core_complete_filter", f"WITH {MATRIX_SQL} SELECT * FROM m WHERE {CORE}")
def core_complete_filter(spark, sf):
    return x.filter_complete(matrix(spark, sf), **RULE)


@query("core_complete_counts", f"""WITH {MATRIX_SQL} SELECT cohort_split, count(*) AS rows_before,
  count(*) FILTER (WHERE {CORE}) AS rows_after, count(*) FILTER (WHERE NOT ({CORE})) AS rows_removed,
  count(*) FILTER (WHERE label = 1) AS cases_before, count(*) FILTER (WHERE label = 1 AND ({CORE})) AS cases_after,
  count(*) FILTER (WHERE label = 1 AND NOT ({CORE})) AS cases_removed FROM m GROUP BY cohort_split""")
def core_complete_counts(spark, sf):
    return x.completeness_counts(matrix(spark, sf), "cohort_split", "label", x.complete(**RULE))


@query("two_column_complete_filter", f"WITH {MATRIX_SQL} SELECT * FROM m WHERE click_first IS NOT NULL AND view_first IS NOT NULL")
def two_column_complete_filter(spark, sf):
    return x.filter_complete(matrix(spark, sf), ["click_first", "view_first"])


NULLS = " + ".join(f"({c} IS NULL)::INT" for c in FIRSTS)


@query("row_missing_filter", f"WITH {MATRIX_SQL} SELECT * FROM m WHERE ({NULLS}) / 5 <= 0.4")
def row_missing_filter(spark, sf):
    return x.drop_sparse_rows(matrix(spark, sf), FIRSTS, 0.4)


@query("column_missing_profile", f"WITH {MATRIX_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(({c} IS NULL)::INT), 6) AS null_rate FROM m WHERE cohort_split = 'train'"
    for c in FIRSTS))
def column_missing_profile(spark, sf):
    train = matrix(spark, sf).where(F.col("cohort_split") == "train")
    return rounded(x.column_null_rates(train, FIRSTS), "null_rate")


@query("category_codes", """WITH d AS (SELECT o_orderkey, coalesce(nullif(o_orderpriority, '3-MEDIUM'), 'MISSING') AS kind,
  coalesce(nullif(o_orderstatus, 'P'), 'MISSING') AS place FROM orders)
SELECT *, dense_rank() OVER (ORDER BY kind) - 1 AS kind_code, dense_rank() OVER (ORDER BY place) - 1 AS place_code FROM d""")
def category_codes(spark, sf):
    return x.category_codes(admissions(spark, sf).select("o_orderkey", "kind", "place"), ["kind", "place"])


@query("one_hot", f"""WITH {ADM_SQL}, d AS (SELECT o_orderkey, kind, CASE WHEN {HALF.format(key='o_orderkey')} THEN 'test'
  ELSE 'train' END AS cohort_split FROM adm) SELECT o_orderkey, cohort_split, coalesce((kind = '2-HIGH')::INT, 0) AS "kind_2-HIGH",
  coalesce((kind = '4-NOT SPECIFIED')::INT, 0) AS "kind_4-NOT SPECIFIED", coalesce((kind = '5-LOW')::INT, 0) AS "kind_5-LOW" FROM d""")
def one_hot(spark, sf):
    rows = holdout_split(admissions(spark, sf).select("o_orderkey", "kind"), ["o_orderkey"])
    return x.one_hot(rows, "cohort_split", ["kind"])


@query("clipped_scale", """WITH q AS (SELECT quantile_cont(s_acctbal, 0.05) AS lo, quantile_cont(s_acctbal, 0.95) AS hi FROM supplier)
SELECT s_suppkey, round((least(greatest(s_acctbal, lo), hi) - lo) / (hi - lo), 6) AS colour FROM supplier, q""")
def clipped_scale(spark, sf):
    out = x.clipped_scale(table(spark, sf, "supplier"), "s_acctbal", "colour")
    return rounded(out.select("s_suppkey", "colour"), "colour")


@query("minmax_scale", """WITH g AS (SELECT p_brand, avg(p_retailprice) AS price, count(*)::DOUBLE AS n, 1.0::DOUBLE AS same
  FROM part GROUP BY p_brand), l AS (SELECT min(price) AS a, max(price) AS b, min(n) AS c, max(n) AS d FROM g)
SELECT p_brand, round((price - a) / (b - a), 6) AS price, round((n - c) / (d - c), 6) AS n, 0.5::DOUBLE AS same FROM g, l""")
def minmax_scale(spark, sf):
    rows = table(spark, sf, "part").groupBy("p_brand").agg(
        F.avg("p_retailprice").alias("price"), F.count(F.lit(1)).cast("double").alias("n"))
    return rounded(x.minmax_scale(rows.withColumn("same", F.lit(1.0)), ["price", "n", "same"]), "price", "n", "same")


FAMILY_RULES = [("prefix", "PROMO", "offers"), ("suffix", "UM", "middle"), ("name", "LARGE", "big")]


@query("feature_families", """SELECT CASE WHEN starts_with(p_type, 'PROMO') THEN 'offers' WHEN suffix(p_type, 'UM') THEN 'middle'
  WHEN p_type = 'LARGE' THEN 'big' ELSE 'other' END AS family, count(*) AS n FROM part GROUP BY 1""")
def feature_families(spark, sf):
    return x.family_counts(table(spark, sf, "part"), "p_type", FAMILY_RULES)
