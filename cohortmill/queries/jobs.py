"""Whole jobs: matrices, materialised tables, models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import phenotype_group
from ..operators import audit as a
from ..operators import cohort as c
from ..operators import metrics as m
from ..operators import models as ml
from ..operators.permute import PRIME, round_keys
from ..plans import matrices as pm
from ..plans import training as pt
from ..sources import materialize as s
from ..sources import readers
from ..session import cut_lineage, ensure_checkpoint_dir
from .audits import FIRSTS, MATRIX_SQL, matrix
from .common import EVENT_TYPES, event_spine, query, rounded, table
from .features import JOINED_SQL, TYPES, features, wide_sql


def workspace(spark) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/cohortmill-{uuid.uuid4().hex}"


@query("raw_matrix", f"""WITH {JOINED_SQL}, f AS (SELECT user_id, {wide_sql('first', 'mean')} FROM j GROUP BY user_id)
SELECT s.user_id, s.index_time, s.window_end, s.label, f.* EXCLUDE (user_id) FROM spine s LEFT JOIN f ON s.user_id = f.user_id""")
def raw_matrix(spark, sf):
    source = pm.EventFeatures(table(spark, sf, "events"), EVENT_TYPES, "event_type", "value", "ts")
    out = pm.raw_matrix(event_spine(spark, sf), [source], ["user_id"], "user_id", "index_time", "window_end",
                        ["first", "mean"])
    return rounded(out, *[f"{t}_mean" for t in TYPES])


# The branches of the raw matrix beside the long events: a wide table of measurements and order texts, both from the events.
ECG_FORMS = {"rr_interval": "CASE WHEN event_id % 5 = 0 THEN 0 ELSE value * 10 END", "p_onset": "value", "p_end": "value + 40", "qrs_onset": "value + event_id % 9",
             "qrs_end": "value + 150", "t_end": "value + 400", "p_axis": "CAST(event_id % 90 AS DOUBLE)", "qrs_axis": "CAST(event_id % 70 AS DOUBLE)",
             "t_axis": "CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 50 AS DOUBLE) END"}
ORDER_GROUPS = {"buy": [r"\bpurchase\b", r"\br2\b"], "high": [r"\bhigh\b"]}
_ECG_ALL = [*ECG_FORMS, "qt_interval", "qtc_bazett"]
_DRUG_TEXT = "event_type || ' ' || CASE WHEN value > 50 THEN 'HIGH' ELSE '' END || ' r' || event_id % 3"
_DRUG_COUNTS = ", ".join(f"count(*) FILTER (WHERE regexp_matches(worded, '{'|'.join(p)}', 'i')) AS {g}" for g, p in ORDER_GROUPS.items())


@query("raw_matrix_all_sources", f"""WITH {JOINED_SQL}, f AS (SELECT user_id, {wide_sql('mean', 'max')} FROM j GROUP BY user_id),
e0 AS (SELECT user_id, ts, {', '.join(f'{x} AS {c}' for c, x in ECG_FORMS.items())} FROM events WHERE event_type = 'view'),
e1 AS (SELECT *, t_end - qrs_onset AS qt_interval, CASE WHEN rr_interval > 0 THEN (t_end - qrs_onset) / sqrt(rr_interval / 1000) END AS qtc_bazett FROM e0),
e AS (SELECT s.user_id, count(*) AS ecg_count, {', '.join(f'round(avg({c}), 6) AS ecg_{c}_mean, max({c}) AS ecg_{c}_max' for c in _ECG_ALL)}
      FROM e1 JOIN spine s ON e1.user_id = s.user_id AND e1.ts BETWEEN s.index_time AND s.window_end GROUP BY s.user_id),
d0 AS (SELECT s.user_id, {_DRUG_TEXT} AS worded FROM events JOIN spine s ON events.user_id = s.user_id AND ts BETWEEN s.index_time AND s.window_end),
d AS (SELECT user_id, {_DRUG_COUNTS} FROM d0 GROUP BY user_id)
SELECT s.user_id, s.index_time, s.window_end, s.label, f.* EXCLUDE (user_id), e.* EXCLUDE (user_id),
  {', '.join(f'coalesce({g}, 0) AS med_{g}_count, (coalesce({g}, 0) > 0)::INT AS med_{g}_any' for g in ORDER_GROUPS)}
FROM spine s LEFT JOIN f ON s.user_id = f.user_id LEFT JOIN e ON s.user_id = e.user_id LEFT JOIN d ON s.user_id = d.user_id""")
def raw_matrix_all_sources(spark, sf):
    """Long events, a wide measurement table with its derived intervals, and order texts in drug groups, on one spine."""
    events = table(spark, sf, "events")
    ecg = events.where("event_type = 'view'").selectExpr("user_id", "ts AS ecg_time", *[f"{x} AS {c}" for c, x in ECG_FORMS.items()])
    orders = events.selectExpr("user_id", "ts AS starttime", "event_type AS drug", "CASE WHEN value > 50 THEN 'HIGH' END AS formulary_drug_cd",
                               "concat('r', event_id % 3) AS route")
    out = pm.raw_matrix(event_spine(spark, sf), [pm.EventFeatures(events, EVENT_TYPES, "event_type", "value", "ts")], ["user_id"], "user_id", "index_time",
                        "window_end", ["mean", "max"], ecg, orders, drug_groups=ORDER_GROUPS)
    return rounded(out, *[f"{t}_mean" for t in TYPES], *[f"ecg_{c}_mean" for c in _ECG_ALL])


@query("leakage_columns", """SELECT 'item_' || l_partkey || s AS column_name FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey % 97 = 0),
  (VALUES ('_first'), ('_mean')) v(s)""")
def leakage_columns(spark, sf):
    """Model columns of the items that tell about test ordering."""
    items = table(spark, sf, "lineitem").select("l_partkey").distinct().select(
        F.concat(F.lit("item_"), F.col("l_partkey")).alias("feature_name"), (F.col("l_partkey") % 97 == 0).alias("ordering_sensitive"))
    return spark.createDataFrame([(n,) for n in a.leakage_columns(items, ["_first", "_mean"])], "column_name string")


NULLS = " + ".join(f"({col} IS NULL)::INT" for col in FIRSTS)


@query("model_matrix", f"""WITH {MATRIX_SQL}, k AS (SELECT * FROM m WHERE ({NULLS}) / 5 <= 0.6)
SELECT user_id, CASE WHEN substr(md5(user_id || ':42'), 1, 8) < '80000000' THEN 'test' ELSE 'train' END AS cohort_split, label,
  kind, click_first, purchase_first, view_first FROM (SELECT *, CASE WHEN user_id % 3 = 0 THEN 'MISSING' ELSE 'kind ' || user_id % 3 END AS kind FROM k)""")
def model_matrix(spark, sf):
    raw = c.holdout_split(matrix(spark, sf), ["user_id"], 0.5).withColumn("kind", F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("kind "), F.col("user_id") % 3)))
    rules = pm.MatrixRules(["user_id"], "label", categories=["kind"], row_threshold=0.6, column_threshold=0.8,
                           leakage=["error_first"], drop=["signup_first"])
    return pm.model_matrix(raw, rules)[0]


@query("model_matrix_encoded", f"""WITH {MATRIX_SQL}, k AS (SELECT * FROM m WHERE ({NULLS}) / 5 <= 0.6)
SELECT user_id, CASE WHEN substr(md5(user_id || ':42'), 1, 8) < '80000000' THEN 'test' ELSE 'train' END AS cohort_split, label,
  (user_id % 3 = 2)::INT AS "kind_kind 2", click_first, purchase_first, view_first FROM k""")
def model_matrix_encoded(spark, sf):
    raw = c.holdout_split(matrix(spark, sf), ["user_id"], 0.5).withColumn("kind", F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("kind "), F.col("user_id") % 3)))
    rules = pm.MatrixRules(["user_id"], "label", categories=["kind"], row_threshold=0.6, column_threshold=0.8,
                           leakage=["error_first"], drop=["signup_first"], encode=True)
    return pm.model_matrix(raw, rules)[0]


@query("model_matrix_vector", f"""WITH {MATRIX_SQL},
s AS (SELECT * EXCLUDE (cohort_split), CASE WHEN substr(md5(user_id || ':42'), 1, 8) < '80000000' THEN 'test' ELSE 'train' END AS cohort_split,
  CASE WHEN user_id % 3 <> 0 THEN 'kind ' || user_id % 3 END AS kind, 'user ' || user_id % 40 AS place FROM m),
v AS (SELECT DISTINCT 'kind' AS col, kind AS value FROM s WHERE cohort_split = 'train' AND kind IS NOT NULL
      UNION SELECT DISTINCT 'place', place FROM s WHERE cohort_split = 'train'),
slots AS (SELECT col, value, row_number() OVER (ORDER BY col, value) - 1 AS slot FROM v
          WHERE value <> (SELECT min(w.value) FROM v w WHERE w.col = v.col))
SELECT s.user_id, s.cohort_split, (SELECT count(*) FROM slots) AS width,
  coalesce((SELECT string_agg(x.slot::VARCHAR, ',' ORDER BY x.slot) FROM slots x
            WHERE (x.col = 'kind' AND x.value = s.kind) OR (x.col = 'place' AND x.value = s.place)), '') AS ones FROM s""")
def model_matrix_vector(spark, sf):
    """One-hot columns as one sparse vector, whose slots are as many as the training values."""
    from pyspark.ml.functions import vector_to_array

    from ..operators import matrix as x
    raw = c.holdout_split(matrix(spark, sf), ["user_id"], 0.5).withColumns({
        "kind": F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("kind "), F.col("user_id") % 3)), "place": F.concat(F.lit("user "), F.col("user_id") % 40)})
    rows, _ = x.one_hot_vector(raw, "cohort_split", ["kind", "place"])
    values = rows.select("user_id", "cohort_split", vector_to_array("encoded").alias("v"))
    places = F.filter(F.transform("v", lambda one, i: F.when(one == 1, i)), lambda i: i.isNotNull())
    return values.select("user_id", "cohort_split", F.size("v").cast("long").alias("width"), F.array_join(places.cast("array<string>"), ",").alias("ones"))


@query("scoring_frame", """SELECT o_orderkey, (o_orderstatus = 'F')::INT AS y, o_totalprice / 500000 AS score, o_custkey,
  CASE WHEN o_orderstatus = 'F' THEN 'Final target: type unclear' WHEN o_orderpriority = '1-URGENT'
  THEN 'Control: dissection ruled out' ELSE 'Control' END AS phenotype_group FROM orders""")
def scoring_frame(spark, sf):
    orders = table(spark, sf, "orders")
    predictions = orders.select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"),
                                (F.col("o_totalprice") / 500000).alias("score"))
    labels = orders.where(F.col("o_orderpriority") == "1-URGENT").select(
        "o_orderkey", F.lit("dissection_ruled_out").alias("cleanup"), F.lit(None).cast("string").alias("subtype"))
    out = pm.scoring_frame(predictions, orders.select("o_orderkey", "o_custkey"), labels, ["o_orderkey"],
                           phenotype_group("y", "subtype", "cleanup"))
    return out.drop("cleanup", "subtype")


ITEMS = ["click", "purchase"]


@query("event_table_roundtrip", "SELECT user_id, ts, event_type, value FROM events WHERE event_type IN ('click', 'purchase')")
def event_table_roundtrip(spark, sf):
    """Written on the first call, read back on the second."""
    root, source = workspace(spark), table(spark, sf, "events").select("user_id", "ts", "event_type", "value")
    for _ in range(2):
        out = s.event_table(spark, root, "item_events", source, [f"{sf}/events.parquet"], "user_id", "event_type", "ts", ITEMS)
    return out


@query("event_table_lookup", """SELECT user_id, ts, event_type, value FROM events WHERE event_type IN ('click', 'purchase')
  AND user_id IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 40)""")
def event_table_lookup(spark, sf):
    """The clicks and purchases of some users from a table written for such lookups; a third item is written but not asked for."""
    root, source = workspace(spark), table(spark, sf, "events").select("user_id", "ts", "event_type", "value")
    held = s.lookup_table(spark, root, "user_events", source, [f"{sf}/events.parquet"], "user_id", "event_type", "ts", [*ITEMS, "view"])
    users = table(spark, sf, "events").where("event_type = 'signup' AND value > 40")
    return s.events_of(held, users, "user_id", "event_type", ITEMS)


@query("matrix_manifest", f"""WITH {JOINED_SQL} SELECT user_id, {wide_sql('first')} FROM j GROUP BY user_id""")
def matrix_manifest(spark, sf):
    root = workspace(spark)
    for config in ({"stats": ["first"], "hours": 24}, {"hours": 24, "stats": ["first"]}):
        out = s.feature_matrix(spark, root, "matrix", lambda: features(spark, sf, ["first"]), config,
                               [f"{sf}/events.parquet"])
    return out


@query("csv_roundtrip", "SELECT event_id, ts, user_id, value FROM events")
def csv_roundtrip(spark, sf):
    path = f"{workspace(spark)}/events_csv"
    s.write_csv(table(spark, sf, "events"), path)
    return readers.read_table(spark, path, {"event_id": "long", "ts": "timestamp_ntz", "user_id": "long", "value": "double"})


@query("json_roundtrip", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderpriority FROM orders")
def json_roundtrip(spark, sf):
    path = f"{workspace(spark)}/orders_json"
    s.write_json(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), path)
    return readers.read_table(spark, path, {"o_orderkey": "string", "o_orderpriority": "string"}, "json")


@query("appended_results", """SELECT o_orderpriority AS variant, count(*) AS n, CASE WHEN o_orderpriority = '5-LOW' THEN 'failed'
  ELSE 'ok' END AS status FROM orders GROUP BY ALL""")
def appended_results(spark, sf):
    """Two batches with different columns in one growing table."""
    path = f"{workspace(spark)}/results"
    counts = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("variant")).agg(F.count(F.lit(1)).alias("n"))
    s.append_rows(counts.where("variant <> '5-LOW'"), path)
    s.append_rows(counts.where("variant = '5-LOW'").withColumn("status", F.lit("failed")), path)
    return s.read_rows(spark, path, {"variant": "string", "n": "long", "status": "string"}).fillna({"status": "ok"})


@query("fixed_feature_set", f"WITH {MATRIX_SQL} SELECT user_id, label, view_first, click_first FROM m")
def fixed_feature_set(spark, sf):
    from ..operators import matrix as x
    return x.fixed_features(matrix(spark, sf), ["user_id", "label"], preset="web",
                            presets={"web": ["view_first", "click_first"]})


@query("dropped_columns", f"WITH {MATRIX_SQL} SELECT * EXCLUDE (error_first) FROM m")
def dropped_columns(spark, sf):
    from ..operators import matrix as x
    return x.drop_present(matrix(spark, sf), ["error_first", "not_there"])


@query("error_lines", "SELECT count(*) AS n FROM events WHERE event_type = 'error'")
def error_lines(spark, sf):
    path = f"{workspace(spark)}/errors"
    table(spark, sf, "events").select(
        F.when(F.col("event_type") == "error", F.col("props")).otherwise(" ").alias("value")).write.text(path)
    return readers.nonblank_lines(spark, path)


@query("run_manifest", """SELECT 'r1' AS run_id, (SELECT count(*) FROM orders) AS orders_rows, (SELECT count(*) FROM events) AS events_rows""")
def run_manifest(spark, sf):
    return s.run_manifest(spark, {"run_id": "r1"}, {n: table(spark, sf, n) for n in ("orders", "events")})


@query("source_fingerprint", "SELECT 1 AS files, true AS has_size")
def source_fingerprint(spark, sf):
    files = s.fingerprint(spark, f"{sf}/events.parquet")
    return files.agg(F.count(F.lit(1)).cast("int").alias("files"), (F.sum("size") > 0).alias("has_size"))


@query("fingerprint_of_written", """SELECT event_type AS folder, count(*) AS rows, true AS has_files, true AS digest_follows_files FROM events GROUP BY event_type""")
def fingerprint_of_written(spark, sf):
    """A folder per event type is written, fingerprinted and read back: every row lies in a file of the fingerprint, whose digest
    changes with a further file and not with the order in which files are listed."""
    path = f"{workspace(spark)}/events"
    held = table(spark, sf, "events").select("event_type", "event_id")
    held.withColumn("folder", F.col("event_type")).write.partitionBy("folder").parquet(path)
    files = s.fingerprint(spark, path)
    before, again = s.source_digest(files), s.source_digest(files.orderBy(F.rand(1)))
    held.where("event_type = 'click'").limit(1).write.parquet(f"{path}_more")
    follows = before == again and before != s.source_digest(s.fingerprint(spark, path, f"{path}_more"))
    named = files.select(F.regexp_extract("path", "/([^/]+/[^/]+)$", 1).alias("file"), F.col("size").alias("file_size"))
    rows = spark.read.parquet(path).select("folder", F.regexp_extract("_metadata.file_path", "/([^/]+/[^/]+)$", 1).alias("file"))
    counted = rows.groupBy("folder", "file").agg(F.count(F.lit(1)).alias("n")).join(named, "file")
    return counted.groupBy("folder").agg(F.sum("n").alias("rows"), F.bool_and(F.col("file_size") > 0).alias("has_files")).withColumn(
        "digest_follows_files", F.lit(follows))


# Models: text statistics of the labelled documents against their quality label.
NUMBERS = ["n_chars", "n_words", "n_lines", "n_digits", "share_upper", "n_distinct"]
FAST = {"maxIter": 4, "maxDepth": 3, "stepSize": 0.3}


def labelled_documents(spark, sf):
    """Text statistics, label and split of the labelled documents. Texts are read once: both sides and every fit start from the counts."""
    words = F.split(F.col("text"), r"\s+")
    docs = table(spark, sf, "documents").select(
        "doc_id", "lang", "n_chars", F.size(words).alias("n_words"),
        F.regexp_count("text", F.lit(r"\n")).alias("n_lines"),
        F.regexp_count("text", F.lit("[0-9]")).alias("n_digits"),
        (F.regexp_count("text", F.lit("[A-Z]")) / F.length("text")).alias("share_upper"),
        F.size(F.array_distinct(words)).alias("n_distinct"))
    rows = docs.join(table(spark, sf, "labels"), "doc_id").withColumn("label", 1 - F.col("quality"))
    return c.stratified_split(cut_lineage(rows.drop("quality", "toxic")), ["doc_id"], "label", 0.3)


def sides(spark, sf):
    rows = labelled_documents(spark, sf)
    return rows.where("cohort_split = 'train'"), rows.where("cohort_split = 'test'")


@query("model_predictions")
def model_predictions(spark, sf):
    train, test = sides(spark, sf)
    return ml.fit(train, [*NUMBERS, "lang"], "label", FAST).score(test, ["doc_id"])


@query("second_learner")
def second_learner(spark, sf):
    train, test = sides(spark, sf)
    model = ml.fit(train, [*NUMBERS, "lang"], "label", {"numTrees": 10, "maxDepth": 4}, "forest")
    return m.summary_scores(model.score(test), "y_true", "y_probability")


@query("gbt_grid")
def gbt_grid(spark, sf):
    train, test = sides(spark, sf)
    return ml.grid_search(train, test, NUMBERS, "label", [FAST, {**FAST, "maxDepth": 2}])[1]


@query("cross_validation")
def cross_validation(spark, sf):
    rows = c.cv_folds(labelled_documents(spark, sf), ["doc_id"], "label")
    return ml.cross_validate(rows, "fold", NUMBERS, "label", FAST)


@query("feature_importance")
def feature_importance(spark, sf):
    train, _ = sides(spark, sf)
    return ml.importance_table(train, ml.fit(train, [*NUMBERS, "lang"], "label", FAST))


@query("backward_elimination")
def backward_elimination(spark, sf):
    train, test = sides(spark, sf)
    return ml.backward_elimination(train, test, NUMBERS, "label", {"maxIter": 20}, "linear", minimum=2, tolerance=0.05,
                                   protected=["n_chars"])[1]


@query("shadow_filter")
def shadow_filter(spark, sf):
    train, test = sides(spark, sf)
    return ml.shadow_filter(train, test, ["doc_id"], NUMBERS, "label", FAST)[0]


@query("shadow_values", """SELECT 'real' AS side, sum(n_chars)::BIGINT AS total, count(*) AS n FROM documents
UNION ALL SELECT 'shadow', sum(n_chars)::BIGINT, count(*) FROM documents""")
def shadow_values(spark, sf):
    """A permutation keeps every value: the totals of a feature and of its shadow are the same."""
    both = ml.with_shadows(table(spark, sf, "documents").select("doc_id", "n_chars"), ["doc_id"], ["n_chars"], 42)
    return both.select(F.col("n_chars").alias("real"), F.col("shadow__n_chars").alias("shadow")).unpivot(
        [], ["real", "shadow"], "side", "v").groupBy("side").agg(F.sum("v").alias("total"), F.count("v").alias("n"))


def _permuted_sql(key: str) -> str:
    """The place that a row of place p asks for, of n, under the permutation of `key`."""
    keys = round_keys(key)
    shift, a_, b_, c_ = (f"([{', '.join(str(k[i]) for k in keys)}]::BIGINT[])[r]" for i in range(4))
    partner = f"((({shift} - x) % n + n) % n)"
    m_ = f"greatest(x, {partner})"
    odd = f"(({m_} % {PRIME} * {a_} % {PRIME} + {m_} // {PRIME} % {PRIME} * {b_} % {PRIME} + {c_}) % {PRIME}) % 2 = 1"
    return f"list_reduce([p] || range(1, {len(keys) + 1}), lambda x, r: CASE WHEN {odd} THEN {partner} ELSE x END)"


@query("shadow_places", f"""WITH k AS (SELECT doc_id, n_chars, lang, row_number() OVER (ORDER BY md5(doc_id || ':42')) - 1 AS p, count(*) OVER () AS n FROM documents),
asked AS (SELECT doc_id, {_permuted_sql('42:n_chars')} AS a, {_permuted_sql('42:copy')} AS b, {_permuted_sql('42:lang')} AS c FROM k)
SELECT asked.doc_id, x.n_chars AS shadow__n_chars, y.n_chars AS shadow__copy, z.lang AS shadow__lang
FROM asked JOIN k x ON x.p = a JOIN k y ON y.p = b JOIN k z ON z.p = c""")
def shadow_places(spark, sf):
    """Each feature's copy takes its values from rows of its own: two copies of one column differ."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", F.col("n_chars").alias("copy"), "lang")
    return ml.with_shadows(docs, ["doc_id"], ["n_chars", "copy", "lang"], 42).drop("n_chars", "copy", "lang")


@query("shadow_summary", """WITH r AS (SELECT l_linenumber AS feature, l_quantity AS x, 40.0::DOUBLE AS mx, 35.0::DOUBLE AS p FROM lineitem)
SELECT feature::VARCHAR AS feature, round(avg(x), 6) AS mean_real_importance, median(x) AS median_real_importance,
  max(x) AS max_real_importance, 40.0::DOUBLE AS mean_shadow_max_importance, 35.0::DOUBLE AS mean_shadow_p95_importance,
  count(*) FILTER (WHERE x > mx) AS hit_count, round(avg((x > mx)::INT), 6) AS hit_rate,
  round(avg(x - mx), 6) AS mean_importance_minus_shadow_max, count(*) AS shadow_filter_repeats,
  CASE WHEN avg((x > mx)::INT) <= 0.2 THEN 'reject' WHEN avg((x > mx)::INT) >= 0.8 THEN 'keep' ELSE 'tentative' END
  AS shadow_filter_status FROM r GROUP BY feature""")
def shadow_summary(spark, sf):
    raw = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").cast("string").alias("feature"), F.col("l_quantity").alias("real_importance"),
        F.lit(40.0).alias("shadow_max"), F.lit(35.0).alias("shadow_p95"))
    return rounded(ml.shadow_summary(raw), "mean_real_importance", "hit_rate", "mean_importance_minus_shadow_max")


@query("drop_set_comparison")
def drop_set_comparison(spark, sf):
    train, test = sides(spark, sf)
    return ml.drop_set_comparison(train, test, NUMBERS, "label", {"without_size": ["n_chars", "n_words"]}, FAST)


@query("permutation_importance")
def permutation_importance(spark, sf):
    train, test = sides(spark, sf)
    model = ml.fit(train, NUMBERS, "label", FAST)
    return ml.permutation_importance(model, test, ["doc_id"], NUMBERS, "label")


@query("mean_absolute", " UNION ALL ".join(f"SELECT '{x}' AS feature, round(avg(abs({x} - 0.04)), 6) AS mean_abs FROM lineitem"
                                           for x in ("l_discount", "l_tax")))
def mean_absolute(spark, sf):
    shifted = table(spark, sf, "lineitem").select((F.col("l_discount") - 0.04).alias("l_discount"), (F.col("l_tax") - 0.04).alias("l_tax"))
    return rounded(ml.mean_absolute(shifted, ["l_discount", "l_tax"]), "mean_abs")


@query("run_summary")
def run_summary(spark, sf):
    """The row of a training job with five folds; its threshold comes from the validation rows inside the training rows."""
    return pt.train_and_evaluate(labelled_documents(spark, sf), training_rules(folds=5)).summary


def training_rules(**options) -> pt.TrainingRules:
    return pt.TrainingRules(["doc_id"], "label", NUMBERS, validation_share=0.25, grid=[FAST, {**FAST, "maxDepth": 2}], run_id="r1",
                            model_label="text statistics", **options)


# The documents' split and the parts of its training rows, by the order of md5(key:42) in each label.
ROLES_SQL = """
rows AS (SELECT doc_id, 1 - quality AS y FROM documents JOIN labels USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(doc_id || ':42')) AS k, count(*) OVER (PARTITION BY y) AS n FROM rows),
split AS (SELECT doc_id, y, k > floor(0.3 * n + 0.5) AS train FROM placed),
again AS (SELECT *, row_number() OVER (PARTITION BY train, y ORDER BY md5(doc_id || ':42')) AS k, count(*) OVER (PARTITION BY train, y) AS n FROM split),
roles AS (SELECT doc_id, y, (k - 1) % 5 + 1 AS fold, CASE WHEN NOT train THEN 'holdout' WHEN k <= floor(0.25 * n + 0.5) THEN 'validation' ELSE 'fit' END AS role
          FROM again)"""
RULES = ["validation_f1", "default_0.5", *[f"recall>={t:.2f}" for t in m.RECALL_TARGETS], *[f"fp<={b}" for b in m.FP_BUDGETS]]


@query("train_and_evaluate", f"""WITH {ROLES_SQL}
SELECT 'role' AS part, role AS name, count(*) AS rows, sum(y)::BIGINT AS positive FROM roles GROUP BY role
UNION ALL SELECT 'fold', fold::VARCHAR, count(*), sum(y)::BIGINT FROM roles WHERE role <> 'holdout' GROUP BY fold
UNION ALL SELECT 'candidate', p, i, NULL FROM (VALUES (1, '{{"maxDepth": 3, "maxIter": 4, "stepSize": 0.3}}'), (2, '{{"maxDepth": 2, "maxIter": 4, "stepSize": 0.3}}')) v(i, p)
UNION ALL SELECT 'rule', r, (SELECT count(*) FROM roles WHERE role = 'holdout'), (SELECT sum(y)::BIGINT FROM roles WHERE role = 'holdout')
  FROM (VALUES {', '.join(f"('{r}')" for r in RULES)}) v(r)
UNION ALL SELECT 'threshold', 'is a score of a validation row', (SELECT count(*) FROM roles WHERE role = 'validation'), (SELECT sum(y)::BIGINT FROM roles WHERE role = 'validation')
UNION ALL SELECT 'holdout curve', 'ends at all cases', (SELECT count(*) FROM roles WHERE role = 'holdout'), (SELECT sum(y)::BIGINT FROM roles WHERE role = 'holdout')
UNION ALL SELECT 'features', 'kept and dropped', 6, NULL""")
def train_and_evaluate(spark, sf):
    """The whole job on the labelled documents, elimination, folds and shadows included, as the counts that its tables rest on."""
    run = pt.train_and_evaluate(labelled_documents(spark, sf), training_rules(folds=5, minimum=5, passes=1, tolerance=0.05, shadows=1))
    long = lambda df, part, name, rows, positive: df.select(F.lit(part).alias("part"), name.alias("name"), rows.cast("long").alias("rows"),
                                                            positive.cast("long").alias("positive"))
    at = run.validation.agg(F.count(F.lit(1)).alias("n"), F.sum("y_true").alias("p"), F.count_if(F.col("y_probability") == run.threshold).alias("hit")).where("hit > 0")
    curve = run.pr_curve.where("recall = 1").limit(1).crossJoin(run.predictions.agg(F.count(F.lit(1)).alias("n"), F.sum("y_true").alias("p")))
    none = F.lit(None)
    names = spark.createDataFrame([(len({*run.features, *run.dropped}),)], "n int")
    out = long(run.roles, "role", F.col("role"), F.col("rows"), F.col("positive"))
    for more in (long(run.folds, "fold", F.col("fold").cast("string"), F.col("validation_rows"), F.col("validation_positive")),
                 long(run.candidates, "candidate", F.col("params_json"), F.col("candidate"), none),
                 long(run.operating_points, "rule", F.col("rule"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), F.col("tp") + F.col("fn")),
                 long(at, "threshold", F.lit("is a score of a validation row"), F.col("n"), F.col("p")),
                 long(curve, "holdout curve", F.lit("ends at all cases"), F.col("n"), F.col("p")),
                 long(names, "features", F.lit("kept and dropped"), F.col("n"), none)):
        out = out.unionByName(more)
    return out


@query("sweep_with_failures")
def sweep_with_failures(spark, sf):
    train, test = sides(spark, sf)
    def run(names):
        return m.summary_scores(ml.fit(train, names, "label", FAST).score(test), "y_true", "y_probability")
    runs = ml.sweep({"size": lambda: run(NUMBERS[:2]), "broken": lambda: run(["no_such_column"])}, spark)
    return a.leaderboard(runs, {"average_precision": True, "variant": False})
