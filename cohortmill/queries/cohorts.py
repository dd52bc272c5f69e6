"""Cohort building: code lists, one encounter per subject, spines, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes as k
from ..operators import cohort as c
from ..operators import joins as j
from ..plans import spines
from .common import query, table

TARGETS = {9: ["Brand#17.1", "brand#3.4", "Brand#9.0"], 10: ["Brand#21.5", "BRAND#8.8", "Brand#12.2"]}
GROUPS = {"first": {9: ["Brand#5"], 10: ["Brand#6.1", "Brand#6.2"]}, "second": {9: ["Brand#7.1"], 10: ["Brand#14"]}}


def in_list(values):
    return "(" + ", ".join(f"'{k.plain(v)}'" for v in values) + ")"


EXACT_SQL = " OR ".join(f"(version = {v} AND code IN {in_list(codes)})" for v, codes in TARGETS.items())


def prefix_sql(prefixes):
    return "(" + " OR ".join(f"(version = {v} AND starts_with(code, '{k.plain(p)}'))"
                             for v, listed in prefixes.items() for p in listed) + ")"


CODES_SQL = """
codes AS (SELECT l_orderkey AS adm, 9 + l_linenumber % 2 AS version,
                 upper(replace(p_brand || '.' || (p_size % 10), '.', '')) AS code
          FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def raw_codes(spark, sf):
    part = table(spark, sf, "part").select(
        "p_partkey", F.concat_ws(".", "p_brand", (F.col("p_size") % 10).cast("string")).alias("code"))
    return (table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
            .select(F.col("l_orderkey").alias("o_orderkey"), (9 + F.col("l_linenumber") % 2).alias("version"), "code"))


def codes(spark, sf):
    return k.prepare_codes(raw_codes(spark, sf), "o_orderkey", "code", "version")


@query("normal_codes", f"WITH {CODES_SQL} SELECT version, code AS code_norm, count(*) AS n FROM codes GROUP BY 1, 2")
def normal_codes(spark, sf):
    return codes(spark, sf).groupBy("version", "code_norm").agg(F.count(F.lit(1)).alias("n"))


@query("exact_code_mask", f"WITH {CODES_SQL} SELECT DISTINCT adm AS o_orderkey FROM codes WHERE {EXACT_SQL}")
def exact_code_mask(spark, sf):
    return spines.coded_admissions(codes(spark, sf), "o_orderkey", TARGETS)


@query("prefix_groups", f"WITH {CODES_SQL} " + " UNION ALL ".join(
    f"SELECT '{g}' AS code_group, count(DISTINCT adm) AS admissions, count(*) AS code_rows FROM codes "
    f"WHERE {prefix_sql(p)}" for g, p in GROUPS.items()))
def prefix_groups(spark, sf):
    return k.group_counts(codes(spark, sf), "o_orderkey", "code_norm", "version", GROUPS)


@query("loose_code_regex", """SELECT p_partkey, regexp_matches(coalesce(nullif(p_brand, 'Brand#2'), ''), '17|2[13]')
  AS is_case FROM part""")
def loose_code_regex(spark, sf):
    parts = table(spark, sf, "part").withColumn("code", F.nullif("p_brand", F.lit("Brand#2")))
    return parts.select("p_partkey", k.loose_code("code", "17|2[13]").alias("is_case"))


SIMILAR_SQL = f"""
similar_adm AS (SELECT adm FROM codes WHERE {' OR '.join(prefix_sql(p) for p in GROUPS.values())}
                EXCEPT SELECT adm FROM codes WHERE {EXACT_SQL})"""


@query("similar_controls", f"WITH {CODES_SQL}, {SIMILAR_SQL} SELECT adm AS o_orderkey FROM similar_adm")
def similar_controls(spark, sf):
    return spines.similar_admissions(codes(spark, sf), "o_orderkey", GROUPS, TARGETS)


ADM_SQL = """
adm AS (SELECT o_orderkey, o_custkey, o_orderdate AS index_time, nullif(o_orderpriority, '3-MEDIUM') AS kind,
               nullif(o_orderstatus, 'P') AS place, o_totalprice FROM orders)"""


def admissions(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").alias("index_time"),
        F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("kind"),
        F.nullif("o_orderstatus", F.lit("P")).alias("place"), "o_totalprice")


PEOPLE_SQL = """
people AS (SELECT c_custkey AS o_custkey, 10 + c_custkey % 40 AS anchor_age, 1996 AS anchor_year,
                  c_mktsegment AS segment FROM customer)"""


def people(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), (10 + F.col("c_custkey") % 40).alias("anchor_age"),
        F.lit(1996).alias("anchor_year"), F.col("c_mktsegment").alias("segment"))


def pick_sql(how, columns, order):
    return ", ".join(f"arg_{how}({x}, {order}) FILTER (WHERE {x} IS NOT NULL) AS {x}" for x in columns)


EARLY, LATE = "row(index_time, o_orderkey)", "row(index_time, -o_orderkey)"


@query("first_nonnull_per_subject", f"""WITH {ADM_SQL}
SELECT o_custkey, {pick_sql('min', ['o_orderkey', 'index_time', 'kind', 'place'], EARLY)} FROM adm GROUP BY o_custkey""")
def first_nonnull_per_subject(spark, sf):
    return c.first_non_null(admissions(spark, sf), "o_custkey", "index_time", "o_orderkey",
                            ["o_orderkey", "index_time", "kind", "place"])


@query("latest_nonnull", f"""WITH {ADM_SQL}
SELECT o_custkey, {pick_sql('max', ['kind', 'place'], LATE)} FROM adm GROUP BY o_custkey""")
def latest_nonnull(spark, sf):
    return spines.latest_demographics(admissions(spark, sf), "o_custkey", "index_time", "o_orderkey",
                                      ["kind", "place"])


ROW_SQL = """WITH {adm} SELECT o_custkey, o_orderkey, index_time, kind, place, o_totalprice FROM adm
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY index_time {way}, o_orderkey) = 1"""


@query("latest_row_per_subject", ROW_SQL.format(adm=ADM_SQL, way="DESC"))
def latest_row_per_subject(spark, sf):
    return c.one_row(admissions(spark, sf), "o_custkey", "index_time", "o_orderkey")


@query("earliest_row_per_subject", ROW_SQL.format(adm=ADM_SQL, way="ASC"))
def earliest_row_per_subject(spark, sf):
    return spines.earliest_row(admissions(spark, sf), "o_custkey", "index_time", "o_orderkey")


@query("first_proxy_time", """SELECT l_orderkey, l_suppkey, min(l_shipdate) AS proxy_time FROM lineitem
WHERE l_returnflag = 'R' GROUP BY 1, 2""")
def first_proxy_time(spark, sf):
    returned = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R")
    return c.first_time(returned, ["l_orderkey", "l_suppkey"], "l_shipdate", "proxy_time")


HALF = "substr(md5({key} || ':42'), 1, 8) < '33333333'"

SPINE_BODY = """
cases AS (SELECT o_custkey, {case_cols} FROM hits GROUP BY o_custkey),
pool AS (SELECT * FROM adm WHERE o_custkey NOT IN (SELECT o_custkey FROM cases) {similar}),
controls AS (SELECT o_custkey, {control_cols} FROM pool GROUP BY o_custkey),
both_sides AS (SELECT *, 1 AS label FROM cases UNION ALL SELECT *, 0 FROM controls),
aged AS (SELECT b.*, segment, anchor_age + year(index_time) - anchor_year AS index_age
         FROM both_sides b JOIN people USING (o_custkey))
SELECT o_custkey, o_orderkey, index_time, kind, place, label, segment, CAST(index_age AS BIGINT) AS index_age,
       CASE WHEN {test} THEN 'test' ELSE 'train' END AS cohort_split, index_time + INTERVAL 24 HOUR AS feature_window_end
FROM aged WHERE index_age >= 18"""
COLS = ["o_orderkey", "index_time", "kind", "place"]


def spine_sql(similar: bool) -> str:
    body = SPINE_BODY.format(case_cols=pick_sql("min", COLS, EARLY), control_cols=pick_sql("max", COLS, LATE),
                             similar="AND o_orderkey IN (SELECT adm FROM similar_adm)" if similar else "",
                             test=HALF.format(key="o_custkey"))
    return f"""WITH {CODES_SQL}, {SIMILAR_SQL}, {ADM_SQL}, {PEOPLE_SQL},
hits AS (SELECT * FROM adm WHERE o_orderkey IN (SELECT adm FROM codes WHERE {EXACT_SQL}) AND o_totalprice > 100000), {body}"""


def code_spine(spark, sf, similar):
    adm = admissions(spark, sf)
    listed = adm.where(F.col("o_totalprice") > 100000)
    spine = spines.code_defined_spine(adm, codes(spark, sf), people(spark, sf), listed, "o_custkey", "o_orderkey",
                                      "index_time", TARGETS, similar, ["kind", "place"])
    return spine.withColumn("index_age", F.col("index_age").cast("long"))


@query("code_cohort", spine_sql(False))
def code_cohort(spark, sf):
    return code_spine(spark, sf, None)


@query("code_cohort_similar_controls", spine_sql(True))
def code_cohort_similar_controls(spark, sf):
    return code_spine(spark, sf, GROUPS)


# Options of the code-defined spine, on the cohort with similar controls: kinds and places of hard controls, and times at
# which a case's window ends, from eight hours before its start to a day and more after it.
KINDS, PLACES = ["1-URGENT", "2-HIGH"], ["F"]


def optioned_spine(spark, sf, **options):
    adm = admissions(spark, sf)
    spine = spines.code_defined_spine(adm, codes(spark, sf), people(spark, sf), adm.where(F.col("o_totalprice") > 100000), "o_custkey",
                                      "o_orderkey", "index_time", TARGETS, GROUPS, ["kind", "place"], options=spines.SpineOptions(**options))
    return spine.withColumn("index_age", F.col("index_age").cast("long"))


def optioned_sql(test: str, kept: str, columns: str = "index_time + INTERVAL 24 HOUR AS feature_window_end") -> str:
    """The spine's rows `aged` with a split by `test`, those that `kept` keeps, and the window's columns."""
    head = spine_sql(True).split("SELECT o_custkey, o_orderkey, index_time, kind, place, label, segment")[0]
    return f"""{head}, grown AS (SELECT * FROM aged WHERE index_age >= 18),
splits AS (SELECT *, CASE WHEN {test} THEN 'test' ELSE 'train' END AS cohort_split FROM grown),
hard AS (SELECT *, cohort_split = 'train' AND label = 0 AS control, coalesce(kind IN ('1-URGENT', '2-HIGH'), false) OR coalesce(place IN ('F'), false) AS is_hard FROM splits),
kept AS ({kept})
SELECT o_custkey, o_orderkey, index_time, kind, place, label, segment, CAST(index_age AS BIGINT) AS index_age, cohort_split, {columns} FROM kept"""


EXACT_TEST = """row_number() OVER (PARTITION BY label ORDER BY md5(o_custkey || ':42')) <= floor(0.2 * count(*) OVER (PARTITION BY label) + 0.5)"""
DOWNSAMPLED = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY control ORDER BY md5(o_custkey || ':42')) AS k FROM {rows})
  WHERE NOT control OR k <= floor(1.5 * (SELECT count(*) FROM {rows} WHERE cohort_split = 'train' AND label = 1))"""
PROXY = "index_time + to_hours((o_orderkey % 40 - 8)::INT)"
CENSORED = f"""CASE WHEN label = 1 AND o_orderkey % 3 <> 0 THEN least(index_time + INTERVAL 24 HOUR, greatest({PROXY}, index_time))
  ELSE index_time + INTERVAL 24 HOUR END AS feature_window_end,
  CASE WHEN label = 1 AND o_orderkey % 3 <> 0 THEN greatest({PROXY}, index_time) END AS proxy_time,
  CASE WHEN label = 1 AND o_orderkey % 3 <> 0 THEN 'report' END AS proxy_source"""


def proxies(spark, sf):
    """Two times for each admission whose number is not divisible by three, of which the earlier one counts, and one without."""
    hours = lambda more: F.col("index_time") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 40 - 8 + more).cast("int"))
    times = F.explode(F.array(hours(5), hours(0), F.lit(None).cast("timestamp_ntz")))
    return admissions(spark, sf).where("o_orderkey % 3 <> 0").select("o_custkey", "o_orderkey", times.alias("proxy_time"))


@query("code_cohort_censored", optioned_sql(EXACT_TEST, "SELECT * FROM hard", CENSORED))
def code_cohort_censored(spark, sf):
    return optioned_spine(spark, sf, exact_split=True, proxies=proxies(spark, sf), proxy_source="report")


@query("code_cohort_hard_controls", optioned_sql(EXACT_TEST, "SELECT * FROM hard WHERE NOT control OR is_hard"))
def code_cohort_hard_controls(spark, sf):
    return optioned_spine(spark, sf, exact_split=True, hard_controls=("kind", KINDS, "place", PLACES))


@query("code_cohort_downsampled", optioned_sql(EXACT_TEST, DOWNSAMPLED.format(rows="hard")))
def code_cohort_downsampled(spark, sf):
    return optioned_spine(spark, sf, exact_split=True, control_ratio=1.5)


@query("code_cohort_all_options", optioned_sql("false", DOWNSAMPLED.format(rows="(SELECT * FROM hard WHERE NOT control OR is_hard)"), CENSORED))
def code_cohort_all_options(spark, sf):
    return optioned_spine(spark, sf, one_split=True, hard_controls=("kind", KINDS, "place", PLACES), control_ratio=1.5,
                          proxies=proxies(spark, sf), proxy_source="report")


EXACT_SPLIT = """sides AS (SELECT {key}, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5({key} || ':42'), {key})
  <= floor(0.2 * count(*) OVER (PARTITION BY label) + 0.5) THEN 'test' ELSE 'train' END AS cohort_split FROM {rows})"""


@query("list_cohort", f"""WITH {ADM_SQL}, {PEOPLE_SQL},
cohort AS (SELECT o_custkey, o_orderkey, CAST(o_custkey % 3 = 0 AS INTEGER) AS label FROM adm
           WHERE kind = '1-URGENT' AND o_custkey % 3 IN (0, 1)),
aged AS (SELECT cohort.*, adm.index_time, segment, anchor_age + year(index_time) - anchor_year AS index_age
         FROM cohort JOIN adm USING (o_custkey, o_orderkey) JOIN people USING (o_custkey)),
kept AS (SELECT * FROM aged WHERE index_age >= 18),
subjects AS (SELECT o_custkey, max(label) AS label FROM kept GROUP BY o_custkey),
{EXACT_SPLIT.format(key='o_custkey', rows='subjects')}
SELECT o_custkey, o_orderkey, label, index_time, segment, CAST(index_age AS BIGINT) AS index_age, cohort_split,
       index_time + INTERVAL 24 HOUR AS feature_window_end FROM kept JOIN sides USING (o_custkey)""")
def list_cohort(spark, sf):
    urgent = admissions(spark, sf).where(F.col("kind") == "1-URGENT")
    spine = spines.list_defined_spine(
        urgent.where(F.col("o_custkey") % 3 == 0), urgent.where(F.col("o_custkey") % 3 == 1),
        admissions(spark, sf).select("o_custkey", "o_orderkey", "index_time"), people(spark, sf),
        "o_custkey", "o_orderkey", "index_time")
    return spine.withColumn("index_age", F.col("index_age").cast("long")).drop("cohort_row_id")


# Lists and admissions as text: ids that are none, early times that are absent, before, after or unreadable.
RAW_IDS = "CASE WHEN o_custkey % 40 = 0 THEN 'ED_' || o_custkey ELSE CAST(o_custkey AS STRING) END"


@query("list_cohort_from_raw", f"""WITH {ADM_SQL}, {PEOPLE_SQL},
timed AS (SELECT o_custkey, o_orderkey, kind, CASE WHEN o_orderkey % 4 = 1 THEN index_time - INTERVAL 2 HOUR ELSE index_time END AS index_time,
  CASE o_orderkey % 4 WHEN 1 THEN 'edregtime' WHEN 2 THEN 'admittime_edregtime_after_admit' ELSE 'admittime' END AS index_time_source
  FROM adm WHERE o_custkey % 40 <> 0),
cohort AS (SELECT *, CAST(o_custkey % 3 = 0 AS INTEGER) AS label FROM timed WHERE kind = '1-URGENT' AND o_custkey % 3 IN (0, 1)),
kept AS (SELECT cohort.* EXCLUDE (kind), segment, anchor_age + year(index_time) - anchor_year AS index_age FROM cohort JOIN people USING (o_custkey)
         WHERE anchor_age + year(index_time) - anchor_year >= 18),
subjects AS (SELECT o_custkey, max(label) AS label FROM kept GROUP BY o_custkey),
{EXACT_SPLIT.format(key='o_custkey', rows='subjects')}
SELECT o_custkey, o_orderkey, label, index_time, index_time_source, segment, CAST(index_age AS BIGINT) AS index_age, cohort_split,
       index_time + INTERVAL 24 HOUR AS feature_window_end, CAST(NULL AS TIMESTAMP) AS proxy_time, CAST(NULL AS VARCHAR) AS proxy_source
FROM kept JOIN sides USING (o_custkey)""")
def list_cohort_from_raw(spark, sf):
    rows = admissions(spark, sf)
    early = F.when(F.col("o_orderkey") % 4 == 1, (F.col("index_time") - F.expr("INTERVAL 2 HOURS")).cast("string")).when(
        F.col("o_orderkey") % 4 == 2, (F.col("index_time") + F.expr("INTERVAL 3 HOURS")).cast("string")).when(F.col("o_orderkey") % 4 == 3, "unknown")
    raw = rows.select(F.expr(RAW_IDS).alias("o_custkey"), F.col("o_orderkey").cast("string").alias("o_orderkey"),
                      F.col("index_time").cast("string").alias("admittime"), early.alias("edregtime"))
    listed = lambda k: rows.where((F.col("kind") == "1-URGENT") & (F.col("o_custkey") % 3 == k)).select(
        F.expr(RAW_IDS).alias("o_custkey"), F.col("o_orderkey").cast("string").alias("o_orderkey"))
    spine = spines.list_spine_from_raw(listed(0), listed(1), raw, people(spark, sf), "o_custkey", "o_orderkey", "admittime", "edregtime")
    return spine.withColumn("index_age", F.col("index_age").cast("long")).drop("cohort_row_id")


TRANSFERS_SQL = """
transfers AS (SELECT user_id AS o_custkey, CASE WHEN event_type <> 'signup' THEN event_id END AS o_orderkey, ts,
                     CASE WHEN value > 30 THEN 'ED' ELSE 'WARD' END AS unit FROM events)"""


def transfers(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("o_custkey"),
        F.when(F.col("event_type") != "signup", F.col("event_id")).alias("o_orderkey"), "ts",
        F.when(F.col("value") > 30, "ED").otherwise("WARD").alias("unit"))


def coded_cases(spark, sf):
    return j.among(admissions(spark, sf), spines.coded_admissions(codes(spark, sf), "o_orderkey", TARGETS),
                   ["o_orderkey"])


CASES_SQL = f"cases AS (SELECT o_custkey FROM adm WHERE o_orderkey IN (SELECT adm FROM codes WHERE {EXACT_SQL}))"
LATEST_SQL = "QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY encounter_time DESC, visit_id DESC) = 1"


def standalone_sql(prefix, name, where):
    return (f"SELECT o_custkey, '{prefix}_' || o_custkey || '_' || strftime(ts, '%Y%m%d%H%M') AS visit_id, "
            f"ts AS encounter_time, '{name}' AS visit_type FROM transfers WHERE o_orderkey IS NULL {where}")


@query("emergency_controls", f"""WITH {CODES_SQL}, {ADM_SQL}, {TRANSFERS_SQL}, {CASES_SQL},
pool AS (SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS visit_id, index_time AS encounter_time,
                'ADMITTED_ED' AS visit_type FROM adm WHERE place = 'F'
         UNION ALL {standalone_sql('ED', 'STANDALONE_ED', "AND unit = 'ED'")})
SELECT * FROM pool WHERE o_custkey NOT IN (SELECT o_custkey FROM cases) {LATEST_SQL}""")
def emergency_controls(spark, sf):
    return spines.emergency_controls(admissions(spark, sf), transfers(spark, sf), coded_cases(spark, sf), "o_custkey",
                                     "o_orderkey", "index_time", ("place", "F"), ("unit", "ED"), "ts")


@query("adult_controls", f"""WITH {CODES_SQL}, {ADM_SQL}, {TRANSFERS_SQL}, {CASES_SQL}, {PEOPLE_SQL},
pool AS (SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS visit_id, index_time AS encounter_time,
                'ADMITTED' AS visit_type, kind FROM adm
         UNION ALL SELECT *, NULL FROM ({standalone_sql('SA', 'STANDALONE', '')})),
latest AS (SELECT * FROM pool WHERE o_custkey NOT IN (SELECT o_custkey FROM cases) {LATEST_SQL})
SELECT o_custkey, visit_id, encounter_time, visit_type, kind, segment,
       CAST(anchor_age + year(encounter_time) - anchor_year AS BIGINT) AS index_age
FROM latest JOIN people USING (o_custkey) WHERE anchor_age + year(encounter_time) - anchor_year >= 50""")
def adult_controls(spark, sf):
    out = spines.adult_controls(admissions(spark, sf), transfers(spark, sf), people(spark, sf),
                                coded_cases(spark, sf), "o_custkey", "o_orderkey", "index_time", "ts", 50, ["kind"])
    return out.withColumn("index_age", F.col("index_age").cast("long"))


@query("standalone_union", f"""WITH {ADM_SQL}, {TRANSFERS_SQL}
SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS visit_id, index_time AS encounter_time, 'ADMITTED' AS visit_type, kind
FROM adm UNION ALL SELECT *, NULL FROM ({standalone_sql('SA', 'STANDALONE', '')})""")
def standalone_union(spark, sf):
    admitted = admissions(spark, sf).select(
        "o_custkey", F.col("o_orderkey").cast("string").alias("visit_id"),
        F.col("index_time").alias("encounter_time"), F.lit("ADMITTED").alias("visit_type"), "kind")
    return j.stack(admitted, spines.standalone_visits(transfers(spark, sf), "o_custkey", "o_orderkey", "ts", "SA",
                                                      "STANDALONE"))


@query("case_origin_rate", f"""WITH {ADM_SQL}, first_visit AS (
  SELECT * FROM adm WHERE regexp_matches(coalesce(kind, ''), 'URGENT|HIGH')
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY index_time, o_orderkey) = 1)
SELECT count(*) AS subjects, count(*) FILTER (WHERE place = 'F' OR kind = '2-HIGH') AS flagged,
       round(count(*) FILTER (WHERE place = 'F' OR kind = '2-HIGH') / count(*), 6) AS rate FROM first_visit""")
def case_origin_rate(spark, sf):
    hits = admissions(spark, sf).where(k.loose_code("kind", "URGENT|HIGH"))
    first = c.one_row(hits, "o_custkey", "index_time", "o_orderkey", latest=False)
    flag = F.coalesce((F.col("place") == "F") | (F.col("kind") == "2-HIGH"), F.lit(False))
    return first.agg(F.count(F.lit(1)).alias("subjects"), F.count_if(flag).alias("flagged"),
                     F.round(F.avg(flag.cast("double")), 6).alias("rate"))


@query("loose_case_index", f"""WITH {ADM_SQL}, hit AS (
  SELECT * FROM adm WHERE regexp_matches(coalesce(kind, ''), 'URGENT|HIGH'))
SELECT o_custkey, {pick_sql('min', ['index_time', 'place'], EARLY)} FROM hit GROUP BY o_custkey""")
def loose_case_index(spark, sf):
    return spines.loose_case_index(admissions(spark, sf), "o_custkey", "index_time", "o_orderkey", "kind",
                                   "URGENT|HIGH", ["place"])


@query("hash_split", f"""SELECT event_id, CASE WHEN {HALF.format(key='event_id')} THEN 'test' ELSE 'train' END
  AS cohort_split FROM events""")
def hash_split(spark, sf):
    return c.holdout_split(table(spark, sf, "events"), ["event_id"]).select("event_id", "cohort_split")


LABELLED_SQL = "labelled AS (SELECT o_orderkey, o_custkey, CAST(o_orderstatus = 'F' AS INTEGER) AS label FROM orders)"


def labelled(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey",
                                             (F.col("o_orderstatus") == "F").cast("int").alias("label"))


@query("stratified_split", f"""WITH {LABELLED_SQL}, {EXACT_SPLIT.format(key='o_orderkey', rows='labelled')}
SELECT o_orderkey, o_custkey, label, cohort_split FROM labelled JOIN sides USING (o_orderkey)""")
def stratified_split(spark, sf):
    return c.stratified_split(labelled(spark, sf), ["o_orderkey"], "label")


@query("grouped_split", f"""WITH {LABELLED_SQL},
subjects AS (SELECT o_custkey, max(label) AS label FROM labelled GROUP BY o_custkey),
{EXACT_SPLIT.format(key='o_custkey', rows='subjects')}
SELECT o_orderkey, o_custkey, label, cohort_split FROM labelled JOIN sides USING (o_custkey)""")
def grouped_split(spark, sf):
    return c.grouped_split(labelled(spark, sf), "o_custkey", "label")


@query("subject_labels", f"WITH {LABELLED_SQL} SELECT o_custkey, max(label) AS label FROM labelled GROUP BY o_custkey")
def subject_labels(spark, sf):
    return c.subject_labels(labelled(spark, sf), "o_custkey", "label")


SPLIT_SQL = f"split_rows AS (SELECT *, CASE WHEN {HALF.format(key='o_orderkey')} THEN 'test' ELSE 'train' END AS cohort_split FROM labelled)"


@query("control_downsample", f"""WITH {LABELLED_SQL}, {SPLIT_SQL}, ranked AS (SELECT *,
  row_number() OVER (PARTITION BY cohort_split, label ORDER BY md5(o_orderkey || ':42'), o_orderkey) AS r FROM split_rows)
SELECT o_orderkey, o_custkey, label, cohort_split FROM ranked WHERE cohort_split = 'test' OR label = 1
  OR r <= floor(1.5 * (SELECT count(*) FROM split_rows WHERE cohort_split = 'train' AND label = 1))""")
def control_downsample(spark, sf):
    split = c.holdout_split(labelled(spark, sf), ["o_orderkey"])
    return c.downsample_controls(split, ["o_orderkey"], "label", 1.5, "cohort_split")


@query("cv_folds", f"""WITH {LABELLED_SQL} SELECT *, (row_number() OVER (
  PARTITION BY label ORDER BY md5(o_orderkey || ':42'), o_orderkey) - 1) % 5 + 1 AS fold FROM labelled""")
def cv_folds(spark, sf):
    return c.cv_folds(labelled(spark, sf), ["o_orderkey"], "label")


@query("hard_controls", f"""WITH {ADM_SQL}, rows_ AS (SELECT o_orderkey, kind, place,
  CAST(o_totalprice > 300000 AS INTEGER) AS label,
  CASE WHEN {HALF.format(key='o_orderkey')} THEN 'test' ELSE 'train' END AS cohort_split FROM adm)
SELECT * FROM rows_ WHERE cohort_split = 'test' OR label = 1 OR coalesce(kind IN ('1-URGENT', '2-HIGH'), false)
  OR coalesce(place = 'F', false)""")
def hard_controls(spark, sf):
    rows = admissions(spark, sf).select("o_orderkey", "kind", "place",
                                        (F.col("o_totalprice") > 300000).cast("int").alias("label"))
    split = c.holdout_split(rows, ["o_orderkey"])
    return c.hard_controls(split, "label", "cohort_split", "kind", ["1-URGENT", "2-HIGH"], "place", ["F"])


@query("derived_label_cohort", """WITH l AS (SELECT d.doc_id, source AS subject, TIMESTAMP '2024-01-01 00:00:00' +
    to_hours(CAST(n_chars % 5000 AS INTEGER)) AS seen, quality = 0 AS is_new, n_chars % 2 = 0 AS type_b,
    toxic = 1 AS known, lang = 'en' AS useful, n_chars > 300 AS symptom
  FROM documents d JOIN labels USING (doc_id)),
cases AS (SELECT * FROM l WHERE is_new AND NOT type_b AND NOT known),
controls AS (SELECT * FROM l WHERE useful AND symptom AND NOT is_new
             AND subject NOT IN (SELECT subject FROM l WHERE is_new)
             QUALIFY row_number() OVER (PARTITION BY subject ORDER BY seen DESC, doc_id) = 1)
SELECT subject, doc_id, seen, label, seen + INTERVAL 24 HOUR AS feature_window_end
FROM (SELECT *, 1 AS label FROM cases UNION ALL SELECT *, 0 FROM controls)""")
def derived_label_cohort(spark, sf):
    return spines.derived_label_cohort(reviewed(spark, sf), "subject", "doc_id", "seen", "is_new", "type_b", "known",
                                       "useful", "symptom")[0]


def reviewed(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    hours = F.make_dt_interval(F.lit(0), (F.col("n_chars") % 5000).cast("int"))
    return docs.join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", F.col("source").alias("subject"),
        (F.expr("timestamp_ntz'2024-01-01 00:00:00'") + hours).alias("seen"),
        (F.col("quality") == 0).alias("is_new"), (F.col("n_chars") % 2 == 0).alias("type_b"),
        (F.col("toxic") == 1).alias("known"), (F.col("lang") == "en").alias("useful"),
        (F.col("n_chars") > 300).alias("symptom"))


@query("cleanup_yield", """WITH l AS (SELECT quality = 0 AS is_new, n_chars % 2 = 0 AS type_b, toxic = 1 AS known
  FROM documents d JOIN labels USING (doc_id))
SELECT count(*) AS base, count(*) FILTER (WHERE type_b) AS excluded_type_b,
       count(*) FILTER (WHERE NOT type_b AND known) AS excluded_known,
       count(*) FILTER (WHERE NOT type_b AND NOT known) AS final_cases FROM l WHERE is_new""")
def cleanup_yield(spark, sf):
    return spines.derived_label_cohort(reviewed(spark, sf), "subject", "doc_id", "seen", "is_new", "type_b", "known",
                                       "useful", "symptom")[1]


@query("one_to_one_join", """SELECT o_orderkey, o_custkey, n_lines FROM orders LEFT JOIN (
  SELECT l_orderkey, count(*) AS n_lines FROM lineitem WHERE l_quantity > 40 GROUP BY 1) ON o_orderkey = l_orderkey""")
def one_to_one_join(spark, sf):
    lines = (table(spark, sf, "lineitem").where(F.col("l_quantity") > 40)
             .groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines")))
    return j.one_to_one(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), lines, ["o_orderkey"])


@query("many_to_one_join", """SELECT l_orderkey, l_partkey, l_linenumber, p_brand FROM lineitem
LEFT JOIN part ON l_partkey = p_partkey""")
def many_to_one_join(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return j.many_to_one(lines, parts, ["l_partkey"])


@query("match_indicator", """SELECT coalesce(c.c_custkey, e.user_id) AS id, CASE WHEN c.c_custkey IS NOT NULL AND
  e.user_id IS NOT NULL THEN 'both' WHEN c.c_custkey IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS _merge
FROM customer c FULL JOIN (SELECT DISTINCT user_id FROM events WHERE value > 60) e ON c.c_custkey = e.user_id""")
def match_indicator(spark, sf):
    users = table(spark, sf, "events").where(F.col("value") > 60).select(F.col("user_id").alias("id")).distinct()
    return j.with_indicator(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), users, ["id"], "full")


@query("label_lookup", """SELECT s_suppkey, coalesce(n_name, 'unknown') AS nation FROM supplier LEFT JOIN
  (SELECT * FROM nation WHERE n_regionkey <> 2) ON s_nationkey = n_nationkey""")
def label_lookup(spark, sf):
    nations = (table(spark, sf, "nation").where(F.col("n_regionkey") != 2)
               .select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation")))
    return j.lookup(table(spark, sf, "supplier"), nations, ["s_nationkey"], {"nation": "unknown"}).select(
        "s_suppkey", "nation")


@query("semi_anti", """SELECT o_orderkey, 'semi' AS side FROM orders WHERE o_custkey IN (SELECT user_id FROM events)
UNION ALL SELECT o_orderkey, 'anti' FROM orders o WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = o_custkey)""")
def semi_anti(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    users = table(spark, sf, "events").select(F.col("user_id").alias("o_custkey"))
    return j.stack(j.among(orders, users, ["o_custkey"]).select("o_orderkey", F.lit("semi").alias("side")),
                   j.not_among(orders, users, ["o_custkey"]).select("o_orderkey", F.lit("anti").alias("side")))


@query("numeric_ids", """SELECT event_id, TRY_CAST(split_part(props, ' ', 2)[:-2] AS BIGINT) AS k FROM events
WHERE TRY_CAST(CASE WHEN event_type = 'view' THEN props ELSE split_part(props, ' ', 2)[:-2] END AS BIGINT) IS NOT NULL""")
def numeric_ids(spark, sf):
    k_text = F.regexp_extract("props", r"(\d+)", 1)
    rows = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "view", F.col("props")).otherwise(k_text).alias("k"))
    return c.normal_ids(rows, "event_id", "k")


@query("distinct_pairs", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def distinct_pairs(spark, sf):
    return table(spark, sf, "orders").select("o_custkey", "o_orderstatus").distinct()


@query("eligible_set_difference", """SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT
SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O'""")
def eligible_set_difference(spark, sf):
    lines = table(spark, sf, "lineitem")
    return (lines.where(F.col("l_returnflag") == "A").select("l_orderkey")
            .subtract(lines.where(F.col("l_linestatus") == "O").select("l_orderkey")))


@query("stable_row_id", """SELECT o_orderkey, sha256(length(CAST(o_custkey AS VARCHAR)) || ':' || o_custkey || '|'
    || length(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey) AS row_id FROM orders""")
def stable_row_id(spark, sf):
    return c.row_id(table(spark, sf, "orders"), ["o_custkey", "o_orderkey"]).select("o_orderkey", "row_id")


@query("master_spine", f"""WITH {CODES_SQL}, {ADM_SQL}, hits AS (SELECT * FROM adm WHERE o_orderkey IN
  (SELECT adm FROM codes WHERE {EXACT_SQL})),
cases AS (SELECT o_custkey, {pick_sql('min', ['o_orderkey', 'index_time'], EARLY)} FROM hits GROUP BY o_custkey),
controls AS (SELECT o_custkey, {pick_sql('max', ['o_orderkey', 'index_time'], LATE)} FROM adm
             WHERE o_custkey NOT IN (SELECT o_custkey FROM cases) GROUP BY o_custkey),
demo AS (SELECT o_custkey, {pick_sql('max', ['kind', 'place'], LATE)} FROM adm GROUP BY o_custkey)
SELECT * FROM (SELECT *, 1 AS label FROM cases UNION ALL SELECT *, 0 FROM controls) LEFT JOIN demo USING (o_custkey)""")
def master_spine(spark, sf):
    adm = admissions(spark, sf)
    cols = ["o_orderkey", "index_time"]
    cases = c.first_non_null(coded_cases(spark, sf), "o_custkey", "index_time", "o_orderkey", cols)
    controls = c.first_non_null(j.not_among(adm, cases, ["o_custkey"]), "o_custkey", "index_time", "o_orderkey", cols,
                                latest=True)
    demo = spines.latest_demographics(adm, "o_custkey", "index_time", "o_orderkey", ["kind", "place"])
    return spines.master_spine(cases, controls, "label", "index_time").join(demo, "o_custkey", "left")
