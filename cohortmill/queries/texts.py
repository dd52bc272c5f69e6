"""Text rules, notes per visit, JSON records and responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as r
from ..functions import text as t
from ..functions.times import window_end
from ..operators.joins import among, require_qualified
from ..plans import notes as n
from .common import query, table

POSITIVE = [r"\bwith the\b", r"\bthat (?:is|on)\b", r"\bfor[^\n.]{0,40}\bthe\b"]
NEGATED = [r"\bis not\b", r"\band (?:the )?of\b", r"\bwas the\b"]


def alternation(patterns):
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


@query("text_positive_not_negated", f"""SELECT doc_id, regexp_matches(text, '{alternation(POSITIVE)}')
  AND NOT regexp_matches(text, '{alternation(NEGATED)}') AS is_positive FROM documents""")
def text_positive_not_negated(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", t.positive_not_negated(F.col("text"), POSITIVE, NEGATED).alias("is_positive"))


# Reports with header lines: every " the " of a document becomes a line that starts with "the:".
SECTION = r"(?ims)^\s*(?:the|and)\s*:.*"
REPORT_SQL = r"reports AS (SELECT doc_id, source, replace(text, ' the ', chr(10) || ' The : ') AS report, n_chars FROM documents)"


def reports(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", "source", F.replace("text", F.lit(" the "), F.lit("\n The : ")).alias("report"), "n_chars")


@query("section_tail", f"WITH {REPORT_SQL} SELECT doc_id, md5(regexp_extract(report, '{SECTION}')) AS section_hash, "
                       f"length(regexp_extract(report, '{SECTION}')) AS section_chars FROM reports")
def section_tail(spark, sf):
    section = t.result_section(F.col("report"), ["the", "and"])
    return reports(spark, sf).select("doc_id", F.md5(section).alias("section_hash"),
                                     F.length(section).cast("long").alias("section_chars"))


DETAIL_SQL = """detail AS (SELECT doc_id, 'exam_name' AS field_name, CASE doc_id % 4 WHEN 0 THEN 'CT CHEST W/CONTRAST'
  WHEN 1 THEN 'MRI HEAD AND NECK' WHEN 2 THEN 'CHEST (PA AND LAT)' ELSE 'CTA ABD' END AS field_value FROM documents
  UNION ALL SELECT doc_id, 'exam_name', 'CT PELVIS' FROM documents WHERE doc_id % 6 = 0
  UNION ALL SELECT doc_id, 'exam_code', 'MRA AORTA' FROM documents)"""
EXAMS_SQL = """exams AS (SELECT doc_id, string_agg(field_value, ' | ' ORDER BY field_value) AS exam_name FROM detail
  WHERE field_name = 'exam_name' GROUP BY doc_id)"""


def exam_sql(name):
    return (f"(regexp_matches({name}, '{alternation(t.EXAM_MODALITY)}') AND regexp_matches({name}, "
            f"'{alternation(t.EXAM_ANATOMY)}') AND NOT regexp_matches({name}, '{alternation(t.EXAM_EXCLUDED)}'))")


def detail(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    kind = F.col("doc_id") % 4
    main = docs.select("doc_id", F.lit("exam_name").alias("field_name"), F.when(kind == 0, "CT CHEST W/CONTRAST")
                       .when(kind == 1, "MRI HEAD AND NECK").when(kind == 2, "CHEST (PA AND LAT)")
                       .otherwise("CTA ABD").alias("field_value"))
    second = docs.where(F.col("doc_id") % 6 == 0).select("doc_id", F.lit("exam_name"), F.lit("CT PELVIS"))
    return main.union(second).union(docs.select("doc_id", F.lit("exam_code"), F.lit("MRA AORTA")))


@query("exam_rule", f"WITH {DETAIL_SQL}, {EXAMS_SQL} SELECT doc_id, 0 AS part_no, exam_name, {exam_sql('exam_name')} AS is_diagnostic FROM exams")
def exam_rule(spark, sf):
    exams = n.exam_names(detail(spark, sf).where(F.col("field_name") == "exam_name"), "doc_id", "field_value")
    return exams.withColumn("is_diagnostic", t.diagnostic_exam(F.col("exam_name")))


DATED_SQL = """dated AS (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_hours((n_chars % 5000)::INT) AS charttime FROM reports)"""


@query("proxy_times", f"""WITH {REPORT_SQL}, {DETAIL_SQL}, {EXAMS_SQL}, {DATED_SQL},
hits AS (SELECT *, regexp_extract(report, '{SECTION}') AS section FROM dated WHERE source <> 'src7')
SELECT source, min(charttime) AS proxy_time FROM hits JOIN exams USING (doc_id)
WHERE regexp_matches(section, '{alternation([r"\bwith\b", r"\bthat\b"])}')
  AND NOT regexp_matches(section, '{alternation(NEGATED)}') AND {exam_sql('exam_name')} GROUP BY source""")
def proxy_times(spark, sf):
    hours = F.make_dt_interval(F.lit(0), (F.col("n_chars") % 5000).cast("int"))
    dated = reports(spark, sf).withColumn("charttime", F.expr("timestamp_ntz'2024-01-01 00:00:00'") + hours)
    cases = dated.where(F.col("source") != "src7").select("source").distinct()
    return n.proxy_times(dated, detail(spark, sf), cases, ["source"], "doc_id", "charttime", "report",
                         ("field_name", "field_value", "exam_name"), [r"\bwith\b", r"\bthat\b"], NEGATED, ["the", "and"])


GROUPS = {"colour": [r"\bred\b", r"\bblue\b", r"\bgreen\b"], "size": [r"\bsmall\b", r"\blarge\b"], "thing": [r"\bring\b", r"\bwidget\b"]}


@query("group_regex_counts", "SELECT p_brand, " + ", ".join(
    f"count(*) FILTER (WHERE regexp_matches(concat_ws(' ', coalesce(p_name, ''), coalesce(nullif(p_type, 'LARGE'), ''), "
    f"p_size::VARCHAR), '{alternation(p)}')) AS med_{g}_count, (count(*) FILTER (WHERE regexp_matches(concat_ws(' ', "
    f"coalesce(p_name, ''), coalesce(nullif(p_type, 'LARGE'), ''), p_size::VARCHAR), '{alternation(p)}')) > 0)::INT AS med_{g}_any"
    for g, p in GROUPS.items()) + " FROM part GROUP BY p_brand")
def group_regex_counts(spark, sf):
    parts = table(spark, sf, "part").withColumn("p_type", F.nullif("p_type", F.lit("LARGE")))
    return t.count_groups(parts, ["p_brand"], t.joined_text("p_name", "p_type", "p_size"), GROUPS, "med_")


DRUG_SPINE = """spine AS (SELECT o_orderkey, o_custkey, o_orderdate AS index_time, o_orderdate + INTERVAL 9600 HOUR AS window_end
  FROM orders), rx AS (SELECT o_custkey, o_orderkey, l_shipdate, p_name || ' ' || p_type AS drug FROM lineitem
  JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""


@query("drug_features", f"""WITH {DRUG_SPINE}, j AS (SELECT s.o_orderkey, drug FROM spine s JOIN rx ON s.o_custkey = rx.o_custkey
  AND s.o_orderkey = rx.o_orderkey AND l_shipdate BETWEEN index_time AND window_end), c AS (SELECT o_orderkey, """ + ", ".join(
    f"count(*) FILTER (WHERE regexp_matches(drug, '{alternation(p)}')) AS med_{g}_count" for g, p in GROUPS.items()) +
    " FROM j GROUP BY o_orderkey) SELECT s.*, " + ", ".join(
    f"coalesce(med_{g}_count, 0) AS med_{g}_count, (coalesce(med_{g}_count, 0) > 0)::INT AS med_{g}_any" for g in GROUPS) +
    " FROM spine s LEFT JOIN c USING (o_orderkey)")
def drug_features(spark, sf):
    orders = table(spark, sf, "orders")
    spine = orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("index_time"),
                          window_end("o_orderdate", 9600).alias("window_end"))
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    rx = (table(spark, sf, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
          .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
          .select("o_custkey", "o_orderkey", "l_shipdate", "p_name", "p_type"))
    return n.drug_features(rx, spine, ["o_custkey", "o_orderkey"], "o_orderkey", "l_shipdate", "index_time", "window_end",
                           t.joined_text("p_name", "p_type"), GROUPS, bin_seconds=9600 * 3600)


LADDER = [("First", ["red", "blu"]), ("Second", ["ring", "green"]), ("Third", ["small"])]


@query("keyword_category", """SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') OR contains(lower(p_name), 'blu') THEN 'First'
  WHEN contains(lower(p_name), 'ring') OR contains(lower(p_name), 'green') THEN 'Second'
  WHEN contains(lower(p_name), 'small') THEN 'Third' ELSE 'Other/unclear' END AS category FROM part""")
def keyword_category(spark, sf):
    return table(spark, sf, "part").select("p_partkey", t.keyword_category(F.col("p_name"), LADDER).alias("category"))


@query("clean_labels", """WITH w AS (SELECT doc_id, trim(regexp_replace(replace(text, '_', ' '), '\\s+', ' ', 'g')) AS x FROM documents)
SELECT doc_id, CASE WHEN len(string_split(x, ' ')) > 4 THEN array_to_string(string_split(x, ' ')[1:4], ' ') || '...' ELSE x END AS label
FROM w""")
def clean_labels(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.clean_label(F.col("text"), 4).alias("label"))


@query("mapped_labels", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Now' WHEN '2-HIGH' THEN 'Soon'
  WHEN '3-MEDIUM' THEN 'missing' ELSE o_orderpriority END AS label FROM orders""")
def mapped_labels(spark, sf):
    kind = F.nullif("o_orderpriority", F.lit("3-MEDIUM"))
    return table(spark, sf, "orders").select("o_orderkey", t.mapped_label(kind, {"1-URGENT": "Now", "2-HIGH": "Soon"}).alias("label"))


@query("suffix_removal", "SELECT o_orderkey, regexp_replace(o_orderpriority, 'H$', '') AS label FROM orders")
def suffix_removal(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", t.without_suffix(F.col("o_orderpriority"), "H").alias("label"))


@query("phenotype_groups", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_custkey % 3 = 0 THEN 'Final target: Stanford A'
  WHEN o_orderstatus = 'F' THEN 'Final target: type unclear' WHEN o_orderpriority = '1-URGENT' THEN 'Control: dissection ruled out'
  WHEN o_orderpriority = '2-HIGH' THEN 'Control: no aortic syndrome' ELSE 'Control' END AS phenotype_group FROM orders""")
def phenotype_groups(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        F.when(F.col("o_custkey") % 3 == 0, " A ").when(F.col("o_custkey") % 3 == 1, "Unclear").alias("subtype"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "dissection_ruled_out")
        .when(F.col("o_orderpriority") == "2-HIGH", "no_aortic_syndrome_evidence").alias("cleanup"))
    return rows.select("o_orderkey", t.phenotype_group("y", "subtype", "cleanup").alias("phenotype_group"))


# Notes: the turns of a conversation, with sequence numbers whose text order differs from their number order.
NOTES_SQL = """notes AS (SELECT conv_id, conv_id || '-' || turn AS note_id, (turn * 4)::VARCHAR AS note_seq, role AS note_type,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(turn::INT) AS charttime, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text
  FROM conversations WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY {order}, charttime, note_id) AS note_no,
  count(*) OVER (PARTITION BY conv_id) AS note_count FROM notes)"""


def raw_notes(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", F.concat_ws("-", "conv_id", "turn").alias("note_id"), (F.col("turn") * 4).cast("string").alias("note_seq"),
        F.col("role").alias("note_type"),
        (F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.col("turn").cast("int"))).alias("charttime"),
        "text")


def numbered(spark, sf, **options):
    return n.numbered_notes(n.staged_notes(raw_notes(spark, sf), ["conv_id"], "text"), "conv_id", "note_seq", "charttime",
                            "note_id", "text", **options)


@query("note_order", f"WITH {NOTES_SQL.format(order='note_seq')} SELECT conv_id, note_id, note_no, note_count FROM numbered")
def note_order(spark, sf):
    return numbered(spark, sf).select("conv_id", "note_id", "note_no", "note_count")


@query("note_order_bucketed", f"WITH {NOTES_SQL.format(order='note_seq')} SELECT conv_id, note_id, note_no, note_count FROM numbered")
def note_order_bucketed(spark, sf):
    """The same through sampled bucket limits, which take over for a visit with very many notes."""
    return numbered(spark, sf, rows_per_task=5).select("conv_id", "note_id", "note_no", "note_count")


@query("note_order_numeric", f"WITH {NOTES_SQL.format(order='note_seq::INT')} SELECT conv_id, note_id, note_no, note_count FROM numbered")
def note_order_numeric(spark, sf):
    return numbered(spark, sf, numeric=True).select("conv_id", "note_id", "note_no", "note_count")


@query("combine_notes", f"""WITH {NOTES_SQL.format(order='note_seq')} SELECT conv_id, 0 AS part_no, max(note_count) AS note_count,
  string_agg(CASE WHEN note_count > 1 THEN 'DISCHARGE NOTE ' || note_no || chr(10) || text ELSE text END, chr(10) || chr(10)
    ORDER BY note_no) AS combined_text, string_agg(note_id, '|' ORDER BY note_no) AS note_ids,
  string_agg(note_type, '|' ORDER BY note_no) AS note_types, string_agg(note_seq, '|' ORDER BY note_no) AS note_seqs,
  string_agg(strftime(charttime, '%Y-%m-%d %H:%M:%S'), '|' ORDER BY note_no) AS charttimes,
  'Discharge note text:' || chr(10) || combined_text AS prompt FROM numbered GROUP BY conv_id""")
def combine_notes(spark, sf):
    return n.prompts(n.combined_notes(numbered(spark, sf), "conv_id", "text", ["note_id", "note_type", "note_seq", "charttime"]))


@query("combine_notes_in_parts", f"""WITH {NOTES_SQL.format(order='note_seq')}, b AS (SELECT *, coalesce(sum(length(text)) OVER (
  PARTITION BY conv_id ORDER BY note_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM numbered)
SELECT conv_id, (ahead // 2000)::BIGINT AS part_no, max(note_count) AS note_count,
  string_agg(CASE WHEN note_count > 1 THEN 'DISCHARGE NOTE ' || note_no || chr(10) || text ELSE text END, chr(10) || chr(10)
  ORDER BY note_no) AS combined_text FROM b GROUP BY 1, 2""")
def combine_notes_in_parts(spark, sf):
    return n.combined_notes(numbered(spark, sf), "conv_id", "text", part_chars=2000)


@query("visit_texts_in_parts", f"""WITH {NOTES_SQL.format(order='note_seq')}, whole AS (SELECT conv_id, max(note_count) AS note_count,
  string_agg(CASE WHEN note_count > 1 THEN 'DISCHARGE NOTE ' || note_no || chr(10) || text ELSE text END, chr(10) || chr(10) ORDER BY note_no) AS t
  FROM numbered GROUP BY conv_id)
SELECT conv_id, k AS part_no, note_count, substr(t, k * 700 + 1, 700) AS part_text
FROM whole, LATERAL (SELECT unnest(range(0, (length(t) - 1) // 700 + 1)) AS k)""")
def visit_texts_in_parts(spark, sf):
    """The visits' texts cut every 700 characters, so that most notes go on in another part."""
    return n.visit_text_parts(n.staged_notes(raw_notes(spark, sf), ["conv_id"], "text"), "conv_id", "note_seq", "charttime", "note_id", "text",
                              part_chars=700)


VISITS_SQL = "visits AS (SELECT o_orderkey AS conv_id, o_custkey AS subject_id, o_orderpriority AS kind FROM orders WHERE o_orderkey % 3 <> 0)"


def visits(spark, sf):
    return (table(spark, sf, "orders").where(F.col("o_orderkey") % 3 != 0)
            .select(F.col("o_orderkey").alias("conv_id"), F.col("o_custkey").alias("subject_id"),
                    F.col("o_orderpriority").alias("kind")))


ITEMS_SQL = "items AS (SELECT *, row_number() OVER (ORDER BY conv_id) AS sequence_index FROM visits WHERE conv_id IN (SELECT conv_id FROM notes))"


@query("work_items", f"WITH {NOTES_SQL.format(order='note_seq')}, {VISITS_SQL}, {ITEMS_SQL} SELECT * FROM items")
def work_items(spark, sf):
    return n.work_items(visits(spark, sf), n.staged_notes(raw_notes(spark, sf), ["conv_id"], "text"), "conv_id")


@query("work_items_limited", f"WITH {NOTES_SQL.format(order='note_seq')}, {VISITS_SQL}, {ITEMS_SQL} SELECT * FROM items WHERE sequence_index <= 25")
def work_items_limited(spark, sf):
    return n.work_items(visits(spark, sf), n.staged_notes(raw_notes(spark, sf), ["conv_id"], "text"), "conv_id", limit=25)


@query("visit_records", f"""WITH {NOTES_SQL.format(order='note_seq')}, {VISITS_SQL}, {ITEMS_SQL}
SELECT conv_id, sequence_index, subject_id, kind, note_count, string_agg(note_no || ':' || note_id, ',' ORDER BY note_no) AS note_list
FROM items JOIN numbered USING (conv_id) GROUP BY ALL""")
def visit_records(spark, sf):
    items = work_items(spark, sf)
    records = n.visit_records(items, numbered(spark, sf), "conv_id", ["subject_id", "kind"], ["note_id", "note_type"])
    return records.select("conv_id", "sequence_index", "visit.subject_id", "visit.kind", "note_count", F.array_join(F.transform(
        "notes", lambda x: F.concat_ws(":", x["note_no"].cast("string"), x["note_id"])), ",").alias("note_list"))


@query("requested_visits", f"WITH {VISITS_SQL} SELECT * FROM visits WHERE conv_id % 30 = 1")
def requested_visits(spark, sf):
    rows = visits(spark, sf)
    wanted = table(spark, sf, "orders").where(F.col("o_orderkey") % 30 == 1).select(F.col("o_orderkey").alias("conv_id"))
    return require_qualified(wanted, rows, "conv_id")


# Records: one JSON text per document; the id decides which rule it breaks.
SMALL = {"presentation": {"chest_pain": r.YES_NO, "evidence": r.TEXT}, "context": {"modality": ("list", ["CTA", "TEE"])}}
SHAPES = {
    0: '{"presentation":{"chest_pain":"yes","evidence":"@"},"context":{"modality":["CTA","TEE"]}}',
    1: '{"presentation":{"chest_pain":"no","evidence":"@"},"context":{"modality":[]}}',
    2: '{"presentation":{"chest_pain":"no"},"context":{"modality":[]}}',
    3: '{"presentation":{"chest_pain":"no","evidence":"@"},"context":{"modality":[]},"more":1}',
    4: '{"presentation":{"chest_pain":"maybe","evidence":"@"},"context":{"modality":[]}}',
    5: '{"presentation":{"chest_pain":"no",',
    6: '{"presentation":{"chest_pain":"no","evidence":5},"context":{"modality":[]}}',
    7: '{"presentation":{"chest_pain":"no","evidence":"@"},"context":{"modality":["CTA","XR"]}}',
    8: '{"presentation":"@","context":{"modality":[]}}',
    9: '[1, 2]',
}
ERRORS = {2: "$.presentation: missing: evidence", 3: "$: unexpected: more", 4: "$.presentation.chest_pain: value not allowed",
          5: "$: not JSON", 6: "$.presentation.evidence: wrong type", 7: "$.context.modality: value not allowed",
          8: "$.presentation: not an object", 9: "$: not an object"}
RECORD_SQL = "rec AS (SELECT doc_id, source, CASE doc_id % 10 " + " ".join(
    f"WHEN {k} THEN replace('{v}', '@', source)" for k, v in SHAPES.items()) + " END AS body FROM documents)"


def record_texts(spark, sf):
    body = None
    for k, v in SHAPES.items():
        text = F.replace(F.lit(v), F.lit("@"), F.col("source"))
        body = F.when(F.col("doc_id") % 10 == k, text) if body is None else body.when(F.col("doc_id") % 10 == k, text)
    return table(spark, sf, "documents").select("doc_id", "source", body.alias("body"))


@query("json_validate_split", "SELECT doc_id, CASE doc_id % 10 " + " ".join(
    f"WHEN {k} THEN '{v}'" for k, v in ERRORS.items()) + " END AS error FROM documents")
def json_validate_split(spark, sf):
    good, bad = r.split_valid(record_texts(spark, sf), "body", SMALL)
    return good.select("doc_id", F.lit(None).cast("string").alias("error")).union(bad.select("doc_id", "error"))


@query("json_flatten", """SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'yes' ELSE 'no' END AS presentation__chest_pain,
  source AS presentation__evidence, CASE doc_id % 10 WHEN 0 THEN 'CTA|TEE' ELSE '' END AS context__modality FROM documents
WHERE doc_id % 10 IN (0, 1)""")
def json_flatten(spark, sf):
    good, _ = r.split_valid(record_texts(spark, sf), "body", SMALL)
    return r.flatten_records(good, "body", SMALL, ["doc_id"])


@query("json_to_struct", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_to_struct(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("sorted_json", """SELECT p_partkey, '{"p_brand":"' || p_brand || '","p_size":' || p_size || '}' AS params FROM part""")
def sorted_json(spark, sf):
    return table(spark, sf, "part").select("p_partkey", r.json_text("p_size", "p_brand").alias("params"))


def responses(spark, sf):
    inner = F.replace(F.replace(F.col("body"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    usage = F.concat(F.lit('"usage":{"input_tokens":'), F.col("doc_id"),
                     F.lit(',"input_tokens_details":{"cached_tokens":3},"output_tokens":7,"total_tokens":'), F.col("doc_id") + 7, F.lit("}}"))
    split = F.concat(F.lit('{"output":[{"content":[{"text":"'), inner, F.lit('"}]},{"kind":"none"}],'), usage)
    given = F.concat(F.lit('{"output_text":"'), inner, F.lit('",'), usage)
    return record_texts(spark, sf).select("doc_id", F.when(F.col("doc_id") % 2 == 0, split).otherwise(given).alias("raw"))


@query("response_extract", f"""WITH {RECORD_SQL} SELECT doc_id, body AS answer, doc_id AS usage_input_tokens, 3::BIGINT AS usage_cached_tokens,
  7::BIGINT AS usage_output_tokens, NULL::BIGINT AS usage_reasoning_tokens, doc_id + 7 AS usage_total_tokens FROM rec""")
def response_extract(spark, sf):
    opened = responses(spark, sf).withColumn("response", F.from_json("raw", r.RESPONSE_TYPE))
    return opened.select("doc_id", r.response_text("response").alias("answer"), *r.usage_columns("response.usage"))


@query("response_texts_joined", """SELECT event_id, 'a' || event_id || chr(10) || 'b' || chr(10) || 'c' AS answer FROM events""")
def response_texts_joined(spark, sf):
    raw = F.concat(F.lit('{"output":[{"content":[{"text":"a'), F.col("event_id"),
                   F.lit('"},{"text":"b"},{"kind":"x"}]},{"content":[{"text":"c"}]}]}'))
    opened = table(spark, sf, "events").select("event_id", F.from_json(raw, r.RESPONSE_TYPE).alias("response"))
    return opened.select("event_id", r.response_text("response").alias("answer"))


INGEST_SQL = """SELECT doc_id, doc_id AS usage_input_tokens, 3::BIGINT AS usage_cached_tokens, 7::BIGINT AS usage_output_tokens,
  NULL::BIGINT AS usage_reasoning_tokens, doc_id + 7 AS usage_total_tokens, CASE doc_id % 10 WHEN 0 THEN 'yes' ELSE 'no' END
  AS presentation__chest_pain, source AS presentation__evidence, CASE doc_id % 10 WHEN 0 THEN 'CTA|TEE' ELSE '' END
  AS context__modality FROM documents WHERE doc_id % 10 IN (0, 1)"""


@query("ingest_results", INGEST_SQL)
def ingest_results(spark, sf):
    return n.ingest_responses(responses(spark, sf), "raw", ["doc_id"], SMALL)[0]


@query("ingest_errors", "SELECT doc_id, CASE doc_id % 10 " + " ".join(
    f"WHEN {k} THEN '{v}'" for k, v in ERRORS.items()) + " END AS error FROM documents WHERE doc_id % 10 > 1")
def ingest_errors(spark, sf):
    return n.ingest_responses(responses(spark, sf), "raw", ["doc_id"], SMALL)[1]


@query("result_column_order", """SELECT doc_id::VARCHAR AS doc_id, '' AS sequence_index, coalesce(nullif(lang, 'en'), '') AS lang
FROM documents""")
def result_column_order(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.nullif("lang", F.lit("en")).alias("lang"))
    return r.in_column_order(docs, ["sequence_index", "doc_id", "lang"])


@query("lenient_types", """SELECT event_id, TRY_CAST(CASE WHEN event_type = 'click' THEN 'n/a' ELSE value::VARCHAR END AS DOUBLE) AS number,
  TRY_CAST(CASE WHEN event_type = 'view' THEN 'never' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS seen FROM events""")
def lenient_types(spark, sf):
    from ..functions.times import lenient_timestamp
    rows = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "click", "n/a").otherwise(F.col("value").cast("string")).alias("number"),
        F.when(F.col("event_type") == "view", "never").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("seen"))
    return rows.select("event_id", F.col("number").try_cast("double").alias("number"), lenient_timestamp("seen").alias("seen"))
