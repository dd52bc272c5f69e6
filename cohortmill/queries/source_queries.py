"""Every source shape as a query: dirty text written as CSV from the driver tables, read by its reader, held against the casts in SQL.

The written folders have an unused column in front and values that do not fit their type; rows that lack a required value go.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers
from .common import query, table
from .jobs import workspace

_SQL_TYPES = {"long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP", "string": "VARCHAR"}
_TABLES = ("customer", "orders", "lineitem", "events", "documents", "part")


def written(spark, sf, raw: str, **options) -> str:
    """The rows of `raw`, in which {name} stands for a driver table, as a CSV folder."""
    for t in _TABLES:
        table(spark, sf, t).createOrReplaceTempView(f"raw_{t}")
    rows = spark.sql(raw.format(**{t: f"raw_{t}" for t in _TABLES}))
    path = f"{workspace(spark)}/source_csv"
    rows.select(F.lit("unused").alias("first_column"), *rows.columns).write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **options).csv(path)
    return path


def cast_sql(raw: str, columns: dict[str, str], required=(), where: str = "true", shown: dict[str, str] = {}) -> str:
    """What a lenient reader gives: values that fit their type, rows that have the required ones."""
    def value(name, kind):
        cast = f"TRY_CAST(nullif({name}, '') AS {_SQL_TYPES[kind]})"
        return f"CASE WHEN NOT isnan({cast}) THEN {cast} END" if kind == "double" else cast
    inner = ", ".join(f"{value(n, k)} AS {n}" for n, k in columns.items())
    names = ", ".join(f"{shown[n]} AS {n}" if n in shown else n for n in columns)
    needs = " AND ".join([*(f"{n} IS NOT NULL" for n in required), where])
    return f"SELECT {names} FROM (SELECT {inner} FROM ({raw.format(**{t: t for t in _TABLES})})) WHERE {needs}"


def shape(name: str, raw: str, columns: dict[str, str], read, required=(), where: str = "true", digest: str | None = None):
    """Register the query `source_<name>`; a long text column is given by its md5."""
    shown = {digest: f"md5({digest})"} if digest else {}

    @query(f"source_{name}", cast_sql(raw, columns, required, where, shown))
    def run(spark, sf):
        out = read(spark, written(spark, sf, raw))
        return out.withColumn(digest, F.md5(digest)) if digest else out
    return run


def text_id(column: str, every: int, prefix: str) -> str:
    """A number as text, for one row in `every` a key that is none."""
    return f"CASE WHEN {column} % {every} = 0 THEN '{prefix}_' || {column} ELSE CAST({column} AS STRING) END"


_TIME = "CASE WHEN {key} % 13 = 0 THEN 'unknown' ELSE substr(CAST({ts} AS STRING), 1, 19) END"
_NUMBER = "CASE WHEN {key} % 17 = 0 THEN '>50' WHEN {key} % 19 = 0 THEN 'NaN' WHEN {key} % 23 = 0 THEN NULL ELSE CAST({value} AS STRING) END"

shape("patients", f"SELECT {text_id('c_custkey', 50, 'x')} AS subject_id, CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE CAST(20 + c_custkey % 60 AS STRING) END AS anchor_age, "
      "CAST(2000 + c_custkey % 20 AS STRING) AS anchor_year, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 'F' ELSE 'M' END AS gender FROM {customer}",
      readers.PATIENTS, readers.patients)
shape("admissions", f"SELECT {text_id('o_custkey', 40, 'ED')} AS subject_id, {text_id('o_orderkey', 31, 'SA')} AS hadm_id, {_TIME.format(key='o_custkey', ts='o_orderdate')} AS admittime, "
      f"{_TIME.format(key='o_orderkey', ts='o_orderdate')} AS edregtime, o_orderpriority AS admission_type, o_orderstatus AS admission_location, CASE WHEN o_custkey % 5 = 0 THEN NULL "
      "ELSE 'GROUP, \"' || o_orderstatus || '\"' END AS race, 'Plan' AS insurance, CAST(NULL AS STRING) AS marital_status FROM {orders}",
      readers.ADMISSIONS, readers.admissions, ("subject_id", "hadm_id"))
shape("diagnoses", f"SELECT CAST(l_suppkey AS STRING) AS subject_id, {text_id('l_orderkey', 29, 'A')} AS hadm_id, CASE WHEN l_partkey % 37 = 0 THEN NULL ELSE 'I' || l_partkey % 100 || '.0' END AS icd_code, "
      "CASE WHEN l_linenumber = 7 THEN 'ten' ELSE CAST(9 + l_linenumber % 2 AS STRING) END AS icd_version FROM {lineitem}",
      readers.DIAGNOSES, readers.diagnoses, ("hadm_id", "icd_code", "icd_version"))
_EVENT_ITEMS = [50800, 50802, 50803]
shape("events", f"SELECT {text_id('user_id', 41, 'u')} AS subject_id, {_TIME.format(key='event_id', ts='ts')} AS charttime, CAST(50800 + event_id % 5 AS STRING) AS itemid, "
      f"{_NUMBER.format(key='event_id', value='value')} AS valuenum FROM {{events}}",
      readers.EVENTS, lambda spark, path: readers.events(spark, path, _EVENT_ITEMS), ("subject_id", "charttime", "itemid", "valuenum"), "itemid IN (50800, 50802, 50803)")
shape("ecg", f"SELECT {text_id('l_suppkey', 40, 's')} AS subject_id, {_TIME.format(key='l_orderkey', ts='l_shipdate')} AS ecg_time, "
      + ", ".join(f"{_NUMBER.format(key=f'(l_partkey + {i})', value=f'(l_quantity + {i})')} AS {c}" for i, c in enumerate(readers.ECG_COLUMNS)) + " FROM {lineitem}",
      readers.ECG, readers.ecg_measurements, ("subject_id", "ecg_time"))
shape("prescriptions", f"SELECT {text_id('l_suppkey', 40, 's')} AS subject_id, {text_id('l_orderkey', 31, 'SA')} AS hadm_id, {_TIME.format(key='l_partkey', ts='l_shipdate')} AS starttime, "
      "'Drug ' || l_partkey % 50 || ', 5 mg' AS drug, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE 'CODE' || l_partkey % 50 END AS formulary_drug_cd, l_returnflag AS route FROM {lineitem}",
      readers.PRESCRIPTIONS, readers.prescriptions, ("subject_id", "hadm_id", "starttime"))
# Carriage returns become line feeds in a CSV field, so the text has none; quotes, commas and line feeds come back as they are.
shape("radiology_notes", "SELECT 'n' || doc_id AS note_id, " + text_id("doc_id", 30, "p") + " AS subject_id, CAST(doc_id + 7 AS STRING) AS hadm_id, CASE WHEN doc_id % 13 = 0 THEN 'later' ELSE "
      "'2150-01-' || (10 + doc_id % 20) || ' 08:30:00' END AS charttime, 'Report \"A\", first' || replace(text, chr(13), ' ') || '.' AS text FROM {documents}",
      readers.RADIOLOGY, readers.radiology_notes, ("subject_id", "hadm_id", "charttime"), digest="text")
shape("radiology_detail", "SELECT 'n' || user_id AS note_id, event_type AS field_name, props AS field_value FROM {events}", readers.RADIOLOGY_DETAIL, readers.radiology_detail)
shape("transfers", f"SELECT {text_id('user_id', 41, 'u')} AS subject_id, CASE WHEN event_type = 'signup' THEN NULL ELSE {text_id('event_id', 31, 'SA')} END AS hadm_id, "
      f"CASE WHEN value > 30 THEN 'Emergency \"ED\"' ELSE 'Ward' END AS careunit, {_TIME.format(key='event_id', ts='ts')} AS intime FROM {{events}}",
      readers.TRANSFERS, readers.transfers, ("subject_id", "intime"))
shape("lab_labels", f"SELECT {text_id('p_partkey', 37, 'i')} AS itemid, p_name AS label, 'Blood' AS fluid, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_type END AS category FROM {{part}}",
      readers.LAB_LABELS, readers.lab_labels, ("itemid",))
shape("code_titles", "SELECT 'I' || p_partkey AS icd_code, CASE WHEN p_size % 9 = 0 THEN 'nine' ELSE CAST(9 + p_size % 2 AS STRING) END AS icd_version, p_name || ', \"other\"' AS long_title FROM {part}",
      readers.CODE_TITLES, readers.code_titles)
shape("cohort_list", f"SELECT {text_id('o_custkey', 40, 'ED')} AS subject_id, {text_id('o_orderkey', 31, 'SA')} AS hadm_id FROM {{orders}}", readers.COHORT_LIST, readers.cohort_list, ("subject_id", "hadm_id"))
shape("case_visits", f"SELECT {text_id('o_custkey', 40, 'ED')} AS subject_id, {text_id('o_orderkey', 31, 'SA')} AS hadm_id, {_TIME.format(key='o_orderkey', ts='o_orderdate')} AS encounter_time, "
      "'441.0' || o_custkey % 4 AS diagnosis, o_orderstatus AS admission_location, o_orderpriority AS encounter_urgency FROM {orders}", readers.CASE_VISITS, readers.case_visits)
_LABEL_COLUMNS = {"sequence_index": "long", "subject_id": "long", "hadm_id": "long", "note_count": "long", "usage_input_tokens": "long", "status": "string", "findings__type": "string"}
shape("parsed_labels", f"SELECT CAST(doc_id AS STRING) AS sequence_index, {text_id('doc_id', 30, 'p')} AS subject_id, CAST(doc_id * 3 AS STRING) AS hadm_id, CAST(1 + doc_id % 4 AS STRING) AS note_count, "
      "CASE WHEN doc_id % 11 = 0 THEN 'none' ELSE CAST(n_chars AS STRING) END AS usage_input_tokens, 'ok' AS status, CASE WHEN doc_id % 3 = 0 THEN 'A|B' ELSE lang END AS findings__type FROM {documents}",
      _LABEL_COLUMNS, lambda spark, path: readers.parsed_labels(spark, path, list(_LABEL_COLUMNS)))


_DISCHARGE_RAW = ("SELECT 'd' || doc_id AS note_id, " + text_id("doc_id", 30, "p") + " AS subject_id, CAST(doc_id % 40 AS STRING) AS hadm_id, 'DS' AS note_type, CAST(doc_id % 12 AS STRING) AS note_seq, "
                  "'2150-01-02 08:30:00' AS charttime, CASE WHEN doc_id % 9 = 0 THEN '  ' WHEN doc_id % 10 = 0 THEN NULL ELSE '  Summary \"B\": ' || replace(text, chr(13), ' ') || ' end ' END AS text FROM {documents}")


@query("source_discharge_notes", f"""SELECT note_id, subject_id, hadm_id, note_type, note_seq, charttime, md5(trim(text)) AS text
FROM (SELECT * REPLACE (TRY_CAST(subject_id AS BIGINT) AS subject_id, TRY_CAST(hadm_id AS BIGINT) AS hadm_id) FROM ({_DISCHARGE_RAW.format(documents='documents')}))
WHERE subject_id IS NOT NULL AND hadm_id IS NOT NULL AND trim(text) <> ''""")
def source_discharge_notes(spark, sf):
    """Notes with numeric ids and text that is not blank, trimmed."""
    return readers.discharge_notes(spark, written(spark, sf, _DISCHARGE_RAW)).withColumn("text", F.md5("text"))


@query("report_tables", """SELECT 'text_model' AS label, 'r1' AS run_id, 'sizes' AS report, o_orderpriority AS name, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_orderpriority
UNION ALL SELECT 'text_model', 'r1', 'statuses', o_orderstatus, count(*), round(avg(o_totalprice), 4) FROM orders GROUP BY o_orderstatus""")
def report_tables(spark, sf):
    """Two report tables of a run written as CSV folders and read back."""
    from ..sources.materialize import write_reports
    count = lambda c: table(spark, sf, "orders").groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    paths = write_reports({"sizes": count("o_orderpriority"), "statuses": count("o_orderstatus")}, workspace(spark), "r1", "text_model")
    out = None
    for name, path in paths.items():
        rows = readers.read_table(spark, path, {"model_label": "string", "run_id": "string", "name": "string", "n": "long", "mean": "double"})
        rows = rows.select(F.col("model_label").alias("label"), "run_id", F.lit(name).alias("report"), "name", "n", "mean")
        out = rows if out is None else out.union(rows)
    return out
