"""Sources with declared columns. A value that does not fit its type becomes null."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns that the jobs use, with their types.
PATIENTS = {"subject_id": "long", "anchor_age": "int", "anchor_year": "int", "gender": "string"}
ADMISSIONS = {"subject_id": "long", "hadm_id": "long", "admittime": "timestamp_ntz", "edregtime": "timestamp_ntz",
              "admission_type": "string", "admission_location": "string", "race": "string", "insurance": "string",
              "marital_status": "string"}
DIAGNOSES = {"subject_id": "long", "hadm_id": "long", "icd_code": "string", "icd_version": "int"}
EVENTS = {"subject_id": "long", "charttime": "timestamp_ntz", "itemid": "long", "valuenum": "double"}
ECG_COLUMNS = ["rr_interval", "p_onset", "p_end", "qrs_onset", "qrs_end", "t_end", "p_axis", "qrs_axis", "t_axis"]
ECG = {"subject_id": "long", "ecg_time": "timestamp_ntz", **{c: "double" for c in ECG_COLUMNS}}
PRESCRIPTIONS = {"subject_id": "long", "hadm_id": "long", "starttime": "timestamp_ntz", "drug": "string",
                 "formulary_drug_cd": "string", "route": "string"}
RADIOLOGY = {"note_id": "string", "subject_id": "long", "hadm_id": "long", "charttime": "timestamp_ntz", "text": "string"}
RADIOLOGY_DETAIL = {"note_id": "string", "field_name": "string", "field_value": "string"}
DISCHARGE = {"note_id": "string", "subject_id": "long", "hadm_id": "long", "note_type": "string", "note_seq": "string",
             "charttime": "string", "text": "string"}
TRANSFERS = {"subject_id": "long", "hadm_id": "long", "careunit": "string", "intime": "timestamp_ntz"}
LAB_LABELS = {"itemid": "long", "label": "string", "fluid": "string", "category": "string"}
CODE_TITLES = {"icd_code": "string", "icd_version": "int", "long_title": "string"}
COHORT_LIST = {"subject_id": "long", "hadm_id": "long"}
CASE_VISITS = {"subject_id": "long", "hadm_id": "long", "encounter_time": "timestamp_ntz", "diagnosis": "string",
               "admission_location": "string", "encounter_urgency": "string"}

# Item ids of the vital signs and laboratory tests and their feature names.
VITALS = {220045: "heart_rate", 220050: "abp_sys", 220051: "abp_dias", 220179: "nibp_sys", 220180: "nibp_dias",
          220210: "resp_rate", 220277: "spo2", 223761: "temp_f"}
LABS = {50915: "ddimer", 51003: "troponin_t", 51002: "troponin_i", 50889: "crp", 51214: "fibrinogen", 51237: "inr",
        50912: "creatinine", 50983: "sodium", 50971: "potassium", 50931: "glucose", 51006: "bun", 50902: "chloride",
        50882: "bicarbonate", 50868: "anion_gap", 50960: "magnesium", 50893: "calcium_total", 50970: "phosphate",
        51222: "hemoglobin", 51221: "hematocrit", 51265: "platelets", 51301: "wbc", 50820: "ph", 50813: "lactate",
        50861: "alt", 50878: "ast"}


def read_table(spark: SparkSession, path: str, columns: Mapping[str, str], fmt: str = "csv",
               required: tuple[str, ...] = (), long_text: bool = False) -> DataFrame:
    """The named columns of a CSV, JSON or Parquet table, cast leniently; rows without a required one are dropped.

    CSV columns are found by header name. Spark parses (or, for Parquet, reads) only the selected columns and
    splits large files by `spark.sql.files.maxPartitionBytes`; `long_text` allows line breaks inside a field,
    at the price of one task per file.
    """
    if fmt == "csv":
        options = {"header": True, "escape": '"', "multiLine": long_text}
        raw = spark.read.options(**options).csv(path)
    elif fmt == "json":
        raw = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).json(path)
    else:
        raw = spark.read.format(fmt).load(path)
    absent = [c for c in columns if c not in raw.columns]
    if absent:
        raise ValueError(f"{path} lacks the columns {absent}")
    have = dict(raw.dtypes)
    typed = raw.select(*[F.col(c) if have[c] == t else F.col(c).try_cast(t).alias(c) for c, t in columns.items()])
    floats = [c for c, t in columns.items() if t == "double"]
    typed = typed.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else typed
    return typed.dropna(subset=list(required)) if required else typed


def patients(spark, path, fmt="csv"):
    return read_table(spark, path, PATIENTS, fmt)


def admissions(spark, path, fmt="csv"):
    return read_table(spark, path, ADMISSIONS, fmt, ("subject_id", "hadm_id"))


def diagnoses(spark, path, fmt="csv"):
    return read_table(spark, path, DIAGNOSES, fmt, ("hadm_id", "icd_code", "icd_version"))


def events(spark, path, items=None, fmt="csv"):
    """Long events; an item list is applied as a filter that reaches a Parquet scan."""
    rows = read_table(spark, path, EVENTS, fmt, ("subject_id", "charttime", "itemid", "valuenum"))
    return rows.where(F.col("itemid").isin(list(items))) if items is not None else rows


def ecg_measurements(spark, path, fmt="csv"):
    return read_table(spark, path, ECG, fmt, ("subject_id", "ecg_time"))


def prescriptions(spark, path, fmt="csv"):
    return read_table(spark, path, PRESCRIPTIONS, fmt, ("subject_id", "hadm_id", "starttime"))


def radiology_notes(spark, path, fmt="csv"):
    return read_table(spark, path, RADIOLOGY, fmt, ("subject_id", "hadm_id", "charttime"), long_text=True)


def radiology_detail(spark, path, fmt="csv"):
    return read_table(spark, path, RADIOLOGY_DETAIL, fmt)


def discharge_notes(spark, path, fmt="csv"):
    from ..plans.notes import staged_notes
    return staged_notes(read_table(spark, path, DISCHARGE, fmt, long_text=True), ["subject_id", "hadm_id"], "text")


def transfers(spark, path, fmt="csv"):
    return read_table(spark, path, TRANSFERS, fmt, ("subject_id", "intime"))


def lab_labels(spark, path, fmt="csv"):
    return read_table(spark, path, LAB_LABELS, fmt, ("itemid",))


def code_titles(spark, path, fmt="csv"):
    return read_table(spark, path, CODE_TITLES, fmt)


def cohort_list(spark, path, fmt="csv"):
    return read_table(spark, path, COHORT_LIST, fmt, ("subject_id", "hadm_id"))


def case_visits(spark, path, fmt="csv"):
    return read_table(spark, path, CASE_VISITS, fmt)


def parsed_labels(spark, path, columns, fmt="csv"):
    """Flat label results: ids and counters as numbers, the rest as text."""
    numbers = {"sequence_index", "subject_id", "hadm_id", "note_count", "ecg_count_24h"}
    kinds = {c: "long" if c in numbers or c.startswith("usage_") else "string" for c in columns}
    return read_table(spark, path, kinds, fmt)


def nonblank_lines(spark, path) -> DataFrame:
    """One row: lines of a text file that are not blank (the error records of a run)."""
    return spark.read.text(path).agg(F.count_if(F.trim("value") != "").alias("n"))
