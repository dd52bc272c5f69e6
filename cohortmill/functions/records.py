"""Label records as JSON: schema, strict checks, flattening, usage counters, response text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A schema maps each section to its leaves; a leaf is TEXT, a list of allowed values, or ("list", values).
TEXT = "text"
YES_NO = ["yes", "no", "unclear"]

# Sections, leaves and allowed values of a reviewed discharge record.
LABEL_SCHEMA = {
    "chief_complaint_or_presenting_symptoms": {"summary": TEXT, "evidence": TEXT},
    "presentation_phenotype": {
        "chest_pain": YES_NO, "back_pain": YES_NO, "abdominal_pain": YES_NO, "pain_radiating_to_back": YES_NO,
        "migratory_pain": YES_NO, "transfer_from_outside_hospital": YES_NO, "evidence": TEXT},
    "aortic_syndrome_status": {
        "confirmed_acute_aortic_dissection": YES_NO, "known_dissection_only": YES_NO,
        "chronic_typeb_dissection": YES_NO, "intramural_hematoma": YES_NO,
        "penetrating_atherosclerotic_ulcer": YES_NO, "aneurysm_without_dissection": YES_NO,
        "rupture_or_contained_rupture": YES_NO, "dissection_explicitly_ruled_out": YES_NO, "evidence": TEXT},
    "diagnosis_context": {
        "diagnosed_before_arrival_at_outside_hospital": YES_NO, "incidental_finding": YES_NO,
        "suspected_because_of_symptoms": YES_NO,
        "diagnostic_modality": ("list", ["CTA", "CT chest/abdomen/pelvis", "TEE", "MRI/MRA", "operative finding",
                                         "outside-hospital imaging", "other", "unclear"]),
        "how_diagnosis_was_made": TEXT, "evidence": TEXT},
    "anatomic_detail": {
        "stanford_type": ["A", "B", "none", "unclear"], "debakey_type": ["I", "II", "III", "none", "unclear"],
        "ascending_aorta": YES_NO, "arch": YES_NO, "descending_thoracic": YES_NO, "abdominal": YES_NO,
        "iliac_extension": YES_NO, "complicated_type_b_malperfusion": YES_NO, "complicated_type_b_rupture": YES_NO,
        "complicated_type_b_refractory_pain": YES_NO, "complicated_type_b_uncontrolled_hypertension": YES_NO,
        "evidence": TEXT},
    "treatment": {
        "open_surgical_repair": YES_NO, "tevar_or_endovascular_repair": YES_NO, "medical_management_only": YES_NO,
        "prior_repair_or_stent_graft_only_no_new_repair": YES_NO, "repaired_this_admission": YES_NO, "evidence": TEXT},
    "control_usefulness": {
        "primary_discharge_diagnosis_or_alternative_explanation": TEXT,
        "plausible_aortic_dissection_mimic_presentation": YES_NO, "evidence": TEXT},
    "overall": {
        "target_cleanup_label": ["newly_identified_dissection", "previously_known_dissection_only",
                                 "aortic_syndrome_not_dissection", "aneurysm_without_dissection",
                                 "dissection_ruled_out", "no_aortic_syndrome_evidence", "unclear"],
        "brief_summary": TEXT},
}

# The columns before the label leaves, in output order.
RESULT_BASE_COLUMNS = [
    "sequence_index", "subject_id", "hadm_id", "note_count", "note_ids", "note_types", "note_seqs", "note_charttimes",
    "index_time", "index_time_source", "feature_window_end", "first_ecg_time_24h", "ecg_count_24h", "admission_type",
    "admission_location", "usage_input_tokens", "usage_cached_tokens", "usage_output_tokens", "usage_reasoning_tokens",
    "usage_total_tokens",
]
ERROR_COLUMNS = ["sequence_index", "subject_id", "hadm_id", "note_count", "note_ids", "error"]
RESPONSE_TYPE = ("output_text string, output array<struct<content array<struct<text string>>>>, "
                 "usage struct<input_tokens bigint, input_tokens_details struct<cached_tokens bigint>, "
                 "output_tokens bigint, output_tokens_details struct<reasoning_tokens bigint>, total_tokens bigint>")


def _is_list(kind) -> bool:
    return isinstance(kind, tuple)


def struct_type(schema: Mapping) -> T.StructType:
    leaf = lambda kind: T.ArrayType(T.StringType()) if _is_list(kind) else T.StringType()
    return T.StructType([
        T.StructField(section, T.StructType([T.StructField(name, leaf(kind)) for name, kind in leaves.items()]))
        for section, leaves in schema.items()])


def leaf_columns(schema: Mapping) -> list[str]:
    return [f"{section}__{name}" for section, leaves in schema.items() for name in leaves]


def result_columns(schema: Mapping = LABEL_SCHEMA) -> list[str]:
    return RESULT_BASE_COLUMNS + leaf_columns(schema)


def _key_errors(found: Column, wanted: Sequence[str], path: str) -> list[Column]:
    names = F.array(*[F.lit(n) for n in wanted])
    missing, extra = F.array_except(names, found), F.array_except(found, names)
    problem = lambda keys, what: F.when(F.size(keys) > 0, F.struct(
        F.lit(path).alias("path"), F.concat(F.lit(what), F.array_join(F.array_sort(keys), ", ")).alias("message")))
    return [problem(missing, "missing: "), problem(extra, "unexpected: ")]


def record_errors(text: str, parsed: str, schema: Mapping) -> Column:
    """All schema violations of a JSON text as an array of (path, message): not JSON, missing or unexpected
    keys, wrong types, values outside their list. Empty for a good record. `parsed` is the text as variant."""
    body = F.col(parsed)
    kind_of = lambda value: F.schema_of_variant(value)
    at = lambda path: F.try_variant_get(body, path, "variant")
    problem = lambda when, path, message: F.when(when, F.struct(F.lit(path).alias("path"), F.lit(message).alias("message")))
    # A variant opens as a map of variants, so keys are found without parsing the text again.
    keys_of = lambda value: F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    is_object = kind_of(body).startswith("OBJECT")
    checks = _key_errors(keys_of(body), list(schema), "$")
    for section, leaves in schema.items():
        path = f"$.{section}"
        present = at(path).isNotNull()
        section_object = kind_of(at(path)).startswith("OBJECT")
        checks.append(problem(present & ~section_object, path, "not an object"))
        checks += _key_errors(F.when(section_object, keys_of(at(path))), list(leaves), path)
        for name, kind in leaves.items():
            leaf = f"{path}.{name}"
            found, got = at(leaf).isNotNull(), kind_of(at(leaf))
            if _is_list(kind):
                right = got.isin("ARRAY<STRING>", "ARRAY<VOID>")
                values = F.try_variant_get(body, leaf, "array<string>")
                outside = F.size(F.array_except(values, F.array(*[F.lit(v) for v in kind[1]]))) > 0
            else:
                right = got == "STRING"
                values = F.try_variant_get(body, leaf, "string")
                outside = ~values.isin(kind) if kind != TEXT else F.lit(False)
            checks.append(problem(found & ~right, leaf, "wrong type"))
            checks.append(problem(found & right & outside, leaf, "value not allowed"))
    none = F.array().cast("array<struct<path:string,message:string>>")
    one = lambda message: F.array(F.struct(F.lit("$").alias("path"), F.lit(message).alias("message")))
    return (F.when(F.col(text).isNull() | body.isNull(), one("not JSON"))
            .when(~is_object, one("not an object"))
            .otherwise(F.coalesce(F.filter(F.array(*checks), lambda c: c.isNotNull()), none)))


def split_valid(df: DataFrame, text: str, schema: Mapping) -> tuple[DataFrame, DataFrame]:
    """(good rows, rows with `error`: every violation as `path: message`, joined by `; `)."""
    parsed = df.withColumn("_parsed", F.try_parse_json(F.col(text)))
    errors = parsed.withColumn("_found", record_errors(text, "_parsed", schema)).drop("_parsed")
    # A filter on the errors would be pushed below the parsing and repeat it for every check. Passing the
    # list through a one-element generator keeps the filter above, so a text is parsed and checked once.
    checked = errors.withColumn("_errors", F.explode(F.array("_found"))).drop("_found")
    good = checked.where(F.size("_errors") == 0).drop("_errors")
    bad = checked.where(F.size("_errors") > 0).withColumn("error", F.array_join(
        F.transform("_errors", lambda e: F.concat_ws(": ", e["path"], e["message"])), "; ")).drop("_errors")
    return good, bad


def flat_columns(record: str, schema: Mapping) -> list[Column]:
    """`section__leaf` columns of a parsed record; lists joined by `|`, null as empty text."""
    out = []
    for section, leaves in schema.items():
        for name, kind in leaves.items():
            value = F.col(f"{record}.{section}.{name}")
            out.append((F.coalesce(F.array_join(value, "|"), F.lit("")) if _is_list(kind)
                        else F.coalesce(value, F.lit(""))).alias(f"{section}__{name}"))
    return out


def flatten_records(df: DataFrame, text: str, schema: Mapping, keep: Sequence[str]) -> DataFrame:
    parsed = df.withColumn("_record", F.from_json(text, struct_type(schema)))
    return parsed.select(*keep, *flat_columns("_record", schema))


def usage_columns(usage: str) -> list[Column]:
    """Flat token counters of a nested usage struct."""
    return [F.col(f"{usage}.{path}").alias(f"usage_{name}_tokens") for name, path in (
        ("input", "input_tokens"), ("cached", "input_tokens_details.cached_tokens"), ("output", "output_tokens"),
        ("reasoning", "output_tokens_details.reasoning_tokens"), ("total", "total_tokens"))]


def response_text(response: str) -> Column:
    """`output_text` if present, else all content texts of all outputs, one per line."""
    outputs = F.col(f"{response}.output")
    parts = F.flatten(F.transform(outputs, lambda o: F.coalesce(
        F.transform(o["content"], lambda c: c["text"]), F.array().cast("array<string>"))))
    joined = F.array_join(F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda t: t.isNotNull()), "\n")
    given = F.col(f"{response}.output_text")
    return F.when(given != "", given).otherwise(joined)


def json_text(*columns: str) -> Column:
    """Columns as one JSON object with sorted keys."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def in_column_order(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly the given columns as text, in order; absent ones and nulls as empty text."""
    have = set(df.columns)
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c)
                       for c in columns])
