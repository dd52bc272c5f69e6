"""Text rules, notes and JSON records."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from cohortmill.functions import records as r
from cohortmill.functions import text as t
from cohortmill.plans import notes as n


def values(spark, column, *texts):
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    return [row[0] for row in df.select(column).collect()]


def test_positive_and_negated_phrases(spark):
    got = values(spark, t.positive_not_negated(F.col("x")), "Type  A dissection.", "AORTIC DISSECTION seen",
                 "aortic dissection. No evidence of aortic dissection elsewhere", "aneurysm", "aorta\ndissection")
    assert got == [True, True, False, False, False]


def test_result_section(spark):
    got = values(spark, t.result_section(F.col("x")), "HISTORY: a\nfindings : b\nIMPRESSION: c", "none", None, "see FINDINGS: x",
                 "IMPRESSION: first\nFINDINGS: second")
    assert got == ["findings : b\nIMPRESSION: c", "", "", "", "IMPRESSION: first\nFINDINGS: second"]


def test_exam_rule(spark):
    got = values(spark, t.diagnostic_exam(F.col("x")), "cta chest", "CT HEAD | CTA CHEST", "CHEST (PORTABLE AP)", "MRI", None)
    assert got == [True, False, False, False, False]


def test_drug_groups_match_whole_words(spark):
    flags = t.group_flags(F.col("x"), t.DRUG_GROUPS)
    assert set(flags) == set(t.DRUG_GROUPS)
    assert values(spark, flags["vasopressor"], "Norepinephrine IV", "epinephrines", "EPINEPHRINE") == [True, False, True]


def test_labels(spark):
    assert values(spark, t.keyword_category(F.col("x")), "Chest PAIN", "back pain", None, "fever and COPD") == [
        "Cardiac/arrhythmia", "Musculoskeletal/pain", "Other/unclear", "Pneumonia/respiratory"]
    assert values(spark, t.clean_label(F.col("x"), 2), "a_b  c", " a_b ", None) == ["a b...", "a b", "missing"]
    assert values(spark, t.mapped_label(F.col("x")), "unclear", "new_kind", None) == ["Unclear", "new kind", "missing"]
    assert values(spark, t.without_suffix(F.col("x")), "hr_first", "first_x") == ["hr", "first_x"]


NOTE = "visit long, id string, seq string, ts timestamp_ntz, kind string, text string"
T0 = dt.datetime(2024, 1, 1)


def note(visit, ident, seq, text, hours=0):
    return (visit, ident, seq, T0 + dt.timedelta(hours=hours), "DS", text)


@pytest.mark.parametrize("rows_per_task", [10 ** 6, 1])
def test_note_order_and_combination(spark, rows_per_task):
    raw = spark.createDataFrame([note(1, "a", "2", "two"), note(1, "b", "10", " ten \n"), note(1, "c", "2", "same", 1),
                                 note(2, "d", "1", "only"), note(3, "e", "1", "  "), note(3, "f", "1", None)], NOTE)
    staged = n.staged_notes(raw, ["visit"], "text")
    numbered = n.numbered_notes(staged, "visit", "seq", "ts", "id", "text", rows_per_task=rows_per_task)
    got = {x["visit"]: x for x in n.combined_notes(numbered, "visit", "text", ["id", "seq"]).collect()}
    assert set(got) == {1, 2}
    assert got[1]["combined_text"] == "DISCHARGE NOTE 1\nten\n\nDISCHARGE NOTE 2\ntwo\n\nDISCHARGE NOTE 3\nsame"
    assert (got[1]["ids"], got[1]["seqs"], got[2]["combined_text"]) == ("b|a|c", "10|2|2", "only")
    number = n.numbered_notes(staged, "visit", "seq", "ts", "id", "text", numeric=True)
    assert [x["id"] for x in number.where("visit = 1").orderBy("note_no").collect()] == ["a", "c", "b"]


def test_parts_make_the_whole_text(spark):
    raw = spark.createDataFrame([note(1, f"n{i:03}", f"{i:03}", "x" * (i % 40)) for i in range(1, 200)], NOTE)
    numbered = n.numbered_notes(n.staged_notes(raw, ["visit"], "text"), "visit", "seq", "ts", "id", "text")
    whole = n.combined_notes(numbered, "visit", "text").collect()
    parts = n.combined_notes(numbered, "visit", "text", part_chars=300).orderBy("part_no").collect()
    assert len(whole) == 1 and len(parts) > 5
    assert "\n\n".join(p["combined_text"] for p in parts) == whole[0]["combined_text"]


def test_proxy_times(spark, rows):
    notes = spark.createDataFrame([
        (1, 10, "a", T0, "FINDINGS: type B dissection"), (1, 10, "b", T0 - dt.timedelta(hours=2), "type B dissection"),
        (1, 10, "c", T0 + dt.timedelta(hours=1), "IMPRESSION: aortic dissection"), (2, 20, "d", T0, "FINDINGS: aortic dissection"),
        (3, 30, "e", T0, "FINDINGS: aortic dissection"), (1, 10, "f", None, "FINDINGS: aortic dissection")],
        "subject long, adm long, note string, ts timestamp_ntz, text string")
    detail = spark.createDataFrame([("a", "exam_name", "CT CHEST"), ("b", "exam_name", "CT CHEST"), ("c", "exam_name", "CTA ABD"),
                                    ("d", "exam_name", "CHEST PORT"), ("e", "other", "CT CHEST"), ("f", "exam_name", "CT CHEST")],
                                   "note string, name string, value string")
    cases = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "subject long, adm long")
    out = n.proxy_times(notes, detail, cases, ["subject", "adm"], "note", "ts", "text", ("name", "value", "exam_name"))
    assert rows(out) == [(1, 10, T0)]


def good_record():
    pick = lambda kind: "text" if kind == r.TEXT else ([kind[1][0], kind[1][1]] if isinstance(kind, tuple) else kind[0])
    return {s: {leaf: pick(kind) for leaf, kind in leaves.items()} for s, leaves in r.LABEL_SCHEMA.items()}


def test_schema_has_all_leaves():
    assert len(r.leaf_columns(r.LABEL_SCHEMA)) == 47
    assert len(r.RESULT_BASE_COLUMNS) == 20 and r.result_columns()[20] == "chief_complaint_or_presenting_symptoms__summary"


def test_record_checks_and_flattening(spark):
    bad_value, extra, missing, empty = good_record(), good_record(), good_record(), good_record()
    bad_value["anatomic_detail"]["stanford_type"] = "C"
    extra["overall"]["note"] = "x"
    del missing["treatment"]["evidence"]
    empty["diagnosis_context"]["diagnostic_modality"] = []
    null = good_record()
    null["overall"]["brief_summary"] = None
    bodies = {"good": json.dumps(good_record()), "empty": json.dumps(empty), "value": json.dumps(bad_value), "extra": json.dumps(extra),
              "missing": json.dumps(missing), "null": json.dumps(null), "text": "no json", "none": None, "list": "[]"}
    df = spark.createDataFrame(list(bodies.items()), "name string, body string")
    good, bad = r.split_valid(df, "body", r.LABEL_SCHEMA)
    errors = {x["name"]: x["error"] for x in bad.collect()}
    assert errors == {
        "value": "$.anatomic_detail.stanford_type: value not allowed", "extra": "$.overall: unexpected: note",
        "missing": "$.treatment: missing: evidence", "null": "$.overall.brief_summary: wrong type", "text": "$: not JSON",
        "none": "$: not JSON", "list": "$: not an object"}
    flat = {x["name"]: x for x in r.flatten_records(good, "body", r.LABEL_SCHEMA, ["name"]).collect()}
    assert set(flat) == {"good", "empty"}
    assert flat["good"]["diagnosis_context__diagnostic_modality"] == "CTA|CT chest/abdomen/pelvis"
    assert flat["empty"]["diagnosis_context__diagnostic_modality"] == ""
    ordered = r.in_column_order(r.flatten_records(good, "body", r.LABEL_SCHEMA, ["name"]), r.result_columns())
    assert ordered.columns == r.result_columns() and ordered.first()["subject_id"] == ""


def test_a_text_is_parsed_once(spark):
    df = spark.createDataFrame([(1, "{}")], "k int, body string")
    for side in r.split_valid(df, "body", r.LABEL_SCHEMA):
        plan = side._jdf.queryExecution().optimizedPlan().toString()
        assert "json_object_keys" not in plan and "get_json_object" not in plan


@pytest.mark.parametrize("part_chars,rows_per_task", [(7, 1_000), (50, 4), (100_000, 1_000)])
def test_parts_of_a_visit_are_cut_by_what_is_written(spark, part_chars, rows_per_task):
    rows = [(1, i, f"{i:03d}", "x" * (i % 9) + f"note {i}") for i in range(1, 131)] + [(2, 1, "a", "alone"), (3, 1, "b", "one"), (3, 2, "c", "t\u00e4\u4e2dwo")]
    df = spark.createDataFrame([(v, s, None, f"{v}-{k}", t) for v, s, k, t in rows], "v long, s int, ts timestamp_ntz, k string, t string").repartition(3)
    out = n.visit_text_parts(df, "v", "s", "ts", "k", "t", "NOTE", part_chars, numeric=True, rows_per_task=rows_per_task)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # What is sorted are lengths, below the join that fetches the texts.
    assert "ShuffledHashJoin" in plan and "_text" not in plan.split("Sort [", 1)[1]
    got = out.collect()
    assert max(len(r["part_text"]) for r in got) <= part_chars
    for v in (1, 2, 3):
        own = [t for x, _, _, t in sorted(rows) if x == v]
        want = "\n\n".join(f"NOTE {i}\n{t}" if len(own) > 1 else t for i, t in enumerate(own, 1))
        parts = sorted((r["part_no"], r["part_text"]) for r in got if r["v"] == v)
        assert "".join(t for _, t in parts) == want and [k for k, _ in parts] == list(range(-(-len(want) // part_chars)))
        assert {r["note_count"] for r in got if r["v"] == v} == {len(own)}
