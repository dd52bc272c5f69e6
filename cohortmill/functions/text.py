"""Text phenotyping: phrase and section rules, exam names, drug groups, label clean-up."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that state or deny the finding, section headers, and exam-name rules.
POSITIVE_PHRASES = [
    r"\baortic dissection\b",
    r"\bdissection of (?:the )?aorta\b",
    r"\btype\s+[ab]\s+(?:aortic\s+)?dissection\b",
    r"\b(?:ascending|descending|thoracic)\s+aortic\s+dissection\b",
    r"\baorta[^\n.]{0,80}dissection\b",
    r"\bdissection[^\n.]{0,80}aorta\b",
]
NEGATED_PHRASES = [
    r"\bno (?:evidence of )?(?:acute )?aortic dissection\b",
    r"\bwithout (?:evidence of )?(?:acute )?aortic dissection\b",
    r"\bnegative for (?:acute )?aortic dissection\b",
    r"\brule out (?:acute )?aortic dissection\b",
    r"\bevaluate for (?:acute )?aortic dissection\b",
    r"\bconcern for (?:acute )?aortic dissection\b",
    r"\bquestion of (?:acute )?aortic dissection\b",
]
RESULT_HEADERS = ["FINDINGS", "IMPRESSION"]
EXAM_MODALITY = [r"\bCTA\b", r"\bCT\b", r"\bMRA\b", r"\bMRI\b", r"\bCARDIAC STRUCTURE\b"]
EXAM_ANATOMY = [r"\bCHEST\b", r"\bABD\b", r"\bABDOMEN\b", r"\bPELVIS\b", r"\bAORTA\b", r"\bTHORACIC\b", r"\bCARDIAC\b"]
EXAM_EXCLUDED = [r"\bCHEST \(PORTABLE", r"\bCHEST PORT", r"\bCHEST \(PA", r"\bPRE-OP AP", r"\bHEAD\b", r"\bNECK\b",
                 r"\bSPINE\b", r"\bRENAL U\.S", r"\bULTRASOUND\b", r"\bDUPLEX\b"]

# Drug patterns per group.
DRUG_GROUPS = {
    "beta_blocker": [r"\besmolol\b", r"\blabetalol\b", r"\bmetoprolol\b", r"\batenolol\b",
                     r"\bcarvedilol\b", r"\bpropranolol\b"],
    "vasodilator": [r"\bnicardipine\b", r"\bclevidipine\b", r"\bnitroprusside\b", r"\bnitroglycerin\b", r"\bhydralazine\b"],
    "vasopressor": [r"\bnorepinephrine\b", r"\bepinephrine\b", r"\bphenylephrine\b", r"\bvasopressin\b",
                    r"\bdopamine\b", r"\bdobutamine\b"],
    "opioid_analgesic": [r"\bmorphine\b", r"\bhydromorphone\b", r"\bfentanyl\b", r"\boxycodone\b"],
    "nonopioid_analgesic": [r"\bacetaminophen\b", r"\bketorolac\b"],
    "anticoagulant": [r"\bheparin\b", r"\benoxaparin\b", r"\bwarfarin\b", r"\bapixaban\b",
                      r"\brivaroxaban\b", r"\bbivalirudin\b", r"\bargatroban\b"],
    "antiplatelet": [r"\baspirin\b", r"\bclopidogrel\b", r"\bticagrelor\b", r"\bprasugrel\b",
                     r"\beptifibatide\b", r"\btirofiban\b"],
    "statin": [r"\batorvastatin\b", r"\brosuvastatin\b", r"\bsimvastatin\b", r"\bpravastatin\b"],
}

# Keyword ladder of diagnosis categories, first match wins.
DIAGNOSIS_LADDER = [
    ("Pneumonia/respiratory", ["pneumonia", "copd", "respiratory", "pleuritic", "asthma"]),
    ("Cardiac/arrhythmia", ["atrial", "tachy", "chest pain", "myocard", "heart", "coronary"]),
    ("GI/abdominal", ["abdominal", "pancreatitis", "chole", "colitis", "diarrhea", "bowel"]),
    ("Infection/sepsis", ["sepsis", "infection", "bacter", "fever", "abscess"]),
    ("Neurologic", ["stroke", "seizure", "syncope", "altered"]),
    ("Musculoskeletal/pain", ["back pain", "fracture", "musculoskeletal", "pain"]),
]
DIAGNOSIS_OTHER = "Other/unclear"

# Display names of the reviewed label.
LABEL_NAMES = {
    "newly_identified_dissection": "New dissection",
    "confirmed_acute_dissection": "New dissection",
    "previously_known_dissection_only": "Prior/known dissection",
    "aortic_syndrome_not_dissection": "Other aortic syndrome",
    "aneurysm_without_dissection": "Aneurysm only",
    "dissection_ruled_out": "Ruled out",
    "no_aortic_syndrome_evidence": "No aortic evidence",
    "unclear": "Unclear",
}


def any_pattern(text: Column, patterns: Sequence[str]) -> Column:
    """Case-blind search for any of the patterns, as one alternation."""
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def positive_not_negated(text: Column, positive: Sequence[str] = POSITIVE_PHRASES,
                         negated: Sequence[str] = NEGATED_PHRASES) -> Column:
    """The whole text has a positive phrase and nowhere a negated one."""
    found = any_pattern(text, positive)
    return found & ~any_pattern(text, negated) if negated else found


def result_section(text: Column, headers: Sequence[str] = RESULT_HEADERS) -> Column:
    """Text from the first header line (`HEADER:`, any case) to the end; empty if there is none."""
    names = "|".join(re.escape(h) for h in headers)
    return F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?ims)^\s*(?:{names})\s*:.*", 0)


def diagnostic_exam(name: Column, modality: Sequence[str] = EXAM_MODALITY, anatomy: Sequence[str] = EXAM_ANATOMY,
                    excluded: Sequence[str] = EXAM_EXCLUDED) -> Column:
    name = F.coalesce(name, F.lit(""))
    return any_pattern(name, modality) & any_pattern(name, anatomy) & ~any_pattern(name, excluded)


def joined_text(*columns: str) -> Column:
    """Columns joined by single blanks, null as empty text."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def group_flags(text: Column, groups: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    return {group: any_pattern(text, patterns) for group, patterns in groups.items()}


def keyword_category(text: Column, ladder=DIAGNOSIS_LADDER, other: str = DIAGNOSIS_OTHER) -> Column:
    lower, category = F.lower(F.coalesce(text, F.lit(""))), None
    for label, needles in ladder:
        hit = F.lit(False)
        for needle in needles:
            hit = hit | lower.contains(needle)
        category = F.when(hit, label) if category is None else category.when(hit, label)
    return category.otherwise(other)


def clean_label(text: Column, max_words: int = 6) -> Column:
    """Underscores to blanks, runs of blanks to one, at most `max_words` words, then `...`; null is `missing`."""
    spaced = F.replace(F.coalesce(text.cast("string"), F.lit("missing")), F.lit("_"), F.lit(" "))
    squeezed = F.trim(F.regexp_replace(spaced, r"\s+", " "))
    words = F.split(squeezed, " ")
    short = F.concat(F.array_join(F.slice(words, 1, max_words), " "), F.lit("..."))
    return F.when(F.size(words) > max_words, short).otherwise(squeezed)


def mapped_label(text: Column, names: Mapping[str, str] = LABEL_NAMES) -> Column:
    """Mapped name; an unmapped value is cleaned up instead, null stays `missing`."""
    lookup = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    return F.coalesce(lookup[text], clean_label(text))


def without_suffix(text: Column, suffix: str = "_first") -> Column:
    return F.regexp_replace(text, re.escape(suffix) + "$", "")


def phenotype_group(label: str, subtype: str, cleanup: str) -> Column:
    """Display group of a scored row: cases by subtype, controls by their reviewed label."""
    kind = F.trim(F.coalesce(F.col(subtype), F.lit("")))
    known = (kind != "") & ~F.lower(kind).isin("nan", "none", "unclear")
    return (F.when((F.col(label) == 1) & known, F.concat(F.lit("Final target: Stanford "), kind))
            .when(F.col(label) == 1, "Final target: type unclear")
            .when(F.col(cleanup) == "dissection_ruled_out", "Control: dissection ruled out")
            .when(F.col(cleanup) == "no_aortic_syndrome_evidence", "Control: no aortic syndrome")
            .otherwise("Control"))


def count_groups(events: DataFrame, key: Sequence[str], text: Column, groups: Mapping[str, Sequence[str]],
                 prefix: str = "") -> DataFrame:
    """Per key: matching rows of each group, and a 0/1 flag whether there are any."""
    counts = events.groupBy(*key).agg(*[
        F.sum(flag.cast("long")).alias(f"{prefix}{g}_count") for g, flag in group_flags(text, groups).items()])
    return counts.withColumns({f"{prefix}{g}_any": (F.col(f"{prefix}{g}_count") > 0).cast("int") for g in groups})
