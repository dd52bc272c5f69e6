"""Cohort spines: which encounter of which subject is a case or a control, and when it starts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import any_group, exact_code, loose_code
from ..functions.times import (WINDOW_HOURS, age_at, censor_windows, index_time, index_time_source, lenient_timestamp, synthetic_key,
                               window_end)
from ..operators.cohort import (downsample_controls, first_non_null, grouped_split, hard_controls, holdout_split, normal_ids, one_row,
                                row_id, stack_cases, stratified_split)
from ..operators.joins import JoinCheckError, among, many_to_one, not_among, stack
from ..operators.matrix import require_rows
from ..session import cut_lineage

# Fixed value: the youngest age at index time.
MIN_AGE = 18


def coded_admissions(codes: DataFrame, admission: str, targets: Mapping[int, Sequence[str]]) -> DataFrame:
    """Admissions with a code that is listed exactly for its version. `codes` comes from `prepare_codes`."""
    return codes.where(exact_code("code_norm", "version", targets)).select(admission).distinct()


def admission_flags(codes: DataFrame, admission: str, targets: Mapping, groups: Mapping) -> DataFrame:
    """Per admission: whether any code is a target and whether any is in a prefix group, in one pass."""
    return codes.where(F.col(admission).isNotNull()).groupBy(admission).agg(
        F.bool_or(exact_code("code_norm", "version", targets)).alias("is_target"),
        F.bool_or(any_group("code_norm", "version", groups)).alias("is_similar"))


def similar_admissions(codes: DataFrame, admission: str, groups: Mapping, exclude: Mapping) -> DataFrame:
    """Admissions with a code in a prefix group and none that is excluded."""
    flags = admission_flags(codes, admission, exclude, groups)
    return flags.where(F.col("is_similar") & ~F.col("is_target")).select(admission)


def add_demographics(spine: DataFrame, people: DataFrame, subject: str, start: str, min_age: int = MIN_AGE) -> DataFrame:
    """Inner join to people (`anchor_age`, `anchor_year`, ...), age at index time, and the minimum age."""
    joined = spine.join(people, subject, "inner")
    aged = joined.withColumn("index_age", age_at(start, "anchor_age", "anchor_year"))
    return aged.where(F.col("index_age") >= min_age).drop("anchor_age", "anchor_year")


@dataclass
class SpineOptions:
    """What a code-defined spine does beyond its plain form, in this order: split, training filter, downsampling, windows.

    `exact_split`: the test share is exact in each label; `one_split`: all rows train. `hard_controls`: (kind column, kinds,
    place column, places) that a training control must be in. `control_ratio`: training controls per training case.
    `proxies`: (subject, admission, time) at which a case's window ends at the latest, named by `proxy_source`.
    """
    exact_split: bool = False
    one_split: bool = False
    hard_controls: tuple[str, Sequence[str], str, Sequence[str]] | None = None
    control_ratio: float | None = None
    proxies: DataFrame | None = None
    proxy_time: str = "proxy_time"
    proxy_source: str = "proxy"


def code_defined_spine(admissions: DataFrame, codes: DataFrame, people: DataFrame, case_list: DataFrame | None,
                       subject: str, admission: str, start: str, targets: Mapping, similar: Mapping | None,
                       columns: Sequence[str], label: str = "label", hours: int = WINDOW_HOURS,
                       min_age: int = MIN_AGE, share: float = 0.2, seed: int = 42, options: SpineOptions = SpineOptions()) -> DataFrame:
    """Cases: per subject the earliest admission with a target code, columns filled from later ones where
    null. Controls: the latest admission of every other subject, after keeping only similar admissions.

    A subject with a target code that is not on `case_list` can be a control through another admission. Errors: no code that
    is a target, or in a similar group; no admission of other subjects, or none that is similar; a filter that leaves no
    training control.
    """
    _require_codes(codes, targets, similar)
    if similar is None:
        coded = coded_admissions(codes, admission, targets)
    else:
        # Both lists come from one aggregation over the codes, whose shuffle Spark reuses.
        flags = admission_flags(codes, admission, targets, similar)
        coded = flags.where("is_target").select(admission)
        eligible = flags.where(F.col("is_similar") & ~F.col("is_target")).select(admission)
    hits = among(admissions, coded, [admission])
    if case_list is not None:
        hits = among(hits, case_list, [subject, admission])
    kept = [admission, start, *columns]
    cases = first_non_null(hits, subject, start, admission, kept)
    pool = others = not_among(admissions, cases, [subject])
    if similar is not None:
        pool = among(pool, eligible, [admission])
    controls = first_non_null(pool, subject, start, admission, kept, latest=True)
    # One row per subject, computed once: the checks, the cuts of the split and the filters below read it again.
    spine = cut_lineage(stack_cases(cases, controls, label))
    if similar is not None and spine.where(F.col(label) == 0).isEmpty():
        require_rows(others, "no admission of a subject without a case is there to choose controls from")
        raise ValueError("no rows left: no control has a similar admission")
    spine = add_demographics(spine, people, subject, start, min_age)
    return _finished(spine, subject, admission, start, label, hours, share, seed, options)


def _require_codes(codes: DataFrame, targets: Mapping, similar: Mapping | None) -> None:
    """Both checks of the code lists in one pass over the codes, without a shuffle."""
    wanted = [F.bool_or(exact_code("code_norm", "version", targets))]
    if similar is not None:
        wanted.append(F.bool_or(any_group("code_norm", "version", similar)))
    found = codes.agg(*wanted).first()
    for there, what in zip(found, ("no admission has a target code", "no admission has a similar code")):
        if not there:
            raise ValueError(f"no rows left: {what}")


def _finished(spine: DataFrame, subject: str, admission: str, start: str, label: str, hours: int, share: float, seed: int,
              options: SpineOptions) -> DataFrame:
    """Split, training filters and windows of a spine with demographics."""
    if options.one_split:
        spine = spine.withColumn("cohort_split", F.lit("train"))
    elif options.exact_split:
        spine = stratified_split(cut_lineage(spine), [subject], label, share, seed)
    else:
        spine = holdout_split(spine, [subject], share, seed)
    if options.hard_controls is not None:
        kind, kinds, place, places = options.hard_controls
        spine = cut_lineage(hard_controls(spine, label, "cohort_split", kind, kinds, place, places))
        require_rows(spine.where((F.col("cohort_split") == "train") & (F.col(label) == 0)), "the hard-control filter removed every training control")
    if options.control_ratio:
        spine = downsample_controls(cut_lineage(spine), [subject], label, options.control_ratio, "cohort_split", seed)
    if options.proxies is None:
        return spine.withColumn("feature_window_end", window_end(start, hours))
    proxies = options.proxies.select(subject, admission, F.col(options.proxy_time).alias("_proxy"))
    first = proxies.where(F.col("_proxy").isNotNull()).groupBy(subject, admission).agg(F.min("_proxy").alias("_proxy"))
    return censor_windows(spine.join(first, [subject, admission], "left"), start, "_proxy", label, options.proxy_source, hours).drop("_proxy")


def list_defined_spine(cases: DataFrame, controls: DataFrame, admissions: DataFrame, people: DataFrame, subject: str,
                       admission: str, start: str, label: str = "label", hours: int = WINDOW_HOURS,
                       min_age: int = MIN_AGE, share: float = 0.2, seed: int = 42) -> DataFrame:
    """One row per listed admission. Lists must not overlap in admission or subject, and every listed
    admission must be known; the split keeps a subject on one side."""
    cohort = stack_cases(cases.select(subject, admission), controls.select(subject, admission), label,
                         [admission, subject])
    cohort = row_id(cohort, [subject, admission, label], "cohort_row_id")
    spine = many_to_one(cohort, admissions, [subject, admission])
    spine = add_demographics(spine, people, subject, start, min_age)
    spine = grouped_split(spine, subject, label, share, seed)
    return spine.withColumn("feature_window_end", window_end(start, hours))


def list_spine_from_raw(cases: DataFrame, controls: DataFrame, admissions: DataFrame, people: DataFrame, subject: str, admission: str,
                        main: str, early: str, label: str = "label", use_early: bool = True, **options) -> DataFrame:
    """`list_defined_spine` from lists and admissions as they were read: ids and times may be text.

    Rows of a list or of the admissions without numeric ids go; unreadable times are null. The index time is the early one
    where it is not after the main one, and `index_time_source` says which was taken. A listed admission that is unknown,
    known twice, or without a main time is an error. `proxy_time` and `proxy_source` are there and null.
    """
    cases, controls = (normal_ids(df.select(subject, admission), subject, admission) for df in (cases, controls))
    known = normal_ids(admissions, subject, admission).withColumns({c: lenient_timestamp(c) for c in (main, early)})
    listed = stack(cases, controls)
    untimed = among(known.where(F.col(main).isNull()), listed, [subject, admission]).select(subject, admission).limit(5).collect()
    if untimed:
        raise JoinCheckError(f"listed admissions without {main}, for example {[tuple(r) for r in untimed]}")
    timed = known.withColumns({"index_time": index_time(main, early, use_early), "index_time_source": index_time_source(main, early, use_early)})
    spine = list_defined_spine(cases, controls, timed.drop(main, early), people, subject, admission, "index_time", label, **options)
    return spine.withColumns({"proxy_time": F.lit(None).cast("timestamp_ntz"), "proxy_source": F.lit(None).cast("string")})


def loose_case_index(visits: DataFrame, subject: str, ts: str, tie: str, diagnosis: str, pattern: str,
                     columns: Sequence[str]) -> DataFrame:
    """Per subject the earliest visit whose diagnosis text matches, null columns filled from later ones."""
    return first_non_null(visits.where(loose_code(diagnosis, pattern)), subject, ts, tie, [ts, *columns])


def emergency_controls(admissions: DataFrame, transfers: DataFrame, cases: DataFrame, subject: str, admission: str,
                       ts: str, emergency_place: tuple[str, str], emergency_unit: tuple[str, str],
                       transfer_ts: str) -> DataFrame:
    """Per subject outside `cases`, the latest emergency visit: admitted ones from admissions, standalone
    ones (no admission) from transfers under a synthetic key."""
    place, place_value = emergency_place
    unit, unit_value = emergency_unit
    admitted = admissions.where(F.col(place) == place_value).select(
        subject, F.col(admission).cast("string").alias("visit_id"), F.col(ts).alias("encounter_time"),
        F.lit("ADMITTED_ED").alias("visit_type"))
    standalone = standalone_visits(transfers.where(F.col(unit) == unit_value), subject, admission, transfer_ts, "ED",
                                   "STANDALONE_ED")
    pool = not_among(stack(admitted, standalone), cases, [subject])
    return latest_visit(pool, subject)


def standalone_visits(transfers: DataFrame, subject: str, admission: str, ts: str, prefix: str,
                      visit_type: str) -> DataFrame:
    """Transfers without admission, under the key `PREFIX_subject_yyyyMMddHHmm`."""
    return transfers.where(F.col(admission).isNull()).select(
        subject, synthetic_key(prefix, subject, ts).alias("visit_id"), F.col(ts).alias("encounter_time"),
        F.lit(visit_type).alias("visit_type"))


def latest_visit(visits: DataFrame, subject: str) -> DataFrame:
    """The latest visit per subject as a whole row; visits at the same time by key."""
    others = [c for c in visits.columns if c != subject]
    best = visits.groupBy(subject).agg(
        F.max_by(F.struct(*others), F.struct("encounter_time", "visit_id")).alias("_row"))
    return best.select(subject, *[F.col(f"_row.{c}").alias(c) for c in others])


def adult_controls(admissions: DataFrame, transfers: DataFrame, people: DataFrame, cases: DataFrame, subject: str,
                   admission: str, ts: str, transfer_ts: str, min_age: int = MIN_AGE,
                   extra: Sequence[str] = ()) -> DataFrame:
    """Per subject outside `cases`, the latest encounter of any kind, kept if the subject is then an adult."""
    admitted = admissions.select(
        subject, F.col(admission).cast("string").alias("visit_id"), F.col(ts).alias("encounter_time"),
        F.lit("ADMITTED").alias("visit_type"), *extra)
    standalone = standalone_visits(transfers, subject, admission, transfer_ts, "SA", "STANDALONE")
    latest = latest_visit(not_among(stack(admitted, standalone), cases, [subject]), subject)
    return add_demographics(latest, people, subject, "encounter_time", min_age)


def latest_demographics(admissions: DataFrame, subject: str, ts: str, tie: str, columns: Sequence[str]) -> DataFrame:
    """Latest non-null value per subject and column."""
    return first_non_null(admissions, subject, ts, tie, columns, latest=True)


def master_spine(cases: DataFrame, controls: DataFrame, label: str, ts: str) -> DataFrame:
    """Cases over controls in time order."""
    return stack_cases(cases, controls, label).orderBy(ts)


def earliest_row(df: DataFrame, subject: str, ts: str, tie: str) -> DataFrame:
    return one_row(df, subject, ts, tie, latest=False)


def derived_label_cohort(labels: DataFrame, subject: str, admission: str, ts: str, new_case: str, type_b: str,
                         known_before: str, useful_control: str, symptom: str, hours: int = WINDOW_HOURS) -> tuple:
    """Cohort from reviewed labels (boolean columns): cases are new findings that are neither type B nor
    known before; controls are, per other subject, the latest visit that is useful and has the symptom.

    Returns (cohort, yield table): the yield table has the count per step and its share of the base.
    """
    base = labels.where(F.col(new_case))
    keep = ~F.coalesce(F.col(type_b), F.lit(False)) & ~F.coalesce(F.col(known_before), F.lit(False))
    cases = base.where(keep).select(subject, admission, ts)
    pool = labels.where(F.col(useful_control) & F.col(symptom) & ~F.coalesce(F.col(new_case), F.lit(False)))
    pool = not_among(pool, base, [subject]).select(subject, admission, ts)
    controls = one_row(pool, subject, ts, admission, latest=True)
    cohort = stack_cases(cases, controls, "label").withColumn("feature_window_end", window_end(ts, hours))
    counts = base.agg(
        F.count(F.lit(1)).alias("base"),
        F.count_if(F.coalesce(F.col(type_b), F.lit(False))).alias("excluded_type_b"),
        F.count_if(~F.coalesce(F.col(type_b), F.lit(False)) & F.coalesce(F.col(known_before), F.lit(False)))
        .alias("excluded_known"),
        F.count_if(keep).alias("final_cases"))
    return cohort, counts
