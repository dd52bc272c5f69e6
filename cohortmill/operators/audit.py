"""Counts, cross-tabs, missingness and agreement between cohorts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import hours_between
from .ranks import exact_quantiles, sequence_sums


def _count(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def as_rows(df: DataFrame, rows: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """Turn the single row of an aggregate into one row per entry of `rows`."""
    structs = [F.struct(*[value.alias(name) for value, name in zip(row, names)]) for row in rows]
    return df.select(F.inline(F.array(*structs)))


def split_counts(df: DataFrame, split: str, label: str) -> DataFrame:
    """Rows, cases, controls and prevalence per split."""
    return df.groupBy(split).agg(
        _count("rows_total"), F.count_if(F.col(label) == 1).alias("cases"),
        F.count_if(F.col(label) == 0).alias("controls"),
        (F.count_if(F.col(label) == 1) / F.count(F.lit(1))).alias("prevalence"))


def null_rates_by_label(df: DataFrame, label: str, columns: Sequence[str], warn_gap: float = 0.5,
                        kept: Sequence[str] | None = None) -> DataFrame:
    """Per column: null rate of controls and cases, their absolute gap, and whether it reaches `warn_gap`.

    With `kept` also `survived`, whether the column is in that list: the leakage audit of special columns.
    One aggregation over the table, whatever the number of columns.
    """
    aggs = []
    for c in columns:
        null = F.col(c).isNull().cast("double")
        for side in (0, 1):
            aggs.append(F.avg(F.when(F.col(label) == side, null)).alias(f"_{c}_{side}"))
    rates = df.agg(*aggs)
    names = ["column", "control_null_rate", "case_null_rate", "gap", "warn"]
    rows = []
    for c in columns:
        low, high = F.col(f"_{c}_0"), F.col(f"_{c}_1")
        gap = F.abs(low - high)
        rows.append([F.lit(c), low, high, gap, gap >= warn_gap])
        if kept is not None:
            rows[-1].append(F.lit(c in set(kept)))
    return as_rows(rates, rows, names + (["survived"] if kept is not None else []))


def family_availability(df: DataFrame, label: str, families: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per label and feature family: the mean over its existing columns of the share of nulls, and the rest."""
    have = set(df.columns)
    missing = {f: [F.avg(F.col(c).isNull().cast("double")) for c in cols if c in have] for f, cols in families.items()}
    missing = {f: cols for f, cols in missing.items() if cols}
    rates = df.groupBy(label).agg(*[(sum(cols[1:], cols[0]) / len(cols)).alias(f) for f, cols in missing.items()])
    long = rates.unpivot([label], list(missing), "feature_family", "missing_fraction")
    return long.withColumn("observed_fraction", 1 - F.col("missing_fraction"))


def distributions(df: DataFrame, label: str, columns: Sequence[str], max_rows: int | None = None) -> DataFrame:
    """n, median and interquartile range of the values that are numbers, neither null nor NaN, per label and column."""
    long = df.select(label, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [label], list(columns), "feature", "value").where(~F.isnan("value"))
    out = exact_quantiles(long, "value", {"q25": 0.25, "median": 0.5, "q75": 0.75}, [label, "feature"],
                          max_rows=max_rows)
    return out.select(label, "feature", "n", "median", (F.col("q75") - F.col("q25")).alias("iqr"))


def null_density(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of null cells over all given columns."""
    nulls = sum([F.count_if(F.col(c).isNull()) for c in columns[1:]], F.count_if(F.col(columns[0]).isNull()))
    return df.agg((nulls / (F.count(F.lit(1)) * len(columns))).alias("null_density"))


def frequencies(df: DataFrame, column: str, missing: str | None = None) -> DataFrame:
    """Value, count and percent, nulls included (or named `missing`)."""
    value = F.coalesce(F.col(column), F.lit(missing)) if missing is not None else F.col(column)
    counts = df.groupBy(value.alias(column)).agg(_count("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("percent", F.col("n") * 100.0 / total)


def crosstab(df: DataFrame, row: str, column: str, margin: str = "All") -> DataFrame:
    """Counts of every (row, column) pair with row, column and grand totals under the name `margin`."""
    pairs = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(_count("_n"))
    # The cube repeats its input four times, so it runs on the counted pairs.
    cells = pairs.cube(row, column).agg(
        F.sum("_n").alias("n"), F.grouping(row).alias("_r"), F.grouping(column).alias("_c"))
    name = lambda c, flag: F.when(F.col(flag) == 1, margin).otherwise(F.col(c).cast("string"))
    return cells.select(name(row, "_r").alias(row), name(column, "_c").alias(column), "n")


def overlap_summary(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: distinct ids on the left, on the right, on both, and on one side only; ids may be of any type.

    Ids are tagged, stacked and grouped once, so copies collapse on the map side.
    """
    tagged = None
    for frame, in_left in ((left, True), (right, False)):
        part = frame.select(*[F.col(k).cast("string").alias(k) for k in keys]).unpivot([], list(keys), "key", "id")
        part = part.where(F.col("id").isNotNull()).select("key", "id", F.lit(in_left).alias("l"),
                                                          F.lit(not in_left).alias("r"))
        tagged = part if tagged is None else tagged.unionByName(part)
    sides = tagged.groupBy("key", "id").agg(F.bool_or("l").alias("l"), F.bool_or("r").alias("r"))
    return sides.groupBy("key").agg(
        F.count_if("l").alias("left_ids"), F.count_if("r").alias("right_ids"),
        F.count_if(F.col("l") & F.col("r")).alias("both"), F.count_if(F.col("l") & ~F.col("r")).alias("left_only"),
        F.count_if(~F.col("l") & F.col("r")).alias("right_only"))


def joined_values(df: DataFrame, keys: Sequence[str], value: str, name: str, separator: str = "|",
                  distinct: bool = True, part_chars: int = 16_000_000) -> DataFrame:
    """Values per key in one sorted text, each once or, without `distinct`, as often as it occurs.

    Copies are counted before any list is built. A key has one row with `part_no` 0; a text longer than
    `part_chars` goes on in further rows, and the parts in order, joined by the separator, are the whole.
    """
    counts = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("string").alias("_v"))
              .agg((F.lit(1) if distinct else F.count(F.lit(1))).cast("long").alias("_n")))
    # A value with very many copies is cut into chunks of at most `part_chars` characters.
    cost = F.length("_v") + len(separator)
    fit = F.greatest(F.lit(1), F.floor(F.lit(part_chars) / cost))
    chunks = counts.withColumn("_fit", fit).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / F.col("_fit")))))
    copies = F.least(F.col("_fit"), F.col("_n") - F.col("_chunk") * F.col("_fit"))
    pieces = chunks.select(*keys, "_v", "_chunk", copies.alias("_copies"), (copies * cost).alias("_cost"))
    placed = sequence_sums(pieces, ["_v", "_chunk"], {"_upto": "_cost"}, keys)
    part = F.floor((F.col("_upto") - F.col("_cost")) / part_chars).alias("part_no")
    lists = placed.groupBy(*keys, part).agg(
        F.sort_array(F.collect_list(F.struct("_v", "_chunk", "_copies"))).alias("_pieces"))
    repeated = F.flatten(F.transform("_pieces", lambda p: F.array_repeat(p["_v"], p["_copies"].cast("int"))))
    return lists.select(*keys, "part_no", F.array_join(repeated, separator).alias(name))


def subject_summary(df: DataFrame, subject: str, admission: str, confirmed: str, label: str) -> DataFrame:
    """Per subject: distinct admissions, confirmed rows, its labels joined by `|`, and whether any is confirmed.

    Reduced to one row per (subject, admission, label) first, so a hot subject is spread by admission.
    """
    cells = df.groupBy(subject, admission, label).agg(F.sum(F.col(confirmed).cast("long")).alias("_n"))
    per_visit = cells.groupBy(subject, admission).agg(
        F.sum("_n").alias("_n"), F.collect_set(F.col(label).cast("string")).alias("_labels"))
    return per_visit.groupBy(subject).agg(
        F.count(admission).alias("admissions"), F.sum("_n").alias("confirmed_rows"),
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("_labels")))), "|").alias("labels"),
        (F.sum("_n") > 0).alias("any_confirmed"))


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(c).alias(c) for c in columns])


def top_codes(codes: DataFrame, admission: str, keys: Sequence[str], titles: DataFrame, n: int = 50) -> DataFrame:
    """The codes of most admissions with their title: distinct pairs, count, top n, then the title join."""
    counts = codes.select(admission, *keys).distinct().groupBy(*keys).agg(_count("admissions"))
    top = counts.orderBy(F.desc("admissions"), *keys).limit(n)
    return top.join(titles.select(*keys, "title").distinct(), list(keys), "left")


def mean_and_sd(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd")]
    return df.groupBy(*groups).agg(*aggs)


def attrition(steps: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(step number, step, rows) of a list of cohort stages."""
    out = None
    for number, (name, frame) in enumerate(steps, start=1):
        row = frame.agg(F.lit(number).alias("step_no"), F.lit(name).alias("step"), _count("n"))
        out = row if out is None else out.unionByName(row)
    return out


def yields(df: DataFrame, base: Column, categories: Mapping[str, Column]) -> DataFrame:
    """Count of each category and its share of the base count, in one pass."""
    counts = df.agg(F.count_if(base).alias("_base"),
                    *[F.count_if(condition).alias(f"_{i}") for i, condition in enumerate(categories.values())])
    return as_rows(counts, [[F.lit(name), F.col(f"_{i}"), F.try_divide(F.col(f"_{i}"), F.col("_base"))]
                            for i, name in enumerate(categories)], ["category", "n", "share_of_base"])


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """Negatives per positive."""
    return df.agg(F.try_divide(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("case_weight"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, groups: Sequence[str] = ()) -> DataFrame:
    """Counts per equal-width bin 1..bins of [low, high]; the last bin is closed. Values outside are left out."""
    inside = df.where(F.col(value).between(low, high))
    bin_ = F.least(F.width_bucket(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)),
                   F.lit(bins)).cast("long")
    return inside.groupBy(*groups, bin_.alias("bin")).agg(_count("n"))


def fitted_histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Histogram between the smallest and the largest value, which are found first."""
    low, high = df.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    if low is None:
        raise ValueError(f"{value} has no values")
    if low == high:
        low, high = low - 0.5, high + 0.5
    return histogram(df, value, low, high, bins)


def usage_summary(df: DataFrame, columns: Sequence[str], max_rows: int | None = None) -> DataFrame:
    """Per usage counter: n, total, quartiles of its values that are numbers; text that is none, null and NaN are left out."""
    number = {c: F.col(c).try_cast("double") for c in columns}
    long = df.select(*[F.when(~F.isnan(n), n).alias(c) for c, n in number.items()]).unpivot([], list(columns), "counter", "value")
    sums = long.groupBy("counter").agg(F.sum("value").alias("total"))
    return sums.join(exact_quantiles(long, "value", {"q25": 0.25, "median": 0.5, "q75": 0.75}, ["counter"],
                                     max_rows=max_rows), "counter")


def throughput(df: DataFrame, ok: Column, start: str, end: str) -> DataFrame:
    """Successes, errors, elapsed hours between the first start and the last end, and successes per hour."""
    totals = df.agg(F.count_if(ok).alias("parsed"), F.count_if(~ok).alias("errors"),
                    F.min(start).alias("_from"), F.max(end).alias("_to"))
    hours = hours_between("_from", "_to")
    return totals.select("parsed", "errors", hours.alias("elapsed_hours"),
                         F.try_divide(F.col("parsed"), hours).alias("parsed_per_hour"))


# Items seen inside the window, by label.

def item_prevalence(observed: DataFrame, spine: DataFrame, row_key: str, item: str, label: str) -> DataFrame:
    """Per item: spine rows that have it, overall and by label, with rates over all spine rows.

    `observed` holds (row, item) events inside the window. They are reduced to distinct pairs with the label
    already on them, so a hot item is counted from map-side partials.
    """
    pairs = observed.where(F.col(item).isNotNull()).select(row_key, item, label).distinct()
    case, control = F.col(label) == 1, F.col(label) == 0
    counts = pairs.groupBy(item).agg(
        _count("observed"), F.count_if(case).alias("case_observed"), F.count_if(control).alias("control_observed"))
    totals = spine.agg(_count("total"), F.count_if(case).alias("cases"), F.count_if(control).alias("controls"))
    total, cases, controls = (totals.select(c).scalar() for c in ("total", "cases", "controls"))
    return counts.withColumns({
        "total_rows": total, "total_cases": cases, "total_controls": controls,
        "overall_prevalence": F.try_divide(F.col("observed"), total),
        "case_prevalence": F.try_divide(F.col("case_observed"), cases),
        "control_prevalence": F.try_divide(F.col("control_observed"), controls)})


def rank_items(prevalence: DataFrame, item: str) -> DataFrame:
    """`prevalence_rank` 1..n by observed rows, then by item id."""
    keyed = prevalence.withColumns({"_one": F.lit(1).cast("long"), "_down": -F.col("observed")})
    ranked = sequence_sums(keyed, ["_down", item], {"prevalence_rank": "_one"})
    return ranked.drop("_one", "_down", "prevalence_rank_total")


def top_items(prevalence: DataFrame, item: str, n: int, labels: DataFrame | None = None,
              sensitive: Sequence = ()) -> DataFrame:
    """The n most prevalent items with rank, label, feature name and model column.

    The limit comes first, so ranking and naming only ever see n rows.
    """
    top = prevalence.orderBy(F.desc("observed"), F.asc(item)).limit(n)
    if labels is not None:
        top = top.join(labels, item, "left").fillna(
            "", [c for c in ("fluid", "category") if c in labels.columns])
    else:
        top = top.withColumn("label_text", F.lit(None).cast("string"))
    top = top.withColumn("label_text", F.coalesce("label_text", F.concat(F.lit("itemid_"), F.col(item))))
    top = top.withColumn("prevalence_rank", F.row_number().over(
        Window.orderBy(F.desc("observed"), F.asc(item))).cast("long"))
    named = feature_names(top, "label_text", item, "prevalence_rank")
    return named.withColumns({
        "model_column": F.concat(F.col("feature_name"), F.lit("_first")),
        "ordering_sensitive": F.col(item).isin(list(sensitive)) if sensitive else F.lit(False)})


def feature_names(items: DataFrame, label: str, item: str, rank: str) -> DataFrame:
    """Lower-case names of letters, digits and single underscores; `lab_` before a digit or for an empty
    label; a name that is taken by a better rank gets its item id appended."""
    base = F.trim(F.regexp_replace(F.lower(F.col(label)), r"[^a-z0-9]+", "_"), F.lit("_"))
    base = F.when(base == "", F.concat(F.lit("lab_"), F.col(item))).when(
        base.rlike(r"^\d"), F.concat(F.lit("lab_"), base)).otherwise(base)
    taken = F.row_number().over(Window.partitionBy("_base").orderBy(rank)) > 1
    return (items.withColumn("_base", base)
            .withColumn("feature_name", F.when(taken, F.concat_ws("_", "_base", item)).otherwise(F.col("_base")))
            .drop("_base"))


# Items whose being ordered at all tells about the diagnosis.
ORDERING_SENSITIVE_ITEMS = [50915, 51003, 51002, 50889, 51214]


def leakage_columns(named_items: DataFrame, suffixes: Sequence[str] = ("_first",)) -> list[str]:
    """Model columns of the order-sensitive items in a table from `top_items` (at most its n rows)."""
    names = [r[0] for r in named_items.where("ordering_sensitive").select("feature_name").collect()]
    return [name + suffix for name in sorted(names) for suffix in suffixes]


# Ranked reports.

def leaderboard(runs: DataFrame, order: Mapping[str, bool]) -> DataFrame:
    """Runs sorted by several columns; True means descending."""
    return runs.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in order.items()])


def extremes(df: DataFrame, by: str, tie: str, n: int = 25) -> DataFrame:
    """The n highest and the n lowest rows."""
    high = df.orderBy(F.desc(by), F.asc(tie)).limit(n).withColumn("side", F.lit("highest"))
    low = df.orderBy(F.asc(by), F.asc(tie)).limit(n).withColumn("side", F.lit("lowest"))
    return high.unionByName(low)


def keep_top_labels(counts: DataFrame, group: str, label: str, n: int = 7, other: str = "Other") -> DataFrame:
    """Counts with all but the n most frequent labels merged into `other`."""
    top = counts.groupBy(label).agg(F.sum("n").alias("_t")).orderBy(F.desc("_t"), label).limit(n)
    marked = counts.join(top.select(label, F.lit(True).alias("_top")), label, "left")
    merged = F.when(F.col("_top"), F.col(label)).otherwise(F.lit(other))
    return marked.groupBy(F.col(group), merged.alias(label)).agg(F.sum("n").alias("n"))


def flow_counts(df: DataFrame, left: str, right: str, top: int = 7, other: str = "Other") -> DataFrame:
    """Flows between two labels with the small right labels merged, and the totals of both sides.

    Total rows have null on the other side; the grand total has null on both.
    """
    flows = keep_top_labels(df.groupBy(left, right).agg(_count("n")), left, right, top, other)
    return flows.cube(left, right).agg(F.sum("n").alias("n"))


def top_values(df: DataFrame, columns: Sequence[str], n: int = 5, missing: str = "missing") -> DataFrame:
    """The n most frequent values of each column, nulls under `missing`; equal counts by value.

    Counted first, so the window holds one row per distinct value.
    """
    long = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in columns]).unpivot(
        [], list(columns), "domain", "subgroup")
    counts = long.groupBy("domain", "subgroup").agg(_count("n"))
    place = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("n"), "subgroup"))
    return counts.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def agreement_audit(coded: DataFrame, labelled: DataFrame, codes: DataFrame, titles: DataFrame, subject: str,
                    admission: str, confirmed: str, label: str) -> dict[str, DataFrame]:
    """Two definitions of a case held against each other.

    `coded`: the cases of the code definition. `labelled`: reviewed admissions with a boolean `confirmed` and a
    text `label`. `codes`: (admission, version, code_norm, is_target). Every result is a DataFrame.
    """
    yes = labelled.where(F.col(confirmed))
    target = codes.where("is_target")
    # A set of listed codes is never longer than the list, so it can be collected per admission as it is.
    by_admission = target.where(F.col(admission).isNotNull()).groupBy(admission).agg(
        F.array_join(F.sort_array(F.collect_set("code_norm")), "|").alias("target_codes"))
    audited = labelled.join(by_admission, admission, "left").withColumn("has_target", F.col("target_codes").isNotNull())
    reviewed = coded.select(subject, admission).join(
        labelled.select(subject, admission, label, confirmed), [subject, admission], "left")
    without = audited.where(F.col(confirmed) & ~F.col("has_target"))
    other_codes = codes.where(~F.col("is_target")).join(without.select(admission), admission, "left_semi")
    summary = subject_summary(labelled, subject, admission, confirmed, label)
    prior = coded.select(subject).distinct().withColumn("in_prior", F.lit(True))
    summary = summary.join(prior, subject, "left").fillna({"in_prior": False})
    return {
        "overlap": overlap_summary(coded, yes, [subject, admission]),
        "labels_of_coded": frequencies(reviewed, label, "<missing>"),
        "confirmed_by_code": crosstab(audited, confirmed, "has_target"),
        "coded_not_confirmed": reviewed.where(~F.coalesce(F.col(confirmed), F.lit(False))),
        "confirmed_not_coded": yes.join(coded, [subject, admission], "left_anti"),
        "confirmed_without_code": without,
        "code_without_confirmation": audited.where(F.col("has_target") & ~F.col(confirmed)),
        "top_other_codes": top_codes(other_codes, admission, ["version", "code_norm"], titles),
        "subjects": summary,
        "subjects_by_prior": crosstab(summary, "in_prior", "any_confirmed"),
    }
