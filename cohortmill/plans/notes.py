"""Note jobs: proxy times from reports, visit texts, prompts, and the ingest of their responses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records as r
from ..functions import text as t
from ..operators.audit import joined_values
from ..operators.joins import among
from ..operators.ranks import ROWS_PER_TASK, ordered_sums, sequence_sums
from ..operators.windows import interval_join
from ..session import cut_lineage

PART_CHARS = 16_000_000
NOTES_PER_TASK = 100_000


def proxy_times(notes: DataFrame, detail: DataFrame, cases: DataFrame, keys: Sequence[str], note_id: str, ts: str,
                text: str, field: tuple[str, str, str], positive: Sequence[str] = t.POSITIVE_PHRASES,
                negated: Sequence[str] = t.NEGATED_PHRASES, headers: Sequence[str] = t.RESULT_HEADERS,
                modality: Sequence[str] = t.EXAM_MODALITY, anatomy: Sequence[str] = t.EXAM_ANATOMY,
                excluded: Sequence[str] = t.EXAM_EXCLUDED) -> DataFrame:
    """First time per `keys` of a note whose result section states the finding and whose exam qualifies.

    `detail` is a key/value table; `field` = (name column, value column, wanted name). A note qualifies when
    its values together name a modality and an anatomy and nothing excluded. Each pattern lies inside one
    value, so three flags per note say the same as a search in the joined values.
    """
    name, value, wanted = field
    dated = among(notes, cases, keys).where(F.col(ts).isNotNull())
    section = t.result_section(F.col(text), headers) if headers else F.coalesce(F.col(text), F.lit(""))
    # The generator keeps the filter above the section, which is cut out once; the hits are narrow and settled, so that the
    # texts are read and matched once for both uses below.
    cut = dated.select(*keys, note_id, ts, F.explode(F.array(section)).alias("_section"))
    hits = cut_lineage(cut.where(t.positive_not_negated(F.col("_section"), positive, negated)).select(*keys, note_id, ts))
    exam = F.coalesce(F.col(value).cast("string"), F.lit(""))
    flags = among(detail.where(F.col(name) == wanted), hits, [note_id]).groupBy(note_id).agg(
        F.bool_or(t.any_pattern(exam, modality)).alias("_modality"), F.bool_or(t.any_pattern(exam, anatomy)).alias("_anatomy"),
        F.bool_or(t.any_pattern(exam, excluded)).alias("_excluded"))
    wanted_notes = flags.where(F.col("_modality") & F.col("_anatomy") & ~F.col("_excluded"))
    return among(hits, wanted_notes, [note_id]).groupBy(*keys).agg(F.min(ts).alias("proxy_time"))


def exam_names(detail: DataFrame, note_id: str, value: str) -> DataFrame:
    """Exam names of a note, sorted and joined by ` | `."""
    return joined_values(detail, [note_id], value, "exam_name", " | ", distinct=False)


def drug_features(orders: DataFrame, spine: DataFrame, on: Sequence[str], row_key: str, ts: str, start: str, end: str,
                  text: Column, groups: Mapping[str, Sequence[str]], prefix: str = "med_",
                  bin_seconds: int = 86_400) -> DataFrame:
    """Spine with the in-window order counts and flags per drug group; 0 where a row has no orders."""
    worded = orders.select(*on, ts, text.alias("_text"))
    windows = spine.select(*dict.fromkeys([*on, row_key, start, end]))
    joined = interval_join(worded, windows, on, ts, start, end, bin_seconds)
    counts = t.count_groups(joined, [row_key], F.col("_text"), groups, prefix)
    return spine.join(counts, row_key, "left").fillna(0, [c for c in counts.columns if c != row_key])


def staged_notes(notes: DataFrame, ids: Sequence[str], text: str) -> DataFrame:
    """Notes with numeric ids and text that is not blank, trimmed."""
    typed = notes.withColumns({c: F.col(c).try_cast("long") for c in ids})
    trimmed = typed.withColumn(text, F.regexp_replace(F.col(text), r"^\s+|\s+$", ""))
    return trimmed.dropna(subset=[*ids, text]).where(F.col(text) != "")


def numbered_notes(notes: DataFrame, visit: str, seq: str, ts: str, note_id: str, text: str,
                   numeric: bool = False, rows_per_task: int = NOTES_PER_TASK) -> DataFrame:
    """`note_no` 1..n and `note_count` per visit, by sequence as text (so "10" comes before "2"; as a number
    with `numeric`), then time, then id. Also `chars_before`, the note characters ahead of the note."""
    keyed = notes.withColumns({
        "_seq": F.col(seq).try_cast("double") if numeric else F.col(seq).cast("string"),
        "_one": F.lit(1).cast("long"), "_chars": F.length(text).cast("long")})
    counted = sequence_sums(keyed, ["_seq", ts, note_id], {"note_no": "_one", "_upto": "_chars"}, [visit],
                            rows_per_task=rows_per_task)
    return (counted.withColumn("chars_before", F.col("_upto") - F.col("_chars"))
            .withColumnRenamed("note_no_total", "note_count")
            .drop("_seq", "_one", "_chars", "_upto", "_upto_total"))


def combined_notes(numbered: DataFrame, visit: str, text: str, meta: Sequence[str] = (), title: str = "DISCHARGE NOTE",
                   part_chars: int = PART_CHARS) -> DataFrame:
    """Visit text in note order, blank line between notes, with numbered titles when there are several notes;
    `meta` columns are joined by `|` in the same order.

    A visit is one row with `part_no` 0 unless its notes exceed `part_chars` characters. Then it is several
    rows, and the parts in order, joined by a blank line, are the whole text: no cell and no task has to hold
    a visit of any size.
    """
    section = F.when(F.col("note_count") > 1, F.concat(F.lit(f"{title} "), F.col("note_no").cast("string"), F.lit("\n"),
                                                       F.col(text))).otherwise(F.col(text))
    pieces = numbered.select(
        visit, F.floor(F.col("chars_before") / part_chars).alias("part_no"), "note_count",
        F.struct(F.col("note_no"), section.alias("section"),
                 *[F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in meta]).alias("_piece"))
    grouped = pieces.groupBy(visit, "part_no").agg(
        F.max("note_count").alias("note_count"), F.sort_array(F.collect_list("_piece")).alias("_pieces"))
    joined = lambda name, sep: F.array_join(F.transform("_pieces", lambda p: p[name]), sep)
    return grouped.select(visit, "part_no", "note_count", joined("section", "\n\n").alias("combined_text"),
                          *[joined(c, "|").alias(f"{c}s") for c in meta])


def _digits_upto(m: Column) -> Column:
    """Decimal digits of all numbers from 1 to m together."""
    digits = F.length(m.cast("string"))
    below = F.aggregate(F.sequence(F.lit(1), F.greatest(digits - 1, F.lit(1))), F.lit(0).cast("long"),
                        lambda n, d: n + F.when(d < digits, 9 * F.pow(F.lit(10), d - 1).cast("long") * d).otherwise(0))
    return F.when(m > 0, below + (m - F.pow(F.lit(10), digits - 1).cast("long") + 1) * digits).otherwise(0)


def visit_text_parts(notes: DataFrame, visit: str, seq: str, ts: str, note_id: str, text: str, title: str = "DISCHARGE NOTE",
                     part_chars: int = PART_CHARS, numeric: bool = False, rows_per_task: int = NOTES_PER_TASK) -> DataFrame:
    """(visit, part_no, note_count, part_text): the text that `combined_notes` writes for a visit, cut every `part_chars` characters.

    Parts in order, put together as they are, are the whole text; none is longer than `part_chars`, titles and blank lines
    counted, and a note longer than a part goes on in the next. Notes are ordered and cut by their lengths alone; the texts
    are read once, fetched by note and sent only to the parts that they are in. `note_id` names a note.
    """
    lengths = notes.select(visit, seq, ts, note_id, F.length(text).alias("_chars"))
    narrow = lengths.withColumns({"_seq": F.col(seq).try_cast("double") if numeric else F.col(seq).cast("string"), "_one": F.lit(1).cast("long"),
                                  "_size": F.col("_chars").cast("long")})
    placed = sequence_sums(narrow, ["_seq", ts, note_id], {"note_no": "_one", "_upto": "_size"}, [visit], rows_per_task=rows_per_task)
    number, several, last = F.col("note_no"), F.col("note_no_total") > 1, F.col("note_no") == F.col("note_no_total")
    heads = lambda m: F.when(several, m * (len(title) + 2) + _digits_upto(m)).otherwise(0)  # the title, a blank, the number, a line end
    begin = F.col("_upto") - F.col("_size") + heads(number - 1) + 2 * (number - 1)
    end = F.col("_upto") + heads(number) + 2 * (number - 1) + F.when(last, 0).otherwise(2)
    spans = placed.select(visit, note_id, number.alias("note_no"), F.col("note_no_total").alias("note_count"), begin.alias("_begin"), end.alias("_end"))
    parts = F.explode(F.sequence(F.floor(F.col("_begin") / part_chars), F.floor(F.greatest(F.col("_begin"), F.col("_end") - 1) / part_chars)))
    pieces = spans.withColumn("part_no", parts).hint("shuffle_hash")  # built from the narrow side, so that texts are not sorted
    texts = notes.select(F.col(note_id).alias("_note"), F.col(text).alias("_text"))
    met = texts.join(pieces, texts["_note"] == pieces[note_id])
    head = F.when(F.col("note_count") > 1, F.concat(F.lit(f"{title} "), F.col("note_no").cast("string"), F.lit("\n"))).otherwise("")
    tail = F.when(F.col("note_no") < F.col("note_count"), "\n\n").otherwise("")
    begins = F.greatest(F.col("part_no") * part_chars - F.col("_begin"), F.lit(0))
    size = F.least(F.col("_end"), (F.col("part_no") + 1) * part_chars) - F.greatest(F.col("_begin"), F.col("part_no") * part_chars)
    piece = F.substring(F.concat(head, "_text", tail), (begins + 1).cast("int"), size.cast("int"))
    grouped = met.groupBy(visit, "part_no").agg(F.max("note_count").alias("note_count"), F.sort_array(F.collect_list(F.struct("note_no", piece.alias("t")))).alias("_pieces"))
    return grouped.select(visit, "part_no", "note_count", F.array_join(F.transform("_pieces", lambda p: p["t"]), "").alias("part_text"))


def prompts(combined: DataFrame, prefix: str = "Discharge note text:\n") -> DataFrame:
    """The request text of a visit; only its first part carries the prefix."""
    lead = F.when(F.col("part_no") == 0, F.lit(prefix)).otherwise(F.lit(""))
    return combined.withColumn("prompt", F.concat(lead, F.col("combined_text")))


def work_items(visits: DataFrame, notes: DataFrame, visit: str, limit: int | None = None,
               rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Visits that have notes with `sequence_index` 1..n in id order, up to `limit`."""
    having = among(visits, notes, [visit]).withColumn("_one", F.lit(1).cast("long"))
    if limit is not None:
        having = having.orderBy(visit).limit(limit)
    ranked = ordered_sums(having, visit, {"sequence_index": "_one"}, max_rows=limit, rows_per_task=rows_per_task)
    return ranked.drop("_one", "sequence_index_total")


def visit_records(items: DataFrame, numbered: DataFrame, visit: str, visit_fields: Sequence[str],
                  note_fields: Sequence[str], part_notes: int = 10_000) -> DataFrame:
    """One record per visit: a `visit` struct and the `notes` array in note order.

    A visit of more than `part_notes` notes continues in further rows with a higher `part_no`.
    """
    notes = numbered.select(
        visit, F.floor((F.col("note_no") - 1) / part_notes).alias("part_no"), "note_count",
        F.struct("note_no", *note_fields).alias("_note"))
    arrays = notes.groupBy(visit, "part_no").agg(F.max("note_count").alias("note_count"),
                                                 F.sort_array(F.collect_list("_note")).alias("notes"))
    described = items.select(visit, "sequence_index", F.struct(*visit_fields).alias("visit"))
    return described.join(arrays, visit)


def ingest_responses(responses: DataFrame, raw: str, keep: Sequence[str], schema: Mapping) -> tuple[DataFrame, DataFrame]:
    """Raw response JSON to (flat result rows with usage counters, error rows)."""
    opened = responses.withColumn("_response", F.from_json(raw, r.RESPONSE_TYPE))
    texts = opened.withColumn("_text", r.response_text("_response"))
    good, bad = r.split_valid(texts, "_text", schema)
    usage = [c for c in r.usage_columns("_response.usage")]
    results = good.withColumn("_record", F.from_json("_text", r.struct_type(schema))).select(
        *keep, *usage, *r.flat_columns("_record", schema))
    return results, bad.select(*keep, "error")
