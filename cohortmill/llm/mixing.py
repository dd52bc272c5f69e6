"""Mixing sources to target weights: blocks of words, drawn for output shards and joined by index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .places import bucket_bits, placed

#: Words of a block, slots of an output shard on average, and passes that a source makes at most.
BLOCK_WORDS, SHARD_SLOTS, MAX_PASSES = 1_024, 8_192, 3
_ROUNDS, _SLOTS_PER_TASK = 24, 4_096
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], max_passes: int = MAX_PASSES) -> DataFrame:
    """One row per source of (source, source_size): its number by code point (null last), its weight and its target.

    Targets share all sizes by weight; one that would exceed `max_passes` times its source stops there and the excess
    is shared anew. The sources at their limit are those with the smallest limit per weight, so one ordered pass finds
    the common share of the rest.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (sizes.withColumn("source_no", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
              .withColumn("weight", weight).withColumn("_most", F.col("source_size") * float(max_passes))
              .withColumn("_ratio", F.col("_most") / F.col("weight")))
    up_to = Window.orderBy("_ratio", "source_no").rowsBetween(Window.unboundedPreceding, 0)
    onward = Window.orderBy("_ratio", "source_no").rowsBetween(0, Window.unboundedFollowing)
    share = (F.sum("source_size").over(everything) - (F.sum("_most").over(up_to) - F.col("_most"))) / F.sum("weight").over(onward)
    level = F.min(F.when(F.col("_share") <= F.col("_ratio"), F.struct("_ratio", "source_no", "_share"))).over(everything)
    return (ranked.withColumn("_share", share).withColumn("_level", level["_share"])
            .withColumn("target", F.least("_most", F.col("weight") * F.col("_level")))
            .select("source", "source_size", "source_no", "weight", "target"))


def permuted(index: Column, size: Column, *keys: Column) -> Column:
    """A pseudorandom permutation of 0 to size - 1, chosen by `keys`: swap-or-not rounds, which suit any size."""
    def swap(x: Column, r: Column) -> Column:
        partner = F.pmod(F.xxhash64(r, *keys) - x, size)
        return F.when(F.xxhash64(F.greatest(x, partner), r, *keys) < 0, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), index.cast("long"), swap)


def drawn_slots(sources: DataFrame, seed: int, block: int, shard_slots: int) -> DataFrame:
    """The mix: (shard, source_no, slot, pass, block, block_words), one row for each block that the mix takes.

    A source's slots walk through one permutation of its blocks after the other, so no block is used twice before all
    are used once. The last slot takes only the words left to the target; a source's short last block ends each pass.
    Every slot draws its output shard, so the counts of a source over the shards are multinomial with the target's total.
    """
    blocks = F.ceil(F.col("source_size") / block)
    full_blocks = F.floor(F.col("source_size") / block)
    planned = (sources.where(F.col("source_size") > 0)
               .withColumn("_blocks", blocks).withColumn("_full", full_blocks)
               .withColumn("_passes", F.floor(F.col("target") / F.col("source_size")))
               .withColumn("_rest", F.floor(F.col("target") - F.col("_passes") * F.col("source_size")))
               .withColumn("_slots", F.col("_passes") * F.col("_blocks") + F.ceil(F.col("_rest") / block)))
    shards = planned.agg(F.greatest(F.lit(1), F.ceil(F.sum("_slots") / shard_slots)).alias("_shards"))
    chunks = (planned.where(F.col("_slots") > 0).join(F.broadcast(shards))
              .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_slots") - 1) / _SLOTS_PER_TASK)))))
    slots = (chunks.repartition("source_no", "_chunk")
             .withColumn("slot", F.explode(F.sequence(F.col("_chunk") * _SLOTS_PER_TASK,
                                                      F.least((F.col("_chunk") + 1) * _SLOTS_PER_TASK, F.col("_slots")) - 1)))
             .withColumn("pass", F.floor(F.col("slot") / F.col("_blocks")))
             .withColumn("_at", F.col("slot") % F.col("_blocks")))
    picked = F.when(F.col("_at") < F.col("_full"),
                    permuted(F.col("_at"), F.col("_full"), F.lit(seed), F.col("source_no"), F.col("pass"))).otherwise(F.col("_full"))
    left = F.when(F.col("pass") < F.col("_passes"), F.lit(block)).otherwise(
        F.least(F.lit(block), F.col("_rest") - F.col("_at") * block))
    return (slots.withColumn("block", picked).withColumn("block_words", left.cast("long"))
            .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "source_no", "slot"), F.col("_shards")))
            .select("shard", "source_no", "slot", "pass", "block", "block_words"))


def mixed_rows(docs: DataFrame, weights: list[float], text: str = "text", source: str = "source", key: str = "doc_id",
               seed: int = 17, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces): every row of `docs` with its place in its source's stream of words, and what the mix takes of it.

    rows: `_row`, a struct of the columns of `docs`, and size, source_size, source_no, target, place. pieces: (source_no,
    place, shard, slot, pass, from_word, words), words counted from 0 inside the row's text. Null, empty and blank texts have
    size 0 and no pieces; null sources are a source of their own; equal rows are taken as separate rows; an empty table gives
    none. Columns of `docs` come along in the struct, whatever their names. (source_no, place) names a row of size over 0.
    """
    base = docs
    fields = [F.col(source).alias("_source"), F.col(key).cast("string").alias("_id"), F.xxhash64(text).alias("_text")]
    narrow = cut_lineage(base.select(*fields, word_count(text).alias("size")))
    sizes = narrow.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"))
    sources = cut_lineage(source_targets(sizes, weights))
    numbered = sources.select(F.col("source").alias("_named"), "source_size", "source_no", "target")
    bits = bucket_bits(narrow.count())

    def with_places(rows: DataFrame) -> DataFrame:
        joined = rows.join(numbered, F.col("_source").eqNullSafe(F.col("_named"))).drop("_named")
        totals = narrow.join(numbered, F.col("_source").eqNullSafe(F.col("_named"))).select("source_no", "size", "_id", "_text")
        return placed(joined, totals, "source_no", F.col("size"), ["_id", "_text"], bits, "place")

    packed = base.select(F.struct(*docs.columns).alias("_row"), *fields, word_count(text).alias("size"))
    rows = with_places(packed).drop("_source", "_id", "_text")
    spread = (with_places(narrow).where("size > 0").select("source_no", "place", "size")
              .withColumn("block", F.explode(F.sequence(F.floor(F.col("place") / block),
                                                        F.floor((F.col("place") + F.col("size") - 1) / block)))))
    begin = F.greatest(F.col("place"), F.col("block") * block)
    end = F.least(F.col("place") + F.col("size"), F.col("block") * block + F.col("block_words"))
    pieces = (spread.join(drawn_slots(sources, seed, block, shard_slots), ["source_no", "block"])
              .withColumn("from_word", begin - F.col("place")).withColumn("words", end - begin).where("words > 0")
              .select("source_no", "place", "shard", "slot", "pass", "from_word", "words"))
    return rows, pieces


def taken_words(docs: DataFrame, weights: list[float], **options) -> DataFrame:
    """`docs` with size, source_size, target and `taken`, the words that the mix takes of each row, repeats counted.

    Columns of `docs` with one of these names are replaced.
    """
    new = ["size", "source_size", "target", "taken"]
    rows, pieces = mixed_rows(docs, weights, **options)
    sums = (pieces.groupBy(F.col("source_no").alias("_no"), F.col("place").alias("_place")).agg(F.sum("words").alias("taken")))
    there = (F.col("source_no") == F.col("_no")) & (F.col("place") == F.col("_place")) & (F.col("size") > 0)
    return (rows.join(sums, there, "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
            .select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in new], *new))


def mixed_documents(docs: DataFrame, weights: list[float], text: str = "text", **options) -> DataFrame:
    """The mix as documents: for each pass that takes words of a row, the row with the words taken.

    A pass that takes all words keeps the text as it is, another one joins the taken words by blanks, in the text's
    order. Only documents with words can be taken. Returns the columns of `docs`, all but the text as they are.
    """
    rows, pieces = mixed_rows(docs, weights, text=text, **options)
    per_pass = (pieces.groupBy(F.col("source_no").alias("_no"), F.col("place").alias("_place"), "pass")
                .agg(F.sum("words").alias("_taken"), F.sort_array(F.collect_list(F.struct("from_word", "words"))).alias("_spans")))
    there = (F.col("source_no") == F.col("_no")) & (F.col("place") == F.col("_place")) & (F.col("size") > 0)
    words = F.regexp_extract_all(F.col(f"_row.`{text}`"), F.lit(_WORD), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("_spans", lambda s: F.slice(words, s["from_word"].cast("int") + 1,
                                                                         s["words"].cast("int")))), " ")
    whole = F.col("_taken") == F.col("size")
    kept = F.when(whole, F.col(f"_row.`{text}`")).otherwise(cut)
    return rows.join(per_pass, there).select(*[(kept if c == text else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
