"""Keyed permutations of row numbers, and columns whose values change rows independently of each other."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranks import hash_rank

ROUNDS, PRIME = 24, 2_147_483_647


def round_keys(key: str, rounds: int = ROUNDS) -> list[tuple[int, int, int, int]]:
    """Per round a shift and the three numbers of a hash modulo PRIME, from md5."""
    words = lambda r: hashlib.md5(f"{key}:{r}".encode()).digest()
    cut = lambda w, i: int.from_bytes(w[4 * i:4 * i + 4], "big") % PRIME
    return [tuple(cut(words(r), i) for i in range(4)) for r in range(1, rounds + 1)]


def permuted(index: Column, size: Column, keys: Column) -> Column:
    """A permutation of 0 to size - 1 by swap-or-not rounds: any size, no table, its own for every list of round keys.

    Each round pairs x with shift - x and swaps the pair where a hash of the larger one is odd. `keys` is an array of
    structs (shift, a, b, c) as `round_keys` gives them, so that a table can hold a permutation a row.
    """
    def swap(x: Column, k: Column) -> Column:
        partner = F.pmod(k["shift"] - x, size)
        m = F.greatest(x, partner)
        odd = ((m % PRIME * k["a"] % PRIME + ((m - m % PRIME) / PRIME).cast("long") % PRIME * k["b"] % PRIME + k["c"]) % PRIME) % 2 == 1
        return F.when(odd, partner).otherwise(x)

    return F.aggregate(keys, index.cast("long"), swap)


def _key_array(keys: Sequence[tuple[int, ...]]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(("shift", "a", "b", "c"), k)]) for k in keys])


def lending_places(place: Column, size: Column, keys: Sequence[Sequence[tuple[int, ...]]]) -> Column:
    """Per list of round keys the number x for which `permuted(x, size, keys)` is `place`, as an array.

    A round undoes itself, so the rounds run backwards. Numpy takes a batch of rows a round.
    """
    prime = PRIME

    @F.pandas_udf("array<long>")
    def run(place: pd.Series, size: pd.Series) -> pd.Series:
        at, n = place.to_numpy(np.int64), size.to_numpy(np.int64)
        found = np.empty((len(at), len(keys)), np.int64)
        for i, rounds in enumerate(keys):
            x = at
            for shift, a, b, c in reversed(rounds):
                partner = (shift - x) % n
                m = np.maximum(x, partner)
                odd = (m % prime * a % prime + m // prime % prime * b % prime + c) % prime % 2 == 1
                x = np.where(odd, partner, x)
            found[:, i] = x
        return pd.Series(list(found))

    return run(place, size)


def independent_copies(df: DataFrame, keys: Sequence[str], columns: Sequence[str], seed: int | str, prefix: str = "shadow__") -> DataFrame:
    """Adds `<prefix><column>` per column: its values on other rows, by a permutation of the rows of its own.

    Rows are numbered once, by the hash order of `keys`. Each row asks for the number that the column's permutation gives it;
    the permutation backwards tells a value at its row's number which row asks for it, so values go there without a join of
    asked and lent numbers: one shuffle of narrow rows gathers the copies of a row, and one join brings them to it.
    Every copy keeps its column's values, nulls included, and copies of equal columns differ. `keys` identify a row.
    """
    columns = list(columns)
    if not columns:
        return df
    rows = cut_lineage(hash_rank(df, keys, seed, name="_place").withColumn("_place", F.col("_place") - 1))
    number = {c: i for i, c in enumerate(columns)}
    # One field for each type that occurs, so that values of different types share a column.
    kinds = sorted({rows.schema[c].dataType.simpleString() for c in columns})
    field = {k: f"v{i}" for i, k in enumerate(kinds)}
    of = {c: rows.schema[c].dataType.simpleString() for c in columns}
    value = lambda c: F.struct(*[(F.col(c) if of[c] == k else F.lit(None).cast(k)).alias(field[k]) for k in kinds])
    goes = lending_places(F.col("_place"), F.col("_place_total"), [round_keys(f"{seed}:{c}") for c in columns])
    lent = (rows.withColumn("_goes", goes)
            .select(F.explode(F.array(*[F.struct(F.lit(number[c]).alias("c"), F.col("_goes")[number[c]].alias("_place"), value(c).alias("v"))
                                        for c in columns])).alias("x")).select("x.c", "x._place", "x.v"))
    # Dealt out as they are: partial aggregates would be as many and wider.
    met = lent.repartition("_place").groupBy("_place").agg(
        *[F.first(F.when(F.col("c") == number[c], F.col("v")[field[of[c]]]), ignorenulls=True).alias(f"{prefix}{c}") for c in columns])
    return rows.join(met, "_place").select(*df.columns, *[f"{prefix}{c}" for c in columns])
