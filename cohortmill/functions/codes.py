"""Code lists: normalisation, exact and prefix masks by code version."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Target codes and similar-control prefixes by code version.
TARGET_CODES = {
    9: ["441", "44100", "44101", "44103"],
    10: ["I7100", "I7101", "I71010", "I71012", "I71019", "I7103"],
}
SIMILAR_CONTROL_GROUPS = {
    "chest_pain": {9: ["7865"], 10: ["R07"]},
    "back_pain": {9: ["7245"], 10: ["M54"]},
}
LOOSE_TARGET_PATTERN = "441|I71"


def plain(code: str) -> str:
    return code.upper().replace(".", "")


def normal_code(column: str, trim: bool = False) -> Column:
    """Upper case without dots, optionally without outer blanks."""
    out = F.upper(F.replace(F.col(column), F.lit("."), F.lit("")))
    return F.trim(out) if trim else out


def prepare_codes(df: DataFrame, admission: str, code: str, version: str, trim: bool = False) -> DataFrame:
    """Rows with a whole-number admission, a code and a version, and their `code_norm`; a version that is no number is null."""
    given = F.col(code).isNotNull() & F.col(version).isNotNull() & F.col(admission).try_cast("long").isNotNull()
    kinds = {admission: "long", version: "int"}
    return df.where(given).select(*[F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else c for c in df.columns],
                                  normal_code(code, trim).alias("code_norm"))


# A list by version is one flat list of `version:code` keys, and a row has one such key. A row without a code or version
# has no colon in its key, so it is in no list.

def listed_keys(*lists: Mapping[int, Sequence[str]]) -> list[str]:
    return [f"{v}:{plain(c)}" for listed in lists for v, codes in listed.items() for c in codes]


def row_key(code: str, version: str) -> Column:
    return F.concat_ws(":", F.col(version).cast("string"), F.col(code))


def exact_code(code: str, version: str, codes: Mapping[int, Sequence[str]]) -> Column:
    """True where the normalised code is listed for its version, false for nulls."""
    return row_key(code, version).isin(listed_keys(codes))


def code_prefix(code: str, version: str, *prefixes: Mapping[int, Sequence[str]]) -> Column:
    """True where the normalised code starts with a prefix that a list has for its version: one pattern for all of them."""
    keys = listed_keys(*prefixes)
    return row_key(code, version).rlike(f"^(?:{'|'.join(map(re.escape, keys))})") if keys else F.lit(False)


def any_group(code: str, version: str, groups: Mapping[str, Mapping[int, Sequence[str]]]) -> Column:
    return code_prefix(code, version, *groups.values())


def group_counts(df: DataFrame, admission: str, code: str, version: str,
                 groups: Mapping[str, Mapping[int, Sequence[str]]]) -> DataFrame:
    """Per prefix group: distinct admissions and code rows.

    The group flags are summed per admission first, so that no distinct set is built over one hot group.
    """
    flags = df.groupBy(admission).agg(
        *[F.sum(code_prefix(code, version, p).cast("long")).alias(g) for g, p in groups.items()])
    long = flags.unpivot([admission], list(groups), "code_group", "n")
    return long.where(F.col("n") > 0).groupBy("code_group").agg(
        F.count(F.lit(1)).alias("admissions"), F.sum("n").alias("code_rows"))


def loose_code(column: str, pattern: str = LOOSE_TARGET_PATTERN) -> Column:
    """True where the text contains the pattern; null text counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).rlike(pattern)
