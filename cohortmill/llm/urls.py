"""URL filters: allow and block rules in a trie over reversed host labels and path segments."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import with_arrow_columns

#: Rule text up to this size is broadcast as a trie; a larger rule table is joined.
MAX_TRIE_BYTES = 64 << 20
_UPPER = {c: c + 32 for c in range(0x41, 0x5B)}
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty for null or without `://`."""
    found = _URL.search(url) if url is not None else None
    return (found[1].translate(_UPPER), found[2]) if found else ("", "")


def build_trie(rules: list[tuple[str, str, str]]) -> dict:
    """Nested dicts: reversed host labels, under None the path segments, under None there the last, open piece.

    The last piece of a rule's path is a prefix of a segment (empty behind a final slash). Of a rule that is both
    allowed and blocked, the block stays.
    """
    trie: dict = {}
    for host, path, action in rules:
        node = trie
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(None, {})
        *whole, last = path.split("/")
        for segment in whole:
            node = node.setdefault(segment, {})
        ends = node.setdefault(None, {})
        rank = (len(host) + len(path), len(host), action == "block")
        ends[last] = max(ends.get(last, ((),)), (rank, host + path, action), key=lambda x: x[0])
    return trie


def longest_rule(trie: dict, host: str, path: str) -> tuple[str | None, str | None]:
    """The longest rule that fits and its action; (None, None) if none fits."""
    best: tuple = ((),)
    segments = path.split("/")
    node = trie
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        level = node.get(None)
        for segment in segments:
            if level is None:
                break
            if ends := level.get(None):
                pieces = ends if len(ends) <= len(segment) else (segment[:k] for k in range(len(segment) + 1))
                for piece in pieces:
                    if segment.startswith(piece) and piece in ends and ends[piece][0] > best[0]:
                        best = ends[piece]
            level = level.get(segment)
    return best[1:] if len(best) > 1 else (None, None)


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
               max_trie_bytes: int = MAX_TRIE_BYTES, drop: tuple[str, ...] = ()) -> DataFrame:
    """`df` with host, path, rule and verdict of every url; rules: host, path, action (allow or block).

    A rule fits its host and all subdomains where the url's path starts with the rule's. The longest rule (host and
    path together, then host) wins; without one the verdict is `default` and the rule null. Null urls and urls without
    `://` have an empty host and path. Rules with a null field are left out. Columns of `df` named like the four new
    ones are replaced, rows are never merged.
    """
    known = rules.select("host", "path", "action").dropna().distinct()
    size = known.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 16)).first()[0] or 0
    if size > max_trie_bytes:
        return _judged_by_join(df, known, url, default, drop)
    handed = df.sparkSession.sparkContext.broadcast(build_trie([tuple(r) for r in known.collect()]))

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        trie, out = handed.value, []
        for text in batch.column(batch.schema.get_field_index(url)).to_pylist():
            host, path = split_url(text)
            rule, action = longest_rule(trie, host, path)
            out.append((host, path, rule, action or default))
        return [pa.array(x, pa.string()) for x in zip(*out, strict=True)]

    kind = T.StringType()
    return with_arrow_columns(df, [(n, kind) for n in ("host", "path", "rule", "verdict")], make, drop)


def _judged_by_join(df: DataFrame, rules: DataFrame, url: str, default: str, drop: tuple[str, ...]) -> DataFrame:
    """The same result without a broadcast: distinct (host, path) meet rules on each host suffix and folder of the path."""
    names = [c for c in df.columns if c not in {"host", "path", "rule", "verdict", *drop}]
    found = F.regexp_extract(F.col(url), r"(?s)://([^/?#]*)([^?#]*)", 0)
    lower = F.translate(F.regexp_extract(F.col(url), r"(?s)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                        "abcdefghijklmnopqrstuvwxyz")
    blank = F.coalesce(found == "", F.lit(True))
    split = df.select(*names, F.when(blank, "").otherwise(lower).alias("host"),
                      F.when(blank, "").otherwise(F.regexp_extract(F.col(url), r"(?s)://[^/?#]*([^?#]*)", 1)).alias("path"))
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    keyed = (split.select("host", "path").distinct()
             .select("*", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)),
                                                lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("key_host"))
             .select("*", F.explode(F.transform(F.sequence(F.lit(1), F.size(segments)),
                                                lambda i: F.array_join(F.slice(segments, F.lit(1), i - 1), "/"))).alias("key_path")))
    cut = F.split("rule_path", "/")
    ruled = (rules.select(F.col("host").alias("key_host"), F.col("path").alias("rule_path"), "action")
             .withColumn("key_path", F.array_join(F.slice(cut, F.lit(1), F.size(cut) - 1), "/")))
    fits = F.startswith(F.col("path"), F.col("rule_path"))
    order = F.struct((F.length("key_host") + F.length("rule_path")).alias("a"), F.length("key_host").alias("b"),
                     (F.col("action") == "block").alias("c"))
    best = (keyed.join(ruled, ["key_host", "key_path"]).where(fits).groupBy("host", "path")
            .agg(F.max_by(F.struct(F.concat("key_host", "rule_path").alias("rule"), "action"), order).alias("best")))
    return (split.join(best, ["host", "path"], "left")
            .select(*names, "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.action", F.lit(default)).alias("verdict")))
