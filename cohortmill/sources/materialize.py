"""Results kept as tables: fingerprints, signatures, manifests, sinks."""

from __future__ import annotations

import datetime
import hashlib
import json
import re
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_TYPE = "name string, signature string, data_path string, created_at string"


def canonical(value):
    """Settings in one fixed form: mappings by key, sets and lists sorted, so order never matters."""
    if isinstance(value, Mapping):
        return {str(k): canonical(v) for k, v in sorted(value.items(), key=lambda kv: str(kv[0]))}
    if isinstance(value, (list, tuple, set, frozenset)):
        return sorted((canonical(v) for v in value), key=lambda v: json.dumps(v, sort_keys=True))
    return value if isinstance(value, (str, int, float, bool, type(None))) else str(value)


def fingerprint(spark: SparkSession, *paths: str) -> DataFrame:
    """Path, size and modification time of every file below the paths; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def source_digest(files: DataFrame) -> str:
    """Order-free digest of a fingerprint: count, total size and two hash sums over the file rows."""
    row = F.concat_ws("|", "path", "size", F.unix_micros("modified"))
    out = files.agg(F.count(F.lit(1)), F.sum("size"), F.bit_xor(F.xxhash64(row)),
                    F.sum(F.pmod(F.xxhash64(F.reverse(row)), F.lit(2 ** 31)))).first()
    return "-".join(str(v) for v in out)


def signature(config, sources: str = "") -> str:
    """sha256 of the canonical settings and the digest of the sources."""
    text = json.dumps({"config": canonical(config), "sources": sources}, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()


def safe_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not a table name: {name!r}")
    return name


def _manifest(spark: SparkSession, root: str, name: str, sign: str):
    try:
        rows = spark.read.schema(MANIFEST_TYPE).json(f"{root}/_manifest")
        return rows.where((F.col("name") == name) & (F.col("signature") == sign)).orderBy(
            F.desc("created_at")).limit(1).first()
    except AnalysisException:
        return None


def ensure_table(spark: SparkSession, root: str, name: str, sign: str, build: Callable[[], DataFrame],
                 sort_by: Sequence[str] = (), cluster_by: str | None = None, rebuild: bool = False,
                 partition_by: str | None = None) -> DataFrame:
    """The table of this name and signature: read back if it is there, else built, written and read back.

    Data goes to a directory of its own and is published by one appended manifest line, so readers never
    see a half-written table. Rows are clustered by `cluster_by` and sorted by `sort_by`, which lets later
    scans skip row groups; the rebalance keeps files even when one key holds a third of the rows.
    """
    safe_name(name)
    known = None if rebuild else _manifest(spark, root, name, sign)
    if known is None:
        path = f"{root}/{name}/{sign[:16]}-{uuid.uuid4().hex[:8]}"
        table = build()
        table = table.hint("rebalance", cluster_by) if cluster_by else table.hint("rebalance")
        if sort_by:
            table = table.sortWithinPartitions(*sort_by)
        writer = table.write.mode("errorifexists")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        created = datetime.datetime.now(datetime.timezone.utc).isoformat()
        line = spark.createDataFrame([(name, sign, path, created)], MANIFEST_TYPE)
        line.coalesce(1).write.mode("append").json(f"{root}/_manifest")
    else:
        path = known["data_path"]
    return spark.read.parquet(path)


def event_table(spark: SparkSession, root: str, name: str, source: DataFrame, source_paths: Sequence[str], subject: str,
                item: str, ts: str, items: Sequence) -> DataFrame:
    """The events of an item list, written once and reused while the source files and the list stay the same."""
    sign = signature({"items": list(items), "columns": source.columns}, source_digest(fingerprint(spark, *source_paths)))
    build = lambda: source.where(F.col(item).isin(list(items)))
    return ensure_table(spark, root, name, sign, build, sort_by=[subject, item, ts], cluster_by=subject)


#: Folders of a table that is looked up by subject, and the column that names them.
SUBJECT_FOLDERS, FOLDER = 256, "subject_folder"


def _folder(subject: str, folders: int):
    return F.pmod(F.xxhash64(F.col(subject).cast("string")), F.lit(folders)).cast("int")


def lookup_table(spark: SparkSession, root: str, name: str, source: DataFrame, source_paths: Sequence[str], subject: str,
                 item: str, ts: str, items: Sequence, folders: int = SUBJECT_FOLDERS) -> DataFrame:
    """`event_table` laid out for lookups: a folder for each hash of the subject, rows sorted by item, subject and time.

    A folder's rows are written by as many tasks as its size asks for, so a hot subject gets several files.
    """
    config = {"items": list(items), "columns": source.columns, "folders": folders}
    sign = signature(config, source_digest(fingerprint(spark, *source_paths)))
    build = lambda: source.where(F.col(item).isin(list(items))).withColumn(FOLDER, _folder(subject, folders))
    return ensure_table(spark, root, name, sign, build, sort_by=[FOLDER, item, subject, ts], cluster_by=FOLDER, partition_by=FOLDER)


def events_of(table: DataFrame, subjects: DataFrame, subject: str, item: str, items: Sequence, folders: int = SUBJECT_FOLDERS) -> DataFrame:
    """The rows of a `lookup_table` for the given subjects and items, without the folder column.

    The folders of the subjects, at most `folders` numbers, become a filter on the folder names, so the others are not
    opened; the item list reaches the row groups' statistics. A semi join then keeps the subjects asked for.
    """
    wanted = subjects.select(subject).where(F.col(subject).isNotNull()).distinct()
    named = [r[0] for r in wanted.select(_folder(subject, folders).alias(FOLDER)).distinct().collect()]
    there = table.where(F.col(FOLDER).isin(named) & F.col(item).isin(list(items)))
    return there.join(wanted, subject, "left_semi").drop(FOLDER)


def feature_matrix(spark: SparkSession, root: str, name: str, build: Callable[[], DataFrame], config: Mapping,
                   source_paths: Sequence[str], version: int = 1) -> DataFrame:
    """The matrix of these settings and source files, built only when either has changed."""
    sign = signature({"config": config, "version": version}, source_digest(fingerprint(spark, *source_paths)))
    return ensure_table(spark, root, name, sign, build)


# Sinks.

def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; times keep their microseconds."""
    exact = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
    df.write.mode("errorifexists").options(
        header=True, escape='"', timestampFormat=exact, timestampNTZFormat=exact).csv(path)


def write_reports(reports: Mapping[str, DataFrame], folder: str, run_id: str, label: str) -> dict[str, str]:
    """Report tables of a run as CSV folders `<run>_<label>_<name>`, with run and label as columns."""
    tag = re.sub(r"[^A-Za-z0-9_]+", "_", label).strip("_")
    written = {}
    for name, frame in reports.items():
        path = f"{folder}/{run_id}_{tag}_{name}"
        write_csv(frame.withColumns({"run_id": F.lit(run_id), "model_label": F.lit(label)}), path)
        written[name] = path
    return written


def append_rows(df: DataFrame, path: str) -> None:
    """Add result rows, failed ones included, to a growing JSON table; later rows may have other columns."""
    df.write.mode("append").json(path)


def read_rows(spark: SparkSession, path: str, columns: Mapping[str, str]) -> DataFrame:
    """The declared columns of a growing table; a row that lacks one has null there."""
    return spark.read.schema(", ".join(f"`{c}` {t}" for c, t in columns.items())).json(path)


def run_manifest(spark: SparkSession, values: Mapping[str, str], counts: Mapping[str, DataFrame]) -> DataFrame:
    """One row: text settings of a run and the row counts of its tables."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.withColumns({f"{name}_rows": df.agg(F.count(F.lit(1))).scalar() for name, df in counts.items()})
