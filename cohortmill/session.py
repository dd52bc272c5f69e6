"""Session settings and lineage cuts."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def tuned_session(app: str = "cohortmill", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the operators are written for.

    Adaptive execution stays on: it coalesces small partitions, switches to broadcast joins on measured
    sizes, and splits skewed join partitions, which `interval_join` relies on for hot subjects.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **(conf or {}),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the cluster names, else a temporary one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="cohortmill-checkpoint-")
    context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute `df` once and read it back from the shared checkpoint folder.

    Used where a result is needed by more than one job (a size check, then the work itself), so that a lost
    executor costs a re-read and not a re-run of everything upstream.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def freed(spark: SparkSession) -> None:
    """Lets Spark remove the shuffles and checkpoints that no frame refers to any more.

    Spark's cleaner acts when the driver's collector has found them, which on a quiet driver may be long after; between
    the steps of a large job that is disk which is taken twice.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
