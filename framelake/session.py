"""Session defaults used by tests, the bench and stand-alone use."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

#: Runtime re-planning is left to AQE; the session zone is pinned so that zone-less
#: timestamps read the same everywhere.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "framelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this library's defaults; ``conf`` overrides them (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; only where none is set (tests) a local one is made."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("FRAMELAKE_CHECKPOINT_DIR")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="framelake-checkpoint-")
    context.setCheckpointDir(named)
    return named


def cut(df):
    """``df`` written to the shared checkpoint folder, so that a lost executor costs only a read."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
