"""A session with the settings the engine relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, name: str = "ridgeline", **conf: str) -> SparkSession:
    """UTC clocks, adaptive plans with skew handling, Arrow for kernels. A cluster's own settings win where given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    own = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    for k, v in (own | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and written to the checkpoint folder that all executors share, for plans that read it several times.

    The folder is that of spark.checkpoint.dir, or in local mode, if it is unset, a temporary one.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ridgeline-"))
    return df.checkpoint()
