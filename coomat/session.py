"""Session and lineage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "coomat", master: str | None = None, **conf) -> SparkSession:
    """The running session, or a new one with adaptive execution and UTC."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use the folder in spark.checkpoint.dir; in local mode a temporary one where none is named.

    On a cluster executors don't share the driver's folders, so there a missing setting is an error.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "checkpoints"))


def settled(df: DataFrame, eager: bool = True) -> DataFrame:
    """The same rows without their lineage, from the shared checkpoint folder."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint(eager)
