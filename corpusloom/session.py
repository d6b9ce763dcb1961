"""Spark sessions with the settings that the plans expect."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "corpusloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution and Arrow; on a cluster leave master to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (settings | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, computed and kept in the folder that the cluster names in spark.checkpoint.dir; a local one where that is unset."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="corpusloom-"))
    return df.checkpoint()
