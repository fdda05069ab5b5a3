"""One place that builds the Spark session with the settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "graphloom") -> SparkSession:
    """A session in UTC with AQE on; ``master`` falls back to ``local[*]`` only when none is configured."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    elif "MASTER" not in os.environ and SparkSession.getActiveSession() is None:
        builder = builder.master("local[*]")
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
