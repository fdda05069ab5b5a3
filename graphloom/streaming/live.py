"""LIVE SELECT: the batch plan of a query over a streaming table, and windows with watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.planner import Engine


def live(engine: Engine, table: str, stream: DataFrame, key: str, text: str, **params) -> DataFrame:
    """The streaming frame of a query (LIVE SELECT or SELECT) whose FROM is the streaming table."""
    engine.register(table, stream, key)
    return engine.query(text, **params)


def start(df: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Run a streaming frame; ``handler`` gets each batch of changes once the checkpoint says so."""
    return df.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def tumbling(df: DataFrame, at: str, size: str, *aggregates: Column, by: tuple[str, ...] = (), late: str = "0 seconds") -> DataFrame:
    """Aggregates of windows of one size, over rows or a stream; rows later than ``late`` are dropped from a stream."""
    if df.isStreaming:
        df = df.withWatermark(at, late)
    grouped = df.groupBy(F.window(at, size), *by).agg(*aggregates)
    return grouped.select(F.col("window.start").alias("window_start"), *by, *[c for c in grouped.columns if c not in ("window", *by)])
