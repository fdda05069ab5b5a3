"""Readers and writers of storage formats, and the model of the star schema of TESTDATA.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans.planner import Engine

#: table: key, links, (from table, its column, to table, its column) of edges.
MODEL: dict[str, tuple[str, dict[str, str], tuple[str, str, str, str] | None]] = {
    "region": ("r_regionkey", {}, None),
    "nation": ("n_nationkey", {"n_regionkey": "region"}, None),
    "customer": ("c_custkey", {"c_nationkey": "nation"}, None),
    "supplier": ("s_suppkey", {"s_nationkey": "nation"}, None),
    "part": ("p_partkey", {}, None),
    "orders": ("o_orderkey", {"o_custkey": "customer"}, None),
    "lineitem": ("concat(l_orderkey, ':', l_linenumber)", {}, ("orders", "l_orderkey", "part", "l_partkey")),
    "events": ("event_id", {}, None),
    "documents": ("doc_id", {}, None),
    "embeddings": ("vec_id", {}, None),
    "pages": ("page_id", {}, None),
    "benchmark": ("item_id", {}, None),
    "labels": ("doc_id", {"doc_id": "documents"}, None),
    "conversations": ("concat(conv_id, ':', turn)", {}, None),
}


def read(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """Any format that Spark reads: parquet, orc, csv, json, text, jdbc."""
    reader = spark.read.format(format).options(**options)
    return reader.load() if format == "jdbc" else reader.load(path)


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    df.write.format(format).mode(mode).partitionBy(*partition_by).save(path)


def load_model(spark: SparkSession, directory: str, tables: tuple[str, ...] | None = None) -> Engine:
    """An engine over the tables of a directory; only the named ones are opened."""
    engine = Engine(spark)
    for name in tables or MODEL:
        key, links, relation = MODEL[name]
        engine.register(name, read(spark, f"{directory}/{name}.parquet"), key, links=links, relation=relation)
    return engine
