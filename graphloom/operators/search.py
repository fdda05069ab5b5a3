"""Nearest neighbours and full-text ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import functions as library

DISTANCES = {"EUCLIDEAN": "vector::distance::euclidean", "MANHATTAN": "vector::distance::manhattan", "CHEBYSHEV": "vector::distance::chebyshev", "HAMMING": "vector::distance::hamming", "COSINE": "vector::similarity::cosine", "PEARSON": "vector::similarity::pearson", "JACCARD": "vector::similarity::jaccard"}


def distance(metric: str, a: str, b: str) -> str:
    sql = library.find(DISTANCES[metric.upper()]).render([a, b])
    return f"(1D - {sql})" if "similarity" in DISTANCES[metric.upper()] else sql


def knn(df: DataFrame, column: str, vector: str, k: int, metric: str = "EUCLIDEAN", tie: str | None = None) -> DataFrame:
    """The ``k`` nearest rows with ``__knn_dist``: each task keeps its best k, only these are merged."""
    order = [F.col("__knn_dist")] + ([F.col(tie)] if tie else [])
    return df.withColumn("__knn_dist", F.expr(distance(metric, column, vector))).orderBy(*order).limit(k)


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bm25(df: DataFrame, key: str, text: str, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the rows that hold a term of the query, after Okapi BM25.

    Only the query's terms leave the scan: a row carries its length and its counts of them, so what is shuffled and
    sent on are a handful of sums.
    """
    wanted = sorted({t for t in query.lower().split() if t.isalnum()})
    tokens = df.select(key, terms(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    counts = [F.size(F.filter("w", _equals(t))).alias(f"t{i}") for i, t in enumerate(wanted)]
    counted = tokens.select(key, F.size("w").alias("n"), *counts)
    sums = counted.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.sum((F.col(f"t{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(wanted))]).first()
    score = F.lit(0.0)
    for i in range(len(wanted)):
        have = sums[f"d{i}"] or 0
        idf = F.log(F.lit(1 + (sums["docs"] - have + 0.5) / (have + 0.5)))
        tf = F.col(f"t{i}")
        score = score + idf * tf * (k1 + 1) / (tf + F.lit(k1) * (1 - b + b * F.col("n") / F.lit(sums["mean"] or 1.0)))
    return counted.select(key, score.alias("score")).where("score > 0")


def _equals(term: str):
    return lambda x: x == term
