"""FETCH: record links are equi-joins with the linked table, its row packed in a struct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.catalog import Source

ID = "__id"


def visible(source: Source) -> list[str]:
    return [c for c in source.df.columns if not c.startswith("__") and c not in source.hidden]


def packed(source: Source, only: list[str] | None = None) -> DataFrame:
    """(__k, __row): the id and the row of each record; only the wanted members are read."""
    columns = [c for c in visible(source) if only is None or c in only]
    return source.df.select(F.col(ID).alias("__k"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"))


def fetch(df: DataFrame, path: list[str], target: Source, row_id: str = ID) -> DataFrame:
    """``df`` with the link or the array of links at ``path`` replaced by rows of ``target``.

    A dangling link becomes null. Order and repeats of an array are kept; its rows come back by ``row_id``.
    """
    at = F.col(".".join(f"`{p}`" for p in path))
    kind = df.select(at.alias("x")).schema["x"].dataType
    rows = packed(target)
    if isinstance(kind, T.ArrayType):
        each = df.select(F.col(row_id).alias("__r"), F.posexplode(at).alias("__p", "__l"))
        found = each.join(rows, each["__l"] == rows["__k"], "left").groupBy("__r").agg(F.sort_array(F.collect_list(F.struct("__p", "__row"))).alias("__rows"))
        empty = F.array().cast(T.ArrayType(rows.schema["__row"].dataType))
        joined = df.join(found, df[row_id] == found["__r"], "left")
        value = F.when(at.isNotNull(), F.coalesce(F.transform("__rows", lambda x: x["__row"]), empty))
        return _put(joined, path, value).drop("__r", "__rows")
    joined = df.join(rows, at == F.col("__k"), "left")
    return _put(joined, path, F.col("__row")).drop("__k", "__row")


def _put(df: DataFrame, path: list[str], value: Column) -> DataFrame:
    if len(path) == 1:
        return df.withColumn(path[0], value)
    return df.withColumn(path[0], F.col(f"`{path[0]}`").withField(".".join(f"`{p}`" for p in path[1:]), value))
