"""Graph traversal: each hop is an equi-join, the end of the path a list for each start.

An edge table names the tables of its two ends. A hop follows only the ends whose table is where the path stands, so ids
of different tables never meet; a path that no declared edge allows leads nowhere, and is an error in strict mode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.catalog import Catalog
from graphloom.operators.links import ID, visible


def _step(name: str, source, columns: list[str] | None, rows: DataFrame, key: str, other: str, to: tuple[str, ...]) -> DataFrame:
    """(__k, __next, __end, __row, __in): from the key to the other end, which is a record of the table ``__in``."""
    row = F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.lit(None).cast("string")
    known = F.lit(to[0] if len(to) == 1 else None).cast("string")
    return rows.select(F.col(key).alias("__k"), F.col(other).alias("__next"), F.col(ID).alias("__end"), row.alias("__row"), known.alias("__in"))


def hop(catalog: Catalog, at: DataFrame | None, tables: tuple[str, ...], part: tuple, condition: Callable | None, columns: list[str] | None) -> tuple[DataFrame | None, tuple[str, ...]]:
    """One hop from ``__at``, a record of one of ``tables``: (__start, __at, __end, __row, __in) and the tables that
    ``__at`` is then of. Over an edge, ``__at`` becomes its other end; over a table, it is the record that was met.
    ``columns`` are those of ``__row``, none if only ids are asked for. ``at`` is None where all records start."""
    steps, reached = [], []
    for name, sides in catalog.sides(tables, part):
        source = catalog.source(name)
        rows = source.df if part[3] is None or condition is None else source.df.where(condition(name, part[3]))
        for key, other, to in sides:
            steps.append(_step(name, source, columns, rows, key or ID, other or ID, to))
            reached += [t for t in to if t not in reached]
    found = None
    for step in steps:
        if at is None:
            one = step.select(F.col("__k").alias("__start"), F.col("__next").alias("__at"), "__end", "__row", "__in")
        else:
            one = at.select("__start", "__at").join(step, F.col("__at") == F.col("__k")).select("__start", F.col("__next").alias("__at"), "__end", "__row", "__in")
        found = one if found is None else found.unionByName(one, allowMissingColumns=True)
    return found, tuple(reached)


def paths(catalog: Catalog, df: DataFrame, table: str | None, hops: list[tuple], condition: Callable | None = None, columns: list[str] | None = None, whole: bool = False) -> DataFrame | None:
    """(__start, __end, __row) for each path from the rows of ``df``, records of ``table``, over all hops; None if the
    declared edges allow no such path.

    A last hop that only names a table is not joined: the edge before it already holds the record's id. Where ``df`` is
    a ``whole`` table, a first hop over edges needs no join with it.
    """
    tables = (table,) if table else ()
    at = None if whole and table and all(catalog.source(n).ends for n, _ in catalog.sides(tables, hops[0])) else df.select(F.col(ID).alias("__start"), F.col(ID).alias("__at"))
    for i, part in enumerate(hops):
        last = i == len(hops) - 1
        node = part[2] != ("?",) and all(not catalog.source(n).ends for n in part[2])
        if node and i and at is not None:
            met = [n for n in part[2] if n in tables or not tables]
            catalog.sides(tables, part)
            if len(tables) > 1 or not met:  # edges that lead to several tables
                at = at.where(F.col("__in").isin(*met) | F.col("__in").isNull()) if met else at.where(F.lit(False))
            if part[3] is None and not (last and columns):
                at, tables = at.withColumn("__end", F.col("__at")).withColumn("__row", F.lit(None).cast("string")), tuple(met)
                continue
        at, tables = hop(catalog, at, tables, part, condition, columns if last else None)
        if at is None:
            return None
    return at.select("__start", "__end", "__row")


def attach(catalog: Catalog, df: DataFrame, table: str | None, hops: list[tuple], end: tuple | None, name: str, condition: Callable | None = None, whole: bool = False) -> DataFrame:
    """``df`` with the list ``name`` of what its paths lead to, in the order of ids; empty where there is none."""
    target = catalog.source(hops[-1][2][0] if hops[-1][2] != ("?",) else next(n for n, s in catalog.sources.items() if s.ends))
    everything = visible(target)
    match end:
        case ("all",):
            columns = everything
        case ("destructure", names):
            columns = [n for n in names if n in everything]
        case ("field", field):
            columns = [field]
        case _:
            columns = []
    found = paths(catalog, df, table, hops, condition, columns or None, whole)
    if found is None:  # the columns still have the types of the records that the path names
        found = target.df.where(F.lit(False)).select(F.col(ID).alias("__start"), F.col(ID).alias("__end"), F.struct(*[F.col(f"`{c}`") for c in columns or everything]).alias("__row"))
    value: Column = F.col("__end") if not columns else F.col("__row") if end[0] != "field" else F.col("__row")[columns[0]]
    lists = found.groupBy("__start").agg(F.sort_array(F.collect_list(F.struct(F.col("__end").alias("k"), value.alias("v")))).alias("__list"))
    kind = lists.schema["__list"].dataType.elementType["v"].dataType
    joined = df.join(lists, df[ID] == lists["__start"], "left")
    empty = F.array().cast(f"array<{kind.simpleString()}>")
    return joined.withColumn(name, F.coalesce(F.transform("__list", lambda x: x["v"]), empty)).drop("__start", "__list")
