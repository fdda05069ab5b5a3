"""Writes as functions: each takes a table's rows and gives its new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.links import ID


def insert(rows: DataFrame, new: DataFrame) -> DataFrame:
    return rows.unionByName(new, allowMissingColumns=True)


def untaken(new: DataFrame, rows: DataFrame, table: str, key: str = ID) -> DataFrame:
    """``new``; when it runs, a key that ``rows`` has is an error."""
    known = rows.select(F.col(key).alias("__known")).distinct()
    message = F.concat(F.lit(f"{table}:"), F.col("__known").cast("string"), F.lit(" exists"))
    joined = new.join(known, new[key] == known["__known"], "left")
    return joined.where(F.when(F.col("__known").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).drop("__known")


def diff(old: DataFrame | None, new: DataFrame | None, names: list[str], key: str = ID) -> DataFrame:
    """A list of (op, path, value) for each record that a write touched, as in a JSON patch; values are JSON texts."""
    op = lambda kind, path, value: F.struct(F.lit(kind).alias("op"), F.lit(path).alias("path"), value.alias("value"))
    whole = F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]))
    if old is None:
        return new.select(F.array(op("replace", "/", whole)).alias("diff"))
    if new is None:
        return old.select(F.array(op("remove", "/", F.lit(None).cast("string"))).alias("diff"))
    before = old.select(F.col(key).alias("__k"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("__old"))
    both = new.join(before, new[key] == before["__k"], "left")
    text = lambda c: F.to_json(F.array(c))
    changes = [F.when(~F.col(f"`{n}`").eqNullSafe(F.col("__old")[n]), op("replace", f"/{n}", F.regexp_extract(text(F.col(f"`{n}`")), r"(?s)^\[(.*)\]$", 1))) for n in names]
    found = F.array_compact(F.array(*changes))
    return both.select(F.when(F.col("__k").isNull(), F.array(op("replace", "/", whole))).otherwise(found).alias("diff"))


def update(rows: DataFrame, changes: dict[str, Column], where: Column | None) -> DataFrame:
    """Changed columns keep their types; a predicate that is null changes nothing."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    types = {f.name: f.dataType for f in rows.schema}
    new = {}
    for name, value in changes.items():
        value = value.cast(types[name]) if name in types else value
        new[name] = F.when(hit, value).otherwise(F.col(f"`{name}`") if name in types else F.lit(None))
    return rows.withColumns(new)


def upsert(rows: DataFrame, new: DataFrame, key: str = ID) -> DataFrame:
    """Rows of ``new`` replace those of the same key; the others are added."""
    return rows.join(new.select(key), key, "left_anti").select(rows.columns).unionByName(new, allowMissingColumns=True)


def delete(rows: DataFrame, where: Column | None) -> DataFrame:
    """A null predicate keeps its row."""
    return rows.where(F.lit(False) if where is None else ~F.coalesce(where, F.lit(False)))


def relate(pairs: DataFrame, start: str, end: str, content: dict[str, Column] | None = None, unique: bool = False) -> DataFrame:
    """Edge rows (in, out, content…) of a frame that has a pair a row."""
    edges = pairs.select(F.col(start).alias("in"), F.col(end).alias("out"), *[v.alias(n) for n, v in (content or {}).items()])
    return edges.distinct() if unique else edges
