"""Statements as DataFrames. Plans are declared; Catalyst orders joins, pushes filters and prunes columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom import kinds as K
from graphloom.catalog import Catalog, Source
from graphloom.errors import FieldNotFound, ParameterNotFound, QueryError, RecordExists, TableNotFound, Unimplemented, UnexpectedSyntax
from graphloom.operators import graph, links, writes
from graphloom.operators.links import ID, visible
from graphloom.plans import analyzer
from graphloom.plans.compiler import Compiler, literal, quote
from graphloom.syntax import N, Node, Statement, parse, path_text


class Engine:
    """Runs texts against a catalogue. Writes replace the catalogue's frames; nothing is written to storage."""

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None):
        self.spark, self.catalog = spark, catalog or Catalog()
        self._udfs = False

    def register(self, name: str, df: DataFrame, key: str, **more) -> None:
        """``key`` is a column or an SQL expression; timestamps without a zone are taken to be UTC."""
        df = df.withColumns({f.name: F.col(f"`{f.name}`").cast("timestamp") for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)})
        self.catalog.register(name, df, key, **more)
        self.catalog.sources[name].df = df.withColumn(ID, F.expr(key))

    def execute(self, text: str, **params) -> list:
        """A DataFrame for each statement that has rows; other statements give None."""
        out = []
        for s in parse(text):
            out.append(self._run(s, params))
        return out

    def query(self, text: str, **params) -> DataFrame:
        """The DataFrame of the last statement."""
        return self.execute(text, **params)[-1]

    def kind(self, text: str) -> K.Kind:
        return analyzer.analyze(self.catalog.copy(), text)

    def _run(self, s: Statement, params: dict):
        if s.type.startswith("DEFINE"):
            return self.catalog.define(s)
        match s.type:
            case "SELECT":
                return self.select(s, params)
            case "VALUE" | "RETURN":
                if s.body.type == "subquery":
                    return self._run(s.body[0], params)
                return self.spark.range(1).select(self._expr(Compiler(self.catalog, params)(s.body)).alias("value"))
            case "LET":
                params[s.name] = self._let(s.body, params)
                return None
            case "CREATE" | "INSERT" | "UPDATE" | "UPSERT" | "DELETE" | "RELATE":
                return getattr(self, s.type.lower())(s, params)
            case "LIVE":
                return self._run(s.body, params)
        raise Unimplemented(f"{s.type} cannot be run")

    def _let(self, body: Node, params: dict):
        """A value for later statements. A subquery's rows come to the driver, so it must have a LIMIT or be ONLY."""
        if body.type == "subquery":
            inner = body[0]
            if inner.type == "SELECT" and not (inner.only or inner.limit):
                raise UnexpectedSyntax("LET takes a subquery with LIMIT or ONLY")
            rows = [r.asDict(recursive=True) for r in self._run(inner, params).collect()]
            if inner.value:
                rows = [next(iter(r.values())) for r in rows]
            return rows[0] if inner.only and rows else rows
        return self.spark.range(1).select(self._expr(Compiler(self.catalog, params)(body)).alias("v")).first()["v"]

    def _expr(self, sql: str):
        if "graphloom_" in sql and not self._udfs:
            from graphloom.functions import udfs

            udfs.register(self.spark)
            self._udfs = True
        return F.expr(sql)

    # sources
    def _scan(self, what: Node, params: dict) -> tuple[str | None, DataFrame]:
        if what.type == "subquery":
            return None, self._run(what[0], params)
        if what.type == "param" and what[0] in params and what[0] not in ("auth", "token"):
            v = params[what[0]]
            if isinstance(v, DataFrame):
                return None, v
            if isinstance(v, str) and ":" in v:
                what = N("string", v)
        if what.type == "array":
            rows = self.spark.range(1).select(F.explode(F.expr(Compiler(self.catalog, params)(what))).alias("value"))
            return None, rows
        name = analyzer.target_table(self.catalog, what)
        if name not in self.catalog.tables:
            raise TableNotFound(f"no table {name}")
        df = self.catalog.source(name).df
        key = self._key(what, params)
        return name, df if key is None else df.where(F.col(ID) == key)

    def _key(self, what: Node, params: dict):
        match what.type:
            case "thing":
                return F.expr(Compiler(self.catalog, params)(what))
            case "string":
                return F.lit(what[0].split(":", 1)[1])
            case "param" if what[0] == "auth":
                return F.lit(self.catalog.auth[1])
        return None

    # SELECT
    def select(self, s: Statement, params: dict) -> DataFrame:
        parts = [self._scan(w, params) for w in s.what]
        table, df = parts[0]
        for _, other in parts[1:]:
            df = df.unionByName(other, allowMissingColumns=True)
        if table is None and ID not in df.columns:
            df = df.withColumn(ID, F.lit(None).cast("long"))
        made: dict[str, str] = {}
        shown = [c for c in df.columns if not c.startswith("__") and (table is None or c not in self.catalog.source(table).hidden)]
        every = [e for e, _ in s.fields] + [s.where] + [e for e, _ in s.order]
        compile_ = Compiler(self.catalog, params, table, made, False, self._subquery(params), set(shown))
        where, near = self._nearest(s.where)
        late = []
        whole = len(s.what) == 1 and s.what[0].type == "idiom"
        for e in _conjuncts(where):  # what needs no path is filtered before paths are joined
            if _own(e):
                df, whole = df.where(compile_(e)), False
            else:
                late.append(e)
        df = self._joins(df, table, [e for e in every if e is not None], made, params, whole)
        for e in late:
            df = df.where(compile_(e))
        if near is not None:
            *_, k, sql = compile_.distance(near)
            df = df.withColumn("__knn_dist", self._expr(sql)).orderBy("__knn_dist", ID).limit(k)
        for path in s.split:
            df = df.withColumn(path[0][1], F.explode(F.col(f"`{path[0][1]}`")))
        if s.group is not None:
            out = self._grouped(s, df, table, made, params)
            out = self._ordered(s, out, Compiler(self.catalog, params, None, {}, False, None, set(out.columns)), set(out.columns), params)
        else:
            aliases = {alias: e for e, alias in s.fields if alias}
            out = self._ordered(s, df, compile_, set(), params, aliases)
            out = self._project(s, out, table, made, shown, compile_)
        if s.only and not (len(s.what) == 1 and s.what[0].type == "thing"):
            if len(out.limit(2).collect()) > 1:
                raise UnexpectedSyntax("ONLY met several rows")
            out = out.limit(1)
        return out

    def _subquery(self, params: dict):
        def run(s: Statement) -> str:
            inner = self._run(s, params)
            view = f"graphloom_sub_{uuid.uuid4().hex[:12]}"
            inner.select(inner.columns[0]).createOrReplaceTempView(view)
            return f"(SELECT {quote(inner.columns[0])} FROM {view})"

        return run

    @staticmethod
    def _nearest(where: Node | None) -> tuple[Node | None, Node | None]:
        """A condition without its nearest-neighbour part, and that part."""
        if where is None or where.type == "knn":
            return None, where
        if where.type == "binary" and where[0] in ("AND", "&&"):
            left, a = Engine._nearest(where[1])
            right, b = Engine._nearest(where[2])
            rest = N("binary", "AND", left, right) if left is not None and right is not None else left if left is not None else right
            return rest, a if a is not None else b
        return where, None

    def _joins(self, df: DataFrame, table: str | None, every: list[Node], made: dict[str, str], params: dict, whole: bool = False) -> DataFrame:
        """Columns for graph paths, and rows of links that paths lead through. Each path is joined once."""
        if table is None:
            return df
        for e in every:
            for idiom in _idioms(e):
                parts = idiom[0]
                hops = [p for p in parts if p[0] == "graph"]
                text = path_text(parts)
                if hops and text not in made:
                    lead = [p[1] for p in parts[: parts.index(hops[0])] if p[0] == "field"]
                    start, first = df, table
                    for step in lead:
                        first = self.catalog.link(first, step) if first in self.catalog.tables else None
                    if lead:
                        start = df.withColumn("__own", F.col(ID)).withColumn(ID, F.col(".".join(map(quote, lead))))
                    end = parts[-1] if parts[-1][0] in ("all", "destructure", "field") else None
                    made[text] = name = f"__path{len(made)}"
                    condition = lambda t, c: F.expr(Compiler(self.catalog, params, t, {}, False, None, set(visible(self.catalog.source(t))))(c))
                    df = graph.attach(self.catalog, start, first, hops, end, name, condition, whole and not lead)
                    if lead:
                        df = df.withColumn(ID, F.col("__own")).drop("__own")
                elif not hops and len(parts) > 1 and parts[0][0] == "field" and parts[1][0] in ("field", "destructure", "all"):
                    df = self._link(df, table, parts[0][1], made, params)
        return df

    def _link(self, df: DataFrame, table: str, field: str, made: dict[str, str], params: dict) -> DataFrame:
        to = self.catalog.link(table, field)
        if to is None or field in made or to not in self.catalog.sources:
            return df
        if isinstance(df.schema[field].dataType, T.ArrayType):
            name = f"__link{len(made)}"
            df = links.fetch(df.withColumn(name, F.col(quote(field))), [name], self.catalog.source(to))
        else:
            rows = links.packed(self.catalog.source(to)).withColumnsRenamed({"__k": f"__k{len(made)}", "__row": f"__link{len(made)}"})
            name = f"__link{len(made)}"
            df = df.join(rows, F.col(quote(field)) == F.col(f"__k{len(made)}"), "left").drop(f"__k{len(made)}")
        # the bare link keeps its id; only longer paths go through the row
        for step in [f.name for f in self._struct(df.schema[name].dataType)]:
            made[f"{field}.{step}"] = f"{name}.{quote(step)}"
        made[f"{field}.*"] = name
        made[f"{field}#"] = name
        return df

    @staticmethod
    def _struct(kind: T.DataType):
        return kind.elementType if isinstance(kind, T.ArrayType) else kind

    def _project(self, s: Statement, df: DataFrame, table: str | None, made: dict[str, str], shown: list[str], compile_: Compiler) -> DataFrame:
        fetched = {path_text(p): p for p in s.fetch}
        items: list[tuple[str, str]] = []
        skip = {path_text(p) for p in s.omit}
        nested = [path_text(p) for p in s.omit if len(p) > 1]
        if s.value:
            e, _ = s.fields[0]
            name = path_text(e[0]) if e.type == "idiom" else "value"
            df = self._fetch(df, table, fetched, {name})
            return df.select(self._expr(compile_(e)).alias(name.split(".")[-1] if e.type == "idiom" else "value"))
        star = any(analyzer._star(e) for e, _ in s.fields)
        if star:
            low = {p.lower() for p in skip}
            items += [(c, quote(c)) for c in shown if c.lower() not in low]
        for e, alias in s.fields:
            if analyzer._star(e) or e.type == "idiom" and path_text(e[0]) in skip:
                continue
            items.append(self._item(e, alias, compile_, made))
        names = [n for n, _ in items]
        df = self._fetch(df, table, fetched, set(names))
        columns: dict[str, object] = {}
        for name, sql in items:
            columns[name] = self._expr(sql).alias(name)  # a later item of the same name wins
        if star and nested:
            kinds = {f.name: f.dataType for f in df.schema}
            for path in nested:
                first, rest = path.split(".", 1)
                match = next((c for c in columns if c.lower() == first.lower()), None)
                if match and isinstance(kinds.get(match), T.StructType):
                    columns[match] = F.col(quote(match)).dropFields(rest).alias(match)
        if not columns:
            raise FieldNotFound("nothing is left to select")
        return df.select(*columns.values())

    def _item(self, e: Node, alias: str | None, compile_: Compiler, made: dict[str, str]) -> tuple[str, str]:
        if e.type == "idiom":
            parts = e[0]
            text = path_text(parts)
            hops = [p for p in parts if p[0] == "graph"]
            if hops:
                sql = made[text]
                if alias:
                    return alias, sql
                for hop in reversed(hops[1:]):
                    sql = f"named_struct({literal(path_text([hop]))}, {sql})"
                return path_text([hops[0]]), sql
            names = [p[1] for p in parts if p[0] == "field"]
            if parts[-1][0] == "destructure":
                base = made.get(f"{names[0]}#") if len(names) == 1 else None
                if base is None:
                    base = compile_(N("idiom", parts[:-1]))
                return alias or ".".join(names), "struct(" + ", ".join(f"{base}.{quote(n)} AS {quote(n)}" for n in parts[-1][1]) + ")"
            return alias or (".".join(names) if parts[-1][0] in ("all", "field") else text), compile_(e)
        return alias or analyzer.label(e), compile_(e)

    def _fetch(self, df: DataFrame, table: str | None, fetched: dict, wanted: set[str]) -> DataFrame:
        """Expand links of fields that are projected, shortest paths first."""
        if table is None:
            return df
        for text, parts in sorted(fetched.items(), key=lambda x: len(x[1])):
            path, at = [p[1] for p in parts], table
            if path[0] not in wanted:
                continue
            for i, step in enumerate(path):
                to = self.catalog.link(at, step)
                if to is None:
                    break
                if i == len(path) - 1 or ".".join(path[: i + 1]) not in fetched:
                    df = links.fetch(df, path[: i + 1], self.catalog.source(to))
                at = to
        return df

    def _grouped(self, s: Statement, df: DataFrame, table: str | None, made: dict[str, str], params: dict) -> DataFrame:
        plain = Compiler(self.catalog, params, table, made, False, self._subquery(params), set(df.columns))
        total = Compiler(self.catalog, params, table, made, True, self._subquery(params), set(df.columns))
        aliases = {alias: e for e, alias in s.fields if alias}
        keys: dict[str, str] = {}
        for path in s.group:
            text = path_text(path)
            keys[text] = plain(aliases[text]) if text in aliases else plain(N("idiom", path))
        names = {text: f"__g{i}" for i, text in enumerate(keys)}
        aggregates, out = [], []
        for i, (e, alias) in enumerate(s.fields):
            name = alias or analyzer.label(e)
            text = path_text(e[0]) if e.type == "idiom" else ""
            if name in keys or text in keys:
                out.append(F.col(names[name if name in keys else text]).alias(name))
                continue
            sql = total(e)
            if not total._aggregated((e,)) and e.type not in ("number", "string", "bool"):
                sql = f"collect_list({sql})"
            aggregates.append(self._expr(sql).alias(f"__a{i}"))
            out.append(F.col(f"__a{i}").alias(name))
        grouped = df.groupBy(*[self._expr(sql).alias(names[t]) for t, sql in keys.items()])
        if not aggregates:
            return grouped.agg(F.count("*")).select(*out)
        return grouped.agg(*aggregates).select(*out)

    def _ordered(self, s: Statement, df: DataFrame, compile_: Compiler, own: set[str], params: dict, aliases: dict | None = None) -> DataFrame:
        order = []
        for e, down in s.order:
            text = path_text(e[0]) if e.type == "idiom" else ""
            sql = "rand()" if e.type == "call" and e[0].lower() == "rand" else quote(text) if text in own else compile_((aliases or {}).get(text, e))
            column = self._expr(sql)
            order.append(column.desc_nulls_last() if down else column.asc_nulls_first())
        if order:
            df = df.orderBy(*order)
        if s.start is not None:
            df = df.offset(self._number(s.start, params))
        return df if s.limit is None else df.limit(self._number(s.limit, params))

    @staticmethod
    def _number(e: Node, params: dict) -> int:
        if e.type == "number":
            return int(e[0])
        if e.type == "param" and e[0] in params:
            return int(params[e[0]])
        raise ParameterNotFound("LIMIT and START take a number or a parameter")

    # writes
    def _changes(self, s: Statement, table: str, params: dict) -> dict[str, str]:
        """Column texts of the data of a write, for each column that it sets."""
        source = self.catalog.source(table)
        names = [c for c in source.df.columns if not c.startswith("__")]
        compile_ = Compiler(self.catalog, params, table, {}, False, None, set(names))
        if s.data is None:
            return {}
        match s.data[0]:
            case "SET":
                out = {}
                for path, how, value in s.data[1]:
                    name, sql = path[0][1], compile_(value)
                    if len(path) > 1:
                        raise Unimplemented("SET of a nested path; replace the object")
                    if how != "=":
                        array = isinstance(source.df.schema[name].dataType, T.ArrayType) if name in names else False
                        old = f"coalesce({quote(name)}, array())" if array else f"coalesce({quote(name)}, 0)"
                        sql = {"+=": f"array_append({old}, {sql})" if array else f"({old} + {sql})", "-=": f"array_remove({old}, {sql})" if array else f"({old} - {sql})", "+?=": f"array_union({old}, array({sql}))"}[how]
                    out[name] = sql
                return out
            case "UNSET":
                return {path[0][1]: "NULL" for path in s.data[1]}
            case "PATCH":
                body = self._object(s.data[1], params)
                items = s.data[1][0] if s.data[1].type == "array" else None
                if items and all(o.type == "object" and {"op", "path"} <= dict(o[0]).keys() for o in items):
                    out = {}
                    for o in items:
                        d = dict(o[0])
                        out[d["path"][0].strip("/")] = "NULL" if d["op"][0] == "remove" else compile_(d["value"])
                    return out
                return {n: compile_(v) for n, v in body.items()}
            case "MERGE":
                return {n: compile_(v) for n, v in self._object(s.data[1], params).items()}
        body = {n: compile_(v) for n, v in self._object(s.data[1], params).items()}
        keep = {source.key, *(source.ends or ())}
        return {n: body.get(n, "NULL") for n in names if n in body or n not in keep} | body

    def _object(self, e: Node, params: dict) -> dict[str, Node]:
        if e.type == "param":
            value = params.get(e[0])
            if not isinstance(value, dict):
                raise ParameterNotFound(f"${e[0]} must be an object")
            return {n: N("param", f"{e[0]}.{n}") for n in value if not params.update({f"{e[0]}.{n}": value[n]})}
        return dict(e[0]) if e.type == "object" else {}

    def _rows(self, table: str, given: list[dict[str, str]], key=None) -> DataFrame:
        """New rows with the columns and types of a table."""
        source = self.catalog.source(table)
        own = [f for f in source.df.schema if f.name != ID]
        structs = []
        for values in given:
            texts = [key if key is not None and f.name == source.key else values.get(f.name, "NULL") for f in own]
            structs.append(F.struct(*[F.expr(sql).cast(f.dataType).alias(f.name) for f, sql in zip(own, texts, strict=True)]))
        rows = self.spark.range(1).select(F.inline(F.array(*structs)))
        return rows.withColumn(ID, F.expr(key if key is not None else source.key).cast(source.df.schema[ID].dataType))

    def _untaken(self, new: DataFrame, table: str) -> DataFrame:
        """``new``, given as literals; an id that the table has, or that comes twice, is an error."""
        ids = new.select(ID).where(F.col(ID).isNotNull())
        taken = ids.join(self.catalog.source(table).df.select(ID), ID, "left_semi")
        taken = taken.union(ids.groupBy(ID).count().where("count > 1").select(ID)).first()
        if taken is not None:
            raise RecordExists(f"{table}:{taken[0]} exists")
        return new

    def _returned(self, s: Statement, table: str, params: dict, old: DataFrame | None, new: DataFrame | None) -> DataFrame:
        """What RETURN asks for: rows as they are after the write, or before it, their differences, or columns."""
        source = self.catalog.source(table)
        names = [c for c in visible(source) if c in (new if new is not None else old).columns]
        if s.output in ("NONE", "NULL") or s.output == "BEFORE" and old is None or s.output in (None, "AFTER") and new is None:
            return (new if new is not None else old).select(*names).limit(0)
        if s.output == "BEFORE":
            return old.select(*names)
        if s.output == "DIFF":
            return writes.diff(old, new, names)
        if isinstance(s.output, list):
            compile_ = Compiler(self.catalog, params, table, {}, False, self._subquery(params), set(names))
            return (new if new is not None else old).select(*[self._expr(compile_(e)).alias(alias or analyzer.label(e)) for e, alias in s.output])
        return new.select(*names)

    def _target(self, s: Statement, params: dict) -> tuple[str, str | None, str | None]:
        """The table, the SQL of a record's key and that of the condition."""
        if not s.what:
            raise UnexpectedSyntax("the statement names no table")
        what = s.what[0]
        table = analyzer.target_table(self.catalog, what)
        self.catalog.table(table)
        key = None
        if what.type == "thing":
            key = Compiler(self.catalog, params)(what)
        elif what.type == "string":
            key = literal(what[0].split(":", 1)[1])
        where = None if key is None else f"({ID} = {key})"
        if s.where is not None:
            names = set(visible(self.catalog.source(table)))
            sql = Compiler(self.catalog, params, table, {}, False, self._subquery(params), names)(s.where)
            where = sql if where is None else f"({where} AND {sql})"
        return table, key, where

    def create(self, s: Statement, params: dict) -> DataFrame:
        table, key, _ = self._target(s, params)
        new = self._untaken(self._rows(table, [self._changes(s, table, params)], key), table)
        source = self.catalog.source(table)
        source.df = writes.insert(source.df, new)
        return self._returned(s, table, params, None, new)

    def insert(self, s: Statement, params: dict) -> DataFrame:
        table, _, _ = self._target(s, params)
        source = self.catalog.source(table)
        compile_ = Compiler(self.catalog, params, table, {}, False, None, set(source.df.columns))
        if s.data[0] == "VALUES":
            given = [dict(zip(s.data[1], map(compile_, row), strict=True)) for row in s.data[2]]
        elif s.data[1].type == "subquery":
            new = writes.untaken(self._run(s.data[1][0], params).withColumn(ID, F.expr(source.key)), source.df, table)
            source.df = writes.insert(source.df, new)
            return new.select(*[c for c in visible(source) if c in new.columns])
        else:
            objects = s.data[1][0] if s.data[1].type == "array" else [s.data[1]]
            given = [{n: compile_(v) for n, v in self._object(o, params).items()} for o in objects]
        new = self._rows(table, given)
        if s.split or s.value:  # ON DUPLICATE KEY UPDATE, IGNORE
            fresh = new.join(source.df.select(ID), ID, "left_anti").select(source.df.columns)
            if s.split:
                changes = {path[0][1]: F.expr(compile_(v)) for path, _, v in s.split}
                known = source.df.join(new.select(ID), ID, "left_semi").select(source.df.columns)
                source.df = writes.upsert(source.df, writes.update(known, changes, None))
            source.df = writes.insert(source.df, fresh)
            return self._returned(s, table, params, None, fresh)
        source.df = writes.insert(source.df, self._untaken(new, table))
        return self._returned(s, table, params, None, new)

    def update(self, s: Statement, params: dict) -> DataFrame:
        table, _, where = self._target(s, params)
        source = self.catalog.source(table)
        hit = None if where is None else F.expr(where)
        old = source.df
        changes = {n: self._expr(sql) for n, sql in self._changes(s, table, params).items()}
        changed = old if hit is None else old.where(hit)
        source.df = writes.update(old, changes, hit)
        return self._returned(s, table, params, changed, writes.update(changed, changes, None))

    def upsert(self, s: Statement, params: dict) -> DataFrame:
        table, key, where = self._target(s, params)
        if key is None:
            return self.create(s, params) if where is None else self.update(s, params)
        source = self.catalog.source(table)
        old = source.df.where(F.expr(where))
        texts = self._changes(s, table, params)
        changed = writes.update(old, {n: F.expr(sql) for n, sql in texts.items()}, None)
        fresh = self._rows(table, [{n: t for n, t in texts.items() if f"`{n}`" not in t}], key).join(old.select(ID), ID, "left_anti").select(source.df.columns)
        new = changed.unionByName(fresh, allowMissingColumns=True)
        source.df = writes.upsert(source.df, new)
        return self._returned(s, table, params, old, new)

    def delete(self, s: Statement, params: dict) -> DataFrame:
        table, _, where = self._target(s, params)
        source = self.catalog.source(table)
        gone = source.df if where is None else source.df.where(F.expr(where))
        source.df = writes.delete(source.df, None if where is None else F.expr(where))
        return self._returned(s, table, params, gone, None)

    def relate(self, s: Statement, params: dict) -> DataFrame:
        """A new edge between two records, or one for each row of a subquery that gives both ends."""
        edge = self.catalog.source(s.table)
        start, end = edge.ends
        if s.what[0].type == "subquery" and s.what[0] == s.what[1]:
            pairs = self._run(s.what[0][0], params)
            a, b = pairs.columns[:2]
            new = pairs.select(F.col(a).alias(start), F.col(b).alias(end)).distinct()
            new = new.withColumn(ID, F.expr(edge.key))
        else:
            ends = [Compiler(self.catalog, params)(w) for w in s.what]
            texts = self._changes(s, s.table, params)
            new = self._rows(s.table, [texts | {start: ends[0], end: ends[1]}])
        edge.df = writes.insert(edge.df, new)
        return new.select(*[c for c in visible(edge) if c in new.columns])


def _conjuncts(where: Node | None) -> list[Node]:
    if where is None:
        return []
    if where.type == "group":
        return _conjuncts(where[0])
    if where.type == "binary" and where[0] in ("AND", "&&"):
        return _conjuncts(where[1]) + _conjuncts(where[2])
    return [where]


def _own(e: Node) -> bool:
    """Whether an expression reads only columns of the row itself."""
    return all(len(x[0]) == 1 and x[0][0][0] == "field" for x in _idioms(e))


def _idioms(e):
    """All paths of an expression, but not those inside subqueries."""
    if isinstance(e, Node):
        if e.type == "idiom":
            yield e
            for p in e[0]:
                if p[0] == "value":
                    yield from _idioms(p[1])
        elif e.type != "subquery":
            for x in e.v:
                yield from _idioms(x)
    elif isinstance(e, tuple):
        for x in e:
            yield from _idioms(x)


__all__ = ["Engine", "QueryError", "Source"]
