"""What is known of tables: their declared fields, their links and edges, and where their rows are."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from graphloom import kinds as K
from graphloom.errors import FieldNotFound, InvalidPath, SchemaViolation, TableNotFound, TypeMismatch
from graphloom.syntax import Statement


@dataclass
class Table:
    name: str
    fields: dict[str, K.Kind | None] = field(default_factory=dict)
    relation: tuple[tuple[str, ...], tuple[str, ...]] | None = None


@dataclass
class Source:
    """Rows of a table: ``key`` is its id, ``ends`` are the columns of an edge table that hold its two ends."""

    df: DataFrame
    key: str
    ends: tuple[str, str] | None = None
    hidden: tuple[str, ...] = ()


class Catalog:
    """Definitions by table and path. A later definition of a field replaces an earlier one; in strict mode one of
    another type is an error."""

    def __init__(self, strict: bool = False):
        self.strict = strict
        self.tables: dict[str, Table] = {}
        self.sources: dict[str, Source] = {}
        self.params: dict[str, K.Kind] = {}
        self.functions: dict[str, tuple[list[str], object]] = {}
        self.auth: tuple[str, object] | None = None

    def copy(self) -> Catalog:
        """For one query: what it defines or infers does not leak into the next."""
        other = Catalog(self.strict)
        other.tables = {n: Table(t.name, dict(t.fields), t.relation) for n, t in self.tables.items()}
        other.sources, other.auth, other.functions = dict(self.sources), self.auth, dict(self.functions)
        return other

    def define(self, s: Statement) -> None:
        if s.type == "DEFINE TABLE":
            old = self.tables.get(s.name)
            self.tables[s.name] = Table(s.name, old.fields if old else {}, s.relation or (old.relation if old else None))
        elif s.type == "DEFINE FIELD":
            table = self.tables.setdefault(s.table, Table(s.table))
            old = table.fields.get(s.name)
            if self.strict and old is not None and s.kind is not None and old != s.kind:
                raise TypeMismatch(f"{s.table}.{s.name} is {old}, not {s.kind}")
            table.fields[s.name] = s.kind
        elif s.type == "DEFINE FUNCTION":
            self.functions[s.name] = (s.fields, s.body)

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise TableNotFound(f"no table {name}")
        return self.tables[name]

    def row(self, name: str) -> K.Kind:
        """The type of a whole row; dotted fields are folded into objects, fields without a type are left out."""
        table = self.tables.get(name)
        out: dict = {}
        for path, kind in (table.fields if table else {}).items():
            if kind is None or ".*" in path or "[" in path:
                continue
            *above, last = path.split(".")
            here = out
            for step in above:
                old = here.get(step)
                if not isinstance(old, dict):
                    here[step] = dict(old.fields) if isinstance(old, K.Kind) else {}
                here = here[step]
            here[last] = kind
        return _fold(out)

    def field(self, table: str, path: list[str]) -> K.Kind:
        """The type of a path; a link on the way leads on into its first table."""
        t = self.table(table)
        dotted = ".".join(path)
        if dotted in t.fields:
            if t.fields[dotted] is None:
                raise SchemaViolation(f"{table}.{dotted} has no type")
            return t.fields[dotted]
        here = self.row(table)
        for i, step in enumerate(path):
            if here.name == "either":
                here = next((x for x in here.of if x != K.NULL), here)
            if here.name == "record" and here.of:
                return self.field(here.of[0], path[i:])
            if here.name in ("array", "tuple", "set") and here.of:
                inner = here.of[0]
                return K.array(self.field(inner.of[0], path[i:]) if inner.name == "record" and inner.of else _walk(inner, path[i:], table))
            if here.name in ("any", "object"):
                return K.ANY
            found = here.get(step) if here.name == "fields" else None
            if found is None:
                if i == 0 and step in t.fields:
                    raise SchemaViolation(f"{table}.{step} has no type")
                if i == 0 and step == "id":
                    return K.record(table)
                if i == 0 and step in ("in", "out") and t.relation:
                    return K.record(*t.relation[step == "out"])
                raise FieldNotFound(f"no field {dotted} in {table}")
            here = found
        return here

    def link(self, table: str, name: str) -> str | None:
        """The table that a field links to, straight or in an array."""
        kind = self.tables[table].fields.get(name) if table in self.tables else None
        while kind is not None and kind.name in ("array", "set", "tuple", "either") and kind.of:
            kind = kind.of[0]
        return kind.of[0] if kind is not None and kind.name == "record" and kind.of else None

    def sides(self, tables: tuple[str, ...], part: tuple) -> list[tuple[str, list[tuple]]]:
        """What a hop may follow from a record of one of ``tables`` (any, if there are none): for each name of the hop
        that fits, (key column, column of the other end, tables of the other end); the columns are None for a table
        that is no edge. In strict mode a name that does not fit is an error."""
        _, direction, names, _ = part
        every = names == ("?",)
        found = []
        for name in [n for n, t in self.tables.items() if t.relation] if every else names:
            relation = self.tables[name].relation if name in self.tables else None
            ends = self.sources[name].ends if name in self.sources else None
            if relation is None and ends is None:
                fits = [(None, None, (name,))] if not tables or name in tables else []
            else:
                (start, to), (a, b) = relation or ((), ()), ends or (None, None)
                here = lambda of: not tables or not of or any(t in of for t in tables)
                fits = [(a, b, to)] if direction in ("out", "both") and here(start) else []
                fits += [(b, a, start)] if direction in ("in", "both") and here(to) else []
            if not fits and not every and self.strict:
                raise InvalidPath(f"no path from {' or '.join(tables)} over {name}")
            if fits:
                found.append((name, fits))
        return found

    def source(self, name: str) -> Source:
        if name not in self.sources:
            raise TableNotFound(f"no rows for table {name}")
        return self.sources[name]

    def register(self, name: str, df: DataFrame, key: str, links: dict[str, str] | None = None, relation: tuple[str, str, str, str] | None = None, kinds: dict[str, K.Kind] | None = None) -> None:
        """Give a table its rows. Types come from the frame, ``links`` name the columns that hold ids of other tables,
        ``relation`` is (from table, its column, to table, its column) of an edge table."""
        t = Table(name, relation=((relation[0],), (relation[2],)) if relation else None)
        for f in df.schema:
            kind = K.record(links[f.name]) if links and f.name in links else K.from_spark(f.dataType, f.metadata)
            t.fields[f.name] = (kinds or {}).get(f.name, kind)
        self.tables[name] = t
        self.sources[name] = Source(df, key, (relation[1], relation[3]) if relation else None)


def _fold(members: dict) -> K.Kind:
    return K.fields_of({n: _fold(k) if isinstance(k, dict) else k for n, k in members.items()})


def _walk(kind: K.Kind, path: list[str], table: str) -> K.Kind:
    for step in path:
        if kind.name in ("any", "object"):
            return K.ANY
        found = kind.get(step) if kind.name == "fields" else None
        if found is None:
            raise FieldNotFound(f"no field {'.'.join(path)} in {table}")
        kind = found
    return kind
