"""Type inference for statements and parameters. It runs on the driver alone and reads no row."""

from __future__ import annotations

from graphloom import functions as library
from graphloom import kinds as K
from graphloom.catalog import Catalog
from graphloom.errors import FieldNotFound, MissingAuth, SchemaViolation, TypeMismatch, Unimplemented, UnexpectedSyntax
from graphloom.syntax import N, Node, Statement, parse, path_text

_TRUTH = {"=", "==", "!=", "?=", "*=", "~", "!~", "?~", "*~", "IS", "IN", "INSIDE", "NOTINSIDE", "ALLINSIDE", "ANYINSIDE", "NONEINSIDE", "CONTAINS", "CONTAINSNOT", "CONTAINSALL", "CONTAINSANY", "CONTAINSNONE", "∋", "∌", "∈", "∉", "<", "<=", ">", ">=", "MATCHES", "@@"}
_OBJECTS = ("fields", "object", "any")


def analyze(catalog: Catalog, text: str) -> K.Kind:
    """The type of a text's result: null for none, an array of the one statement's, or a tuple."""
    found = [statement(catalog, s) for s in parse(text)]
    if not found:
        return K.NULL
    return K.array(found[0]) if len(found) == 1 else K.tuple_of(*found)


def statement(catalog: Catalog, s: Statement) -> K.Kind:
    if s.type.startswith("DEFINE"):
        catalog.define(s)
        return K.NULL
    match s.type:
        case "SELECT":
            return Select(catalog, s).kind()
        case "CREATE" | "INSERT" | "UPDATE" | "UPSERT":
            return _write(catalog, s)
        case "RELATE":
            return _relate(catalog, s)
        case "DELETE":
            return K.tuple_of()
        case "VALUE" | "RETURN":
            return statement(catalog, s.body[0]) if s.body.type == "subquery" else infer(catalog, s.body)
        case "LET":
            catalog.params[s.name] = statement(catalog, s.body[0]) if s.body.type == "subquery" else infer(catalog, s.body)
            return K.NULL
    raise Unimplemented(f"analysis of {s.type} is not implemented")


def infer(catalog: Catalog, e: Node, table: str | None = None) -> K.Kind:
    """The type of an expression; what only the rows can tell is ``any``."""
    match e.type:
        case "string":
            return K.STRING
        case "number":
            return K.NUMBER
        case "bool":
            return K.BOOL
        case "null":
            return K.NULL
        case "datetime":
            return K.DATETIME
        case "uuid":
            return K.UUID
        case "duration":
            return K.DURATION
        case "object":
            return K.OBJECT
        case "array":
            return K.array(infer(catalog, e[0][0], table) if e[0] else K.ANY)
        case "thing":
            return K.record(e[0])
        case "param":
            return catalog.params.get(e[0], K.ANY)
        case "cast":
            return e[0]
        case "group":
            return infer(catalog, e[0], table)
        case "closure":
            return K.ANY
        case "constant":
            return library.find(e[0]).kind([])
        case "call":
            return call(catalog, e, table)
        case "unary":
            return K.BOOL if e[0] == "!" else K.NUMBER
        case "binary":
            if e[0] in _TRUTH:
                return K.BOOL
            a, b = infer(catalog, e[1], table), infer(catalog, e[2], table)
            if e[0] in ("??", "?:", "||", "&&", "OR", "AND"):
                return K.BOOL if e[0] in ("||", "&&", "OR", "AND") else a
            if {a.name, b.name} & {"datetime", "duration"}:
                return K.DATETIME if {a.name, b.name} == {"datetime", "duration"} else K.DURATION
            return K.STRING if a == b == K.STRING else K.NUMBER
        case "if":
            return K.either(*[infer(catalog, x, table) for _, x in e[0]], infer(catalog, e[1], table) if e[1] else K.NULL)
        case "subquery":
            return statement(catalog, e[0])
        case "idiom":
            names = [p[1] for p in e[0] if p[0] == "field"]
            if table is not None and len(names) == len(e[0]):
                return catalog.field(table, names)
    return K.ANY


def call(catalog: Catalog, e: Node, table: str | None) -> K.Kind:
    if e[0].startswith("fn::"):
        names, body = catalog.functions.get(e[0], (None, None))
        if names is None:
            return library.find(e[0]).kind([])
        return infer(catalog, substitute(body, dict(zip(names, e[1], strict=False))), table)
    if e[0] in ("type::field", "type::fields"):
        return K.ANY
    f = library.find(e[0])
    given = [infer(catalog, a, table) for a in e[1]]
    if library.aggregate(e[0], ["x"] * max(1, len(given))) and given and given[0].name not in ("array", "set", "tuple"):
        given = [K.array(given[0]), *given[1:]]  # in a group the column stands for the array of its values
    return f.kind(given)


def substitute(e, values: dict[str, Node]):
    """An expression with parameters replaced by expressions."""
    if isinstance(e, Node):
        return values[e[0]] if e.type == "param" and e[0] in values else N(e.type, *(substitute(x, values) for x in e.v))
    return tuple(substitute(x, values) for x in e) if isinstance(e, tuple) else e


def target_table(catalog: Catalog, what: Node) -> str:
    """The table of one FROM item or target."""
    match what.type:
        case "idiom" if len(what[0]) == 1 and what[0][0][0] == "field":
            return what[0][0][1]
        case "thing":
            return what[0]
        case "string" if ":" in what[0]:
            return what[0].split(":", 1)[0]
        case "param" if what[0] == "auth":
            if catalog.auth is None:
                raise MissingAuth("no auth record in this session")
            return catalog.auth[0]
        case "param" if what[0] == "token":
            raise Unimplemented("$token is not a source")
        case "param" if catalog.params.get(what[0], K.ANY).name == "record":
            return catalog.params[what[0]].of[0]
    raise UnexpectedSyntax(f"{what.type} is not a table or a record")


class Select:
    def __init__(self, catalog: Catalog, s: Statement):
        self.c, self.s = catalog, s

    def kind(self) -> K.Kind:
        s = self.s
        self.table = target_table(self.c, s.what[0])
        self.c.table(self.table)
        for e in [s.where] if s.where else []:
            self._check(e)
        if s.value:
            if len(s.fields) != 1:
                raise UnexpectedSyntax("SELECT VALUE takes one field")
            return K.tuple_of(self._fetched(s.fields[0][0], self._value(s.fields[0][0])))
        row = self.row()
        return row if s.only else K.array(row)

    def row(self) -> K.Kind:
        s, out = self.s, {}
        if not s.fields or any(_star(e) for e, _ in s.fields):
            out |= dict(self.c.row(self.table).fields)
            for path in s.omit:
                out = _omit(out, path_text(path).lower().split("."))
        skipped = {path_text(p) for p in s.omit}
        for e, alias in s.fields:
            if not _star(e) and not (e.type == "idiom" and path_text(e[0]) in skipped):
                out |= self.item(e, alias)
        for path in s.fetch:
            out = self._fetch(out, path_text(path).split("."))
        return K.fields_of(out)

    def _check(self, e) -> None:
        """Fields of a condition must be known."""
        if isinstance(e, Node) and e.type == "idiom":
            if all(p[0] == "field" for p in e[0]):
                try:
                    infer(self.c, e, self.table)
                except SchemaViolation:
                    return
        elif isinstance(e, Node):
            if e.type not in ("closure", "subquery"):
                for x in e.v:
                    self._check(x)
        elif isinstance(e, tuple):
            for x in e:
                self._check(x)

    def _value(self, e: Node) -> K.Kind:
        if e.type != "idiom":
            return infer(self.c, e, self.table)
        try:
            return infer(self.c, e, self.table) if all(p[0] == "field" for p in e[0]) else next(iter(self.item(e, "v").values()))
        except SchemaViolation:
            return K.ANY

    def _fetched(self, e: Node, kind: K.Kind) -> K.Kind:
        wanted = {path_text(p) for p in self.s.fetch}
        return self._expand(kind) if e.type == "idiom" and path_text(e[0]) in wanted else kind

    def item(self, e: Node, alias: str | None) -> dict[str, K.Kind]:
        """The members that one projected item adds to the row."""
        if e.type != "idiom":
            return {alias or label(e): infer(self.c, e, self.table)}
        parts = e[0]
        hops = [p for p in parts if p[0] == "graph"]
        if hops:
            inner = self._graph(parts)
            if alias:
                return {alias: inner}
            for hop in reversed(hops):
                inner = K.fields_of({path_text([hop]): inner})
            return dict(inner.fields)
        names = [p[1] for p in parts if p[0] == "field"]
        last = parts[-1]
        if last[0] == "destructure":
            whole = self._object(names)
            return {alias or ".".join(names): K.fields_of({n: whole.get(n) for n in last[1] if whole.get(n)})}
        if last[0] == "all" and names:
            return {alias or ".".join(names): self._object(names)}
        if len(names) == len(parts):
            return {alias or ".".join(names): infer(self.c, e, self.table)}
        return {alias or path_text(parts): K.ANY}

    def _object(self, names: list[str]) -> K.Kind:
        kind = self.c.field(self.table, names)
        if kind.name == "record" and kind.of:
            return self.c.row(kind.of[0])
        if kind.name not in _OBJECTS:
            raise FieldNotFound(f"{'.'.join(names)} in {self.table} is no object")
        return kind

    def _graph(self, parts) -> K.Kind:
        hops = [p for p in parts if p[0] == "graph"]
        if any(h[1] == "both" for h in hops) and self.c.strict:
            raise UnexpectedSyntax("<-> is not allowed in strict mode")
        last = hops[-1][2][0]
        if self.c.strict:
            lead = [p[1] for p in parts[: parts.index(hops[0])] if p[0] == "field"]
            at = (self.c.link(self.table, lead[-1]),) if lead and self.c.link(self.table, lead[-1]) else () if lead or not self.table else (self.table,)
            for h in hops:
                for name in h[2]:
                    if name != "?":
                        self.c.table(name)
                at = tuple(dict.fromkeys(t for _, sides in self.c.sides(at, h) for *_, to in sides for t in to))
        end = parts[-1]
        match end[0]:
            case "all":
                return K.tuple_of(self.c.row(last))
            case "destructure":
                row = self.c.row(last)
                return K.tuple_of(K.fields_of({n: row.get(n) for n in end[1] if row.get(n)}))
            case "field":
                return K.tuple_of(self.c.field(last, [p[1] for p in parts[parts.index(hops[-1]) + 1 :] if p[0] == "field"]))
        return K.tuple_of(K.record(last))

    def _fetch(self, row: dict[str, K.Kind], path: list[str]) -> dict[str, K.Kind]:
        """FETCH items are independent dotted paths."""
        if path[0] not in row:
            return row
        kind = self._expand(row[path[0]]) if len(path) == 1 else row[path[0]]
        if len(path) > 1:
            kind = self._expand(kind)
            if kind.name == "fields":
                kind = K.fields_of(self._fetch(dict(kind.fields), path[1:]))
        return row | {path[0]: kind}

    def _expand(self, kind: K.Kind) -> K.Kind:
        match kind.name:
            case "record" if kind.of:
                return self.c.row(kind.of[0])
            case "array" | "set" if kind.of[0].name == "record":
                return K.tuple_of(self._expand(kind.of[0]))
            case "array" | "set":
                return K.Kind(kind.name, (self._expand(kind.of[0]),), size=kind.size)
            case "either":
                return K.either(*[self._expand(x) for x in kind.of])
        return kind


def _star(e: Node) -> bool:
    return e.type == "idiom" and e[0] == (("all",),)


def _omit(members: dict[str, K.Kind], path: list[str]) -> dict[str, K.Kind]:
    out = {}
    for name, kind in members.items():
        if name.lower() != path[0]:
            out[name] = kind
        elif len(path) > 1:
            out[name] = K.fields_of(_omit(dict(kind.fields), path[1:])) if kind.name == "fields" else kind
    return out


def label(e: Node) -> str:
    """The name of an item without an alias."""
    if e.type == "call":
        return e[0]
    return path_text(e[0]) if e.type == "idiom" else e.type


def _wrap(s: Statement, row: K.Kind) -> K.Kind:
    return row if s.only else K.array(row)


def _write(catalog: Catalog, s: Statement) -> K.Kind:
    if not s.what:
        raise UnexpectedSyntax("INSERT needs INTO")
    table = target_table(catalog, s.what[0])
    _params(catalog, s, table)
    return _wrap(s, catalog.row(table))


def _relate(catalog: Catalog, s: Statement) -> K.Kind:
    t = catalog.tables.get(s.table)
    if t is not None and t.relation:
        for end, names in zip(s.what, t.relation, strict=True):
            if end.type == "param" and names:
                _param(catalog, end[0], catalog.row(names[0]))
    _params(catalog, s, s.table)
    return _wrap(s, catalog.row(s.table))


def _param(catalog: Catalog, name: str, kind: K.Kind) -> None:
    old = catalog.params.get(name)
    catalog.params[name] = kind if old is None or old == kind else K.either(old, kind)


def _params(catalog: Catalog, s: Statement, table: str) -> None:
    """Parameters in the data of a write have the types of the fields that they fill."""
    if s.data is None:
        return
    match s.data[0]:
        case "SET":
            given = [(path_text(path).split("."), value) for path, _, value in s.data[1]]
        case "VALUES":
            given = [([n], v) for row in s.data[2] for n, v in zip(s.data[1], row, strict=False)]
        case "UNSET":
            return
        case _:
            body = s.data[1]
            if body.type == "param":
                _param(catalog, body[0], catalog.row(table))
                return
            items = body[0] if body.type == "array" else (body,)
            given = [([n], v) for o in items if o.type == "object" for n, v in o[0]]
    for path, value in given:
        if value.type == "param":
            _param(catalog, value[0], catalog.field(table, path))
        elif catalog.strict:
            want, have = catalog.field(table, path), infer(catalog, value, table)
            if not _fits(have, want):
                raise TypeMismatch(f"{table}.{'.'.join(path)} is {want}, not {have}")


def _fits(have: K.Kind, want: K.Kind) -> bool:
    if have == want or "any" in (have.name, want.name) or want.name == "either" and any(_fits(have, x) for x in want.of):
        return True
    numbers = {"number", "int", "float", "decimal"}
    return {have.name, want.name} <= numbers or have.name == "object" and want.name in _OBJECTS or have.name == want.name
