"""Expressions of the language as Spark SQL text."""

from __future__ import annotations

import datetime
import decimal
import uuid

from graphloom import functions as library
from graphloom import kinds as K
from graphloom.catalog import Catalog
from graphloom.errors import InvalidFunctionCall, ParameterNotFound, UnexpectedSyntax
from graphloom.operators.search import distance
from graphloom.plans.analyzer import infer, substitute
from graphloom.syntax import N, Node, path_text

_PLAIN = {"=": "=", "!=": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">=", "+": "+", "-": "-", "*": "*", "×": "*", "%": "%", "&&": "AND", "AND": "AND", "||": "OR", "OR": "OR"}
_SHAPES = {
    "==": "({a} <=> {b})", "IS": "({a} <=> {b})", "/": "try_divide({a}, {b})", "÷": "try_divide({a}, {b})", "**": "pow({a}, {b})",
    "??": "coalesce({a}, {b})", "~": "(levenshtein(lower({a}), lower({b})) <= 2)", "!~": "(levenshtein(lower({a}), lower({b})) > 2)",
    "CONTAINSALL": "(size(array_except({b}, {a})) = 0)", "CONTAINSANY": "arrays_overlap({a}, {b})", "CONTAINSNONE": "(NOT arrays_overlap({a}, {b}))",
    "ALLINSIDE": "(size(array_except({a}, {b})) = 0)", "ANYINSIDE": "arrays_overlap({a}, {b})", "NONEINSIDE": "(NOT arrays_overlap({a}, {b}))",
    "?=": "exists({a}, _e -> _e = {b})", "*=": "forall({a}, _e -> _e = {b})",
}
_NAMESPACES = {"string": "string", "array": "array", "tuple": "array", "set": "array", "datetime": "time", "duration": "duration", "number": "math", "int": "math", "object": "object", "fields": "object"}


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(v) -> str:
    match v:
        case None:
            return "NULL"
        case bool():
            return "true" if v else "false"
        case int():
            return str(v) if abs(v) < 2**31 else f"{v}L"
        case float():
            return f"double('{v!r}')" if v != v or v in (float("inf"), float("-inf")) else f"{v!r}D"
        case decimal.Decimal():
            return f"{v}BD"
        case datetime.datetime():
            return f"timestamp'{v.isoformat(sep=' ')}'"
        case datetime.timedelta():
            return interval(v // datetime.timedelta(microseconds=1))
        case list() | tuple():
            return f"array({', '.join(map(literal, v))})"
        case dict():
            return f"named_struct({', '.join(f'{literal(k)}, {literal(x)}' for k, x in v.items())})"
        case uuid.UUID():
            return literal(str(v))
        case str():
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    raise InvalidFunctionCall(f"a {type(v).__name__} cannot be a parameter")


def interval(micros: int) -> str:
    return f"make_dt_interval(0, 0, 0, cast({micros} AS DECIMAL(20, 0)) / 1000000)"


class Compiler:
    """``columns`` maps the text of paths that joins have made to their columns; ``group`` says that calls aggregate."""

    def __init__(self, catalog: Catalog, params: dict, table: str | None = None, columns: dict[str, str] | None = None, group: bool = False, subquery=None, names: set[str] | None = None):
        self.c, self.params, self.table, self.columns, self.group, self.subquery = catalog, params, table, {} if columns is None else columns, group, subquery
        self.names, self.locals = names, set()

    def __call__(self, e: Node) -> str:
        return getattr(self, f"_{e.type}", self._unknown)(e)

    def _unknown(self, e: Node) -> str:
        raise UnexpectedSyntax(f"{e.type} cannot be computed here")

    def _string(self, e):
        return literal(e[0])

    _uuid = _string

    def _number(self, e):
        return literal(e[0])

    def _bool(self, e):
        return literal(e[0])

    def _null(self, e):
        return "NULL"

    def _datetime(self, e):
        return f"cast({literal(e[0])} AS TIMESTAMP)"

    def _duration(self, e):
        return interval(e[0])

    def _group(self, e):
        return f"({self(e[0])})"

    def _array(self, e):
        items = [self(x) for x in e[0]]
        kinds = [K.STRING if x.type == "string" else self.kind(x) for x in e[0]]
        if K.STRING in kinds:  # an array has one type: beside texts, other plain values are texts
            plain = ("number", "int", "float", "decimal", "bool", "literal")
            items = [f"string({sql})" if k.name in plain else sql for sql, k in zip(items, kinds, strict=True)]
        return f"array({', '.join(items)})"

    def _object(self, e):
        return f"named_struct({', '.join(f'{literal(n)}, {self(x)}' for n, x in e[0])})"

    def _thing(self, e):
        return self(e[1]) if isinstance(e[1], Node) else literal(e[1])

    def _constant(self, e):
        return library.find(e[0]).render([])

    def _param(self, e):
        if e[0] in self.locals:
            return quote(e[0])
        if e[0] not in self.params:
            raise ParameterNotFound(f"no value for ${e[0]}")
        return literal(self.params[e[0]])

    def _cast(self, e):
        return f"cast({self(e[1])} AS {K.to_spark(e[0]).simpleString()})"

    def _unary(self, e):
        return f"(NOT {self(e[1])})" if e[0] == "!" else f"(-{self(e[1])})"

    def _if(self, e):
        whens = " ".join(f"WHEN {self(c)} THEN {self(v)}" for c, v in e[0])
        return f"CASE {whens} ELSE {self(e[1]) if e[1] else 'NULL'} END"

    def _closure(self, e):
        inner = Compiler(self.c, self.params, self.table, self.columns, self.group, self.subquery, self.names)
        inner.locals = self.locals | set(e[0])
        return f"{quote(e[0][0]) if len(e[0]) == 1 else '(' + ', '.join(map(quote, e[0])) + ')'} -> {inner(e[1])}"

    def _subquery(self, e):
        if self.subquery is None:
            raise UnexpectedSyntax("a subquery cannot stand here")
        return self.subquery(e[0])

    def _binary(self, e):
        name, left, right = e.v
        if name in ("=", "!=") and "null" in (left.type, right.type):
            other = left if right.type == "null" else right
            return f"({self(other)} IS {'NOT ' if name == '!=' else ''}NULL)"
        if name == "?:":
            a = self(left)
            return f"if(coalesce(try_cast({a} AS BOOLEAN), {a} IS NOT NULL), {a}, {self(right)})"
        if name in ("IN", "INSIDE", "∈", "NOTINSIDE", "∉"):
            no = "NOT " if name in ("NOTINSIDE", "∉") else ""
            if right.type == "array":
                return f"({self(left)} {no}IN ({', '.join(map(self, right[0]))}))"
            if right.type == "subquery":
                return f"({self(left)} {no}IN {self(right)})"
            return f"({no}{self._contains(right, left)})"
        if name in ("CONTAINS", "∋", "CONTAINSNOT", "∌"):
            return f"({'NOT ' if name in ('CONTAINSNOT', '∌') else ''}{self._contains(left, right)})"
        if name in ("MATCHES", "@@"):
            words = f"filter(split(lower({self(right)}), '[^\\\\p{{L}}\\\\p{{N}}]+'), _t -> _t <> '')"
            own = f"filter(split(lower({self(left)}), '[^\\\\p{{L}}\\\\p{{N}}]+'), _t -> _t <> '')"
            return f"(size(array_except({words}, {own})) = 0)"
        a, b = self(left), self(right)
        if name in _SHAPES:
            return _SHAPES[name].format(a=a, b=b)
        if name == "+" and K.STRING in (infer(self.c, left, self._known(left)), infer(self.c, right, self._known(right))):
            return f"concat({a}, {b})"
        return f"({a} {_PLAIN[name]} {b})"

    def _known(self, e: Node) -> str | None:
        return self.table if self.table in self.c.tables and not (e.type == "idiom" and path_text(e[0]) in self.columns) else None

    def _contains(self, whole: Node, part: Node) -> str:
        kind = self.kind(whole)
        return f"contains({self(whole)}, {self(part)})" if kind == K.STRING else f"array_contains({self(whole)}, {self(part)})"

    def kind(self, e: Node) -> K.Kind:
        if e.type == "param" and e[0] in self.params:
            return K.STRING if isinstance(self.params[e[0]], str) else K.ANY
        try:
            return infer(self.c, e, self._known(e))
        except Exception:  # noqa: BLE001 - a path that only the plan knows has any type
            return K.ANY

    def _knn(self, e):
        raise UnexpectedSyntax("a nearest-neighbour condition stands alone or beside AND")

    def distance(self, e: Node) -> tuple[str, str, int, str]:
        return self(e[0]), self(e[3]), e[1], distance(e[2], self(e[0]), self(e[3]))

    def _call(self, e):
        name, args = e.v
        if name.startswith("fn::"):
            if name not in self.c.functions:
                library.find(name)
            names, body = self.c.functions[name]
            return f"({self(substitute(body, dict(zip(names, args, strict=False))))})"
        if name == "type::field":
            return self(N("idiom", tuple(("field", p) for p in args[0][0].split("."))))
        if name == "type::fields":
            return f"struct({', '.join(self(N('idiom', (('field', x[0]),))) for x in args[0][0])})"
        if name == "count" and not self.group and args and self.kind(args[0]).name in ("array", "tuple", "set"):
            return f"cast(size({self(args[0])}) AS BIGINT)"
        if self.group:
            inner = Compiler(self.c, self.params, self.table, self.columns, False, self.subquery, self.names)
            inner.locals = self.locals
            if (sql := library.aggregate(name, [inner(a) for a in args])) is not None and not self._aggregated(args):
                return sql
        f = library.find(name)
        if name == "array::flatten" and self.kind(args[0]).name in ("array", "tuple") and self.kind(args[0]).of[:1] and self.kind(args[0]).of[0].name not in ("array", "tuple", "any"):
            return self(args[0])
        return f.render([self(a) for a in args])

    def _aggregated(self, args) -> bool:
        """Whether an argument already aggregates."""
        def walk(x) -> bool:
            if isinstance(x, Node):
                return x.type == "call" and library.aggregate(x[0], ["x", "1"]) is not None or any(walk(y) for y in x.v)
            return isinstance(x, tuple) and any(walk(y) for y in x)

        return any(walk(a) for a in args)

    def _idiom(self, e):
        parts = e[0]
        for n in range(len(parts), 0, -1):
            if (made := self.columns.get(path_text(parts[:n]))) is not None:
                return self._follow(made, parts[n:])
        first = parts[0]
        if first[0] == "value":
            return self._follow(self(first[1]), parts[1:], self.kind(first[1]))
        if first[0] != "field":
            raise UnexpectedSyntax(f"{path_text(parts)} cannot be computed here")
        name = first[1]
        if name in self.locals:
            return self._follow(quote(name), parts[1:])
        if name == "id" and (self.names is None or "id" not in self.names):
            return self._follow("__id", parts[1:])
        if name in ("in", "out") and self.table in self.c.sources and self.c.sources[self.table].ends and (self.names is None or name not in self.names):
            return quote(self.c.sources[self.table].ends[name == "out"])
        plain = [p for p in parts[1:] if p[0] != "field"]
        kind = self.kind(N("idiom", tuple(p for p in parts if p[0] == "field"))) if plain else K.ANY
        return self._follow(quote(name), parts[1:], kind)

    def _follow(self, sql: str, parts, kind: K.Kind = K.ANY) -> str:
        for p in parts:
            match p[0]:
                case "field":
                    sql = f"{sql}.{quote(p[1])}"
                case "index":
                    sql = f"get({sql}, cast({self(p[1])} AS INT))"
                case "last":
                    sql = f"try_element_at({sql}, -1)"
                case "destructure":
                    sql = "struct(" + ", ".join(f"{sql}.{quote(n)} AS {quote(n)}" for n in p[1]) + ")"
                case "where":
                    inner = Compiler(self.c, self.params, None, None, False, self.subquery, set())
                    sql = f"filter({sql}, _w -> {inner(_under(p[1], '_w'))})"
                case "method":
                    space = _NAMESPACES.get(kind.name, "string")
                    sql = library.find(f"{space}::{p[1]}").render([sql, *map(self, p[2])])
                case "all":
                    pass
        return sql


def _under(e, name: str):
    """Paths of an expression, as members of the lambda's variable."""
    if isinstance(e, Node):
        if e.type == "idiom":
            return N("idiom", (("field", name), *e[0]))
        return N(e.type, *(_under(x, name) for x in e.v))
    return tuple(_under(x, name) for x in e) if isinstance(e, tuple) else e
