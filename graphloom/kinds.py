"""The type algebra: kinds, their text form, and what they are in Spark and in TypeScript."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from graphloom.errors import ParseError

SIMPLE = ("any", "null", "bool", "bytes", "datetime", "decimal", "duration", "float", "int", "number", "object", "point", "string", "uuid", "range", "function")


@dataclass(frozen=True)
class Kind:
    """``name`` is a simple kind or one of: record, geometry, option, either, set, array, literal, fields, tuple."""

    name: str
    of: tuple = ()
    fields: tuple = field(default=())
    size: int | None = None

    def __str__(self) -> str:
        return text(self)

    def __eq__(self, other) -> bool:
        if not isinstance(other, Kind):
            return NotImplemented
        mine, theirs = (sorted(k.fields, key=lambda f: f[0]) for k in (self, other))
        same = set if self.name == "either" else list
        return self.name == other.name and self.size == other.size and mine == theirs and (same(self.of) == same(other.of))

    def __hash__(self) -> int:
        return hash((self.name, self.size, len(self.of), tuple(sorted(f[0] for f in self.fields))))

    def get(self, name: str) -> Kind | None:
        return dict(self.fields).get(name)


def simple(name: str) -> Kind:
    return Kind(name)


ANY, NULL, BOOL, NUMBER, INT, STRING, DATETIME, DURATION, OBJECT, BYTES, UUID = map(simple, ("any", "null", "bool", "number", "int", "string", "datetime", "duration", "object", "bytes", "uuid"))


def record(*tables: str) -> Kind:
    return Kind("record", tables)


def array(of: Kind, size: int | None = None) -> Kind:
    return Kind("array", (of,), size=size)


def tuple_of(*kinds: Kind) -> Kind:
    return Kind("tuple", kinds)


def fields_of(members: dict[str, Kind]) -> Kind:
    return Kind("fields", fields=tuple(members.items()))


def option(of: Kind) -> Kind:
    return either(of, NULL)


def either(*kinds: Kind) -> Kind:
    flat: list[Kind] = []
    for k in kinds:
        for x in k.of if k.name == "either" else (k,):
            if x not in flat:
                flat.append(x)
    return flat[0] if len(flat) == 1 else Kind("either", tuple(flat))


def text(k: Kind) -> str:
    match k.name:
        case "record" | "geometry":
            return k.name + (f"<{' | '.join(k.of)}>" if k.of else "")
        case "array" | "set":
            return f"{k.name}<{k.of[0]}{'' if k.size is None else f', {k.size}'}>"
        case "either":
            return " | ".join(map(str, k.of))
        case "literal":
            return repr(k.of[0])
        case "fields":
            return "{" + ", ".join(f"{_key(n)}: {x}" for n, x in k.fields) + "}"
        case "tuple":
            return "[" + ", ".join(map(str, k.of)) + "]"
    return k.name


def _key(name: str) -> str:
    return name if name.isidentifier() else f'"{name}"'


def parse_kind(source: str) -> Kind:
    """``array<{name: string, tags: [string]}>`` and the like."""
    from graphloom.syntax import Parser

    parser = Parser(source)
    found = parser.kind()
    if not parser.done():
        raise ParseError(f"unexpected {parser.peek().text!r} after the type {found}")
    return found


def to_spark(k: Kind) -> T.DataType:
    match k.name:
        case "bool":
            return T.BooleanType()
        case "number" | "float":
            return T.DoubleType()
        case "int":
            return T.LongType()
        case "decimal":
            return T.DecimalType(38, 9)
        case "string" | "uuid":
            return T.StringType()
        case "bytes":
            return T.BinaryType()
        case "datetime":
            return T.TimestampType()
        case "duration":
            return T.DayTimeIntervalType()
        case "null":
            return T.NullType()
        case "array" | "set":
            return T.ArrayType(to_spark(k.of[0]))
        case "fields":
            return T.StructType([T.StructField(n, to_spark(x)) for n, x in k.fields])
        case "tuple":
            return T.ArrayType(to_spark(k.of[0])) if len(k.of) == 1 else T.StructType([T.StructField(f"_{i}", to_spark(x)) for i, x in enumerate(k.of, 1)])
        case "record":
            return T.StringType() if k.of else T.StructType([T.StructField("tb", T.StringType()), T.StructField("id", T.StringType())])
        case "literal":
            return T.StringType() if isinstance(k.of[0], str) else T.DoubleType()
        case "range":
            return T.StructType([T.StructField("beg", T.VariantType()), T.StructField("end", T.VariantType()), T.StructField("incl", T.BooleanType())])
        case "point" | "geometry":
            return T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.DoubleType()))])
        case "either":
            rest = [x for x in k.of if x != NULL]
            return to_spark(rest[0]) if len(rest) == 1 else T.VariantType()
    return T.VariantType()


def from_spark(t: T.DataType, metadata: dict | None = None) -> Kind:
    if metadata and metadata.get("record"):
        return record(*metadata["record"])
    match t:
        case T.BooleanType():
            return BOOL
        case T.StringType():
            return UUID if metadata and metadata.get("kind") == "uuid" else STRING
        case T.BinaryType():
            return BYTES
        case T.TimestampType() | T.TimestampNTZType() | T.DateType():
            return DATETIME
        case T.DayTimeIntervalType():
            return DURATION
        case T.NullType():
            return NULL
        case T.ArrayType():
            return array(from_spark(t.elementType))
        case T.StructType():
            return fields_of({f.name: from_spark(f.dataType, f.metadata) for f in t})
        case T.NumericType():
            return NUMBER
    return ANY


def to_typescript(k: Kind) -> str:
    match k.name:
        case "bool":
            return "boolean"
        case "number":
            return "number"
        case "string":
            return "string"
        case "datetime":
            return "Date"
        case "duration":
            return "Duration"
        case "uuid":
            return "UUID"
        case "bytes":
            return "Uint8Array"
        case "null":
            return "null"
        case "object":
            return "Record<string, any>"
        case "range":
            return "Range"
        case "record":
            return f"RecordId<{_quote(k.of[0])}>" if k.of else "RecordId<string>"
        case "array":
            return f"Array<{to_typescript(k.of[0])}>"
        case "either":
            return " | ".join(to_typescript(x) for x in k.of)
        case "literal":
            return _quote(k.of[0]) if isinstance(k.of[0], str) else str(k.of[0])
        case "fields":
            return "{ " + " ".join(f"{n if n.isidentifier() else _quote(n)}: {to_typescript(x)};" for n, x in sorted(k.fields)) + " }"
        case "tuple":
            return "[" + ", ".join(to_typescript(x) for x in k.of) + "]" if len(k.of) != 1 else f"Array<{to_typescript(k.of[0])}>"
        case "geometry":
            return "Geometry"
    return "any"


def _quote(s: str) -> str:
    import json

    return json.dumps(s)
