"""How functions are declared, checked and turned into Spark SQL.

A namespace module holds lines ``name(kinds) -> result = template``. Kinds of arguments are ``any``, simple kinds and
``array``; ``?`` marks optional ones, ``*`` as many as there are. The result is a kind, or ``0`` for the kind of the
first argument, or ``0[]`` for its element. In a template ``{0}`` is the first argument as Spark SQL; ``{1|x}`` stands
for ``x`` if there is no second. A template of ``!`` cannot be a column expression; its message follows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from graphloom import kinds as K
from graphloom.errors import FunctionNotFound, InvalidFunctionCall, UnexpectedSyntax

_LINE = re.compile(r"^(?P<name>[\w:*]+)\((?P<args>[^)]*)\)\s*->\s*(?P<ret>\S+(?:<[^=]*>)?)\s*=\s*(?P<sql>.*)$")


@dataclass(frozen=True)
class Function:
    name: str
    args: tuple[str, ...]
    least: int
    most: float
    returns: str
    sql: str

    def kind(self, given: list[K.Kind]) -> K.Kind:
        """The kind of the result; a wrong number or kind of arguments is an error, ``any`` passes."""
        if not self.least <= len(given) <= self.most:
            raise UnexpectedSyntax(f"{self.name} takes {self.least} to {self.most} arguments, not {len(given)}")
        for i, k in enumerate(given):
            want = self.args[min(i, len(self.args) - 1)] if self.args else "any"
            if not accepts(want, k):
                raise UnexpectedSyntax(f"{self.name}: argument {i + 1} is {k}, not {want}")
        if self.returns == "0":
            return given[0] if given else K.ANY
        if self.returns == "0[]":
            return given[0].of[0] if given and given[0].name in ("array", "set", "tuple") and given[0].of else K.ANY
        return K.parse_kind(self.returns)

    def render(self, args: list[str]) -> str:
        if self.sql.startswith("!"):
            raise InvalidFunctionCall(f"{self.name}: {self.sql[1:].strip()}")

        def fill(m: re.Match) -> str:
            i, other = int(m[1]), m[2]
            if i < len(args):
                return args[i]
            if other is None:
                raise InvalidFunctionCall(f"{self.name}: argument {i + 1} is missing")
            return other

        sql = re.sub(r"\{(\d+)(?:\|([^{}]*))?\}", fill, self.sql)
        return sql.replace("{*}", ", ".join(args))


def accepts(want: str, k: K.Kind) -> bool:
    if want == "any" or k.name in ("any", "null"):
        return True
    if k.name == "either":
        return any(accepts(want, x) for x in k.of)
    if k.name == "literal":
        return want == ("string" if isinstance(k.of[0], str) else "number")
    if want == "number":
        return k.name in ("number", "int", "float", "decimal")
    if want == "array":
        return k.name in ("array", "set", "tuple")
    if want == "object":
        return k.name in ("object", "fields")
    if want == "string":
        return k.name in ("string", "uuid")
    if want == "uuid":
        return k.name in ("string", "uuid")
    return k.name == want


def declare(text: str, into: dict[str, Function], **macros: str) -> None:
    for line in text.strip().splitlines():
        if not line.strip():
            continue
        m = _LINE.match(line.strip())
        if not m:
            raise ValueError(f"bad declaration: {line}")
        sql = m["sql"].strip()
        args = [a.strip() for a in m["args"].split(",") if a.strip()]
        least = sum(not a.endswith(("?", "*")) for a in args)
        most = float("inf") if any(a.endswith("*") for a in args) else len(args)
        into[m["name"]] = Function(m["name"], tuple(a.rstrip("?*") for a in args), least, most, m["ret"], sql)


def find(name: str, table: dict[str, Function]) -> Function:
    if name in table:
        return table[name]
    head = name.split("::")[0]
    if f"{head}::*" in table:
        return table[f"{head}::*"]
    raise FunctionNotFound(f"no function {name}")
