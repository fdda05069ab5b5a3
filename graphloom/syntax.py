"""Tokens, syntax tree and recursive-descent parser of the query language."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from graphloom import kinds as K
from graphloom.errors import ParseError

_TOKEN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|\#[^\n]*|//[^\n]*|/\*.*?\*/)
    |(?P<string>[durs]?'(?:[^'\\]|\\.)*'|[durs]?"(?:[^"\\]|\\.)*")
    |(?P<quoted>`(?:[^`\\]|\\.)*`|⟨[^⟩]*⟩)
    |(?P<duration>(?:\d+(?:ns|us|µs|ms|s|m|h|d|w|y))+(?![A-Za-z0-9_]))
    |(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?:dec|f)?(?![A-Za-z_]))
    |(?P<param>\$[A-Za-z_][A-Za-z0-9_]*)
    |(?P<ident>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<op><->|->|<-(?!\d)|<\||\|>|::|\+\?=|\.\.\.|\.\.=|\.\.|==|!=|\?=|\*=|!~|\?~|\*~|<=|>=|&&|\|\||\?\?|\?:|\?\.|\+=|-=|\*\*|@\d*@|[-+*/%=<>!~?:.,;(){}\[\]|&@∋∌∈∉⊆×÷])""",
    re.X | re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int
    spaced: bool


@dataclass(frozen=True)
class Node:
    """A part of the syntax tree: ``type`` names it, ``v`` holds its parts."""

    type: str
    v: tuple = ()

    def __getitem__(self, i: int) -> Any:
        return self.v[i]


def N(kind: str, *v) -> Node:
    return Node(kind, v)


@dataclass
class Statement:
    type: str
    what: list = field(default_factory=list)
    fields: list = field(default_factory=list)
    value: bool = False
    only: bool = False
    omit: list = field(default_factory=list)
    where: Node | None = None
    split: list = field(default_factory=list)
    group: list | None = None
    order: list = field(default_factory=list)
    limit: Node | None = None
    start: Node | None = None
    fetch: list = field(default_factory=list)
    data: tuple | None = None
    output: Any = None
    name: str = ""
    table: str = ""
    kind: Any = None
    relation: tuple | None = None
    body: Any = None
    source: str = ""


def tokens(source: str) -> list[Token]:
    out, at, spaced = [], 0, False
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise ParseError(f"unexpected character {source[at]!r} at {at}")
        if m.lastgroup == "skip":
            spaced = True
        else:
            out.append(Token(m.lastgroup, m[0], at, spaced))
            spaced = False
        at = m.end()
    out.append(Token("end", "", at, True))
    return out


_UNITS = {"ns": 0, "us": 1, "µs": 1, "ms": 1000, "s": 10**6, "m": 60 * 10**6, "h": 3600 * 10**6, "d": 86400 * 10**6, "w": 7 * 86400 * 10**6, "y": 365 * 86400 * 10**6}


def microseconds(duration: str) -> int:
    total = 0
    for n, unit in re.findall(r"(\d+)(ns|us|µs|ms|s|m|h|d|w|y)", duration):
        total += int(n) // 1000 if unit == "ns" else int(n) * _UNITS[unit]
    return total


#: Binary operators by binding power; words are upper case.
_BINARY = {
    "??": 1, "?:": 1, "||": 2, "OR": 2, "&&": 3, "AND": 3,
    "=": 5, "==": 5, "!=": 5, "?=": 5, "*=": 5, "~": 5, "!~": 5, "?~": 5, "*~": 5, "IS": 5, "IN": 5, "INSIDE": 5, "NOTINSIDE": 5, "ALLINSIDE": 5, "ANYINSIDE": 5, "NONEINSIDE": 5,
    "CONTAINS": 5, "CONTAINSNOT": 5, "CONTAINSALL": 5, "CONTAINSANY": 5, "CONTAINSNONE": 5, "∋": 5, "∌": 5, "∈": 5, "∉": 5, "MATCHES": 5, "@@": 5, "NOT": 5,
    "<": 6, "<=": 6, ">": 6, ">=": 6, "<|": 6, "+": 7, "-": 7, "*": 8, "/": 8, "%": 8, "×": 8, "÷": 8, "**": 9,
}
_CLAUSES = {"FROM", "WHERE", "SPLIT", "GROUP", "ORDER", "LIMIT", "START", "FETCH", "TIMEOUT", "PARALLEL", "WITH", "OMIT", "AS", "RETURN", "SET", "CONTENT", "MERGE", "PATCH", "REPLACE", "UNSET", "EXPLAIN", "TEMPFILES", "ON", "THEN", "ELSE", "END", "VERSION", "INTO", "VALUES"}


class Parser:
    def __init__(self, source: str):
        self.source, self.tokens, self.i = source, tokens(source), 0

    # tokens
    def peek(self, ahead: int = 0) -> Token:
        return self.tokens[min(self.i + ahead, len(self.tokens) - 1)]

    def next(self) -> Token:
        self.i += 1
        return self.tokens[self.i - 1]

    def done(self) -> bool:
        return self.peek().kind == "end"

    def is_op(self, *texts: str, ahead: int = 0) -> bool:
        t = self.peek(ahead)
        return t.kind == "op" and t.text in texts

    def is_word(self, *words: str, ahead: int = 0) -> bool:
        t = self.peek(ahead)
        return t.kind == "ident" and t.text.upper() in words

    def op(self, text: str) -> bool:
        if self.is_op(text):
            self.i += 1
            return True
        return False

    def word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not (self.op(text) or self.word(text)):
            t = self.peek()
            raise ParseError(f"expected {text!r} but found {t.text or 'the end'!r} at {t.at}")

    def ident(self) -> str:
        t = self.next()
        if t.kind == "ident":
            return t.text
        if t.kind == "quoted":
            return t.text[1:-1]
        if t.kind in ("number", "duration"):
            return t.text
        raise ParseError(f"expected a name but found {t.text or 'the end'!r} at {t.at}")

    def commas(self, item) -> list:
        out = [item()]
        while self.op(","):
            out.append(item())
        return out

    # types
    def kind(self) -> K.Kind:
        found = [self._kind()]
        while self.op("|"):
            found.append(self._kind())
        return K.either(*found)

    def _kind(self) -> K.Kind:
        t = self.peek()
        if t.kind == "string":
            return K.Kind("literal", (_unquote(self.next().text),))
        if t.kind == "number":
            return K.Kind("literal", (float(self.next().text),))
        if t.kind == "duration":
            return K.Kind("literal", (self.next().text,))
        if self.op("{"):
            members = {}
            while not self.op("}"):
                name = self.next().text
                name = _unquote(name) if name[0] in "'\"" else name.strip("`")
                optional = self.op("?:") or self.op("?") and self.op(":")
                if not optional:
                    self.need(":")
                members[name] = K.option(self.kind()) if optional else self.kind()
                self.op(",")
            return K.fields_of(members)
        if self.op("["):
            each = []
            while not self.op("]"):
                each.append(self.kind())
                self.op(",")
            return K.tuple_of(*each)
        name = self.ident().lower()
        if name in ("record", "geometry"):
            of = []
            if self.op("<"):
                of.append(self.ident())
                while self.op("|"):
                    of.append(self.ident())
                self.need(">")
            return K.Kind(name, tuple(of))
        if name in ("array", "set", "option"):
            of, size = K.ANY, None
            if self.op("<"):
                of = self.kind()
                if self.op(","):
                    size = int(self.next().text)
                self.need(">")
            return K.option(of) if name == "option" else K.Kind(name, (of,), size=size)
        name = {"boolean": "bool"}.get(name, name)
        if name not in K.SIMPLE:
            raise ParseError(f"unknown type {name!r} at {t.at}")
        return K.simple(name)

    # expressions
    def expression(self, least: int = 0) -> Node:
        left = self.prefix()
        while True:
            t = self.peek()
            name = t.text.upper() if t.kind == "ident" else re.sub(r"@\d*@", "@@", t.text) if t.kind == "op" else ""
            power = _BINARY.get(name)
            if power is None or power <= least:
                return left
            self.next()
            if name == "IS" and self.word("NOT"):
                name = "!="
            elif name == "NOT":
                self.need("IN")
                name = "NOTINSIDE"
            elif name == "<|":
                k = self.next().text
                metric = self.ident() if self.op(",") else "EUCLIDEAN"
                self.need("|>")
                left = N("knn", left, int(k), metric, self.expression(power))
                continue
            left = N("binary", name, left, self.expression(power))

    def prefix(self) -> Node:
        if self.op("!") or self.is_word("NOT") and not self.is_op("(", ahead=1) and self.word("NOT"):
            return N("unary", "!", self.expression(9))
        if self.op("-"):
            return N("unary", "-", self.expression(9))
        if self.op("+"):
            return self.expression(9)
        if self.is_op("<") and self.peek(1).kind == "ident":
            self.next()
            kind = self.kind()
            self.need(">")
            return N("cast", kind, self.expression(9))
        return self.postfix(self.primary())

    def primary(self) -> Node:
        t = self.peek()
        if t.kind == "string":
            self.next()
            return _string(t.text)
        if t.kind == "number":
            self.next()
            raw = re.sub(r"(dec|f)$", "", t.text)
            return N("number", float(raw) if re.search(r"[.eE]", raw) or t.text.endswith(("f", "dec")) else int(raw))
        if t.kind == "duration":
            self.next()
            return N("duration", microseconds(t.text))
        if t.kind == "param":
            self.next()
            return N("param", t.text[1:])
        if self.op("("):
            inner = self.statement() if self.is_word("SELECT", "CREATE", "UPDATE", "UPSERT", "DELETE", "RELATE", "INSERT") else self.expression()
            self.need(")")
            return N("subquery", inner) if isinstance(inner, Statement) else N("group", inner)
        if self.op("["):
            items = []
            while not self.op("]"):
                items.append(self.expression())
                self.op(",")
            return N("array", tuple(items))
        if self.op("{"):
            items = []
            while not self.op("}"):
                key = self.next().text
                self.need(":")
                items.append((_unquote(key) if key[0] in "'\"" else key.strip("`"), self.expression()))
                self.op(",")
            return N("object", tuple(items))
        if self.op("|"):
            names = [] if self.is_op("|") else self.commas(lambda: self.next().text)
            while not self.op("|"):
                self.next()
            return N("closure", tuple(n.lstrip("$") for n in names), self.expression())
        if self.is_op("->", "<-", "<->"):
            return N("idiom", (self.graph(),))
        if self.op("*"):
            return N("idiom", (("all",),))
        if t.kind in ("ident", "quoted"):
            return self.named()
        raise ParseError(f"unexpected {t.text or 'the end'!r} at {t.at}")

    def named(self) -> Node:
        t = self.peek()
        low = t.text.upper() if t.kind == "ident" else ""
        if low in ("TRUE", "FALSE"):
            self.next()
            return N("bool", low == "TRUE")
        if low in ("NONE", "NULL"):
            self.next()
            return N("null", low)
        if low == "IF":
            return self.conditional()
        name = self.ident()
        while self.is_op("::"):
            self.next()
            name += "::" + self.ident()
        if self.is_op("("):
            self.next()
            args = []
            while not self.op(")"):
                args.append(self.expression())
                self.op(",")
            return N("call", name, tuple(args))
        if self.is_op(":") and not self.peek(0).spaced and not self.peek(1).spaced:
            self.next()
            key = self.peek()
            if key.kind == "number" or key.kind == "ident" or key.kind == "quoted":
                self.next()
                value = int(key.text) if key.kind == "number" and key.text.isdigit() else key.text.strip("`⟨⟩")
                return N("thing", name, value)
            return N("thing", name, self.primary())
        if "::" in name:
            return N("constant", name)
        return N("idiom", (("field", name),))

    def conditional(self) -> Node:
        self.need("IF")
        branches, other = [], None
        while True:
            cond = self.expression()
            if self.word("THEN"):
                branches.append((cond, self.expression()))
            else:
                self.need("{")
                branches.append((cond, self.expression()))
                self.op(";")
                self.need("}")
            if not self.word("ELSE"):
                break
            if self.word("IF"):
                continue
            if self.op("{"):
                other = self.expression()
                self.op(";")
                self.need("}")
            else:
                other = self.expression()
            break
        self.word("END")
        return N("if", tuple(branches), other)

    def graph(self) -> tuple:
        direction = {"->": "out", "<-": "in", "<->": "both"}[self.next().text]
        if self.op("?"):
            return ("graph", direction, ("?",), None)
        if self.op("("):
            names = [self.ident() if not self.op("?") else "?"]
            while self.op(","):
                names.append(self.ident())
            cond = self.expression() if self.word("WHERE") else None
            self.need(")")
            return ("graph", direction, tuple(names), cond)
        return ("graph", direction, (self.ident(),), None)

    def postfix(self, base: Node) -> Node:
        parts = list(base[0]) if base.type == "idiom" else []
        start = None if base.type == "idiom" else base
        grown = False
        while True:
            if self.is_op("->", "<-", "<->"):
                parts.append(self.graph())
            elif self.is_op(".", "?.") and (self.peek(1).kind in ("ident", "quoted") or self.is_op("*", "{", ahead=1)):
                self.next()
                if self.op("*"):
                    parts.append(("all",))
                elif self.op("{"):
                    names = []
                    while not self.op("}"):
                        names.append(self.ident())
                        self.op(",")
                    parts.append(("destructure", tuple(names)))
                else:
                    name = self.ident()
                    if self.is_op("("):
                        self.next()
                        args = []
                        while not self.op(")"):
                            args.append(self.expression())
                            self.op(",")
                        parts.append(("method", name, tuple(args)))
                    else:
                        parts.append(("field", name))
            elif self.is_op("...", ".."):
                return self._wrap(start, parts, grown, base)
            elif self.is_op("[") and not self.peek().spaced:
                self.next()
                if self.op("*"):
                    parts.append(("all",))
                elif self.op("$"):
                    parts.append(("last",))
                elif self.word("WHERE") or self.op("?"):
                    parts.append(("where", self.expression()))
                else:
                    parts.append(("index", self.expression()))
                self.need("]")
            else:
                return self._wrap(start, parts, grown, base)
            grown = True

    @staticmethod
    def _wrap(start, parts, grown, base) -> Node:
        if not grown:
            return base
        return N("idiom", tuple(parts)) if start is None else N("idiom", (("value", start), *parts))

    # statements
    def statements(self) -> list[Statement]:
        out = []
        while not self.done():
            if self.op(";"):
                continue
            at = self.peek().at
            s = self.statement()
            s.source = self.source[at : self.peek().at].strip()
            out.append(s)
            if not self.done():
                self.need(";")
        return out

    def statement(self) -> Statement:
        t = self.peek()
        name = t.text.upper() if t.kind == "ident" else ""
        made = {"SELECT": self.select, "CREATE": self.create, "INSERT": self.insert, "UPDATE": self.update, "UPSERT": self.update, "DELETE": self.delete, "RELATE": self.relate, "DEFINE": self.define}.get(name)
        if made:
            self.next()
            s = made()
            s.type = name if name != "DEFINE" else s.type
            return s
        if name == "LET":
            self.next()
            param = self.next().text.lstrip("$")
            self.need("=")
            return Statement("LET", name=param, body=self.value())
        if name == "RETURN":
            self.next()
            return Statement("RETURN", body=self.value())
        if name in ("BEGIN", "COMMIT", "CANCEL", "LIVE", "KILL", "INFO", "USE", "REMOVE", "SHOW", "SLEEP", "THROW", "FOR", "BREAK", "CONTINUE", "OPTION", "REBUILD", "ALTER", "ANALYZE", "ACCESS") and not self.is_op("(", "::", ahead=1):
            if name == "LIVE":
                self.next()
                inner = self.statement()
                return Statement("LIVE", body=inner)
            self.skip()
            return Statement(name)
        return Statement("VALUE", body=self.expression())

    def value(self):
        return N("subquery", self.statement()) if self.is_word("SELECT", "CREATE", "UPDATE", "UPSERT", "DELETE", "RELATE", "INSERT") else self.expression()

    def skip(self) -> None:
        depth = 0
        while not self.done() and not (self.is_op(";") and depth <= 0):
            depth += self.is_op("(", "{", "[") - self.is_op(")", "}", "]")
            self.next()

    def select(self) -> Statement:
        s = Statement("SELECT")
        s.value = self.word("VALUE")
        s.fields = self.commas(self.projection)
        if self.word("OMIT"):
            s.omit = self.commas(self.path)
        self.need("FROM")
        s.only = self.word("ONLY")
        s.what = self.commas(self.expression)
        while True:
            if self.word("WITH"):
                if not self.word("NOINDEX"):
                    self.need("INDEX")
                    self.commas(self.ident)
            elif self.word("WHERE"):
                s.where = self.expression()
            elif self.word("SPLIT"):
                self.word("ON")
                s.split = self.commas(self.path)
            elif self.word("GROUP"):
                if self.word("ALL"):
                    s.group = []
                else:
                    self.word("BY")
                    s.group = self.commas(self.path)
            elif self.word("ORDER"):
                self.word("BY")
                s.order = self.commas(self.ordering)
            elif self.word("LIMIT"):
                self.word("BY")
                s.limit = self.expression()
            elif self.word("START"):
                self.word("AT")
                s.start = self.expression()
            elif self.word("FETCH"):
                s.fetch = self.commas(self.path)
            elif self.word("TIMEOUT"):
                self.next()
            elif self.word("PARALLEL", "TEMPFILES", "EXPLAIN", "FULL"):
                pass
            elif self.word("VERSION"):
                self.expression()
            else:
                return s

    def projection(self) -> tuple:
        e = self.expression()
        return (e, self.path_text() if self.word("AS") else None)

    def path(self) -> tuple:
        return self.postfix(self.named())[0]

    def path_text(self) -> str:
        return path_text(self.path())

    def ordering(self) -> tuple:
        e = self.expression()
        self.word("COLLATE") or self.word("NUMERIC")
        down = self.word("DESC", "DESCENDING")
        self.word("ASC", "ASCENDING")
        return (e, down)

    def target(self):
        return self.expression()

    def changes(self, s: Statement) -> None:
        while True:
            if self.word("SET"):
                s.data = ("SET", self.commas(self.assignment))
            elif self.word("UNSET"):
                s.data = ("UNSET", self.commas(self.path))
            elif self.is_word("CONTENT", "MERGE", "PATCH", "REPLACE"):
                s.data = (self.next().text.upper(), self.expression())
            elif self.word("WHERE"):
                s.where = self.expression()
            elif self.word("RETURN"):
                s.output = self.next().text.upper() if self.is_word("NONE", "BEFORE", "AFTER", "DIFF", "NULL") else self.commas(self.projection)
            elif self.word("TIMEOUT"):
                self.next()
            elif not self.word("PARALLEL"):
                return

    def assignment(self) -> tuple:
        path = self.path()
        t = self.next()
        if t.text not in ("=", "+=", "-=", "+?="):
            raise ParseError(f"expected an assignment but found {t.text!r} at {t.at}")
        return (path, t.text, self.expression())

    def create(self) -> Statement:
        s = Statement("CREATE", only=self.word("ONLY"), what=self.commas(self.target))
        self.changes(s)
        return s

    def update(self) -> Statement:
        s = Statement("UPDATE", only=self.word("ONLY"), what=self.commas(self.target))
        self.changes(s)
        return s

    def delete(self) -> Statement:
        self.word("FROM")
        s = Statement("DELETE", only=self.word("ONLY"), what=self.commas(self.target))
        self.changes(s)
        return s

    def insert(self) -> Statement:
        s = Statement("INSERT")
        s.value = self.word("IGNORE")
        self.word("RELATION")
        if self.word("INTO"):
            s.what = [N("idiom", (("field", self.ident()),))]
        if self.op("("):
            if self.is_word("SELECT"):
                s.data = ("CONTENT", N("subquery", self.statement()))
                self.need(")")
                self.changes_after(s)
                return s
            names = self.commas(self.ident)
            self.need(")")
            self.need("VALUES")
            rows = self.commas(self.tuple)
            s.data = ("VALUES", names, rows)
        else:
            s.data = ("CONTENT", self.expression())
        if self.word("ON"):
            self.need("DUPLICATE")
            self.need("KEY")
            self.need("UPDATE")
            s.split = self.commas(self.assignment)
        self.changes_after(s)
        return s

    def changes_after(self, s: Statement) -> None:
        data = s.data
        self.changes(s)
        s.data = data

    def tuple(self) -> list:
        self.need("(")
        out = self.commas(self.expression)
        self.need(")")
        return out

    def relate(self) -> Statement:
        s = Statement("RELATE", only=self.word("ONLY"))
        start = self.primary()
        forward = self.is_op("->")
        if not (self.op("->") or self.op("<-")):
            raise ParseError(f"expected an arrow at {self.peek().at}")
        s.table = self.ident()
        if self.op(":"):
            self.next()
        if not (self.op("->") or self.op("<-")):
            raise ParseError(f"expected an arrow at {self.peek().at}")
        end = self.primary()
        s.what = [start, end] if forward else [end, start]
        self.word("UNIQUE")
        self.changes(s)
        return s

    def define(self) -> Statement:
        what = self.next().text.upper()
        if self.word("IF"):
            self.need("NOT")
            self.need("EXISTS")
        self.word("OVERWRITE")
        if what == "TABLE":
            s = Statement("DEFINE TABLE", name=self.ident())
            while not (self.done() or self.is_op(";")):
                if self.word("TYPE"):
                    if self.word("RELATION"):
                        ends: dict[str, tuple] = {"FROM": (), "TO": ()}
                        while self.is_word("FROM", "TO", "IN", "OUT"):
                            side = {"IN": "FROM", "OUT": "TO"}.get(w := self.next().text.upper(), w)
                            names = [self.ident()]
                            while self.op("|"):
                                names.append(self.ident())
                            ends[side] = tuple(names)
                        s.relation = (ends["FROM"], ends["TO"])
                    else:
                        self.next()
                else:
                    self.next()
            return s
        if what == "FIELD":
            s = Statement("DEFINE FIELD", name=self.path_text())
            self.need("ON")
            self.word("TABLE")
            s.table = self.ident()
            while not (self.done() or self.is_op(";")):
                if self.word("TYPE"):
                    s.kind = self.kind()
                elif self.word("FLEXIBLE", "READONLY"):
                    pass
                elif self.word("DEFAULT", "VALUE", "ASSERT"):
                    self.word("ALWAYS")
                    self.expression()
                else:
                    self.next()
            return s
        if what == "FUNCTION":
            name = self.ident()
            while self.op("::"):
                name += "::" + self.ident()
            self.need("(")
            names = []
            while not self.op(")"):
                t = self.next()
                if t.kind == "param":
                    names.append(t.text[1:])
                elif t.text == ":":
                    self.kind()
            self.need("{")
            self.word("RETURN")
            body = self.expression()
            self.op(";")
            self.need("}")
            self.skip()
            return Statement("DEFINE FUNCTION", name=name, fields=names, body=body)
        if what == "ANALYZER":
            s = Statement("DEFINE ANALYZER", name=self.ident())
            self.skip()
            return s
        self.skip()
        return Statement(f"DEFINE {what}")


def path_text(parts) -> str:
    out = ""
    for p in parts:
        match p[0]:
            case "field":
                out += ("." if out else "") + p[1]
            case "all":
                out += ".*" if out else "*"
            case "graph":
                out += {"out": "->", "in": "<-", "both": "<->"}[p[1]] + ",".join(p[2])
            case "destructure":
                out += ".{" + ", ".join(p[1]) + "}"
            case "method":
                out += f".{p[1]}()"
            case "index":
                out += f"[{p[1][0] if p[1].type == 'number' else '…'}]"
            case "last":
                out += "[$]"
            case "where":
                out += "[WHERE …]"
    return out


def _unquote(raw: str) -> str:
    raw = re.sub(r"^[durs](?=['\"])", "", raw)[1:-1]
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(m[1], m[1]), raw, flags=re.S)


def _string(raw: str) -> Node:
    value = _unquote(raw)
    match raw[0]:
        case "d":
            return N("datetime", value)
        case "u":
            return N("uuid", value)
        case "r":
            table, _, key = value.partition(":")
            return N("thing", table, int(key) if key.isdigit() else key)
    return N("string", value)


def parse(source: str) -> list[Statement]:
    return Parser(source).statements()
