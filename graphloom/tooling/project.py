"""Check a project's queries and write their TypeScript types."""

from __future__ import annotations

import re
import subprocess
import time
from dataclasses import dataclass
from pathlib import Path

from graphloom import kinds as K
from graphloom.catalog import Catalog
from graphloom.errors import LanguageNotImplemented, QueryError
from graphloom.plans.analyzer import analyze
from graphloom.tooling.config import Config

SUFFIX = ".surql"
_INLINE = re.compile(r"surql\(\s*(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|`((?:[^`\\]|\\.)*)`)", re.S)


@dataclass(frozen=True)
class Query:
    name: str
    text: str
    kind: K.Kind
    params: tuple[tuple[str, K.Kind], ...]


class Failed(QueryError):
    advice = "correct the queries that are named"


def files(path: Path) -> list[Path]:
    return [path] if path.is_file() else sorted(path.rglob(f"*{SUFFIX}"))


def schema(config: Config) -> Catalog:
    catalog = Catalog()
    for path in files(config.schema):
        analyze(catalog, path.read_text())
    return catalog


def pascal(stem: str) -> str:
    return "".join(p[:1].upper() + p[1:] for p in stem.split("_") if p)


def _one(catalog: Catalog, name: str, text: str) -> Query:
    own = catalog.copy()
    kind = analyze(own, text)
    return Query(name, text, kind, tuple(sorted(own.params.items(), key=lambda p: p[0])))


def collect(config: Config) -> list[Query]:
    """All queries of files and of source code, by name, then text; one text makes one entry. Every bad query is named."""
    catalog, found, bad = schema(config), {}, []
    named = [(pascal(p.stem), p.read_text(), str(p)) for p in (files(config.queries) if config.queries else [])]
    for path in sorted(p for p in config.source.rglob("*") if p.suffix in config.extensions) if config.source else []:
        if path == config.output:
            continue
        for i, m in enumerate(_INLINE.finditer(path.read_text(errors="replace"))):
            named.append((f"{pascal(re.sub(r'[^A-Za-z0-9]+', '_', path.stem))}{i + 1}", next(g for g in m.groups() if g is not None), str(path)))
    for name, text, where in named:
        try:
            found.setdefault(text, _one(catalog, name, text))
        except QueryError as e:
            bad.append(f"{where}: {e.report()}")
    if bad:
        raise Failed("\n".join(bad))
    return sorted(found.values(), key=lambda q: (q.name, q.text))


def escape(text: str) -> str:
    for a, b in (("\\", "\\\\"), ("`", "\\`"), ("${", "\\${")):
        text = text.replace(a, b)
    return text


def typescript(queries: list[Query]) -> str:
    lines = ["// Generated file: do not edit.", "", 'import { Surreal, type RecordId, type Duration, type UUID } from "surrealdb";', "", "export type Queries = {"]
    for q in queries:
        variables = f"{q.name}Variables" if q.params else "never"
        lines.append(f"    [{q.name}Query]: {{ variables: {variables}; result: {K.to_typescript(q.kind)} }};")
    lines += ["};", ""]
    for q in queries:
        if q.params:
            lines.append(f"export type {q.name}Variables = {K.to_typescript(K.fields_of(dict(q.params)))};")
        lines.append(f"export const {q.name}Query = `{escape(q.text)}` as const;")
    lines += [
        "",
        "export class TypedSurreal extends Surreal {",
        "    async typed<Q extends keyof Queries>(query: Q, variables?: Queries[Q]['variables']): Promise<Queries[Q]['result']> {",
        "        return (await this.query(query as string, variables)) as Queries[Q]['result'];",
        "    }",
        "}",
        "",
        "export function surql<Q extends string>(query: Q): Q {",
        "    return query;",
        "}",
        "",
    ]
    # constants come first in the file order that TypeScript needs for computed keys
    at = lines.index("export type Queries = {")
    end = lines.index("};", at) + 1
    consts = [x for x in lines if x.startswith("export const ")]
    return "\n".join([*lines[:at], *consts, "", *lines[at:end], *[x for x in lines[end:] if not x.startswith("export const ")]])


def generate(config: Config) -> Path:
    if config.language not in ("typescript", "ts"):
        raise LanguageNotImplemented(f"output in {config.language} is not implemented")
    text = typescript(collect(config))
    config.output.parent.mkdir(parents=True, exist_ok=True)
    config.output.write_text(text)
    if config.format:
        try:
            subprocess.run(["prettier", "--write", str(config.output)], capture_output=True, check=False)
        except FileNotFoundError:
            pass  # the formatter is optional
    return config.output


def watch(config: Config, report=print, rounds: int | None = None, pause: float = 0.5) -> None:
    """Generate, then again whenever an input file changes; errors are reported and do not end it."""
    seen, n = None, 0
    while rounds is None or n < rounds:
        inputs = [*files(config.schema), *(files(config.queries) if config.queries else []), *(config.source.rglob("*") if config.source else [])]
        state = {p: p.stat().st_mtime_ns for p in inputs if p.is_file() and p != config.output}
        if state != seen:
            seen = state
            try:
                report(f"wrote {generate(config)}")
            except QueryError as e:
                report(e.report())
        n += 1
        time.sleep(pause)
