"""The project file ``graphloom.toml``: version, language, schema.path, queries.path, output.path, output.format."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from graphloom.errors import QueryError

NAME = "graphloom.toml"


class ConfigError(QueryError):
    advice = "correct the project file"


@dataclass
class Config:
    root: Path
    version: str
    language: str
    schema: Path
    output: Path
    format: bool
    queries: Path | None = None
    source: Path | None = None
    extensions: tuple[str, ...] = field(default=(".ts", ".js", ".jsx", ".tsx", ".svelte", ".vue"))


def load(path: Path) -> Config:
    """Paths in the file are relative to its folder and must exist, but for the output."""
    raw = tomllib.loads(path.read_text())
    root = path.parent

    def need(*keys: str):
        here = raw
        for k in keys:
            if k not in here:
                raise ConfigError(f"{path}: {'.'.join(keys)} is missing")
            here = here[k]
        return here

    def there(*keys: str, optional: bool = False) -> Path | None:
        if optional and (keys[0] not in raw or keys[1] not in raw[keys[0]]):
            return None
        found = root / need(*keys)
        if not found.exists():
            raise ConfigError(f"{path}: {found} does not exist")
        return found

    return Config(root, str(need("version")), str(need("language")).lower(), there("schema", "path"), root / need("output", "path"), bool(need("output", "format")), there("queries", "path", optional=True), there("queries", "src", optional=True))


def find(start: Path) -> Config:
    """The file in a folder or the nearest one above it."""
    for folder in (start.resolve(), *start.resolve().parents):
        if (folder / NAME).is_file():
            return load(folder / NAME)
    raise ConfigError(f"no {NAME} in {start} or above it")
