"""``python -m graphloom init|check|run|watch [FOLDER]``"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from graphloom.errors import QueryError
from graphloom.tooling import config, project

SAMPLE = """version = "1"
language = "typescript"

[schema]
path = "schema"

[queries]
path = "queries"

[output]
path = "generated/queries.ts"
format = false
"""


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphloom", description="Check queries against a schema and write their types.")
    parser.add_argument("command", choices=["init", "check", "run", "watch"])
    parser.add_argument("folder", nargs="?", default=".", type=Path)
    args = parser.parse_args(argv)
    try:
        if args.command == "init":
            target = args.folder / config.NAME
            if target.exists():
                raise config.ConfigError(f"{target} exists")
            for name in ("schema", "queries"):
                (args.folder / name).mkdir(parents=True, exist_ok=True)
            target.write_text(SAMPLE)
            print(f"wrote {target}")
            return 0
        found = config.find(args.folder)
        match args.command:
            case "check":
                print(f"{len(project.collect(found))} queries are right")
            case "run":
                print(f"wrote {project.generate(found)}")
            case "watch":
                project.watch(found)
    except QueryError as e:
        print(e.report(), file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        pass
    return 0


if __name__ == "__main__":
    sys.exit(main())
