"""The function library: signatures for the analyser, Spark SQL for the planner."""

from __future__ import annotations

from graphloom.functions import arrays, maths, registry, texts, times, values, vectors
from graphloom.functions.registry import Function

LIBRARY: dict[str, Function] = {}
for _module in (arrays, maths, texts, times, values, vectors):
    registry.declare(_module.LINES, LIBRARY)


def find(name: str) -> Function:
    return registry.find(name, LIBRARY)


def aggregate(name: str, args: list[str]) -> str | None:
    """The aggregate of a group that a function over arrays stands for, as Spark SQL; None if there is none."""
    short = name.removeprefix("math::")
    if name.startswith("math::") and short in maths.AGGREGATES:
        return Function(name, (), 0, 9, "any", maths.AGGREGATES[short]).render(args)
    if name in ("time::max", "time::min"):
        return f"{short.removeprefix('time::')}({args[0]})"
    if name == "count":
        return f"count_if(({args[0]}) IS NOT NULL AND coalesce(try_cast({args[0]} AS BOOLEAN), true))" if args else "count(*)"
    if name in ("array::group", "array::distinct"):
        return f"array_sort(collect_set({args[0]}))"
    return None
