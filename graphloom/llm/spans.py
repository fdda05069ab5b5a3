"""Places of regex matches in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.llm.common import let

KIND = "array<struct<start:int,stop:int,m:string>>"
WITH_CONTEXT = "array<struct<start:int,stop:int,m:string,left:string,after:string>>"


def none(context: int = 0) -> Column:
    return F.array().cast(WITH_CONTEXT if context else KIND)


def find(text: Column, regex: Column | str, context: int = 0) -> Column:
    """The leftmost non-overlapping matches as (start, stop, m), in code points, the end exclusive; with ``context`` also
    (left, after): up to so many characters before the match, back to the start of the match before it, and the one
    behind it. They come from the pieces, since cutting them from the text would read it anew for each match.

    The pieces between the matches and the matches themselves come from one regex each; their lengths add up to the
    places. A text of k matches is added up in blocks of about the root of k, since each step of an aggregate copies
    what it has gathered. The regex must not match the empty string.
    """
    regex = F.lit(regex) if isinstance(regex, str) else regex
    pieces = F.split(text, regex, -1)
    found = F.regexp_extract_all(text, regex, F.lit(0))

    def place(both: Column) -> Column:
        n = F.size(both["m"])
        width = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(32))

        def block(acc: Column, first: Column) -> Column:
            def step(own: Column, m: Column) -> Column:
                a = own["at"] + F.length(F.get(both["p"], first + F.size(own["out"])))
                b = a + F.length(m)
                return F.struct(b.alias("at"), F.array_append(own["out"], F.struct(a.alias("start"), b.alias("stop"), m.alias("m"))).alias("out"))

            inner = F.aggregate(F.slice(both["m"], first + 1, width), F.struct(acc["at"].alias("at"), none().alias("out")), step)
            return let(inner, lambda x: F.struct(x["at"].alias("at"), F.array_append(acc["out"], x["out"]).alias("out")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{KIND}>").alias("out"))
        places = F.aggregate(F.sequence(F.lit(0), n - 1, width), start, block, lambda acc: F.flatten(acc["out"]))
        if context:
            return F.when(n == 0, none(context)).otherwise(F.transform(places, lambda s, i: around(both, s, i)))
        return F.when(n == 0, none()).otherwise(places)

    def around(both: Column, s: Column, i: Column) -> Column:
        before = F.concat(F.coalesce(F.get(both["m"], i - 1), F.lit("")), F.get(both["p"], i))
        behind = F.concat(F.get(both["p"], i + 1), F.coalesce(F.get(both["m"], i + 1), F.lit("")))
        sides = (F.right(before, F.lit(context)).alias("left"), F.substring(behind, 1, 1).alias("after"))
        return F.struct(*[s[c].alias(c) for c in ("start", "stop", "m")], *sides)

    return let(F.struct(pieces.alias("p"), found.alias("m")), place)


def joined(kinded: Column) -> Column:
    """``kind:start:stop`` of an array of structs with those fields, comma-joined."""
    return F.array_join(F.transform(kinded, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
