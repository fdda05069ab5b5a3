"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a predicate that rejects a document. On a sample of some ``SAMPLE`` documents, drawn by a hash of their
doc_id, the cascade counts what each rule costs (the characters, words, lines and windows that it touches) and which
share it rejects, and puts the rules in the order of rejection per cost. They are then evaluated in that order, and the first that rejects ends the row's evaluation. The
order changes the time, never the verdict.

Defined results: a null text is an empty one; an empty text has no words and fails; an empty table keeps nothing and
leaves the rules as listed; repeated rows get equal verdicts; of rules with the same rejection per cost the one that is
listed first goes first; a very long text is judged like any other, in one row. Input columns named like a returned one are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import let, packed

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Documents, about, that costs and selectivities are estimated on.
SAMPLE = 2_000


def words_array(text: Column) -> Column:
    """The words of a text; none for an empty one."""
    trimmed = F.trim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+", -1))


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long")


def n_times(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / F.lit(len(what))


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Words inside five-word windows that occur at least twice in the text, the first occurrence included.

    Windows are told apart by 64-bit hashes, within one text. Most texts have no repeat and end there; for the others
    the hashes are sorted with their places, equal neighbours are repeats, and the cover of their places is counted.
    """

    def cover(found: Column) -> Column:
        same = lambda s, j: F.coalesce(F.get(found, j)["h"] == s["h"], F.lit(False))
        places = F.sort_array(F.transform(F.filter(found, lambda s, i: same(s, i - 1) | same(s, i + 1)), lambda s: s["i"]))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5)))), F.lit(0), lambda a, b: a + b))

    def count(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ranked, cover))

    hashes = let(words, lambda w: F.slice(F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, 5)])), F.lit(1), F.size(w) - 4))
    return F.when(F.size(words) < 6, F.lit(0)).otherwise(let(hashes, count)).cast("long")


@dataclass(frozen=True)
class Rule:
    """``rejects`` is the condition over ``_text`` and ``_words``; ``cost`` counts what it touches in a document."""

    name: str
    cost: Callable[[], Column]
    rejects: Callable[[], Column]


def _share(count: Column, whole: Column, limit: float) -> Column:
    return count > F.lit(limit) * F.greatest(whole, F.lit(1))


def _characters() -> Column:
    return F.length("_text")


def _line_work() -> Column:
    """The characters, to count the lines; of more than four, each line and its characters again."""
    lines = n_times(F.col("_text"), "\n") + 1
    return F.length("_text") + F.when(lines > 4, F.length("_text") + lines).otherwise(0)


def _window_work() -> Column:
    """The words; of six or more, the windows and each word's characters in five of them."""
    return F.size("_words") + F.when(F.size("_words") < 6, 0).otherwise(F.size("_words") - 4 + 5 * word_chars(F.col("_words")))


#: Limits that no ordinary prose comes near.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda: F.lit(1), lambda: F.size("_words") < 10),
    Rule("long_words", lambda: F.size("_words") + word_chars(F.col("_words")), lambda: word_chars(F.col("_words")) > 40 * F.size("_words")),
    Rule("symbols", _characters, lambda: _share(n_symbols(F.col("_text")), F.length("_text"), 0.1)),
    Rule("shouting", _characters, lambda: _share(n_times(F.col("_text"), "!"), F.size("_words"), 0.3)),
    Rule("bars", _characters, lambda: _share(n_times(F.col("_text"), " | "), F.size("_words"), 0.3)),
    Rule("dup_lines", _line_work, lambda: let(n_times(F.col("_text"), "\n") + 1, lambda n: (n > 4) & _share(n_dup_lines(F.col("_text")), n, 0.5))),
    Rule("repeats", _window_work, lambda: 100 * n_repeat_words(F.col("_words")) > 20 * F.size("_words")),
)


def _prepared(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("_text", text).withColumn("_words", words_array(F.col("_text")))


def measured(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> list[tuple[float, float]]:
    """(share rejected, mean cost) of each rule, from some ``sample`` documents that a hash of doc_id draws."""
    share, all_of = sample / max(docs.count(), 1), 1 << 30
    drawn = docs.select("doc_id", "text")
    if share < 1:
        drawn = drawn.where(F.pmod(F.xxhash64("doc_id"), F.lit(all_of)) < F.lit(int(share * all_of)))
    row = _prepared(drawn.select("text")).agg(
        *[F.avg(r.rejects().cast("int")).alias(f"r{i}") for i, r in enumerate(rules)],
        *[F.avg(r.cost()).alias(f"c{i}") for i, r in enumerate(rules)],
    ).first()
    return [(row[f"r{i}"] or 0.0, row[f"c{i}"] or 0.0) for i in range(len(rules))]


def order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> list[Rule]:
    """The rules by rejection per cost, as the sample shows it; of equal ones the earlier first."""
    gain = {r.name: (share / (1 + cost), -i) for i, (r, (share, cost)) in enumerate(zip(rules, measured(docs, rules, sample), strict=True))}
    return sorted(rules, key=lambda r: gain[r.name], reverse=True)


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``passed`` boolean: no rule rejects the document."""
    ranked = order(docs, rules, sample)
    verdict = F.when(ranked[0].rejects(), F.lit(False))
    for rule in ranked[1:]:
        verdict = verdict.when(rule.rejects(), F.lit(False))
    judged = _prepared(packed(docs, "text")).withColumn("passed", verdict.otherwise(F.lit(True)))
    return judged.select(*[F.col("_docs")[c].alias(c) for c in docs.columns if c.lower() != "passed"], "passed")


def report(docs: DataFrame) -> DataFrame:
    """The counts of the contract for each document, and the verdict of the cascade.

    What the base rule needs is counted for every row anyway; the cascade takes over its two rules' results.
    """
    docs = docs.select("doc_id", "text")
    base = (F.size("_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.size("_words"))
    rest = tuple(r for r in RULES if r.name not in ("few_words", "repeats"))
    ranked = order(docs)
    verdict = F.when(F.col("base_failed"), F.lit(False))
    for rule in (r for r in ranked if r in rest):
        verdict = verdict.when(rule.rejects(), F.lit(False))
    counted = _prepared(docs).withColumn("n_repeat_words", n_repeat_words(F.col("_words"))).withColumn("base_failed", base)
    return counted.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        word_chars(F.col("_words")).alias("word_chars"),
        n_symbols(F.col("_text")).alias("n_symbols"),
        n_dup_lines(F.col("_text")).alias("n_dup_lines"),
        "n_repeat_words",
        "base_failed",
        verdict.otherwise(F.lit(True)).alias("kept"),
    )
