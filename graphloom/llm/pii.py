"""Personal data by weak supervision, in DataFrame functions only.

Candidates are the spans of the strict patterns and of some wider ones. Four labelers vote on each: the pattern itself
with checks of its value, a gazetteer (issuers, address ranges, calling codes, domains), the words before it, and its
borders. Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability and each
pattern's probability of being personal data. A logistic span classifier is then trained on these probabilities: beside
the votes it sees the span itself, its length, its marks and the variety of its characters, for each kind. It decides on
the wider candidates. Spans of the strict patterns always stay.

The corpus is read once: the candidates of every document are written to the shared folder, all of them enter the
counts, and only the counts (their number is bounded by kinds, votes and features) come to the driver.

Defined results: a null text is empty and has no spans; repeated rows are treated alike; an empty table gives no rows;
wider candidates that touch a strict span are dropped; of overlapping matches of one pattern the leftmost counts; a very
long text is searched like any other, in one row. Only the result's columns are returned.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import let, materialise
from graphloom.llm.spans import find, joined, none

#: Possessive forms of the strict patterns; \G and the look-behinds keep long runs linear and change no match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
WIDE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\])\x20?[a-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[a-z0-9-]{1,63}+){1,4}+",
    "ip": r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?!\.?[0-9]|-)",
}
KINDS = ("email", "ip", "card", "phone")
CUES = r"(?i)(?:e-?mail|mail|contact|write|reach|call|tel|phone|fax|mobile|card|visa|pay|ip|address|host|server|login)[^a-z0-9]{0,4}(?:[a-z]{1,8}[^a-z0-9]{1,3})?$"
FOES = r"(?i)(?:version|isbn|issn|order|ref|no|figure|section|id|build|release|page|v)[^a-z0-9]{0,3}$"
GAZETTEER = {
    "email": r"(?i)[.\])]\x20?(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|us)$",
    "ip": r"^(?!0|10\.|127\.|169\.254\.|192\.168\.|22[4-9]|2[3-5][0-9]|fe80|::)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|3[0689])",
    "phone": r"^\+?(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])?[\x20(.-]*[2-9]",
}
LABELERS = 4
#: Characters before a span that a labeler looks at.
LEFT = 24
#: Bounds of the classes of a span's features: length of each kind, marks in it, different characters.
SIZES = {"email": (14, 26), "ip": (10, 24), "card": (15, 18), "phone": (11, 15)}
MARKS, VARIETY = (2, 4), (4, 7)
FEATURES = 3


def luhn(digits: Column) -> Column:
    """Padded to 19 digits, every second one from the right but one is doubled."""
    padded = F.lpad(digits, 19, "0")
    each = [F.substring(padded, k, 1) if k % 2 else F.translate(F.substring(padded, k, 1), "0123456789", "0246813579") for k in range(1, 20)]
    total = each[0].cast("int")
    for x in each[1:]:
        total = total + x.cast("int")
    return total % 10 == 0


def _digits(m: Column) -> Column:
    return F.translate(m, " -().+", "")


def strict(text: Column) -> dict[str, Column]:
    """The strict spans of each kind."""
    size = lambda m: F.length(_digits(m))
    empty = none(LEFT)
    digit = text.rlike("[0-9]")
    ok_card = lambda s: let(_digits(s["m"]), lambda d: F.length(d).between(13, 19) & luhn(d))
    return {
        "email": F.when(text.contains("@"), find(text, EMAIL, LEFT)).otherwise(empty),
        "ip": F.when(digit, F.filter(find(text, IP, LEFT), lambda s: s["m"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))).otherwise(empty),
        "card": F.when(digit, F.filter(find(text, CARD, LEFT), ok_card)).otherwise(empty),
        "phone": F.when(text.contains("+"), F.filter(find(text, PHONE, LEFT), lambda s: size(s["m"]).between(9, 15))).otherwise(empty),
    }


def _code(kind: str, base: bool, s: Column) -> Column:
    """The votes on a span as a number: the kind, then a digit 0 (no), 1 (abstains) or 2 (yes) for each labeler."""
    left, after = s["left"], s["after"]
    varied = F.length(F.array_join(F.array_distinct(F.split(_digits(s["m"]), "")), "")) > 2
    votes = [
        F.when(~varied, 0).otherwise(2 if base else 1),
        F.when(s["m"].rlike(GAZETTEER[kind]), 2).otherwise(0 if kind == "ip" else 1),
        F.when(left.rlike(FOES), 0).when(left.rlike(CUES), 2).otherwise(1),
        F.when(left.rlike(r"[A-Za-z0-9_]$") | after.rlike("^[A-Za-z0-9_]"), 0).otherwise(2),
    ]
    return _number(F.lit(KINDS.index(kind)), votes)


def _number(code: Column, digits: list[Column]) -> Column:
    for v in digits:
        code = code * 3 + v
    return code


def _shape(kind: str, s: Column) -> Column:
    """The features of a span as a number, a digit for the class of each."""
    marks = F.length(s["m"]) - F.length(F.regexp_replace(s["m"], "[^A-Za-z0-9]", ""))
    variety = F.size(F.array_distinct(F.split(F.lower(s["m"]), "")))
    level = lambda x, bounds: F.when(x < bounds[0], 0).when(x < bounds[1], 1).otherwise(2)
    return _number(F.lit(0), [level(F.length(s["m"]), SIZES[kind]), level(marks, MARKS), level(variety, VARIETY)])


def _apart(found: Column, taken: Column) -> Column:
    """The spans of ``found`` that touch none of ``taken``."""
    both = F.struct(found.alias("f"), taken.alias("t"))
    return let(both, lambda x: F.filter(x["f"], lambda s: ~F.exists(x["t"], lambda u: (u["a"] < s["stop"]) & (s["start"] < u["b"]))))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) with strict and wider candidates of every document and the votes on them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("_t"))
    found = found.select("doc_id", "_t", *[c.alias(f"_{k}") for k, c in strict(F.col("_t")).items()])
    t = F.col("_t")
    gate = {"email": t.rlike(r"(?i)[(\[]at[)\]]"), "ip": t.rlike("(?i)[0-9a-f]:[0-9a-f]"), "phone": t.rlike(r"[0-9]{3}[\x20.-][0-9]{3}")}
    shape = lambda kind, base: lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), F.lit(base).alias("base"), _code(kind, base, s).alias("code"), _shape(kind, s).alias("f"))
    parts = [F.transform(f"_{k}", shape(k, True)) for k in KINDS]
    empty = none(LEFT)
    taken = F.concat(*[F.transform(f"_{k}", lambda s: F.struct(s["start"].alias("a"), s["stop"].alias("b"))) for k in KINDS])
    for kind, regex in WIDE.items():
        free = _apart(find(t, regex, LEFT), taken)
        parts.append(F.transform(F.when(gate[kind], free).otherwise(empty), shape(kind, False)))
    return found.select("doc_id", F.concat(*parts).alias("spans"))


def estimate(counts: dict[int, int], rounds: int = 50) -> dict[int, float]:
    """EM over vote patterns (Dawid and Skene's model for each kind): the probability of each pattern."""
    digits = {c: [(c // 3 ** (LABELERS - 1 - i)) % 3 for i in range(LABELERS)] for c in counts}
    out: dict[int, float] = {}
    for kind in {c // 3**LABELERS for c in counts}:
        mine = [c for c in counts if c // 3**LABELERS == kind]
        p = {c: min(0.95, max(0.05, 0.5 + 0.15 * sum(v - 1 for v in digits[c]))) for c in mine}
        for _ in range(rounds):
            total = sum(counts[c] for c in mine)
            prior = (sum(counts[c] * p[c] for c in mine) + 1) / (total + 2)
            like = []  # chance of each vote given yes and no; the added counts say that labelers tend to be right
            for i in range(LABELERS):
                yes, no = [1.0, 1.0, 4.0], [4.0, 1.0, 1.0]
                for c in mine:
                    yes[digits[c][i]] += counts[c] * p[c]
                    no[digits[c][i]] += counts[c] * (1 - p[c])
                like.append(([x / sum(yes) for x in yes], [x / sum(no) for x in no]))
            for c in mine:
                odds = log(prior / (1 - prior)) + sum(log(like[i][0][v] / like[i][1][v]) for i, v in enumerate(digits[c]))
                p[c] = 1 / (1 + exp(-max(-30.0, min(30.0, odds))))
        out |= p
    return out


def _active(code, f, digit) -> list:
    """The places of a span's weights: its kind, each vote, each feature for its kind."""
    kind = digit(code, LABELERS)
    votes = [len(KINDS) + 3 * i + digit(code, LABELERS - 1 - i) for i in range(LABELERS)]
    first = len(KINDS) + 3 * LABELERS
    return [kind, *votes, *[first + 3 * (FEATURES * kind + i) + digit(f, FEATURES - 1 - i) for i in range(FEATURES)]]


def _digit(number: int, place: int) -> int:
    return number // 3**place % (3 if place < LABELERS else len(KINDS))


def train(counts: dict[tuple[int, int], int], probability: dict[int, float], rounds: int = 400, rate: float = 0.5) -> list[float]:
    """The weights of a logistic regression on kind, votes and features, fitted to the estimated probabilities."""
    w, total = [0.0] * (len(KINDS) + 3 * LABELERS + 3 * FEATURES * len(KINDS)), sum(counts.values()) or 1
    weight = {c: (n / total) ** 0.5 for c, n in counts.items()}
    norm = sum(weight.values()) or 1
    places = {c: _active(*c, _digit) for c in counts}
    for _ in range(rounds):
        step = [1e-4 * x for x in w]
        for c, at in places.items():
            off = (1 / (1 + exp(-sum(w[i] for i in at))) - probability[c[0]]) * weight[c] / norm
            for i in at:
                step[i] += off
        w = [x - rate * s for x, s in zip(w, step, strict=True)]
    return w


def score(weights: list[float], code: int, f: int) -> float:
    return 1 / (1 + exp(-sum(weights[i] for i in _active(code, f, _digit))))


def detect(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, spans): the strict spans and the wider candidates that the trained classifier accepts."""
    found = materialise(candidates(docs), "pii")
    rows = found.select(F.explode("spans").alias("s")).groupBy("s.code", "s.f").count()
    counts = {(r[0], r[1]): r[2] for r in rows.collect()}  # at most len(KINDS) * 3 ** (LABELERS + FEATURES) rows
    patterns: dict[int, int] = {}
    for (code, _), n in counts.items():
        patterns[code] = patterns.get(code, 0) + n
    weights = F.array(*[F.lit(w) for w in train(counts, estimate(patterns))])
    digit = lambda x, place: F.floor(x / 3**place).cast("int") % (3 if place < LABELERS else len(KINDS))

    def accepted(s: Column) -> Column:
        total = F.lit(0.0)
        for place in _active(s["code"], s["f"], digit):
            total = total + F.get(weights, place)
        return total >= F.lit(log(threshold / (1 - threshold)))

    kept = F.filter("spans", lambda s: s["base"] | accepted(s))
    rank = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.sort_array(F.transform(kept, lambda s: F.struct(F.array_position(rank, s["kind"]).alias("k"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["base"].alias("base"))))
    return found.select("doc_id", ordered.alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    found = detect(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    n = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
