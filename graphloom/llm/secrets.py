"""Secret scan with a random forest against false positives, in DataFrame functions only.

Candidates are of two kinds. Runs are 12 or more key characters that hold a digit, wherever they stand. Values are what
a cue like ``password`` or ``api_key`` is set to (quoted, or up to the next blank; 6 characters at least) and what
stands for the password in an address (4 at least); they need no digit and may hold any character. A forest over ten
features decides on each: its length, how often neighbouring characters change their class, how much of it a small
dictionary covers, its share of digits, whether it looks like a path, what the words before it suggest, whether it
begins like a known key, how it is set, how many kinds of character it mixes, and whether it reads like a reference, a
placeholder or prose. It is trained from labelled findings; by default these come from a rule with a fixed seed that
writes secrets of common make and the look-alikes that scans trip over.

Training takes at most ``MAX_FINDINGS`` labelled findings; every text is scanned whole. The forest is compiled to
column expressions.

Defined results: a null or empty text has no candidates; repeated rows are treated alike; spans are in code points, the
end exclusive; a run that is also a value, or lies in a value that is a secret, counts once, as the value; an empty table
gives no rows. Only the result's columns are returned.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import let
from graphloom.llm.spans import find, none

MAX_FINDINGS, TREES, DEPTH, SEED = 4_000, 15, 7, 5
#: A signed web token, whole with its dots, or a run of key characters.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?:eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]*+)?|(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+={0,2})"
LEFT = 64
#: What may be set to a secret; the short words only as words of their own, or after a mark.
NAMES = r"(?:token|secret|passw(?:or)?d|passphrase|passwd|pwd|(?:api|access|private|secret|signing|encryption)[_-]?key|credentials?|authorization|bearer|(?<![A-Za-z])(?:key|pass|auth))"
SET = r"(?:\\?[\"'])?(?:\s{0,24}(?::=|={1,3}>?|::?|>)|\s{1,8}is\b)\s{0,24}(?:(?:bearer|basic|token)\s{1,8})?(?:[bfru]{1,2}(?=\\?[\"'`]))?"
#: A value up to its quote, else up to the next blank, closing tag or next setting.
QUOTED = r"\\?(?:\"[^\"\n]{6,}+(?=\")|'[^'\n]{6,}+(?=')|`[^`\n]{6,}+(?=`))"
BARE = r"\\?[\"'`]?(?:(?!</|[,;&]\w{1,40}[\"']?\s?[:=])[^\s\"'`]){6,}+"
USER = r"://[^\s/@:\"'?#]*+:"
VALUE = f"(?i)(?:{NAMES}{SET}(?:{QUOTED}|{BARE})|{USER}[^\\s/\"'<>?#]{{4,}}(?=@))"
#: What stands before the value in a match.
LEAD = f"(?:{NAMES}{SET}\\\\?[\"'`]?|{USER})"
CUE = r"(?i)(?:token|secret|passw(?:or)?d|passwd|pwd|pass|api[_-]?key|access[_-]?key|private[_-]?key|key|auth(?:orization)?|bearer|credentials?)[\"']?\s*(?:[:=]|\bis\b)?\s*[\"']?$"
FOE = r"(?i)(?:sha-?(?:1|256|512)?|md5|checksum|digest|commit|revision|rev|uuid|guid|etag|isbn|order|invoice|card|phone|version|build|path|file|url|id|no)[\"']?\s*[:=#]?\s*[\"']?$"
PREFIX = r"^(?:AKIA|ASIA|gh[pousr]_|glpat-|xox[abprs]-|sk_live_|sk-|AIza|SG\.|npm_|eyJ)"
#: Common words and parts of names; what they cover of a candidate speaks against a secret.
DICTIONARY = (
    "the", "and", "for", "with", "from", "that", "this", "name", "file", "path", "test", "data", "user", "time", "line", "text", "page", "index",
    "version", "release", "config", "module", "class", "value", "number", "image", "table", "report", "example", "sample", "default", "src", "lib",
    "home", "usr", "tmp", "http", "www", "html", "json", "com", "tion", "ing", "ment", "able", "about", "after", "again", "also", "before", "being",
    "between", "both", "could", "down", "each", "even", "every", "first", "given", "good", "great", "group", "hand", "have", "here", "high", "into",
    "just", "know", "large", "last", "left", "life", "like", "list", "long", "made", "make", "many", "more", "most", "much", "must", "need", "never",
    "next", "only", "open", "order", "other", "over", "part", "place", "point", "right", "same", "second", "show", "small", "some", "state", "still",
    "such", "take", "than", "their", "them", "then", "there", "these", "they", "thing", "think", "three", "through", "under", "upon", "very", "want",
    "water", "well", "were", "what", "when", "where", "which", "while", "will", "word", "work", "world", "would", "write", "year", "access",
    "account", "action", "active", "address", "admin", "agent", "alert", "alias", "allow", "apply", "array", "async", "audit", "auth", "backup",
    "base", "batch", "begin", "block", "board", "body", "book", "boot", "branch", "browser", "buffer", "build", "button", "cache", "call", "card",
    "case", "catch", "chain", "change", "channel", "char", "check", "child", "client", "clone", "cloud", "code", "color", "column", "command",
    "comment", "commit", "common", "compile", "component", "connect", "console", "const", "container", "content", "context", "control", "cookie",
)
#: References, placeholders and calls, which stand where a secret would.
REFERENCE = r"(?i)^(?:\$[{(A-Z_]|<|\{\{|\(|\[|%[({A-Z_]+%?$)|^[A-Z_][\w.]*[(\[]|^(?:self|this|os|env|process|config|settings|args|options|user|request|params|data)[._]|::|://|^(.)\1+$|your|change.?me|placeholder|example|redacted|^(?:db|my|the)?[_-]?(?:password|passwd|secret|token|api.?key)$|^(?:null|none|undefined|true|false|string|required|optional|missing|invalid|default|hidden|unknown)$"
FEATURES = ("size", "changes", "covered", "digits", "path", "cue", "known", "set", "classes", "prose")


def features(m: Column, left: Column) -> Column:
    """The features of a candidate ``m`` with the text ``left`` of it, as array<double>."""
    size = F.length(m).cast("double")
    shape = F.translate(F.regexp_replace(F.regexp_replace(m, "[A-Z]", "A"), "[a-z]", "a"), "123456789", "000000000")
    changes = F.length(F.regexp_replace(shape, r"(.)\1*+", ".")) / size
    covered = (size - F.length(F.regexp_replace(F.lower(m), "|".join(DICTIONARY), ""))) / size
    digits = (size - F.length(F.translate(m, "0123456789", ""))) / size
    path = F.when(m.rlike(r"/[^/]+/|^/|_[a-z]+_|-[a-z]+-"), 1.0).otherwise(0.0)
    cue = F.when(left.rlike(FOE), -1.0).when(left.rlike(CUE), 1.0).otherwise(0.0)
    cue = F.when(left.rlike("(?i)" + LEAD + "$"), 1.0).otherwise(cue)
    known = F.when(m.rlike(PREFIX), 1.0).otherwise(0.0)
    how = F.when(left.rlike(USER + "$"), 3.0).when(left.rlike("[\"'`]$"), 2.0).when(left.rlike("[=>]$"), 1.5).when(left.rlike(r"[:=>]\s*$"), 1.0).otherwise(0.0)
    classes = F.lit(0.0)
    for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"):
        classes = classes + m.rlike(c).cast("double")
    prose = F.when(m.rlike(REFERENCE), 2.0).when(m.rlike(r"\s"), 1.0).otherwise(0.0)
    return F.array(size, changes, covered, digits, path, cue, known, how, classes, prose)


def findings(spark: SparkSession, n: int = 4_000) -> DataFrame:
    """Labelled findings (m, left, label) from a rule: n rows, half of them secrets."""
    i = F.col("id")
    hexes = F.sha2(F.concat(i.cast("string"), F.lit("s")), 256)
    b64 = F.translate(F.base64(F.unhex(hexes)), "=", "")
    caps = F.upper(F.translate(b64, "+/", "XY"))
    words = F.array(*[F.lit(w) for w in DICTIONARY[8:]])
    word = lambda k: F.get(words, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(DICTIONARY) - 8)).cast("int"))
    some = lambda *x: F.get(F.array(*[F.lit(v) for v in x]), F.pmod(F.xxhash64("id", F.lit(99)), F.lit(len(x))).cast("int"))
    size = lambda least, most: (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(most - least)) + least).cast("int")
    cue = some('token = "', "password=", "secret: ", "api_key = '", "Authorization: Bearer ", "access key ", "pwd=")
    foe = some("sha256: ", "commit ", "md5 ", "checksum = ", "uuid: ", "id=", "order no ")
    prose = some("and the ", "of this ", "was ", "in ", "", "see ", "with ")
    digits = F.translate(F.substring(hexes, 1, 30), "abcdef", "012345")
    letters = F.translate(hexes, "0123456789abcdef", "eatoinshrdlucmpy")
    mark = some("!", "#", "$", "%", "^", "@", "*", "!!", "?", "&")
    short = F.get(F.array(F.concat(F.substring(letters, F.lit(1), size(4, 9)), F.substring(digits, F.lit(1), size(1, 4))), F.concat(F.initcap(word(5)), F.substring(digits, 1, 4), mark), F.concat(F.substring(b64, F.lit(1), size(3, 9)), mark, F.substring(b64, 20, 4))), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(3)).cast("int"))
    bare = some("password: ", "password=", "DB_PASSWORD=", "passwd: ", "pwd=", "secret: ", "pass: ", "token=")
    quoted = some('password = "', "password: '", '"password": "', "api_key = '", 'apiKey: "', 'secret="', "token = '", 'pwd = "')
    equals = some("password=", "DB_PASSWORD=", "pwd=", "token=", "api_key=", "secret=", "<password>")
    loose = some("password: ", "key: ", "Key: ", "secret: ", "auth: ", "credentials: ", "token: ", "pass: ", "the key is ", "password is ")
    user = some("postgres://bob:", "https://user:", "mysql://root:", "redis://:", "mongodb+srv://admin:", "ftp://anna:", "amqp://svc-app:")
    false = some("<your-password>", "${DB_PASSWORD}", "$PASSWORD", "os.environ['X']", "getpass.getpass()", "changeme", "xxxxxxxx", "********", "your_api_key_here", "config.password", "process.env.TOKEN", "undefined", "self.token", "get_token(user)", "tokens[0]", "{{ password }}", "required")
    sentence = F.concat_ws(" ", F.initcap(word(5)), word(6), F.substring(letters, 1, 5), word(8))
    kinds = [
        (F.substring(hexes, F.lit(1), size(16, 64)), cue, 1),
        (F.substring(b64, F.lit(1), size(16, 43)), cue, 1),
        (F.concat(F.lit("AKIA"), F.substring(caps, 1, 16)), F.when(i % 3 == 0, cue).otherwise(prose), 1),
        (F.concat(some("ghp_", "glpat-", "xoxb-", "sk_live_", "npm_"), F.substring(F.translate(b64, "+/", "ab"), 1, 36)), F.when(i % 2 == 0, cue).otherwise(prose), 1),
        (F.substring(b64, F.lit(1), size(30, 43)), prose, 1),
        (F.concat(F.lit("eyJ"), F.substring(F.translate(b64, "+/", "-_"), 1, 20), F.lit("."), F.translate(b64, "+/", "-_"), F.lit("."), F.substring(F.translate(b64, "+/", "-_"), F.lit(5), size(20, 38))), F.when(i % 2 == 0, cue).otherwise(prose), 1),
        (F.substring(hexes, F.lit(1), F.when(i % 2 == 0, 40).otherwise(64)), foe, 0),
        (F.concat_ws("_", word(1), word(2), F.substring(digits, 1, 2)), F.when(i % 4 == 0, cue).otherwise(prose), 0),
        (F.concat(F.lit("/"), F.concat_ws("/", word(1), word(2), F.concat(word(3), F.substring(digits, 1, 3)))), prose, 0),
        (F.substring(digits, F.lit(1), size(12, 20)), F.when(i % 2 == 0, foe).otherwise(prose), 0),
        (F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12)), F.when(i % 2 == 0, foe).otherwise(prose), 0),
        (short, F.when(F.pmod(F.xxhash64("id", F.lit(4)), F.lit(2)) == 0, quoted).otherwise(bare), 1),
        (F.substring(letters, F.lit(1), size(6, 40)), quoted, 1),
        (F.translate(F.substring(b64, F.lit(1), size(8, 20)), "0123456789+/", "abcdefghij!_"), F.when(F.pmod(F.xxhash64("id", F.lit(4)), F.lit(2)) == 0, quoted).otherwise(bare), 1),
        (F.when(F.pmod(F.xxhash64("id", F.lit(8)), F.lit(3)) == 0, F.substring(letters, F.lit(1), size(6, 20))).otherwise(short), user, 1),
        (F.substring(letters, F.lit(1), size(6, 30)), equals, 1),
        (short, some("password: ", "passwd: ", "secret: ", "pass: ", "Password: ", "pwd: "), 1),
        (F.when(F.pmod(F.xxhash64("id", F.lit(8)), F.lit(4)) > 0, F.substring(letters, F.lit(1), size(6, 13))).otherwise(F.concat(word(5), word(6))), loose, 0),
        (sentence, quoted, 0),
        (false, F.when(F.pmod(F.xxhash64("id", F.lit(4)), F.lit(3)) == 0, quoted).when(F.pmod(F.xxhash64("id", F.lit(4)), F.lit(3)) == 1, user).otherwise(bare), 0),
        (F.concat(word(5), some("_", ".", "-"), word(6), some("_", ".", "-"), word(8)), F.when(F.pmod(F.xxhash64("id", F.lit(4)), F.lit(2)) == 0, bare).otherwise(loose), 0),
        (F.concat(some("/usr/", "./", "https://", "~/", "../"), F.concat_ws("/", word(5), word(6), word(8))), F.when(F.pmod(F.xxhash64("id", F.lit(4)), F.lit(2)) == 0, quoted).otherwise(loose), 0),
        (F.concat(F.initcap(F.substring(letters, F.lit(1), size(6, 12))), some("", ",", ".")), loose, 0),
    ]
    kind = F.pmod(i, F.lit(len(kinds)))
    pick = lambda j: F.coalesce(*[F.when(kind == k, x[j] if isinstance(x[j], Column) else F.lit(x[j])) for k, x in enumerate(kinds)])
    return spark.range(n).select(pick(0).alias("m"), pick(1).alias("left"), pick(2).alias("label"))


def grow(rows: list[tuple[list[float], int]], rng: random.Random, depth: int):
    """A tree: a share of secrets, or (feature, threshold, low, high), with the least Gini impurity of few features."""
    ones = sum(y for _, y in rows)
    if not depth or ones in (0, len(rows)) or len(rows) < 8:
        return (ones + 0.5) / (len(rows) + 1)
    best = None
    for f in rng.sample(range(len(FEATURES)), 4):
        values = sorted({x[f] for x, _ in rows})
        cuts = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
        for cut in cuts if len(cuts) <= 12 else sorted(rng.sample(cuts, 12)):
            low = [y for x, y in rows if x[f] <= cut]
            a, n = sum(low), len(low)
            b, m = ones - a, len(rows) - n
            impurity = a * (n - a) / n + b * (m - b) / m
            if best is None or impurity < best[0]:
                best = (impurity, f, cut)
    if best is None:
        return (ones + 0.5) / (len(rows) + 1)
    _, f, cut = best
    return (f, cut, grow([r for r in rows if r[0][f] <= cut], rng, depth - 1), grow([r for r in rows if r[0][f] > cut], rng, depth - 1))


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH) -> list:
    """A forest from at most ``MAX_FINDINGS`` labelled findings, drawn by a hash, each tree on a bootstrap of them."""
    some = labelled.select("m", "left", "label").dropna().orderBy(F.xxhash64("m", "left", F.lit(SEED)), "m", "left", "label").limit(MAX_FINDINGS)
    rows = [(list(r[0]), int(r[1])) for r in some.select(features(F.col("m"), F.col("left")), "label").collect()]
    rng = random.Random(SEED)
    return [grow([rng.choice(rows) for _ in rows], rng, depth) for _ in range(trees)] if rows else [1.0]


def score(forest: list, x: Column) -> Column:
    def node(t, x: Column) -> Column:
        if isinstance(t, float):
            return F.lit(t)
        f, cut, low, high = t
        return F.when(F.get(x, F.lit(f)) <= cut, node(low, x)).otherwise(node(high, x))

    def mean(x: Column) -> Column:
        total = node(forest[0], x)
        for t in forest[1:]:
            total = total + node(t, x)
        return total / len(forest)

    return let(x, mean)


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, candidates): the candidates as array<struct<start,stop,score,secret>>."""
    forest = train(findings(docs.sparkSession) if labelled is None else labelled)
    t = F.coalesce(F.col("text"), F.lit(""))

    def judged(s: Column) -> Column:
        return let(score(forest, features(s["m"], s["left"])), lambda p: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), p.alias("score"), (p >= threshold).alias("secret")))

    runs = F.when(t.rlike("[0-9]|eyJ"), find(t, CANDIDATE, LEFT)).otherwise(none(LEFT))
    values = F.when(t.rlike(VALUE), F.transform(find(t, VALUE, LEFT), _value)).otherwise(none(LEFT))
    found = docs.select("doc_id", runs.alias("_r"), values.alias("_v"))
    found = found.select("doc_id", F.transform("_r", judged).alias("_r"), F.transform("_v", judged).alias("_v"))
    return found.select("doc_id", F.when(F.size("_v") == 0, F.col("_r")).otherwise(_merged(F.col("_r"), F.col("_v"))).alias("candidates"))


def _value(s: Column) -> Column:
    """The place of the value in a match of ``VALUE``, a bare one without the marks that end a clause."""
    raw = F.regexp_replace(s["m"], "(?i)^" + LEAD, "")
    lead = F.substring(s["m"], F.lit(1), F.length(s["m"]) - F.length(raw))
    m = F.when(lead.rlike("[\"'`]$"), F.regexp_replace(raw, r"\\$", "")).when(lead.startswith("://"), raw).otherwise(F.regexp_replace(raw, r"[,;.:)\]}\\]+$", ""))
    start = s["stop"] - F.length(raw)
    return F.struct(start.alias("start"), (start + F.length(m)).alias("stop"), m.alias("m"), F.right(F.concat(s["left"], lead), F.lit(LEFT)).alias("left"), s["after"].alias("after"))


def _merged(runs: Column, values: Column) -> Column:
    """Both kinds in the order of start. Runs and values overlap only where a run lies within a value."""
    same = lambda r, v: (v["start"] == r["start"]) & (v["stop"] == r["stop"])
    holds = lambda r, v: v["secret"] & (v["start"] <= r["start"]) & (v["stop"] >= r["stop"])
    alone = F.filter(runs, lambda r: ~F.exists(values, lambda v: same(r, v) | holds(r, v)))
    return F.sort_array(F.concat(alone, values))


def report(docs: DataFrame) -> DataFrame:
    """Candidates, secrets, the secrets' spans and the highest score (0 without candidates), one row a document."""
    found = scan(docs.select("doc_id", "text"))
    secret = F.filter("candidates", lambda s: s["secret"])
    spans = F.transform(secret, lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string")))
    top = F.coalesce(F.array_max(F.transform("candidates", lambda s: s["score"])), F.lit(0.0))
    return found.select("doc_id", F.size("candidates").cast("long").alias("n_candidates"), F.size(secret).cast("long").alias("n_secrets"), F.array_join(spans, ",").alias("spans"), top.alias("top_score"))
