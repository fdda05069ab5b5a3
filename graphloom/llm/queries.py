"""The queries of this subpackage, each over its whole table, and their DuckDB oracles where SQL can express them."""

from __future__ import annotations

from graphloom.llm import decontam, jaccard, licenses, linededup, nbest, pii, ranker, rules, secrets, sharding
from graphloom.llm.common import documents


def op1_pii(spark, sf_dir):
    return pii.report(documents(spark, sf_dir))


def op2_nbest_pieces(spark, sf_dir):
    return nbest.report(documents(spark, sf_dir))


def op3_decontaminate(spark, sf_dir):
    return decontam.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_secrets(spark, sf_dir):
    return secrets.report(documents(spark, sf_dir))


def op5_line_dedup(spark, sf_dir):
    return linededup.report(documents(spark, sf_dir))


def op6_quality_ranker(spark, sf_dir):
    return ranker.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_quality_rules(spark, sf_dir):
    return rules.report(documents(spark, sf_dir))


def op8_sharding(spark, sf_dir):
    return sharding.report(documents(spark, sf_dir))


def op9_licenses(spark, sf_dir):
    return licenses.report(documents(spark, sf_dir))


def op10_jaccard_join(spark, sf_dir):
    return jaccard.report(documents(spark, sf_dir))


def pii_base(spark, sf_dir):
    """What the contract fixes of op1, which SQL can express: counts and places of the base spans."""
    return op1_pii(spark, sf_dir).drop("spans")


def license_base(spark, sf_dir):
    """What the contract fixes of op9, which SQL can express: words, places and labels of the base phrases."""
    return op9_licenses(spark, sf_dir).drop("labels", "score")


QUERIES = {
    f.__name__: f
    for f in (pii_base, license_base, op1_pii, op2_nbest_pieces, op3_decontaminate, op4_secrets, op5_line_dedup, op6_quality_ranker, op7_quality_rules, op8_sharding, op9_licenses, op10_jaccard_join)
}

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOW.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = f"""
WITH i AS (SELECT item_id, {_WORDS} w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') g
       FROM i, unnest(range(1, len(w) - least(len(w), 10) + 2)) t(p) WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS} w FROM documents),
dw AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') g
       FROM d, (SELECT DISTINCT n FROM iw) k, unnest(range(1, len(w) - n + 2)) t(p)),
h AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN iw ON iw.n = dw.n AND iw.g = dw.g),
c AS (SELECT doc_id, count(DISTINCT q) n_hit FROM h, unnest(range(p, p + n)) u(q) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(items, '')) items_sha256, n_hit IS NOT NULL contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""

OP5 = f"""
WITH l AS (SELECT doc_id, i, line, {_LOW.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} k
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) x FROM documents),
                unnest(x) WITH ORDINALITY t(line, i)),
r AS (SELECT k, min(doc_id) first_doc FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
f AS (SELECT l.*, first_doc IS NOT NULL AND doc_id > first_doc gone FROM l LEFT JOIN r USING (k))
SELECT doc_id, count(*) n_lines, CAST(count(*) FILTER (gone) AS BIGINT) n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) kept_sha256
FROM f GROUP BY doc_id
"""

_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP7 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, {_SPACED} w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') g FROM d, unnest(range(1, len(w) - 3)) u(p)),
k AS (SELECT doc_id, count(DISTINCT q) n FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) c FROM g),
      unnest(range(p, p + 5)) u(q) WHERE c > 1 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) x FROM d)
      WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
e AS (SELECT doc_id, t, w, len(w) n_words, coalesce(list_sum([length(x) for x in w]), 0) word_chars,
      length(t) - length(translate(t, '#*$%&|<>', '')) n_symbols, coalesce(l.n, 0) n_dup_lines, coalesce(k.n, 0) n_repeat_words,
      len(string_split(t, chr(10))) n_lines, (length(t) - length(replace(t, ' | ', ''))) / 3 n_bars,
      length(t) - length(replace(t, '!', '')) n_bangs
      FROM d LEFT JOIN l USING (doc_id) LEFT JOIN k USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words base_failed FROM e)
SELECT doc_id, CAST(n_words AS BIGINT) n_words, CAST(word_chars AS BIGINT) word_chars, CAST(n_symbols AS BIGINT) n_symbols,
       CAST(n_dup_lines AS BIGINT) n_dup_lines, CAST(n_repeat_words AS BIGINT) n_repeat_words, base_failed,
       NOT (base_failed OR word_chars > 40 * n_words OR n_symbols > 0.1 * greatest(length(t), 1)
            OR n_bangs > 0.3 * greatest(n_words, 1) OR n_bars > 0.3 * greatest(n_words, 1)
            OR (n_lines > 4 AND n_dup_lines > 0.5 * n_lines)) kept
FROM f
"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + least(len(w), 5) - 1], ' ') g
      FROM d, unnest(range(1, len(w) - least(len(w), 5) + 2)) t(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id a, y.doc_id b, count(*) c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id a, doc_id b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(n, 0) n_shingles, component_id
FROM (SELECT a doc_id, min(b) component_id FROM r GROUP BY a) LEFT JOIN n USING (doc_id)
"""

_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' kind, {i} o, regexp_extract_all(t, '{regex}') m, string_split_regex(t, '{regex}') p FROM d"
    for i, (kind, regex) in enumerate(
        (
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
            ("card", r"[0-9](?:[\x20-]?[0-9])+"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
        )
    )
)
_LENGTHS = "coalesce(list_sum(list_transform({0}, lambda x: length(x))), 0)"

PII_BASE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
f AS ({_FOUND}),
s AS (SELECT doc_id, kind, o, m[i] m, regexp_replace(m[i], '[^0-9]', '', 'g') g, {_LENGTHS.format("p[1:i]")} + {_LENGTHS.format("m[1:i - 1]")} a
      FROM f, unnest(range(1, len(m) + 1)) u(i)),
v AS (SELECT *, a + length(m) b FROM s WHERE CASE kind WHEN 'email' THEN true
      WHEN 'ip' THEN coalesce(list_max(list_transform(string_split(m, '.'), lambda x: coalesce(try_cast(x AS HUGEINT), 999))), 999) <= 255
      WHEN 'phone' THEN length(g) BETWEEN 9 AND 15
      ELSE length(g) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(g) + 1), lambda j:
           CASE WHEN j % 2 = 1 THEN CAST(substr(reverse(g), j, 1) AS INT)
                ELSE 2 * CAST(substr(reverse(g), j, 1) AS INT) - CASE WHEN CAST(substr(reverse(g), j, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0 END)
SELECT doc_id, count(*) FILTER (kind = 'email') n_email, count(*) FILTER (kind = 'ip') n_ip, count(*) FILTER (kind = 'card') n_card,
       count(*) FILTER (kind = 'phone') n_phone, sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY o, a), '')) base_sha256
FROM d LEFT JOIN v USING (doc_id) GROUP BY doc_id
"""

LICENSE_BASE = f"""
WITH d AS (SELECT doc_id, {_WORDS} w FROM documents),
h AS (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'mit' AND w[i + 1] = 'license') a,
      list_filter(range(1, len(w) + 1), lambda i: w[i] = 'apache' AND w[i + 1] = 'license') b,
      list_filter(range(1, len(w) + 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') c FROM d)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(len(a) + len(b) + len(c) AS BIGINT) n_base, list_min(a || b || c) - 1 first_word,
       list_max(a || b || c) - 1 last_word, concat_ws(',', CASE WHEN len(b) > 0 THEN 'apache' END, CASE WHEN len(c) > 0 THEN 'gpl' END, CASE WHEN len(a) > 0 THEN 'mit' END) base_labels
FROM h
"""

ORACLES = {"pii_base": PII_BASE, "license_base": LICENSE_BASE, "op10_jaccard_join": OP10, "op7_quality_rules": OP7, "op3_decontaminate": OP3, "op5_line_dedup": OP5}
