"""Operators of DataFrame functions: personal data, secrets, rules, sharding, licenses."""

import hashlib
import re
import zlib

from graphloom.llm import licenses, pii, rules, secrets, sharding

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOW = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, regex in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        if kind == "email" and len(text) > 40_000:
            continue  # quadratic in this plain form; the text has none
        for m in re.finditer(regex, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


def test_pii_base(odd, corpus):
    for df in (odd, corpus):
        plain = texts(df)
        rows = pii.report(df).collect()
        assert len(rows) == df.count()
        for r in rows:
            want = base_spans(plain[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x[0] for x in want) for k in pii.KINDS)
            assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(",")) | ({""} if not want else set())


def test_pii_adjacent_matches(spark):
    text = "a@b.c_d@e.f 1.2.3.4.5.6.7.8 0001.2.3.4é@é.c 999.1.1.1 4046195599780836 12"
    row = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(text))


def test_pii_em_separates_reliable_votes():
    yes, no = 2 * 27 + 2 * 9 + 2 * 3 + 2, 0
    p = pii.estimate({yes: 50, no: 50})
    assert p[yes] > 0.9 > 0.1 > p[no]
    weights = pii.train({(yes, 0): 50, (no, 0): 50}, p)
    assert pii.score(weights, yes, 0) > 0.5 > pii.score(weights, no, 0)


def test_pii_classifier_learns_from_the_span():
    """Equal votes, but one shape of span goes with good votes and the other with bad ones."""
    yes, no, torn = 2 * 27 + 2 * 9 + 2 * 3 + 2, 0, 27 + 9 + 3 + 1
    counts = {(yes, 26): 80, (no, 0): 80, (torn, 26): 10, (torn, 0): 10}
    weights = pii.train(counts, pii.estimate({yes: 80, no: 80, torn: 20}))
    assert pii.score(weights, torn, 26) > 0.5 > pii.score(weights, torn, 0)


def test_pii_wide_spans(spark, nothing):
    """Planted data in the wider forms is found, numbers that only look alike are not."""
    good = ["write to joe.%d [at] mail [dot] com today", "call (229) 555-48%02d now", "phone: 229-555-48%02d please", "server 2001:db8:85a3:0:0:8a2e:370:73%02d is up"]
    bad = ["order 555-123-45%02dX", "section 229.555.48%02d7", "ref 100 200 30%02d5"]
    rows = [(k, t % (k % 100)) for k, t in enumerate((good + bad) * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.spans for r in pii.report(df).collect()}
    wanted = [k for k, _ in rows if k % 7 < 4]
    assert sum(bool(found[k]) for k in wanted) >= 0.9 * len(wanted)
    assert sum(bool(found[k]) for k, _ in rows if k % 7 >= 4) <= 0.1 * (len(rows) - len(wanted))
    assert pii.report(nothing).count() == 0


def test_many_matches_in_one_text(spark):
    text = " ".join(f"u{i}@h{i}.org" for i in range(50_000))
    row = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_email == 50_000


def test_secrets(odd, nothing):
    rows = {r.doc_id: r for r in secrets.report(odd).collect()}
    text = texts(odd)[15]
    first = text.index("04d")
    assert rows[15].n_candidates == 2 and rows[15].spans == f"{first}:{first + 40}"
    assert rows[1].n_candidates == 0 and rows[1].top_score == 0
    assert secrets.report(nothing).count() == 0


def test_secret_forest_on_held_out_findings(spark):
    made = secrets.findings(spark, 3000)
    forest = secrets.train(made.where("id % 4 <> 0" if "id" in made.columns else "crc32(m) % 4 <> 0"))
    rest = made.where("crc32(m) % 4 = 0")
    from pyspark.sql import functions as F

    right = rest.select(((secrets.score(forest, secrets.features(F.col("m"), F.col("left"))) >= 0.5).cast("int") == F.col("label")).alias("ok"))
    assert right.where("ok").count() >= 0.95 * rest.count()


def plain_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            lines += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    cover = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, len(cover)


def test_rules(odd, corpus, nothing):
    for df in (odd, corpus):
        plain = texts(df)
        for r in rules.report(df).collect():
            want = plain_rules(plain[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
            assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
            assert not (r.base_failed and r.kept)
    assert rules.report(nothing).count() == 0 and rules.cascade(nothing).count() == 0


def test_rule_order_never_changes_the_verdict(odd):
    forward = {(r.doc_id, r.passed) for r in rules.cascade(odd).select("doc_id", "passed").collect()}
    backward = {(r.doc_id, r.passed) for r in rules.cascade(odd, rules.RULES[::-1]).select("doc_id", "passed").collect()}
    assert forward == backward
    assert {r.name for r in rules.order(odd)} == {r.name for r in rules.RULES}


def test_sharding(odd, corpus, nothing):
    for df in (odd, corpus):
        rows = sharding.report(df).collect()
        plain = texts(df)
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in df.collect())
        slots, sizes = {}, {}
        for r in rows:
            assert r.size == len(plain[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(plain[r.doc_id].encode())
            slots.setdefault(r.shard, []).append(r.slot)
            sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        largest = max(r.size for r in rows)
        assert max(sizes.values()) <= sum(sizes.values()) / 16 + largest
    assert sharding.report(nothing).count() == 0


def test_sharding_of_one_hot_text(spark):
    df = spark.range(4000).selectExpr("id doc_id", "if(id % 3 = 0, concat('own ', id), repeat('same ', 20)) text")
    sizes = {r.shard: r.s for r in sharding.report(df).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "s").collect()}
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 202


def test_licenses(odd, corpus, nothing):
    for df in (odd, corpus):
        plain = texts(df)
        for r in licenses.report(df).collect():
            words = re.findall(WORD, plain[r.doc_id].translate(LOW))
            places = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
            assert (r.n_words, r.n_base) == (len(words), len(places))
            assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
            assert r.base_labels == ",".join(sorted({x for _, x in places}))
            assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert next(r.labels for r in licenses.report(odd).collect() if r.doc_id == 16) == "apache,apache-2.0,bsd-3-clause,mit"
    assert licenses.report(nothing).count() == 0
    assert len(licenses.rules()) > 200
