"""Operators of any style: pieces, decontamination, line dedup, ranking, the Jaccard join, and the pipeline."""

import hashlib
import itertools
import random
import re

from graphloom.llm import decontam, jaccard, linededup, nbest, ranker
from graphloom.llm.jaccard import shingles

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOW = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
SPACES = " \t\n\x0b\x0c\r"


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# pieces
def test_pieces_come_back(odd, corpus, nothing):
    for df in (odd, corpus):
        rows = nbest.report(df).collect()
        assert len(rows) == df.count() and all(r.round_trip for r in rows)
    assert nbest.report(nothing).count() == 0
    pairs = nbest.encode(odd.select("doc_id", "text")).withColumnRenamed("text", "old")
    assert all((r.old or "") == r.text for r in nbest.decode(pairs).collect())


def test_n_best_against_all_segmentations():
    encoder = nbest.Encoder(nbest.Vocabulary(), 3)

    def costs(segment):
        ends = {}
        for start, end, cost, _ in encoder._arcs(segment):
            ends.setdefault(end, []).append((start, cost))

        def upto(end):
            if not end:
                yield 0
            for start, cost in ends.get(end, []):
                for rest in upto(start):
                    yield rest + cost

        return sorted(upto(len(segment)))[:3]

    for text in ["", "a", "hello word of", "thation es\nab ▁", "  two  spaces ", "é\U0001f600x"]:
        each = [costs(s) for s in nbest._SEGMENT.findall(" " + text)] if text else []
        want = sorted(sum(c) for c in itertools.product(*each))[:3]
        found = encoder.encode(text)
        assert [c for c, _ in found] == want and len({ids for _, ids in found}) == len(found)
        assert all(encoder.decode(ids) == text for _, ids in found)


# decontamination
def plain_hits(text, items):
    words = re.findall(WORD, text.translate(LOW))
    hit, found = set(), set()
    for item, body in items:
        own = re.findall(WORD, body.translate(LOW))
        n = min(10, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_decontamination(spark, odd, nothing):
    rng = random.Random(1)
    word = lambda: rng.choice("ab") + rng.choice("xy")
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 9, 10, 11, 30])))) for i in range(3, 25)] + [(30, ""), (31, "three four"), (31, "Three four")]
    docs = [(1000 + i, " ".join(word() for _ in range(rng.randrange(80)))) for i in range(150)] + [(2000 + 10 * n + i, f"Start, {t.upper()}! end") for n, (i, t) in enumerate(items)]
    table = spark.createDataFrame([*items, (None, "ax ax"), (99, None)], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    plain = dict(rows_of(df))
    for block in (200_000, 40):
        rows = decontam.scan(df, table, block_words=block).collect()
        assert len(rows) == df.count()
        for r in rows:
            n, hits, found = plain_hits(plain[r.doc_id], items)
            assert (r.n_words, sum(s.stop - s.start for s in r.hit_spans), list(r.hit_items)) == (n, hits, found)
    for r in decontam.report(df, table).collect():
        n, hits, found = plain_hits(plain[r.doc_id], items)
        assert (r.n_hit, r.n_items, r.contaminated) == (hits, len(found), hits > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
    assert decontam.report(nothing, table).count() == 0
    none = decontam.report(odd, table.limit(0)).collect()
    assert len(none) == odd.count() and not any(r.contaminated for r in none)


def test_cut_leaves_no_passage(spark):
    item = "one two three four five six seven eight nine ten eleven"
    filler = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, f"{filler} {item.upper()}, {filler}", "k", 5), (2, item, "k", 5), (3, filler, "k", 5)], "doc_id long, text string, n_words string, n_chars long")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = {r.doc_id: r for r in decontam.decontaminate(df, items).collect()}
    assert set(rows) == {1, 3} and rows[1].text == f"{filler} , {filler}" and rows[1].n_chars == len(rows[1].text)
    assert rows[3].text == filler and rows[3].n_chars == 5 and rows[3].n_words == "k"


# lines
def plain_lines(rows):
    keyed = [(d, t.split("\n")) for d, t in rows]
    key = lambda x: x.strip(SPACES).translate(LOW)
    held = {}
    for d, lines in keyed:
        for x in lines:
            if d is not None and len(key(x)) >= 10:
                held.setdefault(key(x), set()).add(d)
    out = []
    for d, lines in keyed:
        kept = [x for x in lines if not (d is not None and len(held.get(key(x), ())) > 1 and d > min(held[key(x)]))]
        out.append((str(d), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup(odd, corpus, nothing):
    for df in (odd, corpus):
        found = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in linededup.report(df).collect())
        assert found == plain_lines(rows_of(df))
    assert linededup.report(nothing).count() == 0


def test_full_filters_stay_exact(odd, monkeypatch):
    monkeypatch.setattr(linededup, "MOST_BITS", 1024)
    monkeypatch.setattr(linededup, "LEAST_BITS", 1024)
    monkeypatch.setattr(linededup, "FLUSH", 3)
    found = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in linededup.report(odd).collect())
    assert found == plain_lines(rows_of(odd))


# ranking
def test_ranker_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = ranker.report(docs, labels)
    assert scored.count() == docs.count() and scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    held = scored.join(labels, "doc_id").where("held_out")
    assert held.where("predicted = quality").count() >= 0.97 * held.count() > 0


def test_ranker_without_labels(spark, odd, nothing):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    rows = ranker.report(odd, labels).collect()
    assert len(rows) == odd.count() and all(r.score == 0.5 and r.predicted == 1 for r in rows)
    kept = ranker.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert ranker.report(nothing, labels).count() == 0


# the join
def plain_components(rows):
    def sets(text):
        words = [w for w in re.split(f"[{SPACES}]+", text.translate(LOW)) if w]
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    each = [(d, sets(t)) for d, t in rows]
    parent = list(range(len(each)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(each)), 2):
        a, b = each[i][1], each[j][1]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            parent[root(j)] = root(i)
    least = {}
    for i, (d, s) in enumerate(each):
        if d is not None and s:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((str(d), len(s), str(least.get(root(i), d) if s else d)) for i, (d, s) in enumerate(each))


def found_components(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.report(df).collect())


def test_jaccard(odd, corpus, nothing):
    for df in (odd, corpus):
        assert found_components(df) == plain_components(rows_of(df))
    assert jaccard.report(nothing).count() == 0


def test_jaccard_near_the_threshold(spark, monkeypatch):
    """Chains of edits, shared passages and frequent tokens, with tiny blocks, salts, frequencies and names."""
    for name, value in (("BLOCK_TOKENS", 60), ("SALT", 3), ("LOCAL_LEAST", 2), ("FREQUENT_LEAST", 3), ("NAME_BITS", 3), ("FLUSH", 500)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(3000)}"
    passage, docs = [word() for _ in range(60)], []
    for _ in range(14):
        text = [word() for _ in range(rng.randrange(8, 70))]
        for _ in range(rng.randrange(1, 7)):
            docs.append(" ".join(text))
            text = list(text)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = word()
            text += [word()] * rng.randrange(0, 3)
    docs += [" ".join([word() for _ in range(rng.randrange(0, 22))] + passage + [word() for _ in range(rng.randrange(0, 22))]) for _ in range(40)]
    rng.shuffle(docs)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    assert found_components(df) == plain_components(rows_of(df))


def test_shingles_are_sets_of_windows():
    text = "A b c d e f a b c d e"
    assert len(shingles(text.encode())) == 6 and set(shingles(b"a  b\tc\nd E")) <= set(shingles(text.encode()))
    assert len(shingles(b"one two")) == 1 and len(shingles(b" \n ")) == 0


# the pipeline
def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = rows_of(docs)
        docs = corpus_pipeline.materialise(stage(spark, docs, sf), name)
        assert docs.columns == names
        after = dict(rows_of(docs))
        if name == "lines":
            want = {d: h for d, _, _, h in plain_lines(before)}
            assert {str(d): hashlib.sha256(t.encode()).hexdigest() for d, t in after.items()} == want
        if name == "near_duplicates":
            assert {str(d) for d in after} == {c for _, _, c in plain_components(before)}
        if name == "benchmark":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            clean = {d for d, t in before if not plain_hits(t, items)[1]}
            assert clean <= set(after) and all(dict(before)[d] == after[d] for d in clean)
            assert not any(plain_hits(t, items)[1] > 0 for t in after.values())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id: r.text for r in nbest.decode(last.select("doc_id", "ids")).collect()} == dict(rows_of(docs))
