"""Edges: empty and clashing tables through the pipeline's stages, equal rows, license texts, the ranker's optimum."""

import math
import random

import pytest

from graphloom.llm import licenses, linededup, ranker, rules, sharding
from graphloom.llm.common import materialise

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["quality", "lines", "near_duplicates", "benchmark"])
def test_stages_on_empty_and_odd_tables(spark, odd, nothing, name):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    none = stage(spark, nothing, SF)
    assert none.columns == nothing.columns and none.count() == 0
    out = stage(spark, odd, SF)
    assert out.columns == odd.columns
    before = {(r.doc_id, r.lang, r.source, r.n_words, r.score, r._t, r.spans) for r in odd.collect()}
    assert {(r.doc_id, r.lang, r.source, r.n_words, r.score, r._t, r.spans) for r in out.collect()} <= before


def test_last_stage_on_an_empty_table(spark, nothing):
    import corpus_pipeline

    assert corpus_pipeline.STAGES[-1][1](spark, nothing, SF).count() == 0


def test_inner_names_do_not_clash(spark):
    rows = [(1, "a line that repeats\nown", "x", "y", "z"), (2, "a line that repeats", "x", "y", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _lost string, _words string, _text string")
    found = {r.doc_id: r for r in linededup.dedup_lines(df).collect()}
    assert (found[1].n_dropped, found[2].n_dropped, found[2]._lost, found[2]._text) == (0, 1, "x", "z")
    kept = rules.cascade(df).collect()
    assert all((r._lost, r._words, r._text) == ("x", "y", "z") for r in kept) and len(kept) == 2


def test_equal_rows_are_cut(spark):
    df = spark.range(40_000).selectExpr("7L doc_id", "'the very same text' text")
    records = materialise(sharding.keyed(df), "equal")
    cuts = sharding.splitters(records, 64)
    counts = [r["count"] for r in records.groupBy(sharding._range_of(cuts).alias("r")).count().collect()]
    assert len(counts) > 32 and max(counts) < 4_000
    rows = sharding.report(df).groupBy("shard").agg({"slot": "max", "*": "count"}).collect()
    assert len(rows) == 16 and all(r["max(slot)"] + 1 == r["count(1)"] and abs(r["count(1)"] - 2_500) <= 1 for r in rows)


TEXTS = {
    "SPDX-License-Identifier: (MIT OR Apache-2.0)": {"mit", "apache-2.0"},
    "// SPDX-License-Identifier: GPL-2.0-only WITH x AND BSD-3-Clause": {"gpl-2.0", "bsd-3-clause"},
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files": {"mit"},
    "Redistribution and use in source and binary forms, with or without\n modification, are permitted": {"bsd-2-clause"},
    "You may not use this file except in compliance with the License.": {"apache-2.0"},
    "either version 2 of it; you should have received a copy of the GNU General Public License along with": {"gpl"},
    "This is free and unencumbered software released into the public domain.": {"unlicense"},
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": {"mpl-2.0"},
    "Unauthorized copying of this file, via any medium is strictly prohibited": {"proprietary"},
    "an ordinary sentence on compliance, warranties and permission": set(),
}


def test_texts_of_licenses(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = {r.doc_id: set(r.labels.split(",")) - {""} for r in licenses.report(df).collect()}
    for i, (text, want) in enumerate(TEXTS.items()):
        assert want <= found[i] and (want or not found[i]), (text, found[i])


def test_ranker_meets_the_optimum():
    """The gradient of the loss over all pairs, summed plainly, vanishes at the weights; the threshold is the quantile."""
    rng = random.Random(4)
    rows = [(int(rng.random() < 0.6), [rng.gauss(0, 1) for _ in range(ranker.N_FEATURES)]) for _ in range(40)]
    rows = [(y, [x[0] + y, *x[1:]]) for y, x in rows]
    model = ranker.fit(rows)
    z = [[max(-8, min(8, (v - m) / s)) for v, m, s in zip(x, model["mean"], model["scale"], strict=True)] for _, x in rows]
    good, bad = ([v for v, (y, _) in zip(z, rows, strict=True) if y == k] for k in (1, 0))
    grad = [ranker.RIDGE * w for w in model["w"]]
    for a in good:
        for b in bad:
            d = [p - q for p, q in zip(a, b, strict=True)]
            p = 1 / (1 + math.exp(sum(w * v for w, v in zip(model["w"], d, strict=True))))
            grad = [g - v * p / (len(good) * len(bad)) for g, v in zip(grad, d, strict=True)]
    assert max(map(abs, grad)) < 1e-6
    below = sum(sum(w * v for w, v in zip(model["w"], x, strict=True)) < model["threshold"] for x in z)
    assert below == len(bad)
