"""The ranker learns from all labelled rows and all pairs, at any size."""

import random

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import ranker


def drawn(n, seed=5):
    rng = random.Random(seed)
    for _ in range(n):
        y = int(rng.random() < 0.55)
        yield y, [rng.gauss(0, 1) + (y if i == 0 else 0) for i in range(ranker.N_FEATURES)]


def plain_gradient(rows, model):
    y, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8)
    s, grad = z @ model["w"], np.zeros(x.shape[1])
    for a, t in zip(z[y == 1], s[y == 1], strict=True):
        grad -= (a - z[y == 0]).T @ (1 / (1 + np.exp(t - s[y == 0])))
    return grad / ((y == 1).sum() * (y == 0).sum()) + ranker.RIDGE * model["w"]


def test_all_pairs_of_many_rows():
    rows = list(drawn(1200))  # some 350,000 pairs
    assert np.abs(plain_gradient(rows, ranker.fit(rows))).max() < 1e-9


def test_every_labelled_row_counts(spark):
    rng = random.Random(8)
    words = ["alpha", "Beta", "gamma,", "delta!", "12", "#", "of", "the\n", "x|y"]
    # of more than 20,000 labelled rows, the quantile of all training scores parts as many as are labelled 0
    rows = [(i, " ".join(rng.choice(words) + str(rng.randrange(10**6)) for _ in range(rng.randrange(3, 12))), int(rng.random() < 0.6)) for i in range(36_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)
    got = ranker.report(df.select("doc_id", "text"), df.select("doc_id", "quality")).join(df, "doc_id").where("NOT held_out")
    n, zeros, less, upto = got.agg(F.count("*"), *[F.count_if(F.expr(e)) for e in ("quality = 0", "score < 0.5", "score <= 0.5")]).first()
    assert n > 23_000 and less <= zeros <= upto and upto - less < 10


def test_a_table_is_fitted_like_a_list(spark):
    rows = list(drawn(3000, 6))
    df = spark.createDataFrame(rows, "y int, x array<double>").repartition(5).cache()
    table, plain = ranker.fit_table(df), ranker.fit(rows)
    assert all(np.allclose(table[k], plain[k], rtol=0, atol=1e-9) for k in plain)
    assert ranker.fit_table(df.where("y = 1")) is None and ranker.fit_table(df.where("y > 1")) is None


def test_ranks_with_ties(spark, monkeypatch):
    monkeypatch.setattr(ranker, "FEW", 1)
    values = sorted([-(2**63), -5, -5, -5, 0, 1, 7, 7, 2**40, 2**62, 2**63 - 1])
    keys = spark.createDataFrame([(v,) for v in values], "key long")
    assert [ranker.ranked(keys, k) for k in range(1, len(values))] == list(zip(values, values[1:], strict=False))
