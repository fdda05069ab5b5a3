import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, _t string, shard string, ids string, spans string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "Straße", "naïve", "of", "the"]
    long = " ".join(rng.choice(words) + str(rng.randrange(4000)) for _ in range(30_000))
    line = "this very line is found in several documents of the table"
    base = " ".join(rng.choice(words) + str(rng.randrange(90)) for _ in range(60))
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, long), (5, base), (6, base), (6, base), (7, base + " and a tail"), (8, base.upper()),
        (9, f"{line}\nown words of nine\n{line}"), (10, f"  {line.upper()}\t\nown words of ten"), (None, f"{line}\nno id"), (11, line),
        (12, "a@b.co.uk 1.2.3.4 4046195599780836 +1 (229) 555-4838 joe [at] mail [dot] com"), (13, "9" * 5000), (14, "a" * 50_000 + "@"),
        (15, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" commit 04dbebab91ab85687d33eeaaf9ac699e1188f962'),
        (16, "Released under the MIT License. Licensed under the Apache License, Version 2.0. SPDX-License-Identifier: BSD-3-Clause"),
        (17, "one two three four"), (18, "one two  three\nFOUR"), (19, "▁ odd ▁▁ pieces \x00￿\U0001f600"), (20, "w " * 400),
    ]
    full = [(d, t, None, "s" if d and d % 2 else None, None, "x", "y", "z", None, None, "q") for d, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
