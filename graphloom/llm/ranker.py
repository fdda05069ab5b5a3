"""Quality classifier learnt by Bradley-Terry pairwise ranking.

A document's score is a weight vector times its text features. The weights are learnt from preference pairs (a document
labelled 1 before one labelled 0) by logistic loss on the difference of their features, as in the Bradley-Terry model.
The decision threshold is the quantile of the training scores at the share of rows labelled 0.

The model is fitted on every labelled row that may be learnt from, and on every pair of a row labelled 1 and one labelled
0. The pairs are never listed: the loss of a pair depends on the difference of two scores alone, and it is smooth. So each
row is written as weights of the Chebyshev nodes of the piece of the score axis it lies in (`moments`), and the sum over
all pairs becomes a sum over pairs of nodes, equal to it but for rounding (some 1e-12). A step of Newton's method is one
pass over the rows, and the driver gets sums for each piece of the axis that holds a score. The threshold is found by
counting scores by their leading bits, so it is the exact quantile of all training scores. Every document is scored on
its whole text; no other column enters a score.

Defined results: a null text is an empty text, and gets a score; labels that are null, or contradict each other for one
doc_id, are left out; without labels of both kinds every score is 0.5; repeated rows get equal scores; of several texts
with one labelled doc_id the one with the least features is learnt from. Input columns named like a returned one are
replaced.
"""

from __future__ import annotations

from operator import eq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import add_columns, discard, materialise, slices, trimmed, utf8

RIDGE, STEPS = 1e-3, 60
NODES = 16  # to a piece of the score axis of width 2: a pair's loss is met to some 1e-12 there
BITS, FEW = 13, 4096  # of a score that one count looks at; scores that the driver may sort
_SYMBOLS, _UPPER, _MARKS, _DIGITS = b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:?", b"0123456789"
_BREAKS = b"!|\n"
N_FEATURES = 12


def features(text: bytes) -> list[float]:
    words = text.split()
    size, n = max(1, len(text)), max(1, len(words))
    count = lambda kind: len(text) - len(text.translate(None, kind))
    bang, bar, lines = (text.count(x) for x in (b"!", b"|", b"\n"))
    repeated = sum(map(eq, words, words[1:])) / n
    return [
        (count(_SYMBOLS) / size) ** 0.5,
        (count(_UPPER) / size) ** 0.5,
        (count(_MARKS) / n) ** 0.5,
        (count(_DIGITS) / size) ** 0.5,
        (bang / n) ** 0.5,
        (bar / n) ** 0.5,
        (lines / n) ** 0.5,
        repeated**0.5,
        len(set(words)) / n,
        min(size / n, 40.0) / 10,
        min(len(words), 100) / 100,
        1.0 if not words else 0.0,
    ]


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``y`` int and ``x`` array<double>, the label and the features of each labelled doc_id that may be learnt from."""
    import pyarrow as pa

    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("_y"), F.max("quality").alias("_z")).where("_y = _z")
    known = known.select(F.col("doc_id").alias("_id"), "_y")
    # features are much smaller than texts, so they are made before the join, which may shuffle
    rows = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = add_columns(rows, "x array<double>", lambda b: [pa.array([features(t) for t in utf8(b, "text")], pa.list_(pa.float64()))])
    rows = rows.select("doc_id", "x").join(known, F.col("doc_id") == F.col("_id"))
    return rows.groupBy("_id").agg(F.min("_y").cast("int").alias("y"), F.min("x").alias("x")).select("y", "x")


def scaled(x, mean, scale):
    import numpy as np

    return np.clip((x - mean) / scale, -8, 8)


def raw(z, w):
    """The score of each row, summed in an order of its own, whatever rows stand beside it."""
    return (z * w).sum(axis=1)


def _nodes():
    import numpy as np

    return np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))


def moments(y, z, w) -> dict:
    """For each label and each piece of the score axis with rows, what every node gets of them: their number, their
    features, and the products of these."""
    import numpy as np

    s = raw(z, w)
    piece = np.floor(s / 2).astype(int)
    first, second = np.triu_indices(z.shape[1])
    basis = np.cos(np.outer(np.arccos(_nodes()), np.arange(NODES))) * np.r_[1, [2] * (NODES - 1)] / NODES
    out = {}
    for label, p in sorted(set(zip(y.tolist(), piece.tolist(), strict=True))):
        here = np.flatnonzero((y == label) & (piece == p))
        own = z[here]
        angle = np.arccos(np.clip(s[here] - (2 * p + 1), -1, 1))
        share = basis @ np.cos(np.outer(np.arange(NODES), angle))
        out[label, p] = share @ np.hstack([np.ones((len(here), 1)), own, own[:, first] * own[:, second]])
    return out


def _loss(found: dict, w):
    """Loss, gradient and Hessian over all pairs, from the moments at ``w``."""
    import numpy as np

    k = len(w)
    first, second = np.triu_indices(k)

    def side(label):
        pieces = sorted(p for y, p in found if y == label)
        return np.concatenate([_nodes() + 2 * p + 1 for p in pieces]), np.vstack([found[label, p] for p in pieces])

    (at_good, good), (at_bad, bad) = side(1), side(0)
    pairs = good[:, 0].sum() * bad[:, 0].sum()
    loss, grad, half, cross = 0.0, np.zeros(k), np.zeros(len(first)), np.zeros((k, k))
    for i in range(0, len(at_good), NODES):
        g = good[i : i + NODES]
        d = np.clip(at_good[i : i + NODES, None] - at_bad, -500, 500)
        p = 1 / (1 + np.exp(d))
        loss += g[:, 0] @ np.logaddexp(0, -d) @ bad[:, 0]
        grad += (g[:, 0] @ p) @ bad[:, 1 : k + 1] - (p @ bad[:, 0]) @ g[:, 1 : k + 1]
        p *= 1 - p
        half += (p @ bad[:, 0]) @ g[:, k + 1 :] + (g[:, 0] @ p) @ bad[:, k + 1 :]
        cross += g[:, 1 : k + 1].T @ (p @ bad[:, 1 : k + 1])
    hess = np.zeros((k, k))
    hess[first, second] = hess[second, first] = half
    hess -= cross + cross.T
    return loss / pairs + RIDGE * (w @ w) / 2, grad / pairs + RIDGE * w, hess / pairs + RIDGE * np.eye(k)


def weights(k: int, at):
    """The weights of least loss, by Newton's method on a strictly convex loss; ``at(w)`` gives the moments at ``w``."""
    import numpy as np

    w, step, before = np.zeros(k), np.zeros(k), np.inf
    for _ in range(STEPS):
        loss, grad, hess = _loss(at(w), w)
        if loss > before + 1e-9:  # too far
            step = step / 2
            w = w + step
            continue
        before = loss
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(rows: list[tuple[int, list[float]]]) -> dict | None:
    """Mean and scale of the features, the weights and the threshold; None if a kind of label is missing."""
    import numpy as np

    y = np.array([r[0] for r in rows], int)
    if len(set(y.tolist())) < 2:
        return None
    x = np.array([r[1] for r in rows], float)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = scaled(x, mean, scale)
    w = weights(x.shape[1], lambda w: moments(y, z, w))
    s = np.sort(raw(z, w))
    k = int((y == 0).sum())
    return {"mean": mean, "scale": scale, "w": w, "threshold": float((s[k - 1] + s[k]) / 2)}


def fit_table(rows: DataFrame, k: int = N_FEATURES) -> dict | None:
    """``fit`` of a table of any size with columns ``y`` and ``x``, which is read once for each step."""
    import numpy as np
    import pyarrow as pa

    each = [F.struct(F.avg(F.col("x")[i]), F.stddev_pop(F.col("x")[i])) for i in range(k)]
    n, ones, *each = rows.agg(F.count("y"), F.coalesce(F.sum("y"), F.lit(0)), *each).first()
    if not 0 < ones < n:
        return None
    mean, scale = np.array([e[0] for e in each]), np.maximum([e[1] for e in each], 1e-6)

    def read(batch):
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        return batch.column("y").to_numpy(zero_copy_only=False), scaled(x, mean, scale)

    def at(w):
        def run(batches):
            from pyspark import TaskContext

            sums: dict = {}
            for whole in batches:
                for batch in slices(whole, 2048):
                    for key, m in moments(*read(batch), w).items():
                        sums[key] = sums[key] + m if key in sums else m
            task = TaskContext.get().partitionId()
            out = [(task, label, p, m.tobytes()) for (label, p), m in sums.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(("task", "y", "p", "m"), r, strict=True)) for r in out], schema)

        def merge(table):
            whole = sum(np.frombuffer(m) for _, m in sorted(zip(table["task"].to_pylist(), table["m"].to_pylist(), strict=True)))
            return pa.table({"y": table["y"][:1], "p": table["p"][:1], "m": pa.array([whole.tobytes()], pa.binary())})

        schema = pa.schema([("task", pa.int32()), ("y", pa.int32()), ("p", pa.int32()), ("m", pa.binary())])
        parts = rows.mapInArrow(trimmed(run), "task int, y int, p int, m binary")
        found = parts.groupBy("y", "p").applyInArrow(merge, "y int, p int, m binary").collect()
        return {(r.y, r.p): np.frombuffer(r.m).reshape(NODES, -1) for r in found}

    w = weights(k, at)

    def keys(batches):
        for batch in batches:
            s = raw(read(batch)[1], w) + 0.0  # no negative zero
            bits = s.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bits ^ ((bits >> 63) & np.int64(2**63 - 1)))], ["key"])

    low, high = ranked(rows.mapInArrow(trimmed(keys), "key long"), n - ones)
    bits = np.array([low, high], np.int64)
    s = (bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(float)
    return {"mean": mean, "scale": scale, "w": w, "threshold": float((s[0] + s[1]) / 2)}


def ranked(keys: DataFrame, k: int) -> tuple[int, int]:
    """The ``k``-th and the next of the sorted values of ``key``, counted by leading bits until few are left."""

    def pick(counts, rank):
        for value, n in sorted(counts):
            if rank < n:
                return value, rank, n
            rank -= n
        raise AssertionError("rank beyond the table")

    shift, left, rank = 64, keys, k - 1
    while shift:
        shift = max(0, shift - BITS)
        part = F.shiftright("key", shift)
        prefix, rank, n = pick([tuple(r) for r in left.groupBy(part).count().collect()], rank)
        left = left.where(part == prefix)
        if n <= FEW:
            break
    low, rank, n = pick([tuple(r) for r in left.groupBy("key").count().collect()], rank)
    return low, low if rank + 1 < n else keys.where(F.col("key") > low).agg(F.min("key")).first()[0]


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``score`` double in 0..1 and ``predicted`` int."""
    import pyarrow as pa

    rows = materialise(training_rows(docs, labels), "training-rows")
    model = fit_table(rows)
    discard(rows)

    def make(batch):
        import numpy as np

        texts = utf8(batch, "text")
        if model is None or not texts:
            out = np.full(len(texts), 0.5)
        else:
            x = np.array([features(t) for t in texts])
            s = raw(scaled(x, model["mean"], model["scale"]), model["w"])
            out = 1 / (1 + np.exp(-np.clip(s - model["threshold"], -500, 500)))
        return [pa.array(out, pa.float64()), pa.array((out >= 0.5).astype("int32"), pa.int32())]

    return add_columns(docs, "score double, predicted int", make)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier predicts to be good, with the columns they came with."""
    kept = score(docs.withColumn("_docs", F.struct(*[f"`{c}`" for c in docs.columns])).select("_docs", "doc_id", "text"), labels)
    return kept.where("predicted = 1").select("_docs.*")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
