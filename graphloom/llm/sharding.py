"""Sharding by sampled splitters, in DataFrame functions only. Its law is ``bytes``: shard sizes are near equal.

Records are ordered by (text_crc32, doc_id, a random number that is drawn once), so equal texts stand together. A sample
in which a record's chance grows with its size gives splitters at equal quantiles, which cut that order into many ranges
of about equal bytes. The ranges are measured; one that is overfull, as a hot group of equal texts or even of equal rows
makes it, is cut again at quantiles of the sampled keys in it. Running sums within the ranges and over the few ranges' totals give each record the
bytes before it, and with them its shard, and its slot in the shard.

Defined results: a null text has no bytes and checksum 0; an empty table gives no rows; repeated rows are records of
their own; ties are broken by doc_id, then at random; a null doc_id sorts first; doc_ids are whole numbers; a very long text
is one record. Only the columns of the result are returned.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import materialise, shuffle_partitions

SHARDS = 16
#: Sampled keys for each range, and bounds of the number of ranges; all of the sample comes to the driver.
KEYS_A_RANGE, LEAST_RANGES, MOST_RANGES = 32, 64, 4_096
#: The least key, and the seed of random numbers.
LOW, SEED = -(1 << 63), 11
#: A range of more than so many times the mean is cut again.
OVERFULL = 2


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        (F.rand(SEED) * float(1 << 53)).cast("long").alias("drawn"),
    )


def _key() -> tuple[Column, Column, Column]:
    return F.col("text_crc32"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)), F.col("drawn")


def _sample(records: DataFrame, total: int, want: int) -> list[tuple[int, int, int]]:
    """Keys of records, each drawn by itself with a chance of ``want * size / total``; sorted. Records of more than
    ``total / want`` bytes are always drawn, and there are at most ``want`` of them."""
    drawn = records.where(F.rand(SEED + 1) < F.col("size") * F.lit(want / max(total, 1))).select(*_key())
    return sorted((r[0], r[1], r[2]) for r in drawn.collect())


def _quantiles(keys: list, parts: int) -> list:
    return sorted({keys[len(keys) * k // parts] for k in range(1, parts)}) if keys else []


def _range_of(splitters: list[tuple[int, int, int]]) -> Column:
    """The number of splitters at or below the record's key, by binary search in literal arrays."""
    if not splitters:
        return F.lit(0)
    n, parts = len(splitters), [F.array(*[F.lit(s[i]).cast("long") for s in splitters]) for i in range(3)]

    def step(low: Column, k: Column) -> Column:
        at = low + k - 1
        (c, d, u), (x, y, z) = _key(), (F.get(p, at) for p in parts)
        fits = (low + k <= n) & ((c > x) | (c == x) & ((d > y) | (d == y) & (u >= z)))
        return F.when(fits, low + k).otherwise(low)

    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), step)


def splitters(records: DataFrame, ranges: int) -> list[tuple[int, int, int]]:
    """Boundaries of keys: quantiles by checksum first, then inside of overfull ranges by the whole key."""
    total = records.agg(F.sum("size")).first()[0] or 0
    keys = _sample(records, total, ranges * KEYS_A_RANGE)
    first = [(c, LOW, LOW) for c in _quantiles([k[0] for k in keys], ranges)]
    # at most MOST_RANGES sums
    sums = {r[0]: r[1] for r in records.groupBy(_range_of(first).alias("r")).agg(F.sum("size")).collect()}
    inside: dict[int, list] = {}
    for key in keys:
        inside.setdefault(bisect_right(first, key), []).append(key)
    extra = []
    for r, size in sums.items():
        if size * ranges > OVERFULL * total:
            extra += _quantiles(inside.get(r, []), -(-size * ranges // total))
    return sorted({*first, *extra})


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each record."""
    records = materialise(keyed(docs), "shards")
    ranges = min(MOST_RANGES, max(LEAST_RANGES, 4 * shuffle_partitions(docs.sparkSession)))
    ranged = records.withColumn("r", _range_of(splitters(records, ranges)))
    inside = Window.partitionBy("r").orderBy("text_crc32", F.col("doc_id").asc_nulls_first(), "drawn")
    run = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = materialise(ranged.withColumn("run", F.sum("size").over(run)).withColumn("rank", F.row_number().over(inside).cast("long")), "shards")
    sums = placed.groupBy("r").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("r").collect()
    before, bytes_before, rows_before = [], 0, 0
    for s in sums:  # at most twice MOST_RANGES of them
        before.append((s["r"], bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + s["bytes"], rows_before + s["n"]
    known = docs.sparkSession.createDataFrame(before, "r int, bytes_before long, rows_before long")
    middle = F.col("bytes_before") + F.col("run") - F.col("size") / 2
    out = placed.join(F.broadcast(known), "r").withColumn("shard", F.least(F.floor(middle * shards / max(bytes_before, 1)), F.lit(shards - 1)).cast("int"))
    out = out.withColumn("place", F.col("rows_before") + F.col("rank") - 1)
    first = F.broadcast(out.groupBy("shard").agg(F.min("place").alias("first")))  # one row a shard
    return out.join(first, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))


def report(docs: DataFrame) -> DataFrame:
    placed = shard(docs)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
