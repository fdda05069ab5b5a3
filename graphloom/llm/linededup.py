"""Line deduplication over the whole corpus with two Bloom filters, once-seen and twice-seen.

1. Each task lists the slots that its documents' line keys set in the once-seen filter, and those that they set twice.
   The lists are shuffled by chunks of the filters and merged without loss: a slot that two lists have is seen twice, so
   a key of two documents always ends up in the twice-seen filter. Only the merged twice-seen filter leaves a chunk.
2. Lines that the twice-seen filter lacks are certainly unique and never shuffle. The others, the suspects, are
   written as (128-bit digest, doc_id) and confirmed exactly by digest; the smallest doc_id keeps its lines.
3. The digests that a document loses come back to it by a join on doc_id.

The filters grow with the number of documents, so the share of false suspects does not. Beyond ``MOST_BITS``, what a
worker holds at once, the keys are taken in several turns by their hash, each with filters of its own.

Defined results: a null or empty text is one empty line and loses nothing; a repeated key within a single document is
no repeat; rows that share a doc_id are one document; rows without a doc_id neither count nor lose lines; of documents
with the same line the smallest doc_id keeps it; an empty table gives no rows; a very long text is split like any other,
in one row. Input columns named like a returned one are replaced, others stay.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import add_columns, free_name, materialise, packed, slices, trimmed, unpacked, utf8

MIN_CODE_POINTS = 10
#: Bits of a filter: so many for each document, and at most 2**30 (128 MB) at once.
LEAST_BITS, MOST_BITS, BITS_A_DOCUMENT = 1 << 20, 1 << 30, 128
#: Bits of a chunk, and keys that a task holds before it writes their slots.
CHUNK, FLUSH = 1 << 20, 200_000
_STRIP = b" \t\n\x0b\x0c\r"


def key_of(line: bytes) -> bytes | None:
    """The key of a line, or None if it is too short to count."""
    key = line.strip(_STRIP).lower()
    if len(key) >= 4 * MIN_CODE_POINTS or len(key) >= MIN_CODE_POINTS and len(key.decode()) >= MIN_CODE_POINTS:
        return key
    return None


def _digests(text: bytes) -> set[bytes]:
    from xxhash import xxh3_128_digest

    return {xxh3_128_digest(k) for k in map(key_of, text.split(b"\n")) if k is not None}


def _slots(two, bits: int):
    """Two slots of each digest, from the low bits of its halves."""
    import numpy as np

    return (two & np.uint64(bits - 1)).astype(np.int64)


def _in_turn(digests, turn: int, turns: int):
    """The digests (n, 2) that belong to a turn, by high bits that the slots do not use."""
    import numpy as np

    two = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return two, (two[:, 0] >> np.uint64(40)) % np.uint64(turns) == turn


def _filters(docs: DataFrame, bits: int, turn: int, turns: int) -> DataFrame:
    """(chunk, once, twice): slots of a task's keys, as 32-bit places in the chunk."""
    import pyarrow as pa

    size = min(bits, CHUNK)

    def run(batches):
        import numpy as np

        def flush(digests):
            two, mine = _in_turn(digests, turn, turns)
            two = two[mine]
            _, at, count = np.unique(two[:, 0], return_index=True, return_counts=True)
            once = np.unique(_slots(two[at], bits))
            twice = np.unique(_slots(two[at[count > 1]], bits))
            chunks = np.unique(once // size)
            each = [[(x[np.searchsorted(x, c * size) : np.searchsorted(x, (c + 1) * size)] - c * size).astype("<u4").tobytes() for c in chunks] for x in (once, twice)]
            return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), *[pa.array(x, pa.binary()) for x in each]], names=["chunk", "once", "twice"])

        held = []
        for whole in batches:
            for batch in slices(whole):
                for text in utf8(batch, "text"):
                    held += _digests(text)
                if len(held) > FLUSH:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)

    return docs.select("text").mapInArrow(trimmed(run), "chunk long, once binary, twice binary")


def _merge(table):
    import numpy as np
    import pyarrow as pa

    once, twice = (np.frombuffer(b"".join(table.column(c).to_pylist()), "<u4") for c in ("once", "twice"))
    slot, count = np.unique(once, return_counts=True)
    chunk = np.zeros(CHUNK, bool)
    chunk[slot[count > 1]] = True
    chunk[twice] = True
    return pa.table({"chunk": table.column("chunk")[:1], "twice": pa.array([zlib.compress(np.packbits(chunk).tobytes(), 1)])})


def twice_seen(docs: DataFrame, bits: int, turn: int = 0, turns: int = 1):
    """The merged twice-seen filter of a turn as packed bits; at most ``MOST_BITS`` of them come to the driver."""
    import numpy as np

    merged = _filters(docs, bits, turn, turns).groupBy("chunk").applyInArrow(_merge, "chunk long, twice binary")
    packed = np.zeros(max(bits, CHUNK) // 8, np.uint8)
    for row in merged.collect():  # compressed
        part = np.frombuffer(zlib.decompress(bytes(row["twice"])), np.uint8)
        packed[row["chunk"] * CHUNK // 8 :][: len(part)] = part
    return packed


def _suspects(known: DataFrame, bits: int, turn: int, turns: int) -> DataFrame:
    """(doc_id, digest) of the lines that the twice-seen filter of a turn holds."""
    import pyarrow as pa

    shared = known.sparkSession.sparkContext.broadcast(twice_seen(known, bits, turn, turns))

    def run(batches):
        import numpy as np

        seen = shared.value
        for whole in batches:
            for batch in slices(whole):
                sets = [_digests(text) for text in utf8(batch, "text")]
                each = [d for s in sets for d in s]
                if not each:
                    continue
                owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                two, mine = _in_turn(each, turn, turns)
                slots = _slots(two, bits)
                hit = (((seen[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1).all(axis=1) & mine).nonzero()[0]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner[hit])), pa.array([each[i] for i in hit], pa.binary())], names=["doc_id", "digest"])

    kind = known.schema["doc_id"].dataType.simpleString()
    return known.mapInArrow(trimmed(run), f"doc_id {kind}, digest binary")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, digests): the line digests that each document loses, for documents that lose any."""
    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    want = max(LEAST_BITS, docs.count() * BITS_A_DOCUMENT)
    turns = -(-want // MOST_BITS)
    bits = 1 << (min(want, MOST_BITS) - 1).bit_length()
    parts = [materialise(_suspects(known, bits, turn, turns), "lines") for turn in range(turns)]
    suspected = parts[0]
    for more in parts[1:]:
        suspected = suspected.union(more)
    first = suspected.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    confirmed = materialise(first.where("first_doc < last_doc").select("digest", "first_doc"), "repeats")
    lost = suspected.join(confirmed, "digest").where("doc_id > first_doc")
    return lost.groupBy("doc_id").agg(F.collect_set("digest").alias("digests"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept text in ``text``, and ``n_lines`` and ``n_dropped`` long."""
    import pyarrow as pa
    from xxhash import xxh3_128_digest

    gone, owner, new = (free_name(docs, n) for n in ("_lost", "_lost_doc", "_text"))
    lost = repeats(docs).withColumnsRenamed({"doc_id": owner, "digests": gone})
    joined = docs.join(lost, docs["doc_id"] == lost[owner], "left").drop(owner)

    def make(batch):
        texts, counts, dropped = [], [], []
        for text, lose in zip(utf8(batch, "text"), batch.column(gone).to_pylist(), strict=True):
            lines, n = text.split(b"\n"), 0
            counts.append(len(lines))
            if lose:
                lose, n = set(lose), len(lines)
                lines = [x for x in lines if (k := key_of(x)) is None or xxh3_128_digest(k) not in lose]
                n -= len(lines)
                text = b"\n".join(lines)
            texts.append(text)
            dropped.append(n)
        return [pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]

    out = add_columns(joined, f"n_lines long, n_dropped long, `{new}` string", make)
    return out.withColumn("text", F.col(new)).drop(new, gone)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines dropped and its own columns; ``n_chars``, where there is one, counts a cut text anew."""
    return unpacked(dedup_lines(packed(docs, "doc_id", "text")), docs.columns, F.col("n_dropped") > 0)


def report(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
