"""N-gram Jaccard join with a token-group matrix, and the components of its links.

A document is the set of hashes of its five-word shingles; documents with the same set are one class and are carried as
one from the start. Candidates come from prefixes: ordered by (frequency, hash), two sets that are similar enough share
one of the first ``n - ceil(t n) + 1`` tokens of each, and a twelfth of the larger set's size of the first third of each;
a class that shares fewer of its first third with others has no link. Only frequent tokens need a count for that order; they are found
by exact counts within batches that are then summed, and their list has a fixed greatest size.

1. Token-group matrix. A group is what is known to be connected, at first a class. For each token the matrix holds which
   groups have it, as the least and the greatest of them, how many classes, and the least size of a set that has it in
   its prefix. From it a class's overlap with anything outside of its own group is bounded; classes whose bound is too
   low take part no more, tokens of a single group are left out, and the bounds of the others are taken again.
2. Stars. A class scores the sum of the sizes of its prefix tokens' lists: the text that many others were made from
   scores best among them. Each class is compared with the best-scored one that it shares a prefix token with. The links
   found partition similar documents into groups, and the matrix bounds what is left.
3. Classes that are left and hang together by prefix tokens are dealt into blocks of bounded size. A task has two
   blocks: it stores the token union of the one, bounds the overlap of each class of the other with it, and opens the
   block, which is to say counts what is shared with each of its members, for the classes whose bound qualifies only.

So every pair that could be linked is compared, or bounded, or known to be connected, and the components are exact; no
pair within a group is listed. Tokens that very many classes share are dealt out to several buckets.

Defined results: a text without words, or null, has an empty set and is linked with nothing; a text of fewer than five
words is one shingle; repeated rows are one class; rows without a doc_id take part, but name no component; a doc_id may
have any type that can be ordered; an empty table gives no rows; a very long text is a set like any other, in one row.
Shingles are hashes of 64 bits, so sets are told apart but for collisions inside of a compared pair; classes are told
apart by 128 bits. Only the returned columns are read or written, so other columns cannot clash.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, materialise, shuffle_partitions, slices, trimmed, utf8

WIDTH = 5
#: A similarity of 3/4 in whole numbers: 4 * shared >= 3 * union.
PART, WHOLE = 3, 4
#: Tokens counted at least so often in a batch enter the sums; at most MOST_FREQUENT can pass the threshold.
LOCAL_LEAST, FREQUENT_LEAST, MOST_FREQUENT = 8, 64, 1 << 20
#: Classes of a token in one bucket's salt, prefix tokens of a bucket, tokens of a block, bits of the filter.
SALT, BUCKET_TOKENS, BLOCK_TOKENS, ACTIVE_BITS = 8_192, 400_000, 1 << 18, 1 << 26
#: Tokens that a task holds of a batch before it writes them out.
FLUSH = 1 << 20
#: The bits of a class's first name; a name that two sets share is replaced, so fewer bits cost time only.
NAME_BITS = 64


@cache
def _tables(size: int):
    """Random values of bytes, powers of an odd number modulo 2**64, and the powers of its inverse."""
    import numpy as np

    state, table = 0x1234567, []
    for _ in range(256):  # splitmix64
        state = (state + 0x9E3779B97F4A7C15) % 2**64
        z = (state ^ state >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
        table.append(z ^ z >> 31)
    odd = 0xD1342543DE82EF95

    def powers(x: int):
        steps = np.full(size, x, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    return np.array(table, np.uint64), powers(odd), powers(pow(odd, -1, 2**64))


def shingles(text: bytes):
    """The sorted distinct shingle hashes of a text."""
    import numpy as np

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    width = min(WIDTH, len(words))
    line = np.frombuffer(b" ".join([*words, b""]), np.uint8)
    table, power, inverse = _tables(1 << max(16, len(line).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[line] * power[: len(line)], dtype=np.uint64)])
    ends = np.flatnonzero(line == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(ends) - width + 1]
    h = (sums[ends[width - 1 :]] - sums[starts]) * inverse[starts]
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return np.unique(h ^ (h >> np.uint64(33)))


def _names(hashes, bits: int, shared: frozenset) -> tuple[int, int]:
    """The name of a set, and what tells sets of the same first name apart."""
    from xxhash import xxh3_128_intdigest

    both = xxh3_128_intdigest(hashes.tobytes())
    rest = both >> 64
    return _name_again(both & (2**bits - 1), rest, shared) - 2**63, rest - 2**63


def _name_again(name: int, rest: int, shared: frozenset) -> int:
    return (name + rest * 0x9E3779B97F4A7C15 + 1) % 2**64 if name in shared else name


def prefix_size(n: int) -> int:
    return n - (PART * n + WHOLE - 1) // WHOLE + 1


def posted_size(n: int) -> int:
    """How many first tokens of a set are posted: of similar sets, at least ``n / 12`` of these are the same.

    Sets that share s tokens share k of the first ``n - s + k`` of each. With a third of the tokens posted that is
    ``3 n / 4 - 2 n / 3`` of the larger set, and 1 by the prefix, which is always posted.
    """
    return max(-(-n // 3), prefix_size(n))


def _batch(names: list[str], columns: list):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(columns, names=names)


def _profile(docs: DataFrame) -> DataFrame:
    """One row (doc_id, n, e, rest) a document, and rows (tok, count) of tokens that are frequent in a batch."""
    import pyarrow as pa

    bits, names = NAME_BITS, ["doc_id", "n", "e", "rest", "tok", "count"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import numpy as np

        def often(held):
            tok, count = np.unique(np.concatenate(held), return_counts=True)
            k = count >= LOCAL_LEAST
            m = int(k.sum())
            blank = [pa.nulls(m, doc_type), *[pa.nulls(m, pa.int64())] * 3]
            return _batch(names, [*blank, pa.array(tok[k].view(np.int64)), pa.array(count[k].astype(np.int64))])

        held, size, doc_type = {}, 0, None
        for whole in batches:
            for batch in slices(whole):
                doc_type = batch.column("doc_id").type
                sets = [shingles(t) for t in utf8(batch, "text")]
                named = [_names(s, bits, frozenset()) if len(s) else (None, None) for s in sets]
                m = len(sets)
                columns = [pa.array(x, pa.int64()) for x in ([len(s) for s in sets], [x[0] for x in named], [x[1] for x in named])]
                yield _batch(names, [batch.column("doc_id"), *columns, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())])
                for name, one in zip(named, sets, strict=True):
                    if len(one) and name not in held:
                        held[name] = one
                        size += len(one)
                if size > 2 * FLUSH:
                    yield often([*held.values()])
                    held, size = {}, 0
        if held:
            yield often([*held.values()])

    return docs.mapInArrow(trimmed(run), f"doc_id {kind}, n long, e long, rest long, tok long, count long")


def _frequent(counted: DataFrame, total: int):
    """Sorted frequent tokens and their counts; there are at most ``MOST_FREQUENT`` since their counts sum to the total."""
    import numpy as np

    least = max(FREQUENT_LEAST, -(-total // MOST_FREQUENT))
    rows = counted.groupBy("tok").agg(F.sum("count").alias("count")).where(F.col("count") >= least).toArrow()
    tok = rows.column("tok").to_numpy().view(np.uint64)
    order = np.argsort(tok)
    return tok[order], rows.column("count").to_numpy()[order]


def _ordered(h, known, counts):
    """The tokens of a set by (frequency, hash); the frequency of tokens that are not frequent counts as 0."""
    import numpy as np

    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        often = np.where(known[at] == h, counts[at], 0)
        if often.any():
            return h[np.lexsort((h, often))]
    return h


def _postings(docs: DataFrame, name, frequent, buckets: int) -> DataFrame:
    """(e, k): how many of a class's first tokens several classes have among theirs; a row for each bucket.

    Postings travel packed, a row for each batch and bucket, each class once a batch.
    """
    import pyarrow as pa

    def salted(tok, ent):
        """The salt of each posting: classes of a token that very many have are dealt out."""
        import numpy as np

        known, counts = frequent.value
        if not len(known):
            return np.zeros(len(tok), np.int64)
        at = np.minimum(np.searchsorted(known, tok), len(known) - 1)
        parts = np.where(known[at] == tok, 1 + counts[at] // SALT, 1)
        return np.where(parts > 1, 1 + ent % parts, 0)

    def pack(batches):
        import numpy as np

        known, counts = frequent.value

        def flush(toks, ents):
            tok, ent = np.concatenate(toks), np.concatenate(ents)
            bucket = ((tok + salted(tok, ent).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            tok, ent, bucket = tok[order], ent[order], bucket[order]
            ends = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            spans = [*zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            column = lambda x: pa.array([x[a:b].tobytes() for a, b in spans], pa.binary())
            return _batch(["bucket", "tok", "e"], [pa.array(bucket[ends[:-1]]), column(tok), column(ent)])

        done, size, toks, ents = set(), 0, [], []
        for whole in batches:
            for batch in slices(whole):
                for text in utf8(batch, "text"):
                    h = shingles(text)
                    if not len(h) or (e := name(h)) in done:
                        continue
                    done.add(e)
                    toks.append(_ordered(h, known, counts)[: posted_size(len(h))])
                    ents.append(np.full(len(toks[-1]), e, np.int64))
                    size += len(toks[-1])
                if size > FLUSH:
                    yield flush(toks, ents)
                    done, size, toks, ents = set(), 0, [], []
        if size:
            yield flush(toks, ents)

    def lists(table):
        import numpy as np

        tok, ent = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("tok", np.uint64), ("e", np.int64)))
        order = np.lexsort((ent, tok))
        tok, ent = tok[order], ent[order]
        new = np.concatenate([[True], np.diff(tok) != 0])
        fresh = new | np.concatenate([[True], np.diff(ent) != 0])
        tok, ent, new = tok[fresh], ent[fresh], new[fresh]
        run = np.cumsum(new) - 1
        m = np.bincount(run)[run]
        keep = (m > 1) | (salted(tok, ent) > 0)  # the classes of a salted token may lie in different buckets
        e, k = np.unique(ent[keep], return_counts=True)
        return pa.table({"e": e, "k": k})

    packed = docs.select("text").mapInArrow(trimmed(pack), "bucket long, tok binary, e binary")
    return packed.groupBy("bucket").applyInArrow(lists, "e long, k long")


def _sets(docs: DataFrame, name, frequent, active: DataFrame) -> DataFrame:
    """(e, comp, n, k, toks) of the classes ``active`` (e, first): the tokens in their order, of which ``k`` are the prefix. A bitmap of fixed size tells which
    documents to read; a few more may pass it and are dropped by the join."""
    import pyarrow as pa

    slot = F.pmod(F.xxhash64("doc_id"), F.lit(ACTIVE_BITS))
    numbered = active.select(F.pmod(F.xxhash64("first"), F.lit(ACTIVE_BITS)).alias("s"))
    bits = numbered.groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
    maps = docs.sparkSession.sparkContext.broadcast({r["b"]: bytes(r["m"]) for r in bits.collect()})  # at most ACTIVE_BITS bits

    def run(batches):
        import numpy as np

        known, counts = frequent.value
        for whole in batches:
            for batch in slices(whole):
                out = {}
                pick = [(have := maps.value.get(b)) is not None and bool(have[p >> 3] >> (p & 7) & 1) for b, p in zip(batch.column("b").to_pylist(), batch.column("p").to_pylist(), strict=True)]
                for text in utf8(batch.filter(pa.array(pick, pa.bool_())), "text"):
                    h = shingles(text)
                    if len(h) and (e := name(h)) not in out:
                        out[e] = _ordered(h, known, counts)
                if out:
                    sizes = [len(x) for x in out.values()]
                    toks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate([*out.values()]).view(np.int64)))
                    yield _batch(["e", "n", "toks"], [pa.array([*out], pa.int64()), pa.array(sizes, pa.int64()), toks])

    numbered = docs.select("text", F.bitmap_bucket_number(slot).alias("b"), F.bitmap_bit_position(slot).alias("p"))
    read = numbered.mapInArrow(trimmed(run), "e long, n long, toks array<long>")
    read = read.join(active.select("e"), "e", "left_semi").dropDuplicates(["e"])
    return read.select("e", F.col("e").alias("comp"), "n", (F.col("n") - F.ceil(F.col("n") * PART / WHOLE) + 1).alias("k"), "toks")


def _list(column, i: int):
    """One list of an Arrow column as an array, not copied."""
    import numpy as np

    a, b = column.offsets[i].as_py(), column.offsets[i + 1].as_py()
    return np.asarray(column.values.slice(a, b - a))


def _verify(pairs: DataFrame, alive: DataFrame) -> DataFrame:
    """The (a, b) that are similar, a and b being of different groups."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep, x, y = [], batch.column("x"), batch.column("y")
            for i, size in enumerate(batch.column("size").to_pylist()):
                shared = len(np.intersect1d(_list(x, i), _list(y, i), assume_unique=True))
                keep.append((PART + WHOLE) * shared >= PART * size)
            yield _batch(["a", "b"], [batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")])

    left, right = (alive.select(F.col("e").alias(side), F.col("n").alias(f"n{side}"), F.col("toks").alias(x)) for side, x in (("a", "x"), ("b", "y")))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("na") + F.col("nb")).alias("size"), "x", "y")
    return both.mapInArrow(trimmed(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(e, label) for each linked class: the least class that links lead to. Labels spread along the links and jump to
    their labels' labels, until none changes."""
    edges = materialise(links.select("a", "b").union(links.select("b", "a")), "links")
    labels = edges.groupBy(F.col("a").alias("e")).agg(F.least(F.min("a"), F.min("b")).alias("label"))
    labels = materialise(labels.withColumn("moved", F.lit(True)), "labels")
    while not labels.where("moved").isEmpty():
        old, before = labels.select("e", "label"), labels
        near = edges.join(old.withColumnRenamed("e", "b"), "b").groupBy(F.col("a").alias("e")).agg(F.min("label").alias("near"))
        jump = old.join(old.select(F.col("e").alias("label"), F.col("label").alias("far")), "label")
        least = F.least("label", "far", "near")
        labels = materialise(jump.join(near, "e").select("e", least.alias("label"), (least < F.col("label")).alias("moved")), "labels")
        discard(before)
    discard(edges)
    return labels.select("e", "label")


def _stars(edges: DataFrame) -> DataFrame:
    """(a, b): each class of ``edges`` (tok, e, comp, m) with the best-scored class of another group that heads one of
    its tokens' lists."""
    score = edges.groupBy("e").agg(F.sum("m").alias("s"))
    ranked = materialise(edges.join(score, "e").select("tok", F.struct("s", "e", "comp").alias("c")), "ranked")
    top = ranked.groupBy("tok").agg(F.max("c").alias("h"))
    near = ranked.join(top, "tok").where("c.comp <> h.comp").groupBy(F.col("c.e").alias("a")).agg(F.max("h").alias("h"))
    pairs = materialise(near.select("a", F.col("h.e").alias("b")), "pairs")
    discard(ranked)
    return pairs


def _reduced(alive: DataFrame) -> DataFrame:
    """``alive`` (e, comp, n, k, toks) without tokens that a single group has and without classes whose overlap with
    other groups is thereby bounded too low; the tokens of the others by (classes that have it, token).

    The first ``k`` of ``toks`` are what is left of the prefix: tokens of a single group stand before all others.
    """
    spread = alive.select("e", "comp", "n", "k", F.posexplode("toks").alias("at", "tok"))
    spread = spread.select("e", "comp", "n", "tok", (F.col("at") < F.col("k")).alias("head"))
    head = lambda c: F.when(F.col("head"), F.col(c))
    matrix = spread.groupBy("tok").agg(
        F.count("*").alias("m"), F.min("comp").alias("x"), F.max("comp").alias("y"), F.min(head("comp")).alias("px"), F.max(head("comp")).alias("py"), F.min(head("n")).alias("least")
    )
    candidate = F.when(F.col("head") & (F.col("px") < F.col("py")), F.col("least"))
    bound = spread.join(matrix.where("x < y"), "tok").groupBy("e", "comp", "n")
    bound = bound.agg(F.min(candidate).alias("least"), F.sort_array(F.collect_list(F.struct("m", "tok"))).alias("toks"))
    n, most = F.col("n"), F.size("toks").cast("long")
    k = n - F.ceil(n * PART / WHOLE) + 1 - (n - most)
    other = F.greatest("least", F.ceil(n * PART / WHOLE))
    keep = bound.where(F.col("least").isNotNull() & (k > 0) & ((PART + WHOLE) * most >= PART * (n + other)))
    return keep.select("e", "comp", "n", k.alias("k"), F.col("toks.tok").alias("toks"))


def _pruned(alive: DataFrame) -> DataFrame:
    """``alive`` reduced until less than half of its classes go at once; the table given is deleted."""
    n, before = alive.count(), None
    while n and (before is None or 2 * n < before):
        rest = materialise(_reduced(alive), "alive")
        discard(alive)
        alive, before, n = rest, n, rest.count()
    return alive


def _edges(alive: DataFrame) -> DataFrame:
    """(tok, e, comp, m): the prefix tokens of ``alive`` that classes of several groups have in their prefixes."""
    spread = alive.select("e", "comp", F.explode(F.slice("toks", F.lit(1), F.col("k").cast("int"))).alias("tok"))
    lists = spread.groupBy("tok").agg(F.count("*").alias("m"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y")
    return materialise(spread.join(lists.select("tok", "m"), "tok").select("tok", "e", "comp", "m"), "edges")


def _blocks(alive: DataFrame, edges: DataFrame) -> DataFrame:
    """``alive`` with ``fam``, its family, and ``g``, its block in it. A family is what prefix tokens hold together. A
    group of its own blocks if it fills several, and else dealt into one with other groups of the family."""
    first = edges.groupBy("tok").agg(F.min("e").alias("b"))
    fam = components(edges.join(first, "tok").where("e <> b").select(F.col("e").alias("a"), "b").distinct())
    placed = alive.join(fam.withColumnRenamed("label", "fam"), "e").select("e", "comp", "n", "toks", "fam")
    room = F.lit(BLOCK_TOKENS)
    weight = placed.groupBy("fam", "comp").agg(F.sum("n").alias("w"))
    small = weight.where(F.col("w") < room).groupBy("fam").agg(F.sum("w").alias("v"))
    own = F.xxhash64("comp", F.pmod(F.xxhash64("e"), F.ceil(F.col("w") / room)))
    common = F.xxhash64("fam", F.pmod(F.xxhash64("comp"), F.ceil(F.col("v") / room)), F.lit(1))
    dealt = placed.join(weight, ["fam", "comp"]).join(small, "fam", "left")
    return dealt.select("e", "comp", "n", "toks", "fam", F.when(F.col("w") < room, common).otherwise(own).alias("g"))


def _opened(table):
    """The (a, b) of groups that a link joins: classes of the one block against those of the other."""
    import numpy as np
    import pyarrow as pa

    left, comp, n = (np.array(table.column(c).to_pylist()) for c in ("left", "comp", "n"))
    toks = np.concatenate([np.asarray(x.flatten()) for x in table.column("toks").chunks])
    sizes = np.concatenate([np.asarray(x.value_lengths()) for x in table.column("toks").chunks])
    owner = np.repeat(np.arange(len(n)), sizes)
    held = left if left.all() else ~left  # a block may meet itself
    queries, members = np.flatnonzero(left), np.flatnonzero(held)
    inside = held[owner]
    order = np.argsort(toks[inside], kind="stable")
    column, whose = toks[inside][order], owner[inside][order]
    union = np.unique(column)
    at = np.minimum(np.searchsorted(union, toks), len(union) - 1)
    bound = np.bincount(owner, weights=union[at] == toks, minlength=len(n))
    least = n[members].min()
    starts = np.concatenate([[0], np.cumsum(sizes)])
    found = set()
    for q in queries:
        if (PART + WHOLE) * bound[q] < PART * (n[q] + max(least, -(-PART * n[q] // WHOLE))):
            continue
        own = toks[starts[q] : starts[q + 1]]
        low, high = np.searchsorted(column, own, "left"), np.searchsorted(column, own, "right")
        size = high - low
        if not (total := size.sum()):
            continue
        places = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        shared = np.bincount(whose[places], minlength=len(n))
        near = ((PART + WHOLE) * shared >= PART * (n[q] + n)) & held & (comp != comp[q])
        found.update((int(comp[q]), int(c)) for c in np.unique(comp[near]))
    return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})


def _between(alive: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b) of groups with a link between them, found block by block within each family."""
    placed = materialise(_blocks(alive, edges), "placed")
    blocks = placed.groupBy("fam", "g").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
    blocks = materialise(blocks, "blocks")
    other = blocks.select("fam", F.col("g").alias("g2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    several = F.least("x", "x2") < F.greatest("y", "y2")
    met = materialise(blocks.join(other, "fam").where((F.col("g") <= F.col("g2")) & several).select("fam", "g", "g2"), "met")
    sides = met.select("fam", "g", F.struct("g", "g2").alias("task"), F.lit(True).alias("left")).union(
        met.where("g <> g2").select("fam", F.col("g2"), F.struct("g", "g2"), F.lit(False))
    )
    rows = placed.join(sides, ["fam", "g"]).select("fam", F.col("task.g").alias("g"), F.col("task.g2").alias("g2"), "left", "comp", "n", "toks")
    found = materialise(rows.groupBy("fam", "g", "g2").applyInArrow(_opened, "a long, b long").distinct(), "links")
    for table in (placed, blocks, met):
        discard(table)
    return found


def _regrouped(df: DataFrame, more: DataFrame) -> DataFrame:
    """``df`` with its groups ``comp`` joined by ``more`` (e, label)."""
    joined = df.join(more.withColumnRenamed("e", "comp"), "comp", "left")
    return joined.select(*[F.coalesce("label", "comp").alias("comp") if c == "comp" else F.col(c) for c in df.columns])


def _roots(links: DataFrame) -> DataFrame:
    """(e, label) for each linked class, where each class is ``a`` of one link at most and links lead to ever better
    scores: the one at the end of its links. Pointers jump to their pointers' pointers until none changes."""
    up = materialise(links.select(F.col("a").alias("e"), F.col("b").alias("label")), "roots")
    while True:
        far = up.select(F.col("e").alias("label"), F.col("label").alias("far"))
        jumped = up.join(far, "label", "left").select("e", F.coalesce("far", "label").alias("label"), F.col("far").isNotNull().alias("moved"))
        jumped = materialise(jumped, "roots")
        discard(up)
        up = jumped
        if up.where("moved").isEmpty():
            return up.select("e", "label")


def _groups(sets: DataFrame) -> DataFrame:
    """(e, comp): the component of each class, named by one of its classes. ``sets`` is deleted."""
    comps = materialise(sets.select("e", F.col("e").alias("comp")), "comps")
    alive, first = _pruned(sets), True
    n = alive.count()
    while n:
        edges = _edges(alive)
        pairs = _stars(edges)
        links = materialise(_verify(pairs, alive), "links")
        discard(pairs)
        hit, before = links.count(), n
        if hit:
            if first:
                more = _roots(links)
            else:
                known = alive.select("e", "comp")
                ends = links.join(known.select(F.col("e").alias("a"), F.col("comp").alias("x")), "a").join(known.select(F.col("e").alias("b"), F.col("comp").alias("y")), "b")
                more = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
            comps = materialise(_regrouped(comps, more), "comps")
            fresh = materialise(_regrouped(alive, more), "alive")
            discard(alive)
            discard(edges)
            alive, first = _pruned(fresh), False
            n = alive.count()
            edges = _edges(alive) if n else None
        discard(links)
        if n and (not hit or 2 * n < before or 10 * hit < before):  # stars do not help much more
            more = _between(alive, edges)
            if not more.isEmpty():
                comps = materialise(_regrouped(comps, components(more)), "comps")
            break
    discard(alive)
    return comps


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row a document."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    profile = materialise(_profile(docs), "profile")
    # a document row has n, a token row has none
    slim = profile.where("n IS NOT NULL").select("doc_id", "n", "e", "rest")
    total = slim.agg(F.sum("n")).first()[0] or 0
    frequent = spark.sparkContext.broadcast(_frequent(profile.where("tok IS NOT NULL").select("tok", "count"), total))
    # sets of the same 64 bits: (number of sets) ** 2 / 2 ** 65 are expected, none below billions
    twins = slim.where("e IS NOT NULL").groupBy("e").agg(F.min("rest").alias("x"), F.max("rest").alias("y")).where("x < y")
    bits, again = NAME_BITS, frozenset(r["e"] + 2**63 for r in twins.select("e").collect())

    def name(hashes):
        return _names(hashes, bits, again)[0]

    if again:
        slim = _renamed(slim, again)
    buckets = max(2 * shuffle_partitions(spark), total // (3 * BUCKET_TOKENS) + 1)
    posted = materialise(_postings(docs, name, frequent, buckets), "posted")
    classes = slim.where("e IS NOT NULL").groupBy("e").agg(F.min("doc_id").alias("first"), F.min("n").alias("n"))
    least = posted.groupBy("e").agg(F.sum("k").alias("k"))  # a salted token may count although no other class has it
    active = materialise(classes.join(least, "e").where("12 * k >= n").select("e", "first"), "active")
    discard(posted)
    comps = _groups(materialise(_sets(docs, name, frequent, active), "sets"))

    named = comps.join(active, "e")
    heads = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    linked = comps.join(heads, "comp").select("e", "component_id")
    own = materialise(classes.drop("n").join(linked, "e", "left").select("e", F.coalesce("component_id", "first").alias("component_id")), "classes")
    discard(active)
    out = slim.join(own, "e", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _renamed(slim: DataFrame, again: frozenset) -> DataFrame:
    """``slim`` with the names that ``_names`` gives to sets of a shared first name."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            e = [None if x is None else _name_again(x + 2**63, r + 2**63, again) - 2**63 for x, r in zip(batch.column("e").to_pylist(), batch.column("rest").to_pylist(), strict=True)]
            yield _batch(batch.schema.names, [batch.column("doc_id"), batch.column("n"), pa.array(e, pa.int64()), batch.column("rest")])

    return materialise(slim.mapInArrow(trimmed(run), slim.schema), "renamed")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component stays: that of its smallest doc_id (all its rows, if they repeat)."""
    # rows without a doc_id cannot stand for a component; those with nothing else to stand for them stay
    other = join(docs).where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(other, docs["doc_id"] == other["_gone"], "left_anti")


def report(docs: DataFrame) -> DataFrame:
    return join(docs)
