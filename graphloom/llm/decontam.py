"""Benchmark decontamination with a generalised suffix automaton of the benchmark's words.

The automaton of all items (normalised to words) is built on the driver from a block of bounded size and sent to the
executors. Documents stream through it, one step a word: after each word it holds the longest suffix of what was read
that occurs in some item. Where that suffix reaches ``window`` words, the last ``window`` words are a window of an item.

Defined results: a null or empty text has no words; a null item text, or one without words, and an item without an id
count as no item; repeated items count by id; an empty benchmark hits nothing; repeated rows of a document are scanned
on their own; a word in several windows is hit once; an empty table gives no rows; a very long text is scanned like any
other, in one row. Input columns named like a returned one are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import ALNUM_WORDS, add_columns, free_name, materialise, packed, unpacked, utf8

WINDOW = 10
#: Words of one automaton, so about twice as many states; a larger benchmark is scanned block after block.
BLOCK_WORDS = 200_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM_WORDS).split()


class Automaton:
    """Suffix automaton of several word sequences, with the items that each full window and short item stands for."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for item, words in items]
        for _, ids in coded:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        self.items: dict[int, set[str]] = {}
        short: dict[int, list[tuple[int, str]]] = {}
        for item, ids in coded:
            state = 0
            for i, w in enumerate(ids):
                state = self.next[state][w]
                if i + 1 >= window:
                    self.items.setdefault(self._holding(state, window), set()).add(item)
            if 0 < len(ids) < window:
                short.setdefault(self._holding(state, len(ids)), []).append((len(ids), item))
        #: For each state: the state of its last ``window`` words or -1, and the short items that end where it ends.
        self.full, self.short = [-1] * len(self.length), [()] * len(self.length)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            up = self.link[s]
            self.full[s] = s if self.length[up] < window <= self.length[s] else self.full[up]
            self.short[s] = (*short.get(s, ()), *self.short[up])
        lengths = [len(ids) for _, ids in coded if ids]
        self.least = min([window, *lengths])

    def _holding(self, state: int, n: int) -> int:
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of hit words (end exclusive) and the items found."""
        trans, link, length, least, window = self.next, self.link, self.length, self.least, self.window
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        state = size = 0
        for i, w in enumerate(map(self.vocab.get, words)):
            if w is None:
                state = size = 0
                continue
            t = trans[state].get(w)
            while t is None:  # the root has a step for each word of the vocabulary
                state = link[state]
                size = length[state]
                t = trans[state].get(w)
            state = t
            size += 1
            if size < least:
                continue
            hit = 0
            for n, item in self.short[state]:
                if n <= size:
                    found.add(item)
                    hit = max(hit, n)
            if size >= window:
                # the state of a longer match may stand for suffixes longer than what was read; its window is the same
                found |= self.items[self.full[state]]
                hit = window
            if hit:
                start = i + 1 - hit
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, found


def _blocks(items: DataFrame, limit: int):
    block, size = [], 0
    rows = items.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).dropna()
    for item, text in rows.toLocalIterator():
        words = words_of(bytes(text))
        if block and size + len(words) > limit:
            yield block
            block, size = [], 0
        block.append((item, words))
        size += len(words)
    yield block


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``n_words`` long, ``hit_spans`` array<struct<start,stop>> (merged, in words) and ``hit_items``
    array<string> (sorted). A single item longer than a block makes a block of its own."""
    import pyarrow as pa

    fields = "n_words long, hit_spans array<struct<start:int,stop:int>>, hit_items array<string>"
    kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.list_(pa.string())]
    out, old_spans, old_items = docs, free_name(docs, "_spans"), free_name(docs, "_items")
    for n, block in enumerate(_blocks(items, block_words)):
        shared = docs.sparkSession.sparkContext.broadcast(Automaton(block, window))
        first = n == 0
        if not first:  # one automaton in memory at a time
            out = materialise(out, "decontam").withColumnsRenamed({"hit_spans": old_spans, "hit_items": old_items})

        def make(batch, shared=shared, first=first):
            automaton = shared.value
            counts, spans, found = [], [], []
            for i, text in enumerate(utf8(batch, "text")):
                words = words_of(text)
                where, which = automaton.scan(words)
                if not first:
                    where = merge([*where, *((x["start"], x["stop"]) for x in batch.column(old_spans)[i].as_py())])
                    which = which | set(batch.column(old_items)[i].as_py())
                counts.append(len(words))
                spans.append([{"start": a, "stop": b} for a, b in where])
                found.append(sorted(which))
            return [pa.array(x, k) for x, k in zip((counts, spans, found), kinds, strict=True)]

        out = add_columns(out, fields, make).drop(old_spans, old_items)
    return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of ``spans`` and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text.lower())]
    out, pos = [], 0
    for a, b in spans:
        out.append(text[pos : at[a][0]])
        pos = at[b - 1][1]
    return b"".join([*out, text[pos:]])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` without contamination: every hit span is cut from its text, and documents of which hit words make up
    more than ``max_coverage`` go altogether. ``n_chars``, where there is one, is counted anew for a cut text."""
    import pyarrow as pa

    found = scan(packed(docs, "text"), items, window)
    hit = F.aggregate("hit_spans", F.lit(0), lambda n, s: n + s["stop"] - s["start"])
    found = found.where(hit <= F.lit(max_coverage) * F.greatest("n_words", F.lit(1)))

    def make(batch):
        spans = batch.column("hit_spans").to_pylist()
        old = batch.column("text").to_pylist()
        new = [cut(t.encode(), [(s["start"], s["stop"]) for s in x]).decode() if x else t for t, x in zip(old, spans, strict=True)]
        return [pa.array(new, pa.string())]

    cleaned = add_columns(found, "_text string", make).withColumn("text", F.col("_text"))
    return unpacked(cleaned, docs.columns, F.size("hit_spans") > 0)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest of the contract, one row a document."""
    found = scan(docs.select("doc_id", "text"), items)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]).cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )
