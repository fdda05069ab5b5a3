"""N-best segmentation over a public piece vocabulary, and its exact inverse.

A text is a lattice: nodes are the places between characters, arcs are the vocabulary pieces that match there. The cost
of a piece is the logarithm of its rank, a Zipf prior, in whole micro-nats, so sums are exact and ties well defined. A
forward Viterbi pass gives each node its least cost from the start; these costs are exact heuristics for an A-star
search backward from the end, which meets complete paths in the order of their cost.

No piece spans a space or a line feed except at its start, so the lattice of a text is a chain of small lattices, one
for each word with the spaces before it. The search's first two results give each distinct word's best path and what its
second best costs more; both stay in a bounded cache of the task. Words that are new in a batch of texts are searched
together: each has its own lattice, but the forward passes and the backward walks of all go on in step. Only the N - 1 words whose second best costs least more are searched
for N paths. That loses nothing: a segmentation that departs from the best in another word costs at least as much as each of
the N - 1 that depart in one of these words alone, and as the best, so N at least as cheap are found without it.

Characters outside the vocabulary become bytes. Decoding joins the pieces' bytes, so every text comes back unchanged.

Defined results: a null or empty text has no pieces, cost 0 and one segmentation; ties go to longer last pieces first;
repeated rows get equal pieces; an empty table gives no rows; a very long text is encoded whole, word by word; other
columns are kept, and those named like a returned one are replaced. Vocabularies have at most 65,536 pieces, since ids
are packed as 16-bit numbers; a larger one is an error.
"""

from __future__ import annotations

import heapq
import random
import re
from array import array
from itertools import product
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import add_columns

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST, CACHE = 3, 200_000
LONGEST, BLOCK, GROUP = 64, 1 << 17, 1 << 20  # characters: of a kept word, of words searched together, of texts read together
SPACE = "▁"
_SEGMENT = re.compile(r"\n| *[^ \n]+| +")
_FAR = 1 << 62


class Vocabulary:
    """Pieces, their ids, costs and bytes; what is read from the model file is all that executors get."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.pieces: dict[str, tuple[int, int]] = {}
        self.out: list[bytes] = []
        byte_ids: dict[int, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.out.append(b"")
            if sp.is_byte(i):
                byte_ids[int(piece[1:-1], 16)] = i
                self.out[i] = bytes([int(piece[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and SPACE not in piece.lstrip(SPACE) and "\n" not in piece:
                self.pieces[piece] = (i, round(1e6 * log(2.718281828 - sp.get_score(i))))
                self.out[i] = piece.replace(SPACE, " ").encode()
        if len(self.out) > 1 << 16:
            raise ValueError(f"{model} has {len(self.out)} pieces; 65,536 at most can be packed")
        self.bytes = [byte_ids[b] for b in range(256)]
        self.byte_cost = 2 * max(c for _, c in self.pieces.values())
        self.trie = Trie(self.pieces, len(self.out))


class Trie:
    """The pieces as a double array, so that NumPy can follow many words at once: the child of ``state`` by a character of
    code ``c`` is ``base[state] + c`` if ``parent`` there is ``state``. The root is 0, and code 0 is of any other character."""

    def __init__(self, pieces: dict[str, tuple[int, int]], n_ids: int):
        import numpy as np

        letters = sorted(set("".join(pieces)))
        code = {c: i for i, c in enumerate(letters, 1)}
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        children: dict[str, list[str]] = {}
        for prefix in {p[:i] for p in pieces for i in range(1, len(p) + 1)}:
            children.setdefault(prefix[:-1], []).append(prefix)
        room = len(letters) + 4 * sum(map(len, children.values()))
        taken, states = bytearray(room + len(letters) + 1), {"": 0}
        taken[0] = 1
        self.base, self.parent, self.piece = (np.full(len(taken), k, np.int32) for k in (0, -1, -1))
        rng = random.Random(1)
        at = {"": 0}  # the base of each state with children; the root's children stand at their codes
        for prefix in sorted(children, key=lambda p: (p != "", -len(children[p]), p)):
            codes = [code[c[-1]] for c in children[prefix]]
            base = 0 if prefix == "" else rng.randrange(room)
            while any(taken[base + c] for c in codes):
                base = rng.randrange(room)
            at[prefix] = base
            for child, c in zip(children[prefix], codes, strict=True):
                taken[base + c] = 1
                states[child] = base + c
        for prefix, base in at.items():
            self.base[states[prefix]] = base
            self.parent[[states[c] for c in children[prefix]]] = states[prefix]
        self.cost = np.zeros(n_ids, np.int64)
        for piece, (i, cost) in pieces.items():
            self.piece[states[piece]] = i
            self.cost[i] = cost
        self.single = np.zeros(0x110000, bool)
        self.single[[ord(p) for p in pieces if len(p) == 1]] = True


class Encoder:
    def __init__(self, vocabulary: Vocabulary, n: int = N_BEST, cache: int = CACHE):
        import ahocorasick

        self.v, self.n, self.limit = vocabulary, n, cache
        self.kept: dict[str, tuple[int, bytes, int]] = {}
        self.older: dict[str, tuple[int, bytes, int]] = {}
        self.finder = ahocorasick.Automaton()
        for piece, (i, cost) in vocabulary.pieces.items():
            self.finder.add_word(piece, (len(piece), cost, (i,)))
        self.finder.make_automaton()
        self.singles = frozenset(p for p in vocabulary.pieces if len(p) == 1)

    def _arcs(self, segment: str) -> list[tuple[int, int, int, tuple[int, ...]]]:
        """(start, end, cost, ids), by end, longest first."""
        text = segment.replace(" ", SPACE)
        arcs = [(end + 1 - n, end + 1, cost, ids) for end, (n, cost, ids) in self.finder.iter(text)]
        single = {end for start, end, _, _ in arcs if end - start == 1}
        literal = SPACE in segment
        if literal or len(single) < len(text):
            if literal:  # this character of the text itself is written in bytes, since its piece means a space
                arcs = [x for x in arcs if SPACE not in segment[x[0] : x[1]]]
                single = {end for start, end, _, _ in arcs if end - start == 1}
            for end in range(1, len(text) + 1):
                if end not in single:
                    raw = segment[end - 1].encode()
                    arcs.append((end - 1, end, self.v.byte_cost * len(raw), tuple(self.v.bytes[b] for b in raw)))
            arcs.sort(key=lambda x: (x[1], x[0]))
        return arcs

    def _lattice(self, segment: str) -> tuple[list[int], list[list]]:
        """The forward Viterbi pass: the least cost of each node from the start, and the arcs (start, cost, ids) that end
        in each node, longest first."""
        size, text = len(segment), segment.replace(" ", SPACE)
        best, ending = [0] + [_FAR] * size, [[] for _ in range(size + 1)]
        if SPACE not in segment and self.singles.issuperset(text):
            for end, (length, cost, ids) in self.finder.iter(text):
                end += 1
                start = end - length
                ending[end].append((start, cost, ids))
                if (c := best[start] + cost) < best[end]:
                    best[end] = c
        else:
            for start, end, cost, ids in self._arcs(segment):
                ending[end].append((start, cost, ids))
                if (c := best[start] + cost) < best[end]:
                    best[end] = c
        return best, ending

    def search(self, segment: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The ``n`` cheapest segmentations of one lattice, as (cost, ids): A-star backward from the end, each step's
        heuristic being the forward pass's least cost of what is left, which is exact."""
        best, ending = self._lattice(segment)
        size = len(segment)
        found, made = [], 0
        heap: list = [(best[size], size, 0, 0, None)]
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            total, node, _, behind, path = pop(heap)  # of equal costs the one nearest to the start
            if not node:
                ids: list[int] = []
                while path is not None:
                    ids.extend(path[0])
                    path = path[1]
                found.append((total, tuple(ids)))
                if len(found) == n:
                    break
                continue
            for start, cost, piece in ending[node]:
                made += 1
                cost += behind
                push(heap, (best[start] + cost, start, made, cost, (piece, path)))
        return found

    def _entry(self, segment: str) -> tuple[int, bytes, int]:
        """(least cost, its packed ids, what the second best costs more): the first two results of the same backward
        search. Since the heuristic is exact it walks straight along the best path, and the second best is what leaves
        that path at the cheapest sidetrack, so these two need no heap."""
        best, ending = self._lattice(segment)
        node, gap, ids = len(segment), _FAR, []
        total = best[node]
        while node:
            at, taken = best[node], None
            for arc in ending[node]:
                more = best[arc[0]] + arc[1] - at
                if not more and taken is None:
                    taken = arc
                elif more < gap:
                    gap = more
            ids.extend(reversed(taken[2]))
            node = taken[0]
        ids.reverse()
        entry = (total, array("H", ids).tobytes(), gap)
        if len(segment) <= LONGEST:
            self.kept[segment] = entry
        return entry

    def _entries(self, words: list[str]):
        """``_entry`` of many words, each in its own lattice, as (word, entry): the forward passes go from node to node in
        step, then the backward searches walk in step. Words that are not wholly made of pieces are left out."""
        import numpy as np

        trie = self.v.trie
        words = sorted(words, key=len, reverse=True)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(size) - size
        space = flat == 32
        good = np.logical_and.reduceat(trie.single[flat] & (flat != ord(SPACE)) | space, first)
        codes = trie.code[np.where(space, ord(SPACE), flat)]
        longest = int(size[0])
        # words of at least p characters; node p of the word at w is over[p] + w, so the nodes of a place lie together
        many = len(words) - np.searchsorted(size[::-1], np.arange(longest + 2))
        over = np.cumsum(many) - many
        codes = [codes[first[: many[p + 1]] + p] for p in range(longest)]

        # forward: arcs by their start, the least cost of each node
        best = np.full(int(many.sum()), _FAR)
        best[: many[0]] = 0
        arcs = []
        for p in range(longest):
            state = codes[p]
            at = np.flatnonzero(state)
            state = state[at]
            for end in range(p + 1, longest + 1):
                piece = trie.piece[state]
                ends = np.flatnonzero(piece >= 0)
                if len(ends):
                    piece, w = piece[ends], at[ends]
                    start, node = over[p] + w, over[end] + w
                    cost = best[start] + trie.cost[piece]
                    best[node] = np.minimum(best[node], cost)
                    arcs.append((node, start, piece, cost))
                if end == longest:
                    break
                n = np.searchsorted(at, many[end + 1])
                at, state = at[:n], state[:n]
                after = trie.base[state] + codes[end][at]
                on = trie.parent[after] == state
                at, state = at[on], after[on]
                if not len(at):
                    break

        # backward: at each node the longest arc on the best path, and the cheapest sidetrack
        side, back, by = np.full(len(best), _FAR), np.full(len(best), -1), np.zeros(len(best), np.uint16)
        for node, start, piece, cost in arcs:
            more = cost - best[node]
            on = (more == 0) & (back[node] < 0)
            back[node[on]], by[node[on]] = start[on], piece[on]
            more[on] = _FAR
            side[node] = np.minimum(side[node], more)
        good = walk = np.flatnonzero(good)
        last = over[size] + np.arange(len(words))
        node = last[walk]
        gap, made, steps = np.full(len(words), _FAR), np.zeros(len(words), np.int64), []
        while len(walk):
            gap[walk] = np.minimum(gap[walk], side[node])
            made[walk] += 1
            steps.append((walk, by[node]))
            node = back[node]
            on = node >= many[0]
            walk, node = walk[on], node[on]
        after = np.cumsum(made)
        ids = np.zeros(after[-1], np.uint16)
        for step, (walk, of) in enumerate(steps, 1):
            ids[after[walk] - step] = of
        packed, after = ids.tobytes(), 2 * after[good]
        parts = [packed[a:b] for a, b in zip((after - 2 * made[good]).tolist(), after.tolist(), strict=True)]
        return zip([words[i] for i in good.tolist()], zip(best[last[good]].tolist(), parts, gap[good].tolist(), strict=True), strict=True)

    def learn(self, segments: list[list[str]]) -> None:
        """Entries of all distinct words of some texts, searched together. A word goes when half of the cache has been filled
        twice since it was last met."""
        if len(self.kept) >= self.limit // 2:
            self.older, self.kept = self.kept if len(self.kept) <= self.limit else {}, {}
        kept, older = self.kept, self.older
        block, size = [], 0
        for word in set().union(*segments) - kept.keys():
            if (entry := older.get(word)) is not None:
                kept[word] = entry
            elif len(word) <= LONGEST:
                block.append(word)
                size += len(word)
                if size >= BLOCK:
                    kept.update(self._entries(block))
                    block, size = [], 0
        if block:
            kept.update(self._entries(block))

    def each_ways(self, texts: list[str]):
        """``ways`` of each text; the words of texts of some ``GROUP`` characters are searched together."""
        at = 0
        while at < len(texts):
            segments, size = [], 0
            while at < len(texts) and size < GROUP:
                segments.append(_SEGMENT.findall(" " + texts[at]) if texts[at] else [])
                size += len(texts[at])
                at += 1
            self.learn(segments)
            yield from map(self._ways, segments)

    def ways(self, text: str) -> tuple[list[str], list[bytes], list[tuple[int, dict[int, bytes]]]]:
        """The segments of a text, their best ids, and up to ``n`` segmentations, cheapest first: the cost of each and
        the segments in which it differs from the best."""
        return next(self.each_ways([text]))

    def _ways(self, segments: list[str]):
        get, make = self.kept.get, self._entry
        chain = [get(s) or make(s) for s in segments]
        cost = sum([e[0] for e in chain])
        found: list[tuple[int, dict[int, bytes]]] = [(cost, {})]
        if self.n > 1 and chain:
            # the n best differ from the best only where second choices cost least, in n - 1 places at most
            extra, places = [e[2] for e in chain], []
            for _ in range(min(self.n - 1, len(extra))):
                places.append(extra.index(min(extra)))
                extra[places[-1]] = 1 << 63
            choices = [[(c - chain[p][0], array("H", ids).tobytes()) for c, ids in self.search(segments[p], self.n)] for p in places]
            sums = [(sum(w[0] for w in way), k) for k, way in enumerate(product(*choices)) if k]
            for more, k in heapq.nsmallest(self.n - 1, sums):
                swapped = {}
                for p, options in reversed([*zip(places, choices, strict=True)]):
                    k, pick = divmod(k, len(options))
                    if pick:
                        swapped[p] = options[pick][1]
                found.append((cost + more, swapped))
        return segments, [e[1] for e in chain], found

    def encode(self, text: str) -> list[tuple[int, bytes]]:
        """Up to ``n`` segmentations of a whole text as (cost, ids packed as 16-bit numbers), cheapest first."""
        _, parts, found = self.ways(text)
        return [(cost, joined(parts, swapped)) for cost, swapped in found]

    def surface(self, packed: bytes) -> bytes:
        return b"".join(map(self.v.out.__getitem__, array("H", packed)))

    def decode(self, packed: bytes) -> str:
        return self.surface(packed)[1:].decode()


def joined(parts: list[bytes], swapped: dict[int, bytes]) -> bytes:
    """The ids of a text that has other ids in the segments of ``swapped``."""
    if swapped:
        parts = parts.copy()
        for i, x in swapped.items():
            parts[i] = x
    return b"".join(parts)


def encode(docs: DataFrame, n: int = N_BEST, model: str = MODEL) -> DataFrame:
    """``docs`` with ``ids`` array<int> of the best segmentation, ``costs`` array<long> of up to ``n`` segmentations and
    ``alternatives`` array<array<int>> of the later ones."""
    return _with(docs, n, model, "ids array<int>, costs array<bigint>, alternatives array<array<int>>", _full)


def _lists(packed: list[bytes]):
    """Packed ids as an Arrow list column."""
    import numpy as np
    import pyarrow as pa

    offsets = np.cumsum([0, *(len(x) // 2 for x in packed)], dtype=np.int32)
    values = np.frombuffer(b"".join(packed), np.uint16).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _full(encoder, texts):
    import numpy as np
    import pyarrow as pa

    every = [[(cost, joined(parts, swapped)) for cost, swapped in found] for _, parts, found in encoder.each_ways(texts)]
    later = [[w[1] for w in ways[1:]] for ways in every]
    offsets = pa.array(np.cumsum([0, *map(len, later)], dtype=np.int32))
    costs = pa.array([[w[0] for w in ways] for ways in every], pa.list_(pa.int64()))
    return [_lists([ways[0][1] for ways in every]), costs, pa.ListArray.from_arrays(offsets, _lists([x for xs in later for x in xs]))]


def _digest(encoder, texts):
    import hashlib

    import pyarrow as pa

    rows = []
    for text, (segments, parts, found) in zip(texts, encoder.each_ways(texts), strict=True):
        best = b"".join(parts)
        back = encoder.decode(best) == text and all(encoder.surface(x) == segments[p].encode() for _, swapped in found for p, x in swapped.items())
        every = hashlib.sha256()
        for _, swapped in found:
            every.update(joined(parts, swapped) if swapped else best)
        rows.append((len(best) // 2, found[0][0], found[-1][0] - found[0][0], len(found), hashlib.sha256(best).hexdigest(), every.hexdigest(), back))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
    return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]


def _with(docs: DataFrame, n: int, model: str, fields: str, each) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))
    state: dict = {}  # of one task

    def make(batch):
        if "encoder" not in state:
            state["encoder"] = Encoder(shared.value, n)
        return each(state["encoder"], [t or "" for t in batch.column("text").to_pylist()])

    return add_columns(docs, fields, make)


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """``rows`` with ``text`` made from ``ids``."""
    import pyarrow as pa

    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def make(batch):
        back = Encoder(shared.value).decode
        return [pa.array([back(array("H", x or []).tobytes()) for x in batch.column("ids").to_pylist()], pa.string())]

    return add_columns(rows, "text string", make)


def report(docs: DataFrame, n: int = N_BEST, model: str = MODEL) -> DataFrame:
    """Digest: pieces, cost and hash of the best, the hash of the ids of all N best in their order, what the last of them
    costs more, and whether all decode to the text."""
    fields = "n_pieces long, cost long, cost_gap long, n_best long, ids_sha256 string, all_sha256 string, round_trip boolean"
    return _with(docs.select("doc_id", "text"), n, model, fields, _digest).drop("text")
