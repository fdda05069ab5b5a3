"""Pieces: words that are searched together get what each gets by itself."""

import random

from graphloom.llm import nbest

ODD = ["a", " ", "    ", "\n", "▁", " ▁a", "a▁▁b", "\x00", " \U0001f600x", "é", " Straße,", "日本語", "￿", "x" * 64, " " + "ab" * 31, "y" * 65, " " * 70, "z" * 500]


def drawn(n):
    rng = random.Random(2)
    parts = ["th", "e", "on", "an", "ing", "re", "Ble", "tion", ",", ".", "12", "é", "ß", "x", " ", "0f", "|", "日", "\U0001f600"]
    return [*{" " * rng.randrange(3) + "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))).strip() for _ in range(n)} - {""}]


def test_words_together_as_each_by_itself():
    encoder = nbest.Encoder(nbest.Vocabulary())
    words = [*dict.fromkeys(w for t in ODD + drawn(3000) for w in nbest._SEGMENT.findall(t))]
    found = dict(encoder._entries(words))
    assert 0.5 * len(words) < len(found) < len(words)  # others hold characters outside the vocabulary
    for word in words:
        ways = [(c, nbest.array("H", ids).tobytes()) for c, ids in nbest.Encoder.search(encoder, word, 2)]
        gap = ways[1][0] - ways[0][0] if len(ways) > 1 else nbest._FAR
        assert encoder._entry(word) == (*ways[0], gap)
        assert found.get(word, encoder._entry(word)) == (*ways[0], gap)


def test_common_words_are_not_searched_alone(monkeypatch):
    alone, plain = [], nbest.Encoder._entry
    monkeypatch.setattr(nbest.Encoder, "_entry", lambda self, word: alone.append(word) or plain(self, word))
    rng = random.Random(4)
    text = "\n".join(" ".join("".join(rng.choice(["th", "er", "on", "le", "ing", "a"]) for _ in range(5)) for _ in range(9)) for _ in range(300))
    encoder = nbest.Encoder(nbest.Vocabulary())
    assert all(encoder.decode(ids) == text for _, ids in encoder.encode(text))
    assert alone == ["\n"]


def test_a_small_cache_changes_nothing():
    texts = [" ".join(drawn(400)[i : i + 40]) for i in range(0, 300, 25)] + ["", "one  two\nthree ", "w " * 300, "q" * 3000]
    vocabulary = nbest.Vocabulary()
    want = [nbest.Encoder(vocabulary).encode(t) for t in texts]
    for limit in (0, 1, 50):
        small = nbest.Encoder(vocabulary, cache=limit)
        assert [small.encode(t) for t in texts * 2] == want * 2
        assert [[(c, nbest.joined(p, x)) for c, x in f] for _, p, f in small.each_ways(texts)] == want
