"""Words of many texts at once against bytes.split, and what is rare and distinct among shingles."""

import random

import numpy as np

from leafwise.llm import jaccard, words

TEXTS = [b"", b" \t\r\n\x0b\x0c", b"one", b"One  ONE\tone\n", "Ünï ünï \x1c ü x".encode(), b"a\0 a a\0\0", b"12345678 123456789 1234567890123456 12345678901234567", b"x" * 63 + b" " + b"x" * 64 + b" " + b"x" * 65 + b" " + b"x" * 66, b"a" * 3000, b"last "]


def test_words_are_those_of_split():
    rng = random.Random(1)
    texts = TEXTS + [bytes(rng.choices(b"aB \n\xc3\0z1", k=rng.randrange(90))) for _ in range(300)]
    found = words.Words(texts)
    want = [w for t in texts for w in t.lower().split()]
    assert [found.bytes_at(i) for i in range(len(found.start))] == want
    assert found.counts.tolist() == [len(t.split()) for t in texts]
    assert found.last().tolist() == [w[-1] for w in want]
    h = found.hashes().tolist()
    assert len(set(h)) == len(set(zip(h, want))) == len(set(want))
    assert not len(words.Words([]).start) and not len(words.Words([b"", b""]).hashes())


def test_hashes_do_not_depend_on_neighbours(monkeypatch):
    monkeypatch.setattr(words, "AT_ONCE", 10)
    alone = [words.Words([t]).hashes().tolist() for t in TEXTS]
    assert sum(alone, []) == words.Words(TEXTS).hashes().tolist()
    assert [t for run in words.some_at_once(TEXTS) for t in run] == TEXTS and len(list(words.some_at_once(TEXTS))) > 3
    got = list(jaccard.shingles(TEXTS, 4))
    monkeypatch.setattr(words, "AT_ONCE", 10**9)
    for (k, h), (k2, h2), t in zip(got, jaccard.shingles(TEXTS, 4), TEXTS):
        n = len(t.split())
        assert k == k2 and h.tolist() == h2.tolist() and len(h) == (max(1, n - 3) if n else 0)


def test_rarest_are_those_of_a_sort():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 300):
        h = jaccard._distinct(rng.integers(0, max(n, 1) * 3, n).astype(np.uint64))
        count = rng.integers(0, 6, len(h))
        order = h[np.lexsort((h, count))]
        for m in {0, min(1, len(h)), len(h) // 3, len(h)}:
            assert sorted(jaccard._rarest(h, count, m).tolist()) == sorted(order[:m].tolist())
