"""Words of many texts at once: where they are, and their hashes, without an object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from leafwise.llm.common import mix64

#: Bytes of text whose words are found at once; a longer text goes alone.
AT_ONCE = 1 << 20
#: Words of more bytes are hashed one by one.
LONG = 64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: By how many bytes of a number count: the mask that leaves them.
_MASK = np.array([2 ** (8 * i) - 1 for i in range(9)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Words of texts, A-Z lower-cased: their first bytes and lengths in ``text``, and how many each text has."""

    def __init__(self, texts: list[bytes]):
        # a space on either side, and room to read eight bytes from any place
        self.text = b" " + b" ".join(texts).lower() + b" " * 8
        self.data = np.frombuffer(self.text, np.uint8)
        space = _SPACE[self.data]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.start, self.length = edges[::2], edges[1::2] - edges[::2]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.counts = np.diff(np.searchsorted(self.start, ends), prepend=0)

    def bytes_at(self, i: int) -> bytes:
        a = int(self.start[i])
        return self.text[a : a + int(self.length[i])]

    def last(self) -> np.ndarray:
        """Last byte of every word."""
        return self.data[self.start + self.length - 1]

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word; of words of up to eight bytes and equal length no two are the same."""
        eight = np.ndarray(len(self.text) - 7, "<u8", self.text, strides=1)
        h = mix64(self.length.astype(np.uint64) * _ODD)
        h = mix64(h ^ (eight[self.start] & _MASK[np.minimum(self.length, 8)]))
        at = np.flatnonzero(self.length > 8)
        for place in range(8, LONG, 8):
            if not len(at):
                break
            more = eight[self.start[at] + place] & _MASK[np.minimum(self.length[at] - place, 8)]
            h[at] = mix64(h[at] ^ more)
            at = at[self.length[at] > place + 8]
        for i in np.flatnonzero(self.length > LONG).tolist():
            h[i] = xxhash.xxh3_64_intdigest(self.bytes_at(i))
        return h


def some_at_once(texts) -> Iterator[list[bytes]]:
    """The texts in runs of about ``AT_ONCE`` bytes."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= AT_ONCE:
            yield run
            run, size = [], 0
    if run:
        yield run
