"""Small helpers shared by the operators that work on texts inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: ASCII letters to lower case; every other byte stays, so UTF-8 stays valid.
LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))

#: The same for texts.
LOWER_TEXT = {c: c + 32 for c in range(0x41, 0x5B)}

SLICE_ROWS = 64


def slices(column: pa.Array) -> Iterator[list[str]]:
    """The texts of an Arrow column, a few at a time; null counts as empty."""
    for start in range(0, len(column), SLICE_ROWS):
        yield [t if t is not None else "" for t in column.slice(start, SLICE_ROWS).to_pylist()]


def lower_words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


_HELD: dict = {}


def held(key, make):
    """What an operator keeps in this Python worker from batch to batch: vocabularies and values of words.

    The last one asked for only: stages that follow each other run in the same workers, where their caches would add up.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


class WordCache:
    """Values of words, computed once per Python worker and kept within a bound.

    Two generations of up to ``limit`` words: when the young one is full it becomes the old one, and words that are
    met again move back, so frequent words stay and rare ones go.
    """

    def __init__(self, compute, limit: int = 250_000):
        self.compute, self.limit, self.young, self.old = compute, limit, {}, {}

    def learn(self, words: set) -> dict:
        """A dictionary that holds all of ``words``."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        unknown = []
        for word in words.difference(young):
            if word in old:
                young[word] = old[word]
            else:
                unknown.append(word)
        if unknown:
            young.update(zip(unknown, self.compute(unknown)))
        return young


class WordValues(dict):
    """Values of words, computed when they are first asked for and kept within a bound.

    Two generations of up to ``limit`` words, as in ``WordCache``, for values that are computed one by one.
    """

    def __init__(self, compute, limit: int = 250_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, word):
        value = self.old.pop(word, None)
        if value is None:
            value = self.compute(word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value


#: A random odd factor of the hashes of runs of words, and what undoes it modulo 2^64.
STEP = 0x9E3779B97F4A7C13
INVERSE = pow(STEP, -1, 1 << 64)


class Powers:
    """Powers of ``STEP`` and of its inverse, as many as have been needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = (
                np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, f, dtype=np.uint64))]) for f in (STEP, INVERSE)
            )
        return self.up, self.down


POWERS = Powers()
