"""Runs of byte windows that share a minimizer, found block by block.

A window's minimizer is the smallest hash of the grams in it (ties: the last),
so equal windows have equal minimizers at equal places, whatever stands around
them.  Hashes are of a rolling polynomial, made from running sums over blocks
that stay in a processor's cache; a text of any length is a row of such blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .sketch import AT_BITS, _minimizers

#: Windows that start in one block; runs of windows end where it ends.
BLOCK = 1 << 15
#: Bytes of texts that are taken together.
JOINT = 1 << 22
BASE = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1
TABLE = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _M64, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Grams:
    """Finds segments: runs of windows of ``window`` bytes with one minimizer, a gram of ``gram`` bytes."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram
        self.up, self.down = powers(BASE, BLOCK + window), powers(pow(BASE, -1, 1 << 64), BLOCK + window)

    def hashes(self, block: np.ndarray) -> np.ndarray:
        """Hashes of the grams of a block of at most BLOCK windows."""
        n, g = len(block), self.gram
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(TABLE[block] * self.down[:n], out=sums[1:])
        x = (sums[g:] - sums[:-g]) * self.up[: n - g + 1]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ x >> np.uint64(29)

    def segments(self, joint: bytes, first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, first window, number of windows, place of the gram) of the segments of the texts that ``joint`` is made of."""
        data, low = np.frombuffer(joint, np.uint8), np.uint64((1 << AT_BITS) - 1)
        none = np.empty(0, np.int64)
        out: list[tuple] = []
        # the first windows that cross into the next text
        over = np.unique(np.concatenate([first[1:] - self.window + 1, first[1:]])).clip(0) if len(first) > 1 else none
        for a in range(0, len(data) - self.window + 1, BLOCK):
            h = self.hashes(data[a : a + BLOCK + self.window - 1])
            m = _minimizers(h, self.window - self.gram + 1)
            cuts = over[np.searchsorted(over, a, "right") : np.searchsorted(over, a + len(m))] - a
            head = np.union1d(np.flatnonzero(m[1:] != m[:-1]) + 1, cuts)
            head = np.concatenate([[0], head])
            n = np.diff(np.append(head, len(m)))
            own = np.searchsorted(first, head + a, "right") - 1
            inside = head + a + n - 1 + self.window <= (first + counts)[own]
            head, n = head[inside], n[inside]
            x = m[head]
            out.append(((x >> np.uint64(AT_BITS)).astype(np.int64), head + a, n, (low - (x & low)).astype(np.int64) + a))
        if not out:
            return none, none, none, none
        return tuple(np.concatenate(c) for c in zip(*out))


def joined_texts(raws) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """Texts of a batch, a few at a time: place of the first, the bytes of all, where each starts, how long each is."""
    held: list[bytes] = []
    n = first = 0

    def together():
        counts = np.array([len(x) for x in held])
        return first, b"".join(held), np.cumsum(counts) - counts, counts

    for i, raw in enumerate(raws):
        raw = raw.as_py()
        if held and n + len(raw) > JOINT:
            yield together()
            held, n, first = [], 0, i
        held.append(raw)
        n += len(raw)
    if held:
        yield together()
