"""Words, word hashes and window hashes of many texts at once, in numpy.

Word and window hashes are 64 bits wide, the same on every machine and in every run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_STEP = U(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output bits each depend on every input bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


BYTE_KEY = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers = np.multiply.accumulate(np.concatenate([[U(1)], np.full(255, _BASE)]))


def powers(n: int) -> np.ndarray:
    global _powers
    if _powers.size < n:
        _powers = np.multiply.accumulate(np.concatenate([[U(1)], np.full(2 * n, _BASE)]))
    return _powers


@dataclass
class Words:
    """Words of consecutive texts; doc d owns words first[d]:first[d + 1]."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.first.size - 1), self.count)


def batches(texts: list[bytes], limit: int = 1 << 20):
    """(from, to) of runs of texts of about `limit` bytes; a larger text stands alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def words_of(texts: list[bytes]) -> Words:
    """The words of each text, hashed."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    inside = ~SPACE[buf]
    turn = np.diff(inside.view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    doc_end = np.cumsum(sizes)
    first = np.concatenate([[0], np.searchsorted(start, doc_end)])
    if not start.size:
        return Words(buf, start, end, first, np.empty(0, np.uint64))
    size = end - start
    at = np.cumsum(size) - size
    body = buf[inside]
    rank = np.arange(body.size) - np.repeat(at, size)
    h = np.add.reduceat(BYTE_KEY[body] * powers(int(size.max()))[rank], at)
    return Words(buf, start, end, first, mix(h ^ (size.astype(np.uint64) * _STEP)))


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent sums over h[i:i + k] for every i up to len(h) - k, built by doubling the width."""
    n = h.size - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, part, width = None, 0, h, 1
    step = U(0xA0761D6478BD642F)
    weight = step  # step ** width, modulo 2 ** 64
    rest = k
    while rest:
        if rest & 1:
            piece = part[done : done + n]
            out = piece.copy() if out is None else out * weight + piece
            done += width
        rest >>= 1
        if rest:
            part = part[:-width] * weight + part[width:]
            weight = U(int(weight) ** 2 % (1 << 64))
            width *= 2
    return mix(out)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the k-word windows that lie within one text."""
    h = rolled(w.hash, k)
    if not h.size:
        return np.empty(0, np.int64), h
    last = np.repeat(w.first[1:], w.count)[: h.size] - k
    start = np.flatnonzero(np.arange(h.size) <= last)
    return start, h[start]


def covered(n: int, start: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """Whether each of n places lies in some [start, start + width)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + width, -1)
    return np.cumsum(edge[:n]) > 0


def per_doc(first: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Sum of flags over each doc's range."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]
