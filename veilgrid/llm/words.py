"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

A word is a run without ASCII white space (space, tab to carriage return), with A-Z in lower case (unless `letters` says
otherwise). Its hash takes in eight bytes at a time and mixes every bit in between, so that it has no algebraic structure
that texts could hit on (polynomials modulo 2**64 have: Thue-Morse words of 1,024 letters collide in every odd base).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 19
BASE, SECOND = np.uint64(0x9E3779B97F4A7C55), np.uint64(0xD1342543DE82EF95)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
TAIL = np.array([2 ** (8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about BLOCK bytes (a longer text by itself), each with the index of its first."""
    first, run, size = 0, [], 0
    for k, t in enumerate(texts):
        b = t.encode("utf-8", "replace")
        if run and size + len(b) > BLOCK:
            yield first, run
            first, run, size = k, [], 0
        run.append(b)
        size += len(b)
    if run:
        yield first, run


def string_hashes(padded: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each string of bytes that begins at `starts`; at least eight more bytes follow the last one."""
    eight = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    h = mix(sizes.astype(np.uint64) * BASE)
    at, left, live = starts, sizes, None
    while True:
        more = mix((h if live is None else h[live]) ^ (eight[at] & TAIL[np.minimum(left, 8)])) + BASE
        if live is None:
            h, live = more, np.arange(len(h))
        else:
            h[live] = more
        on = left > 8
        live, at, left = live[on], at[on] + 8, left[on] - 8
        if not len(live):
            return h
        if len(live) <= 4 and left.min() > 256:  # a few long ones: no numpy step for each eight bytes
            for k, a, n in zip(live.tolist(), at.tolist(), left.tolist(), strict=True):
                h[k] = mix(h[k : k + 1] ^ np.frombuffer(hashlib.blake2b(padded[a : a + n].tobytes(), digest_size=8).digest(), "<u8"))[0]
            return h


def word_hashes(run: list[bytes], letters: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of a run of texts, and where each text's words begin (one more than there are texts)."""
    data = letters[np.frombuffer(b"\n".join(run) + b"\n" * 9, np.uint8)]
    space = SPACES[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, run), np.int64, len(run)) + 1)])
    h = string_hashes(data, starts, ends - starts) if len(starts) else np.zeros(0, np.uint64)
    return h, np.searchsorted(starts, at)


def distinct(run: list[bytes], hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of each text, sorted in it, the offsets of the texts, and where in `hashes` each was."""
    doc = np.repeat(np.arange(len(run)), np.diff(offsets))
    order = np.lexsort((hashes, doc)) if len(run) > 1 else np.argsort(hashes)
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], np.searchsorted(d[new], np.arange(len(run) + 1)), order[new]


def shingle_hashes(run: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each text as sorted hashes, and offsets; under k words, the whole sequence as one.

    The third array has a second hash of each shingle, mixed otherwise.
    """
    h, offsets = word_hashes(run)
    n = np.diff(offsets)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    if not count.sum():
        return np.zeros(0, np.uint64), np.zeros(len(run) + 1, np.int64), np.zeros(0, np.uint64)
    at = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(run)), count)
    start = offsets[doc] + (np.arange(at[-1]) - at[doc])
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    short = (n < k)[doc]
    s, other = np.zeros(at[-1], np.uint64), np.full(at[-1], BASE)
    for j in range(k):
        w = padded[start + j]
        if j and short.any():
            w = np.where(short & (n[doc] <= j), np.uint64(0), w)
        s = mix(s * BASE + w)
        other = mix((other ^ w) * SECOND + np.uint64(j))
    s, at, where = distinct(run, s, at)
    return s, at, other[where]


def set_digests(h: np.ndarray, other: np.ndarray, at: np.ndarray) -> list[bytes]:
    """128 bits for each set of shingles: a sum over each of two independent hashes of its members; zeros for an empty set."""
    n = np.diff(at)
    some = np.flatnonzero(n)
    d = np.zeros((len(n), 2), np.uint64)
    for j, x in enumerate((h, other) if len(h) else ()):
        d[some, j] = mix(np.add.reduceat(mix(x ^ SECOND), at[some]) + n[some].astype(np.uint64))
    return [x.tobytes() for x in d]
