"""Suffix sorting by induction, in numpy batches over disk-backed bucket queues.

Suffixes are of L or S type, as they are larger or smaller than their right neighbour. Once the leftmost S suffixes
(LMS) are in order, one pass up the buckets of first bytes induces the order of all L suffixes and one pass down that
of all S suffixes. A bucket's queue holds the suffixes already induced into it; as a bucket is popped only after all
smaller (or larger) ones, the 257 queues together are the priority queue of external induced sorting, and spill to a
temporary file beyond a memory limit. A popped batch is processed at once: its predecessors are looked up, and dealt
to their own buckets in order.

The LMS suffixes themselves are put in order by the same two passes over LMS substrings, which are then named; the
string of names is ranked by doubling over the groups of equal names, to a depth that covers `depth` bytes. Suffixes
equal to that depth come in any order.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

SEGMENT = 1 << 20


class BucketQueues:
    """First-in first-out queues of suffix positions, one per byte value; the oldest parts go to disk beyond `memory` bytes."""

    def __init__(self, memory: int, folder: str | None = None):
        self.memory, self.held, self.file = memory, 0, None
        self.folder = folder
        self.parts: list[list[np.ndarray | tuple[int, int]]] = [[] for _ in range(257)]

    def push(self, bucket: int, positions: np.ndarray) -> None:
        if len(positions):
            self.parts[bucket].append(positions)
            self.held += positions.nbytes
            if self.held > self.memory:
                self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=self.folder)
        self.file.seek(0, os.SEEK_END)
        for parts in self.parts:
            for k, p in enumerate(parts):
                if isinstance(p, np.ndarray):
                    parts[k] = (self.file.tell(), len(p))
                    self.file.write(p.astype(np.int64, copy=False).tobytes())
        self.held = 0

    def pop(self, bucket: int) -> Iterator[np.ndarray]:
        """The bucket's positions in segments; what is pushed to it meanwhile comes last."""
        parts, at = self.parts[bucket], 0
        while at < len(parts):
            run, size = [], 0
            while at < len(parts) and size < SEGMENT:
                p = parts[at]
                if not isinstance(p, np.ndarray):
                    self.file.seek(p[0])
                    p = np.frombuffer(self.file.read(8 * p[1]), np.int64)
                else:
                    self.held -= p.nbytes
                parts[at] = np.zeros(0, np.int64)
                run.append(p)
                size += len(p)
                at += 1
            if size:
                yield run[0] if len(run) == 1 else np.concatenate(run)
        parts.clear()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is of S type; the end counts as smaller than all bytes."""
    n = len(text)
    up = np.zeros(n, np.int8)
    up[:-1] = (text[1:] > text[:-1]).astype(np.int8) - (text[1:] < text[:-1]).astype(np.int8)
    up[-1] = -1
    at = np.where(up != 0, np.arange(n), n - 1)
    return up[np.minimum.accumulate(at[::-1])[::-1]] > 0


def deal(queues: BucketQueues, text: np.ndarray, positions: np.ndarray) -> None:
    """Push positions to the queues of their bytes, in order."""
    keys = text[positions]
    order = np.argsort(keys, kind="stable")
    keys, positions = keys[order], positions[order]
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    for k, part in zip(keys[np.concatenate([[0], cut])].tolist() if len(keys) else [], np.split(positions, cut), strict=False):
        queues.push(k, part)


def induce(text: np.ndarray, s_type: np.ndarray, seeds: np.ndarray, memory: int) -> np.ndarray:
    """The order of all suffixes, induced from the LMS suffixes in the order of `seeds`."""
    n = len(text)
    seed_starts = np.searchsorted(text[seeds], np.arange(257))
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    queues = BucketQueues(memory)
    queues.push(int(text[n - 1]), np.array([n - 1], seeds.dtype))
    for c in range(256):
        for batch in queues.pop(c):
            larger[c].append(batch)
            before = batch[batch > 0] - 1
            deal(queues, text, before[~s_type[before]])
        own = seeds[seed_starts[c] : seed_starts[c + 1]]
        deal(queues, text, own[own > 0] - 1)  # the predecessor of an LMS suffix is of L type
    queues.close()
    out = np.empty(n, seeds.dtype)
    end, queues = n, BucketQueues(memory)
    for c in range(255, -1, -1):
        for batch in queues.pop(c):
            out[end - len(batch) : end] = batch[::-1]
            end -= len(batch)
            before = batch[batch > 0] - 1
            deal(queues, text, before[s_type[before]])
        for batch in reversed(larger[c]):
            out[end - len(batch) : end] = batch
            end -= len(batch)
            before = batch[::-1]
            before = before[before > 0] - 1
            deal(queues, text, before[s_type[before]])
        larger[c] = []
    queues.close()
    return out


def names(text: np.ndarray, ordered: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For LMS substrings in order, with their lengths, the number of different ones up to each (from 0)."""
    same = length[1:] == length[:-1]
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        live = live[length[live] > k]
        if len(live):
            ok = text[ordered[live] + k] == text[ordered[live + 1] + k]
            same[live[~ok]] = False
            live = live[ok]
        k += 1
    return np.concatenate([[0], np.cumsum(~same)]).astype(ordered.dtype)


def rank_by_doubling(name: np.ndarray, rounds: int) -> np.ndarray:
    """The order of the suffixes of a string of names, to 2**rounds names; only groups of equal rank are sorted again."""
    m = len(name)
    order = np.argsort(name, kind="stable")
    rank = np.empty(m, np.int64)
    sorted_names = name[order]
    new = np.concatenate([[True], sorted_names[1:] != sorted_names[:-1]])
    first = np.flatnonzero(new)
    rank[order] = first[np.cumsum(new) - 1]  # a group's rank is its first place
    h = 1
    for _ in range(rounds):
        places = np.flatnonzero(~(new & np.append(new[1:], True)))  # in groups of two or more
        if not len(places):
            break
        items = order[places]
        ahead = np.where(items + h < m, rank[np.minimum(items + h, m - 1)] + 1, 0)
        own = rank[items]
        again = np.lexsort((ahead, own))
        items, own, ahead = items[again], own[again], ahead[again]
        order[places] = items
        fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (ahead[1:] != ahead[:-1])])
        new[places] = fresh
        start = places[np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))]
        rank[items] = start
        h *= 2
    return order


def suffix_order(text: np.ndarray, depth: int = 400, memory: int = 256 << 20) -> np.ndarray:
    """The suffixes of a byte array in order, as far as their first `depth` bytes tell them apart."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    s_type = types(text)
    kind = np.int32 if n < 2**31 else np.int64
    lms = (np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1).astype(kind)
    if not len(lms):
        return induce(text, s_type, lms, memory)
    seeds = lms[np.argsort(text[lms], kind="stable")]
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = induce(text, s_type, seeds, memory)
    ordered = order[is_lms[order]]
    del order
    length = np.empty(n, kind)
    length[lms] = np.append(lms[1:], n - 1) - lms + 1
    name = names(text, ordered, length[ordered])
    if name[-1] + 1 < len(lms):
        at = np.empty(n, kind)
        at[ordered] = name
        rounds = max(1, int(np.ceil(np.log2(depth / 2 + 2))))
        ordered = lms[rank_by_doubling(at[lms], rounds)]
    return induce(text, s_type, ordered, memory)


def repeated_starts(text: np.ndarray, valid: np.ndarray, span: int, memory: int = 256 << 20) -> np.ndarray:
    """True at each valid start whose next `span` bytes also begin at another valid start.

    Neighbours in suffix order are compared eight bytes at a time, only as far as they agree; neighbours that agree
    over the span belong to one run of equal strings.
    """
    out = np.zeros(len(text), bool)
    order = suffix_order(text, span, memory)
    order = order[valid[order]]
    if len(order) < 2:
        return out
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.ndarray(shape=(len(text),), dtype="<u8", buffer=padded, strides=(1,))
    a, b = order[:-1], order[1:]
    live = np.arange(len(a))
    for k in [*range(0, span - 7, 8), *([span - 8] if span % 8 else [])]:
        live = live[eight[a[live] + k] == eight[b[live] + k]]
        if not len(live):
            break
    out[a[live]] = True
    out[b[live]] = True
    return out
