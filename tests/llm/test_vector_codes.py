"""Codes by LAESA pivots against plain loops, and on odd tables."""

import hashlib
import math

import numpy as np
import pytest

from veilgrid.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error long, near binary, id long"


def plain(rows, rounds=4, parts=4, entries=256):
    """{row: (code, error)} and the codebooks, by the definition; rows (vec_id, vector), in order of the first codebook."""
    kept = [[math.floor(1024 * x) for x in v] for _, v in rows]
    width = len(kept[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for k, g in groups.items():
                books[p][k] = [sum(col) // len(g) for col in zip(*g, strict=True)]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    return [("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for f in found], books


def test_nearest_entries_prune_and_keep_ties():
    rng = np.random.default_rng(1)
    centres = rng.integers(-900, 900, (40, 16))
    x = centres[rng.integers(0, 40, 3000)] + rng.integers(-20, 21, (3000, 16))
    book = np.concatenate([x[:200], x[:56]])  # repeated entries: the lower index wins
    pivots = V.choose_pivots(book)
    index, distance, computed = V.nearest_entries(x, V.pivot_distances(x, pivots), book, pivots)
    full = ((x[:, None, :] - book[None]) ** 2).sum(-1)
    assert (index == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert computed < full.size / 4


def test_pivots_bound_far_components():
    """Bounds hold where distances are large and rounding of the pivots' counts."""
    rng = np.random.default_rng(2)
    far = int(V.reach(4)) - 10
    x = np.concatenate([rng.integers(far - 5, far, (50, 4)), rng.integers(-far, -far + 5, (50, 4))])
    book = x[rng.permutation(100)[:30]]
    pivots = V.choose_pivots(book, 3)
    index, distance, _ = V.nearest_entries(x, V.pivot_distances(x, pivots), book, pivots)
    full = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e, strict=True)) for e in book] for r in x]
    assert index.tolist() == [f.index(min(f)) for f in full] and distance.tolist() == [min(f) for f in full]


def test_codes_by_definition(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), (rng.integers(0, 3, 8) / 7 - 0.1 + rng.normal(0, 0.01, 8)).tolist(), int(k % 3), None, None, None, 0) for k in rng.permutation(400)]
    table, books = V.fit_codes(spark.createDataFrame(rows, SCHEMA), entries=16)
    want, entries = plain([r[:2] for r in sorted(rows)], entries=16)
    got = sorted((r.id, r.code, r.error, r.label_error) for r in V.with_label_error(V.encode_vectors(table, books)).collect())
    assert [g[1:3] for g in got] == want and books.entries.tolist() == entries
    assert [g[3] for g in got] == [sum(e for (_, e), r in zip(want, sorted(rows), strict=True) if r[2] == k % 3) for k in range(400)]
    assert books.sha256 == hashlib.sha256(",".join(str(x) for b in entries for e in b for x in e).encode()).hexdigest()
    decoded = np.array(books.decode(got[0][1])) * 1024 - 0.5
    assert ((decoded - np.floor(np.array(sorted(rows)[0][1]) * 1024)) ** 2).sum() == pytest.approx(got[0][2])


def test_codes_on_odd_tables(spark):
    v = [0.5, -0.25, 0.0, 1.0]
    rows = [
        (1, None, 1, None, None, None, 1),
        (2, [1.0, None, 0.0, 0.0], 1, None, None, None, 1),
        (3, [1.0, float("nan"), 0.0, 0.0], 1, None, None, None, 1),
        (4, [1.0, float("inf"), 0.0, 0.0], None, None, None, None, 1),
        (5, v, None, "x", 1, b"", 1),
        (5, v, None, "x", 1, b"", 1),
        (None, [0.5, -0.25, 0.0, -1.0], None, "x", 1, b"", 1),
        (6, v, 2, None, None, None, None),
    ]
    table, books = V.fit_codes(spark.createDataFrame(rows, SCHEMA), entries=2)
    got = V.with_label_error(V.encode_vectors(table, books)).collect()
    # Both first entries are the vector of 5, and all go to the lower one; its mean moves off, and the next round parts them.
    assert sorted((r.id or 0, r.label or 0, r.code, r.error, r.label_error) for r in got) == [(0, 0, "00000000", 0, 0), (5, 0, "00000001", 0, 0), (5, 0, "00000001", 0, 0), (6, 2, "00000001", 0, 0)]


def test_codes_of_nothing(spark):
    table, books = V.fit_codes(spark.createDataFrame([(1, None, 1, None, None, None, 1)], SCHEMA))
    assert V.with_label_error(V.encode_vectors(table, books)).collect() == []
    assert books.sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("vectors,what", [([[1.0] * 4, [1.0] * 8], "components that the first has"), ([[1.0] * 6], "equal parts"), ([[1e30] * 4], "64 bits")])
def test_vectors_that_fail(spark, vectors, what):
    rows = spark.createDataFrame([(k, v, 1, None, None, None, 1) for k, v in enumerate(vectors)], SCHEMA)
    with pytest.raises(Exception, match=what):
        V.fit_codes(rows)
