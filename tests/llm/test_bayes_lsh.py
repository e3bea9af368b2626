"""Near duplicates by Bayesian verification against brute force, texts built to be near the limit, and odd tables."""

import math
import random
import re

import numpy as np
import pytest

from veilgrid.llm import bayes_lsh as L
from veilgrid.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, id long, tk string, component long, kept boolean"


def shingles(text, k=2):
    ws = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()


def brute(texts):
    """{id: (set size, component)} of {id: text}, by all pairs."""
    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (len(sets[d]), find(d)) for d in ids}


def found(df):
    return {r.id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_op13(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    want = brute(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op13_bayes_lsh"](spark, sf_dir).collect()}
    assert got == {d: (*w, w[1] == d) for d, w in want.items()}
    assert any(not kept for *_, kept in got.values())


def near_limit(rng, groups=40, most=12):
    """Groups of texts whose similarities lie around 0.8, and chains of them."""
    texts = []
    for g in range(groups):
        words = [f"w{g}x{rng.randrange(400)}" for _ in range(rng.choice([6, 30, 120, 400]))]
        for _ in range(rng.randrange(1, most)):
            words = list(words)
            for _ in range(rng.randrange(1 + len(words) // 9)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
            texts.append(" ".join(words))
    return dict(enumerate(texts))


@pytest.mark.parametrize("chunk", [L.CHUNK_NODES, 3])
def test_texts_near_the_limit(spark, monkeypatch, chunk):
    texts = near_limit(random.Random(5))
    whole = L.block_tasks
    monkeypatch.setattr(L, "block_tasks", lambda spread: whole(spread, nodes=chunk))
    assert found(L.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))) == brute(texts)


def test_a_passage_that_all_share(spark):
    """Texts that are all candidates of each other, of which few link."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(150)]
    texts = {d: " ".join(passage + [f"own{d // 2}x{i}" for i in range(90)] + [f"{d}"] * 3) for d in range(300)}
    texts[300] = " ".join(passage + [str(rng.random())])
    want = brute(texts)
    assert len({c for _, c in want.values()}) == 151
    assert found(L.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))) == want


def test_candidates_are_pruned_before_the_sets_are_compared():
    rng = np.random.default_rng(7)
    shared = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.sort(np.concatenate([shared, rng.integers(0, 2**63, 400).astype(np.uint64)])) for _ in range(120)]
    sets += [np.sort(np.concatenate([sets[0][:-20], rng.integers(0, 2**63, 20).astype(np.uint64)]))]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    links, seen = L.verified_links(sets, L.signatures(np.concatenate(sets), at), np.zeros(len(sets), int), 80, L.least_matches(80))
    assert {frozenset(x) for x in links} == {frozenset((0, 120))}
    assert seen["candidates"] > 500 and seen["survivors"] < 20


def test_least_matches_by_the_posterior():
    """Against the posterior's integral by the midpoint rule, under a uniform prior."""
    s = (np.arange(200_000) + 0.5) / 200_000
    for n, m in zip(range(16, 129, 16), L.least_matches(80, 1e-4), strict=True):
        for k in (m - 1, m):
            density = math.comb(n, k) * (n + 1) * s**k * (1 - s) ** (n - k)
            above = density[s >= 0.8].sum() / 200_000
            assert (above >= 1e-4) == (k >= m)


def test_odd_tables(spark):
    rows = [
        (1, None, 9, "x", 1, True),
        (2, "", 9, "x", None, None),
        (2, "", 9, "x", None, None),
        (3, " \t\n ", None, None, 1, True),
        (None, "the same words again and again", 1, "x", 1, True),
        (5, "The same words AGAIN and again", 1, "x", 1, True),
        (5, "The same words AGAIN and again", 1, "x", 1, True),
        (6, "one", 1, "x", 1, True),
        (4, "one", 1, "x", 1, True),
        (None, "alone here", 1, "x", 1, True),
        (7, "Ä ä", 1, "x", 1, True),
        (8, "ä ä", 1, "x", 1, True),
    ]
    got = L.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.id or 0, r.n_shingles, r.component_id or 0) for r in got)) == sorted([(1, 0, 1), (2, 0, 2), (2, 0, 2), (3, 0, 3), (0, 5, 5), (5, 5, 5), (5, 5, 5), (6, 1, 4), (4, 1, 4), (0, 1, 0), (7, 1, 7), (8, 1, 8)])
    assert L.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_megabyte_texts(spark):
    text = " ".join(f"w{i % 9973} v{i % 7919}" for i in range(150_000))
    rows = [(1, text), (2, text + " end"), (3, text[: len(text) // 2])]
    assert found(L.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(dict(rows))
