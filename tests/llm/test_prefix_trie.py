"""The prefix trie against a plain one, rollups of built forests, and odd tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgrid.llm import prefix_trie as T
from veilgrid.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, node binary, comp string, place long"


def plain(rows, family=5, most=8):
    """The result's rows by the definition, from (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        built[c] = own.get(c - c % family, [])[:h] + turns[h:]
    members = {}
    keys = {}  # a prefix, as its parent's number and its last turn
    paths = {}
    for c, turns in built.items():
        at, path = 0, [0]
        for t in turns:
            at = keys.setdefault((at, t), len(keys) + 1)
            path.append(at)
        paths[c] = path
        for n in path:
            members.setdefault(n, []).append(c)
    up = {n: p for (p, _), n in keys.items()}
    size = {n: len(t[1].encode()) for (_, t), n in keys.items()}
    depth = {n: d for path in paths.values() for d, n in enumerate(path)}
    children = {}
    for n, p in up.items():
        children.setdefault(p, []).append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=lambda n: -depth[n]):
        kids = children.get(n, [])
        leaves[n] = sum(leaves[k] for k in kids) if kids else 1
        saved[n] = (len(members[n]) - 1) * size.get(n, 0) + sum(saved[k] for k in kids)
    ends = {}
    for c, path in paths.items():
        ends.setdefault(path[-1], []).append(c)
    sha = lambda n: hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()
    return sorted((min(ms), depth[n], min(members[up[n]]) if n in up else -1, len(ms), len(children.get(n, [])), leaves[n], saved[n], sha(n)) for n, ms in members.items())


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def got(df):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, None, "x", 7) for r in rows], SCHEMA)


def mixed(rng):
    """Copies, shared heads, a long conversation, families without a first member, ids of several lengths."""
    rows = []
    for c in [*range(60), 1000, 1001, 5004, 123456789]:
        words = ["a", "b"] if c % 7 else ["a", "b", "c", f"own {c}", "é"]
        rows += [(c, t, rng.choice(["user", "assistant"]) if c % 3 else "user", rng.choice(words)) for t in range(rng.randrange(1, 14))]
    rows += [(77, t, "user", f"turn {t}") for t in range(900)] + [(78, t, "user", f"turn {t}") for t in range(700)]
    rng.shuffle(rows)
    return rows


def test_op12(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op12_centroid_trie"](spark, sf_dir)) == plain(rows)


@pytest.mark.parametrize("small,segment", [(T.SMALL, 16), (700, T.SEGMENT)])
def test_trie_by_definition(spark, monkeypatch, small, segment):
    """Also with rounds in Spark, and running sums in several segments."""
    monkeypatch.setattr(T, "SEGMENT", segment)
    rows = mixed(random.Random(2))
    assert got(T.conversation_trie(table(spark, rows), small=small)) == plain(rows)


def test_places_of_a_key_in_many_ranges(spark):
    rows = spark.range(5000).select(F.lit("k").alias("k"), (F.col("id") % 997).alias("a"), "id").repartition(7)
    out = T.with_places(rows, "k", "a", "id").orderBy("place").collect()
    assert [r.place for r in out] == list(range(1, 5001)) and [(r.a, r.id) for r in out] == sorted((r.a, r.id) for r in out)


@pytest.mark.parametrize("shape", ["chain", "star", "random", "broom"])
def test_decomposition(shape):
    rng = np.random.default_rng(4)
    n = 2000
    parent = {
        "chain": np.arange(-1, n - 1),
        "star": np.concatenate([[-1], np.zeros(n - 1, int)]),
        "random": np.array([-1 if k % 400 == 0 else rng.integers(k - k % 400, k) for k in range(n)]),
        "broom": np.concatenate([np.arange(-1, n // 2 - 1), np.full(n // 2, n // 2 - 1)]),
    }[shape]
    own = rng.integers(1, 50, n)
    values = rng.integers(-5, 100, (n, 2))
    weight, sums = own.copy(), values.copy()
    for k in range(n - 1, -1, -1):
        if parent[k] >= 0:
            weight[parent[k]] += weight[k]
            sums[parent[k]] += sums[k]
    shuffle = rng.permutation(n)  # place k goes to shuffle[k]
    moved = np.empty(n, int)
    moved[shuffle] = np.where(parent < 0, -1, shuffle[parent])
    back = np.argsort(shuffle)
    assert (T.decompose(moved, weight[back], values[back]) == sums[back]).all()


def test_hashes_of_many_members(spark, monkeypatch):
    monkeypatch.setattr(T, "JOINED", 50)
    ends = spark.range(3000).select(F.lit(b"n").alias("node"), (F.col("id") * 7).alias("conv")).union(spark.range(2).select(F.lit(b"m"), "id"))
    want = {b"n": ",".join(str(7 * k) for k in range(3000)), b"m": "0,1"}
    assert {bytes(r.node): r.ends_sha256 for r in T.member_hashes(ends.repartition(5)).collect()} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


def test_odd_tables(spark):
    rows = [
        (None, 1, "user", "left out"),
        (5, None, None, None),
        (5, None, None, None),
        (5, 3, "user", None),
        (5, 3, "assistant", ""),
        (6, 1, "user", "x" * 100_000),
        (6, 1, "user", "x" * 100_000),
        (7, -4, "", "é"),
        (10, 2, "a:1", "b"),
        (11, 2, "a", ":1b"),
        (9223372036854775807, 1, "user", "last"),
    ]
    assert got(T.conversation_trie(table(spark, rows))) == plain(rows)
    assert got(T.conversation_trie(table(spark, rows[:1]))) == []
    assert got(T.conversation_trie(table(spark, []))) == []
