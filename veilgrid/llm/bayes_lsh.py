"""Near duplicates by MinHash with sequential Bayesian verification.

A document is its set of distinct k-word shingles; documents with equal sets are one node.

1. Candidates. A node has a MinHash signature, cut into bands. Nodes with an equal band are candidates of each other. No
   pairs are made of them: each is linked with the least node of its band, and the connected components over those
   links are the blocks that are searched.
2. Verification. In a block, the candidates of a node are compared batch by batch of their signatures. With m of n
   positions equal and a uniform prior, their similarity has the posterior Beta(m + 1, n - m + 1); a candidate leaves as
   soon as the posterior gives the similarity asked for less than the miss probability. The survivors are compared in
   full, over both sets. Pairs that are connected by then needn't be looked at.
3. Large blocks are split into chunks, and pairs of chunks are searched in tasks of their own. The links found are
   contracted to components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, in_batches, staged, texts_of
from .components import connected_components
from .jaccard import Groups, linked_sets, need, tokens_of
from .words import blocks, mix, set_digests, shingle_hashes

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Signature positions that are compared at once.
BATCH = 16
#: A pair as similar as asked for may be pruned with this posterior probability.
MISS = 1e-9
FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
#: Nodes and shingles of a chunk.
CHUNK_NODES, CHUNK_SHINGLES = 4096, 1 << 22


def least_matches(percent: int, miss: float = MISS, hashes: int = HASHES, batch: int = BATCH) -> list[int]:
    """After each batch, the least number of equal positions with which P(similarity >= percent % | positions) is `miss` or more.

    For whole numbers that probability is a binomial one: P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m).
    """
    t, out = percent / 100, []
    for n in range(batch, hashes + 1, batch):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(sets, HASHES) the least value of each hash function over each set of 64-bit hashes, its upper 32 bits; 0 for empty sets."""
    out = np.zeros((len(at) - 1, HASHES), np.uint32)
    some = np.flatnonzero(np.diff(at))
    product = np.empty_like(h)
    for j in range(HASHES if len(some) else 0):
        np.multiply(h, FACTORS[j], out=product)
        out[some, j] = np.minimum.reduceat(product, at[some]) >> np.uint64(32)
    return out


def band_keys(signed: np.ndarray) -> np.ndarray:
    """(sets, BANDS) 64-bit keys, equal where a band's rows are."""
    rows = signed.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(1)), rows.shape[:2])
    for r in range(ROWS):
        key = mix(key ^ rows[:, :, r]) + np.uint64(r)
    return key


def signed_documents(docs: DataFrame, k: int) -> DataFrame:
    """(id, tk, n, digest, signature) of docs (id, tk, text): set size, 128-bit hash of the set, signature of a set with members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in blocks(texts_of(batch)):
                h, at, other = shingle_hashes(part, k)
                n = np.diff(at)
                signed = [s.tobytes() if c else None for s, c in zip(signatures(h, at), n, strict=True)]
                rows = batch.slice(first, len(part))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n), pa.array(set_digests(h, other, at), pa.binary()), pa.array(signed, pa.binary())], ["id", "tk", "n", "digest", "signature"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "tk", "text").mapInArrow(run, f"id {kind}, tk long, n long, digest binary, signature binary")


def as_signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def banded(nodes: DataFrame) -> DataFrame:
    """(key, node): each node (node, signature) under its bands' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(as_signatures(batch.column("signature")))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(batch.column("node").to_numpy(), BANDS))], ["key", "node"])

    return nodes.select("node", "signature").mapInArrow(run, "key long, node long")


def candidate_blocks(nodes: DataFrame) -> DataFrame:
    """(node, block) of the nodes that share a band with another one."""
    keys = banded(nodes)
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("c")).where("c >= 2").select("key", "hub")
    # A hint: the same plan at every size; a broadcast of what grows with the corpus is no plan.
    edges = keys.join(hubs.hint("merge"), "key").where("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    return connected_components(edges).select("node", F.col("component").alias("block"))


def verified_links(sets: list[np.ndarray], signed: np.ndarray, role: np.ndarray, percent: int, least: list[int]) -> tuple[list[tuple[int, int]], dict[str, int]]:
    """Links that connect all linked candidates among sets (sorted arrays), and how many pairs were candidates, survived, and were linked.

    role: 0 for all, or 1 and 2 for two chunks, of which only pairs across are looked at. A set's candidates are those
    of the same size or smaller, as large as a link needs, that have a band in common with it and aren't connected yet.
    """
    order = np.lexsort((np.arange(len(sets)), np.fromiter(map(len, sets), np.int64, len(sets))))
    size = np.fromiter((len(sets[k]) for k in order), np.int64, len(sets))
    signed, role = signed[order], role[order]
    keys = band_keys(signed)
    low = np.searchsorted(size, need(size, percent))
    groups, links = Groups(len(sets)), []
    seen = {"candidates": 0, "survivors": 0, "links": 0}
    for q in range(1, len(sets)):
        a = int(low[q])
        near = a + np.flatnonzero((groups.label[a:q] != groups.label[q]) & ((role[a:q] != role[q]) | (role[q] == 0)))
        near = near[(keys[near] == keys[q]).any(axis=1)]
        seen["candidates"] += len(near)
        equal = np.zeros(len(near), np.int64)
        for j, enough in enumerate(least):
            if not len(near):
                break
            span = slice(j * BATCH, (j + 1) * BATCH)
            equal += (signed[near, span] == signed[q, span]).sum(axis=1)
            stay = equal >= enough
            near, equal = near[stay], equal[stay]
        for v in near[np.argsort(-equal, kind="stable")].tolist():
            if groups.label[v] == groups.label[q]:
                continue
            seen["survivors"] += 1
            if linked_sets(sets[order[v]], sets[order[q]], percent):
                seen["links"] += 1
                links.append((int(order[v]), int(order[q])))
                groups.join(v, q)
    return links, seen


def search_blocks(sets: DataFrame, percent: int, miss: float) -> DataFrame:
    """(u, v): links among sets (task, node, tokens, signature, role); a task's sets are compared with each other."""
    least = least_matches(percent, miss)

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        tokens = [np.frombuffer(r[2], np.uint64) for r in rows]
        signed = np.frombuffer(b"".join(r[3] for r in rows), np.uint32).reshape(-1, HASHES)
        links, _ = verified_links(tokens, signed, np.array([r[4] for r in rows]), percent, least)
        u, v = zip(*((rows[a][1], rows[b][1]) for a, b in links), strict=True) if links else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("task", "node", "tokens", "signature", "role")), strict=True):
                if held and row[0] != held[-1][0]:
                    yield solve(held)
                    held = []
                if held and row[1] == held[-1][1]:
                    continue  # rows repeated in full bring a set again
                held.append(row)
        if held:
            yield solve(held)

    return sets.repartition("task").sortWithinPartitions("task", "node").select("task", "node", "tokens", "signature", "role").mapInArrow(run, "u long, v long")


def block_tasks(spread: DataFrame, nodes: int = CHUNK_NODES, shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """(node, task, role) of spread (node, block, n): a block whole, or each pair of its chunks, of so many nodes and shingles on average."""
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / nodes), F.ceil(F.sum("n") / shingles)).cast("int")
    chunks = spread.groupBy("block").agg(parts.alias("chunks"))
    c = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least("c", o).alias("ci"), F.greatest("c", o).alias("cj")))
    role = F.when(F.col("p.ci") == F.col("p.cj"), 0).when(F.col("c") == F.col("p.ci"), 1).otherwise(2)
    tasks = spread.join(chunks, "block").withColumn("c", c).withColumn("p", F.explode(pairs))
    return tasks.select("node", F.struct("block", "p.ci", "p.cj").alias("task"), role.alias("role"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, percent: int = 80, miss: float = MISS) -> DataFrame:
    """One row per row of docs: id, tk (hash of the text), n_shingles, component_id, component (null for an empty set).

    Two documents link when 100 * |A & B| >= percent * |A | B| over their sets of distinct k-word shingles (with fewer
    words, the whole sequence is one); links are confirmed on the full sets, and a pair can only be missed by its
    signature: in all bands (at 80 %, 5e-8), or by the posterior (`miss`). component_id is the smallest id reachable by
    links, its own included; null only where no document of the component has an id. A document without words (a null
    text too) has an empty set and links with nothing. Repeated rows and equal texts are linked. Texts of any length
    count whole. Empty tables give empty results; other columns aren't used, so their names can't clash.
    """
    base = in_batches(docs).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("text"))
    every = staged(signed_documents(base, k))
    classes = every.where("n > 0").groupBy("digest", "n").agg(F.min("id").alias("least"), F.min(F.struct("id", "tk")).alias("one"), F.first("signature").alias("signature"))
    nodes = staged(classes.select(F.monotonically_increasing_id().alias("node"), "digest", "n", "least", "one", "signature"))
    spread = staged(candidate_blocks(nodes).join(nodes.select("node", "n", "one", "signature").hint("merge"), "node"))
    wanted = spread.select("node", "block", F.col("one.id").alias("_vg_i"), F.col("one.tk").alias("_vg_t"))
    texts = base.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("_vg_i")) & (F.col("tk") == F.col("_vg_t")))
    sets = tokens_of(texts, k).select("node", "tokens")
    tasks = block_tasks(spread.select("node", "block", "n")).join(spread.select("node", "signature"), "node")
    links = search_blocks(sets.join(tasks.hint("merge"), "node"), percent, miss)
    return named(every, nodes, staged(connected_components(links)))


def named(every: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (id, tk, n, digest) with the least id of their component, by the components found (node, component) of nodes (node, digest, n, least)."""
    roots = nodes.select("node", "digest", "n", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = roots.groupBy("component").agg(F.min("least").alias("component_id"))
    named = staged(roots.join(least, "component").select(F.col("digest").alias("_vg_d"), F.col("n").alias("_vg_n"), "component_id", "component"))
    out = every.join(named.hint("merge"), (F.col("digest") == F.col("_vg_d")) & (F.col("n") == F.col("_vg_n")), "left")
    return out.select("id", "tk", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "component")


def op13_bayes_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component at a Jaccard similarity of 0.8 over pairs of words, and whether it stays."""
    out = near_duplicates(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
