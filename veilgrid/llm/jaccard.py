"""Exact n-gram Jaccard join by T-occurrence search with DivideSkip.

A document is its set of distinct k-word shingles, as hashes. Documents with equal sets are one node.

1. Filter. A node keeps a sketch, the smallest hashes of its set. Two linked sets share at least T of their sketch
   tokens (T from the sizes alone), so a node with fewer than T sketch tokens that any other node has links with
   nothing and leaves.
2. Short lists. The tokens that remain are inverted lists over nodes. A node has L of them; linked nodes meet in T, so
   its T - 1 longest lists can be skipped and two linked nodes still meet in one of the shorter ones. Nodes that meet
   in a short list are in one block (connected components over the lists, in Spark; no pairs are made).
3. Search. In a block, each node is a query against the index of its inverted lists: lists are split into short and
   long; the short ones are merged by a heap that skips ahead; nodes that reach the occurrences needed are completed
   by binary probes of the long lists, up to the exact overlap. Pairs already connected needn't be looked at again.
   Large blocks are split into chunks of nodes, and pairs of chunks are searched in tasks of their own.
4. The links found are contracted to components.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, in_batches, staged, texts_of
from .components import connected_components
from .words import blocks, mix, shingle_hashes

#: A share of the set beyond what linked sets may differ in, by which sketches are longer.
EXTRA = 10
SALT = np.uint64(0x1F3D5B79)
#: Up to so many entries are merged by the heap.
HEAPED = 64


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set of n with any set it links with: ceil(percent % of n)."""
    return -(-n * percent // 100)


def sketch_size(n: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(n, n - need(n, percent) + np.maximum(1, n // EXTRA))


def shared_tokens(n: str, percent: int) -> str:
    """SQL for T: the sketch tokens that a set of n has in common with any set it links with, at least."""
    return f"greatest(1, floor(ceil({n} * {percent} / 100.0) / {EXTRA}))"


def shingled(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, tk, n, digest, sketch) of docs (id, tk, text): set size, 128-bit hash of the set, 32 bits of each sketch token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in blocks(texts_of(batch)):
                h, at, other = shingle_hashes(part, k)
                n = np.diff(at)
                # Two sums, over independent hashes of the shingles, stand for the set.
                some = np.flatnonzero(n)
                d = np.zeros((len(part), 2), np.uint64)
                if len(h):
                    for j, x in enumerate((h, other)):
                        d[some, j] = mix(np.add.reduceat(mix(x ^ SALT), at[some]) + n[some].astype(np.uint64))
                size = sketch_size(n, percent)
                take = np.repeat(at[:-1], size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
                tokens = (mix(h[take]) >> np.uint64(32)).astype(np.uint32).view(np.int32) if len(h) else np.zeros(0, np.int32)
                sketch = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(tokens))
                rows = batch.slice(first, len(part))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n), pa.array([x.tobytes() for x in d], pa.binary()), sketch], ["id", "tk", "n", "digest", "sketch"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "tk", "text").mapInArrow(run, f"id {kind}, tk long, n long, digest binary, sketch array<int>")


def candidate_blocks(nodes: DataFrame, percent: int) -> DataFrame:
    """(node, block): nodes that may link with another, and the block of each. nodes: (node, n, sketch)."""
    tokens = nodes.select("node", "n", F.explode("sketch").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c >= 2")
    # Hints: the same plan at every size; a broadcast of what grows with the corpus is no plan.
    lists = staged(tokens.join(often.hint("merge"), "token").select("node", "n", "token", "c"))
    needed = F.expr(shared_tokens("n", percent))
    enough = lists.groupBy("node").agg(F.count(F.lit(1)).alias("l"), F.first("n").alias("n")).where(F.col("l") >= needed)
    order = Window.partitionBy("node").orderBy("c", "token")
    short = lists.join(enough.select("node", "l").hint("merge"), "node").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("l") - needed + 1)
    short = staged(short.select("node", "token").distinct())
    hubs = short.groupBy("token").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("c")).where("c >= 2").select("token", "hub")
    edges = short.join(hubs.hint("merge"), "token").select(F.col("hub").alias("u"), F.col("node").alias("v")).where("u <> v").distinct()
    return connected_components(edges).select("node", F.col("component").alias("block"))


def heap_merge(lists: list[np.ndarray], least: int) -> Iterator[tuple[int, int]]:
    """(member, count) of the members of `least` sorted lists or more: a heap of the lists' heads, popped in order of members.

    When fewer than `least` lists have the head, least - 1 of them are popped and all of those skip ahead, by a binary
    search, to the next head: what lies between can't be in enough lists.
    """
    heap = [(int(x[0]), k, 0) for k, x in enumerate(lists) if len(x)]
    heapq.heapify(heap)
    while len(heap) >= least:
        member = heap[0][0]
        popped = []
        while heap and heap[0][0] == member:
            popped.append(heapq.heappop(heap))
        ahead = member + 1
        if len(popped) >= least:
            yield member, len(popped)
        else:
            while len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            ahead = heap[0][0]
        for _, k, at in popped:
            x = lists[k]
            at += int(np.searchsorted(x[at:], ahead))
            if at < len(x):
                heapq.heappush(heap, (int(x[at]), k, at))


def merged_members(lists: list[np.ndarray], least: int) -> Iterator[tuple[int, int]]:
    """heap_merge, with the work of many entries done by counting in numpy: the same members and counts in the same order."""
    if sum(map(len, lists)) <= HEAPED:
        yield from heap_merge(lists, least)
        return
    count = np.bincount(np.concatenate(lists))
    found = np.flatnonzero(count >= least)
    yield from zip(found.tolist(), count[found].tolist(), strict=True)


class Groups:
    """Components of places as an array of labels; the smaller of two that are joined takes the other's label."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members: dict[int, list[int]] = {}

    def join(self, a: int, b: int) -> None:
        a, b = int(self.label[a]), int(self.label[b])
        own, other = self.members.pop(a, [a]), self.members.pop(b, [b])
        if len(own) < len(other):
            a, own, other = b, other, own
        self.label[other] = a
        own += other
        self.members[a] = own


def linked_sets(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    where = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[where] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def divide_skip(sets: list[np.ndarray], queries: np.ndarray, indexed: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect all linked pairs of a query and an indexed set (positions in `sets`, which are sorted arrays).

    Each unordered pair is looked at from its larger set (of equal ones, the later), so the overlap needed is known
    from the query: T = ceil(percent % of its size). Of a query's lists, T - 1 at most are long and are left out of
    the merge; a set must then occur in T - long of the short ones. How many are long follows from the lengths: the
    cheapest sum of merging and probing. Few entries are merged by the heap, many by counting;
    after each link, sets that are connected with the query by now leave the lists.
    """
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    # Sets by size, so that a query's smaller sets are a prefix of every list.
    place = np.empty(n, np.int64)
    by_size = np.lexsort((np.arange(n), size))
    place[by_size] = np.arange(n)
    flat = np.concatenate([sets[k] for k in indexed])
    owner = np.repeat(place[indexed], size[indexed])
    order = np.lexsort((owner, flat))
    flat, owner = flat[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    token, start = flat[start], np.append(start, len(flat))
    least_size = np.searchsorted(size[by_size] * 100, percent * size)  # the first place whose set is large enough
    groups, links = Groups(n), []
    for q in queries.tolist():
        a, here = sets[q], int(place[q])
        at = np.minimum(np.searchsorted(token, a), len(token) - 1)
        known = token[at] == a
        at = at[known]
        t = int(need(size[q], percent))
        if len(at) < t:
            continue
        length = start[at + 1] - start[at]
        by = np.argsort(length, kind="stable")
        low, label = int(least_size[q]), groups.label
        # The nearest sets in a few lists are tried first: among copies one link connects all, and nothing is left to merge.
        shared = by[np.searchsorted(length[by], 2) :]
        for k in at[shared[[0, len(shared) // 4, len(shared) // 2, -1]]].tolist() if len(shared) else ():
            x = owner[start[k] : start[k + 1]]
            p = int(np.searchsorted(x, here)) - 1
            if p >= 0 and x[p] >= low and label[x[p]] != label[here] and linked_sets(a, sets[int(by_size[x[p]])], percent):
                links.append((q, int(by_size[x[p]])))
                groups.join(int(x[p]), here)
        if (label[low:here] == label[here]).all():
            continue
        lengths = np.cumsum(length[by])
        # With `long` lists left out: merge the others, then probe the sets that may still be reached.
        long = np.arange(0, min(t, len(at)))
        merged = lengths[len(at) - 1 - long]
        reached = np.minimum(merged // (t - long), len(indexed))
        m = int(long[np.argmin(merged + reached * (20 + 4 * long))])
        merge, probe = by[: len(at) - m], by[len(at) - m :]
        # Only sets that are large enough, come before the query, and aren't connected with it yet.
        lo, span = start[at[merge]], length[merge]
        ends = np.cumsum(span)
        entries = owner[np.repeat(lo - ends + span, span) + np.arange(int(ends[-1]))] if len(span) else np.zeros(0, np.int64)
        stay = (entries >= low) & (entries < here)
        stay &= label[entries] != label[here]
        cuts = np.concatenate([[0], np.cumsum(stay)])[np.concatenate([[0], ends])]
        entries = entries[stay]
        if len(entries) < t - m:
            continue
        lists = [entries[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if j > i]
        probes = a[known][probe]
        while True:
            linked = None
            for p, count in merged_members(lists, t - m):
                b = sets[int(by_size[p])]
                where = np.minimum(np.searchsorted(b, probes), len(b) - 1)
                both = count + int((b[where] == probes).sum())
                if 100 * both >= percent * (int(size[q]) + len(b) - both):
                    linked = p
                    break
            if linked is None:
                break
            links.append((q, int(by_size[linked])))
            groups.join(linked, here)
            lists = [x[(x > linked) & (label[x] != label[here])] for x in lists]
    return links


def search_blocks(sets: DataFrame, percent: int, gather: int = 4096) -> DataFrame:
    """(u, v): links among sets (task, ci, cj, chunk, node, tokens), each task searched for pairs of its chunks ci and cj."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        tokens = [np.frombuffer(r[2], np.uint64) for r in rows]
        links: list[tuple[int, int]] = []
        if len(rows) > 1:
            every = np.arange(len(rows))
            role = np.array([r[3] for r in rows])
            if (role == 0).all():
                links = divide_skip(tokens, every, every, percent)
            else:  # two chunks of one block: pairs across, from either side
                one, two = every[role == 1], every[role == 2]
                if len(one) and len(two):
                    links = divide_skip(tokens, one, two, percent) + divide_skip(tokens, two, one, percent)
        u, v = zip(*((rows[a][1], rows[b][1]) for a, b in links), strict=True) if links else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("task", "node", "tokens", "role")), strict=True):
                if held and row[0] != held[-1][0] and (len(held) >= gather or row[3] or held[-1][3]):
                    yield solve(held)
                    held = []
                if held and row[1] == held[-1][1]:
                    continue  # rows repeated in full bring a set again
                held.append(row)
        if held:
            yield solve(held)

    return sets.repartition("task").sortWithinPartitions("task", "node").select("task", "node", "tokens", "role").mapInArrow(run, "u long, v long")


def tokens_of(docs: DataFrame, k: int) -> DataFrame:
    """(node, block, tokens binary) of docs (node, block, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in blocks(texts_of(batch)):
                h, at, _ = shingle_hashes(part, k)
                rows = batch.slice(first, len(part))
                yield pa.RecordBatch.from_arrays([rows.column("node"), rows.column("block"), pa.array([h[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())], ["node", "block", "tokens"])

    return docs.select("node", "block", "text").mapInArrow(run, "node long, block long, tokens binary")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, chunk: int = 4096) -> DataFrame:
    """One row per row of docs: id, tk (hash of the text), n_shingles, component_id, component (null for an empty set).

    Two documents link when 100 * |A & B| >= percent * |A | B| over their sets of distinct k-word shingles (with fewer
    words, the whole sequence is one; percent is over 50). component_id is the smallest id reachable by links, its own
    included; null only where no document of the component has an id. A document without words (a null text too) has
    an empty set and links with nothing. Repeated rows and equal texts are linked. Texts of any length count whole.
    Empty tables give empty results; other columns aren't used, so their names can't clash.
    """
    base = in_batches(docs).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("text"))
    every = staged(shingled(base, k, percent))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tk")).alias("one")
    classes = every.where("n > 0").groupBy("digest", "n").agg(first, F.first("sketch").alias("sketch"))
    nodes = staged(classes.select(F.monotonically_increasing_id().alias("node"), "digest", "n", "one", "sketch"))
    spread = staged(candidate_blocks(nodes.select("node", "n", "sketch"), percent).join(nodes.select("node", "one"), "node"))
    wanted = spread.select("node", "block", F.col("one.id").alias("_vg_i"), F.col("one.tk").alias("_vg_t"))
    texts = base.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("_vg_i")) & (F.col("tk") == F.col("_vg_t")))
    sets = tokens_of(texts, k)
    chunks = spread.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    c = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least("c", o).alias("ci"), F.greatest("c", o).alias("cj")))
    tasks = sets.join(chunks, "block").withColumn("c", c).withColumn("p", F.explode(pairs))
    role = F.when(F.col("p.ci") == F.col("p.cj"), 0).when(F.col("c") == F.col("p.ci"), 1).otherwise(2)
    links = search_blocks(tasks.select(F.struct("block", "p.ci", "p.cj").alias("task"), "node", "tokens", role.alias("role")), percent)
    found = staged(connected_components(links))
    roots = nodes.select("node", "digest", "n", "one.id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = roots.groupBy("component").agg(F.min("id").alias("component_id"))
    named = staged(roots.join(least, "component").select(F.col("digest").alias("_vg_d"), F.col("n").alias("_vg_n"), "component_id", "component"))
    out = every.join(named.hint("merge"), (F.col("digest") == F.col("_vg_d")) & (F.col("n") == F.col("_vg_n")), "left")
    return out.select("id", "tk", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay if one document of each component does: the one with the smallest id (null last), then text hash.

    Documents without words are in no component and all stay, but rows repeated in full are one.
    """
    found = staged(similar_documents(docs, id_col, text_col, k, percent))
    linked = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tk")).alias("one")).select("one.id", "one.tk")
    stay = linked.unionByName(found.where("component IS NULL").select("id", "tk").distinct())
    copies = found.groupBy("id", "tk").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select(F.col("id").alias("i2"), F.col("tk").alias("t2"), F.lit(True).alias("again"))
    marked = staged(stay.join(copies, F.col("id").eqNullSafe(F.col("i2")) & (F.col("tk") == F.col("t2")), "left").select(F.col("id").alias("_vg_i"), F.col("tk").alias("_vg_t"), F.coalesce("again", F.lit(False)).alias("_vg_again")))
    rows = docs.withColumn("_vg_k", F.xxhash64(text_col)).join(marked, F.col(id_col).eqNullSafe(F.col("_vg_i")) & (F.col("_vg_k") == F.col("_vg_t")))
    once, again = rows.where("NOT _vg_again"), rows.where("_vg_again").dropDuplicates([id_col, "_vg_k"])
    return once.unionByName(again).select(*docs.columns)


def op10_divide_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component at a Jaccard similarity of 0.8."""
    out = similar_documents(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
