"""The trie of conversation prefixes, and sums over its subtrees by centroid decomposition.

A node is a distinct sequence of first turns. Its key is a hash of the depth and of a running sum over the turns' hashes,
each taken with its place, so that no task needs a conversation whole: places come from a sort by ranges, and running
sums are made in segments.

Subtree sums. A node weighs its members, and a subtree the sum of its nodes' weights, which is known before any rollup:
the places that its members have left. A component's centroid is its deepest node with half of the weight or more. What
lies under it in the component (it included) is summed, and the sum is added along the path from the centroid to the
component's top. The centroid is then taken out: what was above it is one component, what was under each of its children
another, none over half of the weight. The path to the top is the prefix of any member of the centroid, so it is looked
up, not walked. Components that are small enough are decomposed the rest of the way in one task each, many at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_batches, staged

#: Places of a conversation whose running sums are made in one task.
SEGMENT = 4096
#: The weight of components that are decomposed in one task.
SMALL = 16_384
#: Characters of the joined ids that go together into a hash.
JOINED = 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()


def with_places(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with `place`, the rank from 1 within equal keys by the other columns, nulls first; ties in any order.

    Rows are sorted by ranges of key and order, so one key's rows may lie in several tasks; a range's part of a key
    starts after those of the ranges before it.
    """
    blocks = staged(rows.repartitionByRange(key, *order).withColumn("_vg_b", F.spark_partition_id()))
    by = [F.asc_nulls_first(c) for c in order]
    local = blocks.withColumn("place", F.row_number().over(Window.partitionBy(key, "_vg_b").orderBy(*by)).cast("long"))
    counts = blocks.groupBy(key, "_vg_b").agg(F.count(F.lit(1)).alias("_vg_n"))
    before = F.sum("_vg_n").over(Window.partitionBy(key).orderBy("_vg_b").rowsBetween(Window.unboundedPreceding, -1))
    # At most one key is cut between a range and the next: no more rows than ranges.
    starts = counts.withColumn("_vg_s", before).where("_vg_s IS NOT NULL").select(F.col(key).alias("_vg_k"), F.col("_vg_b").alias("_vg_c"), "_vg_s")
    found = local.join(starts, (F.col(key) == F.col("_vg_k")) & (F.col("_vg_b") == F.col("_vg_c")), "left")
    return found.withColumn("place", F.col("place") + F.coalesce("_vg_s", F.lit(0))).drop("_vg_b", "_vg_k", "_vg_c", "_vg_s")


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, digest, bytes): the turns of each conversation in order, with a hash of role and text and the text's UTF-8 bytes.

    Ordered by turn, null first, then role and text. Null roles and texts are empty; rows without a conversation are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    return with_places(rows, "conv", "turn", "role", "text").select("conv", "place", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


def sharing_heads(turns: DataFrame, family: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as their family's first one does: (conv, place, digest, bytes), and (conv, length).

    Conversation c takes the first h turns of conversation c - c % family (all if it has fewer, none if it doesn't
    exist), then its own after the first h; h is crc32 of c in decimal modulo most + 1.
    """
    counts = staged(turns.groupBy("conv").agg(F.max("place").alias("n")))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)).alias("h")
    convs = counts.select("conv", "n", h, (F.col("conv") - F.col("conv") % family).alias("base"))
    convs = convs.join(counts.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    head = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = staged(convs.select("conv", "base", "h", head.alias("head"), (head + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    heads = turns.where(F.col("place") <= most).withColumnRenamed("conv", "base")
    shared = convs.select("conv", "base", "h").join(heads, "base").where("place <= h").select("conv", "place", "digest", "bytes")
    own = turns.join(convs.select("conv", "h", "head"), "conv").where("place > h").select("conv", (F.col("place") - F.col("h") + F.col("head")).alias("place"), "digest", "bytes")
    return shared.unionByName(own), convs.select("conv", "length")


def key_of(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums]).cast("binary")))


def paths_of(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv, depth, node, parent, bytes, length): each conversation's nodes from the root on; parent is null for the root.

    turns: (conv, place, digest, bytes), places gapless from 1; lengths: (conv, length), also of conversations without turns.
    """
    a, b = F.xxhash64("place", "digest"), F.xxhash64("digest", "place")
    # 32 bits each, so that sums stay exact for two billion turns.
    words = [c for x in (a, b) for c in (x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32))]
    rows = turns.withColumn("seg", F.floor(F.col("place") / SEGMENT)).select("*", *[w.alias(f"w{k}") for k, w in enumerate(words)])
    running = Window.partitionBy("conv", "seg").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("conv", "seg").agg(*[F.sum(f"w{k}").alias(f"t{k}") for k in range(4)])
    before = Window.partitionBy("conv").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("conv", "seg", *[F.sum(f"t{k}").over(before).alias(f"b{k}") for k in range(4)]).where("seg > 0")
    summed = rows.select("*", *[F.sum(f"w{k}").over(running).alias(f"s{k}") for k in range(4)]).join(starts, ["conv", "seg"], "left")
    full = [F.col(f"s{k}") + F.coalesce(F.col(f"b{k}"), F.lit(0)) for k in range(4)]
    above = [s - F.col(f"w{k}") for k, s in enumerate(full)]
    nodes = summed.select("conv", F.col("place").alias("depth"), key_of(F.col("place"), full).alias("node"), key_of(F.col("place") - 1, above).alias("parent"), "bytes")
    root = key_of(F.lit(0), [F.lit(0)] * 4)
    roots = lengths.select("conv", F.lit(0).cast("long").alias("depth"), root.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("bytes"), "length")
    return nodes.join(lengths, "conv").unionByName(roots)


def nodes_of(paths: DataFrame) -> DataFrame:
    """(node, parent, conv, depth, n_convs, weight, leaf, saved): the distinct nodes, each with its smallest member.

    weight: the members of all nodes of the subtree, that is the places that the node's members have from it on.
    """
    nodes = paths.groupBy("node").agg(
        F.min("conv").alias("conv"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.count(F.lit(1)).alias("n_convs"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight"), F.first("bytes").alias("bytes"),
    )
    # All members end in a leaf, and only there.
    return nodes.select("node", "parent", "conv", "depth", "n_convs", "weight", (F.col("weight") == F.col("n_convs")).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))


def decompose(parent: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree sums of `values` (nodes, columns) in a forest, by centroid decomposition of all its trees at once.

    parent: the place of each node's parent, -1 for tops; weight: each subtree's, over nodes of positive weight.
    """
    n = len(parent)
    here = np.arange(n)
    weight, out = weight.copy(), np.zeros_like(values)
    top, alive = chased(np.where(parent < 0, here, parent)), np.ones(n, bool)
    while alive.any():
        heavy = np.flatnonzero(alive & (2 * weight >= weight[top]))
        heavy = heavy[np.lexsort((weight[heavy], top[heavy]))]
        centre = heavy[np.flatnonzero(np.diff(top[heavy], prepend=-1))]  # the lightest of the half's: the deepest
        is_centre = np.zeros(n, bool)
        is_centre[centre] = True
        # Pieces: what hangs together without the centroids.
        cut = ~alive | (top == here) | is_centre | is_centre[parent]
        piece = chased(np.where(cut, here, parent))
        total = np.zeros_like(values)
        np.add.at(total, piece[alive], values[alive])
        child = np.flatnonzero(alive & (piece == here) & (top != here) & ~is_centre)  # tops of pieces under a centroid
        under = np.zeros_like(values)
        under[centre] = values[centre]
        np.add.at(under, parent[child], total[child])
        out[centre] += under[centre]
        start = centre[centre != top[centre]]
        at = parent[start]
        while len(at):
            out[at] += under[start]
            weight[at] -= weight[start]
            on = at != top[start]
            at, start = parent[at[on]], start[on]
        alive[centre] = False
        top = piece
    return out


def chased(up: np.ndarray) -> np.ndarray:
    """For each place the end of its chain of pointers; ends point at themselves."""
    while True:
        further = up[up]
        if (further == up).all():
            return up
        up = further


def solve_small(components: DataFrame, gather: int = 20_000) -> DataFrame:
    """(node, leaf, saved): sums over the subtree within the component, of rows (comp, node, parent, depth, weight, leaf, saved)."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        place = {r[1]: k for k, r in enumerate(rows)}
        up = (place.get(r[2], -1) for r in rows)
        parent = np.array([k if k >= 0 and rows[k][0] == r[0] else -1 for k, r in zip(up, rows, strict=True)], np.int64)
        sums = decompose(parent, np.array([r[3] for r in rows], np.int64), np.array([r[4:] for r in rows], np.int64))
        return pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.binary()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["node", "leaf", "saved"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= gather and row[0] != held[-1][0]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    columns = components.select("comp", "node", "parent", "weight", "leaf", "saved")
    return columns.repartition("comp").sortWithinPartitions("comp").mapInArrow(run, "node binary, leaf long, saved long")


def subtree_sums(nodes: DataFrame, paths: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, leaf, saved): both summed over each node's subtree.

    nodes: (node, parent, conv, depth, weight, leaf, saved); paths: (conv, depth, node, parent), the nodes from the root
    to each one that a conversation has. Each round takes a centroid out of every component over `small` in weight.
    """
    rest = nodes.select("node", "parent", "conv", "depth", "weight", "leaf", "saved", F.lit(b"").alias("comp"))
    paths = paths.select(F.col("conv").alias("p_conv"), F.col("depth").alias("p_depth"), F.col("node").alias("p_node"), F.col("parent").alias("p_parent"))
    done, sums = [], []
    while True:
        large = staged(rest.groupBy("comp").agg(F.max("weight").alias("total"), F.min("depth").alias("top")).where(F.col("total") > small))
        if large.isEmpty():
            done.append(rest)
            break
        done.append(rest.join(large, "comp", "left_anti"))
        held = rest.join(large, "comp")
        least = F.min(F.struct("weight", "depth", "conv", "node")).alias("c")
        centres = held.where("2 * weight >= total").groupBy("comp").agg(F.first("top").alias("top"), least)
        centres = staged(centres.select("comp", "top", F.col("c.weight").alias("c_weight"), F.col("c.depth").alias("c_depth"), F.col("c.conv").alias("c_conv"), F.col("c.node").alias("c_node")))
        up = paths.join(centres, (F.col("p_conv") == F.col("c_conv")) & F.col("p_depth").between(F.col("top"), F.col("c_depth")))
        up = staged(up.select(F.col("p_node").alias("u_node"), F.col("comp").alias("u_comp"), F.when(F.col("p_depth") < F.col("c_depth"), F.col("c_weight")).otherwise(0).alias("u_weight")))
        # Under the centroid if the node's own path leads through it; the next node of that path is the new top.
        seen = held.join(centres.drop("top"), "comp").withColumn("c_next", F.when(F.col("depth") > F.col("c_depth"), F.col("c_depth") + 1))
        seen = seen.join(paths, (F.col("conv") == F.col("p_conv")) & (F.col("c_next") == F.col("p_depth")), "left")
        seen = seen.join(up.select("u_node", "u_weight"), F.col("node") == F.col("u_node"), "left")
        under, centre = F.coalesce(F.col("p_parent") == F.col("c_node"), F.lit(False)), F.col("node") == F.col("c_node")
        new = F.when(centre, None).when(under, F.col("p_node")).otherwise(F.col("comp"))
        weight = F.col("weight") - F.coalesce("u_weight", F.lit(0))
        step = staged(seen.select("node", "parent", "conv", "depth", weight.alias("weight"), "leaf", "saved", F.col("comp").alias("was"), new.alias("comp"), (under | centre).alias("counted")))
        totals = step.where("counted").groupBy("was").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
        sums.append(up.join(totals, F.col("u_comp") == F.col("was")).select(F.col("u_node").alias("node"), "leaf", "saved"))
        rest = step.where("comp IS NOT NULL").drop("was", "counted")
    sums.append(solve_small(reduce(DataFrame.unionByName, done)))
    return reduce(DataFrame.unionByName, sums).groupBy("node").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))


def joined_ids(ends: DataFrame) -> DataFrame:
    """(node, first, ids) of ends (node, conv): the ids of each node in order, joined by commas, in pieces of JOINED characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, size, out = None, [], 0, []
        for batch in batches:
            for key, conv in zip(batch.column("node").to_pylist(), batch.column("conv").to_pylist(), strict=True):
                if ids and (key != node or size > JOINED):
                    out.append((node, ids[0], ",".join(map(str, ids))))
                    ids, size = [], 0
                node = key
                ids.append(conv)
                size += len(str(conv)) + 1
            if len(out) > 1000 or sum(len(o[2]) for o in out) > JOINED * 16:
                yield as_batch(out)
                out = []
        if ids:
            out.append((node, ids[0], ",".join(map(str, ids))))
        yield as_batch(out)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["node", "first", "ids"])

    return ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(run, "node binary, first long, ids string")


def member_hashes(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of ends (node, conv): SHA-256 of the node's ids in decimal, ascending, joined by commas.

    A hash is taken in one pass, so a node's ids must meet in a task; they come as joined pieces, and are hashed as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key == node:
                    state.update(b",")
                else:
                    done += [(node, state.hexdigest())] if state else []
                    node, state = key, hashlib.sha256()
                state.update(ids.encode())
            yield as_batch(done)
        yield as_batch([(node, state.hexdigest())] if state else [])

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["node", "ends_sha256"])

    return joined_ids(ends).repartition("node").sortWithinPartitions("node", "first").mapInArrow(run, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row per node.

    turns and lengths as in paths_of. conv_id is the smallest member; n_leaves and saved_tokens, (n_convs - 1) times the
    bytes of the last text, are summed over the subtree; ends_sha256 is the hash of the ids of members without further
    turns. Without any conversation there is no node, not even a root.
    """
    paths = staged(paths_of(turns, lengths))
    nodes = staged(nodes_of(paths))
    sums = subtree_sums(nodes, paths, small).select("node", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    children = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "node")
    ends = member_hashes(paths.where("depth = length").select("node", "conv"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    full = nodes.join(sums, "node").join(children, "node", "left").join(ends, "node", "left").join(parents, "parent", "left")
    return full.select(
        "node", F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, family: int = 5, most: int = 8, small: int = SMALL) -> DataFrame:
    """prefix_trie of the conversations (conv_id, turn, role, text), rebuilt as sharing_heads says.

    Turns are ordered by turn, null first, equal ones by role and text; repeated rows are turns of their own. Null roles and
    texts are empty. Rows without a conv_id are left out. Texts of any length count whole; a conversation of any number of
    turns is spread over tasks. An empty table gives an empty result. Other columns aren't used, so their names can't clash.
    """
    turns = staged(turns_of(in_batches(conversations)))
    return prefix_trie(*sharing_heads(turns, family, most), small)


def op12_centroid_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations, with its subtree's sums."""
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("node")


OP12_SQL = f"""WITH RECURSIVE
    bits(n, v, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, {0xEDB88320}) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
    ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
    crcs(c, s, i, crc) AS (SELECT c, c::VARCHAR, 0, 4294967295::BIGINT FROM ids
        UNION ALL SELECT c, s, i + 1, xor(crc >> 8, v) FROM crcs JOIN bits ON k = 8 AND n = xor(crc & 255, ascii(s[i + 1])) WHERE i < len(s)),
    convs AS (SELECT c, c - c % 5 AS base, xor(crc, 4294967295) % 9 AS h FROM crcs WHERE i = len(s)),
    turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS j, coalesce(role, '') AS role, coalesce(text, '') AS text
              FROM conversations WHERE conv_id IS NOT NULL),
    rebuilt AS (SELECT v.c, 0 AS own, j, role, text FROM convs v JOIN turns t ON t.c = v.base AND t.j <= v.h
                UNION ALL SELECT c, 1, j, role, text FROM convs JOIN turns USING (c) WHERE j > h),
    numbered AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, j) AS d, role, text FROM rebuilt),
    prefixes AS MATERIALIZED (SELECT c, d, sha256(string_agg(len(role) || ':' || role || len(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d)) AS k, strlen(text) AS bytes FROM numbered
                              UNION ALL SELECT c, 0, '', 0 FROM ids),
    nodes AS MATERIALIZED (SELECT d, k, min(c) AS conv, count(*) AS n_convs, any_value(bytes) AS bytes FROM prefixes GROUP BY d, k),
    places AS MATERIALIZED (SELECT c, d, conv, max(d) OVER (PARTITION BY c) = d AS ends FROM prefixes JOIN nodes USING (d, k)),
    tree AS MATERIALIZED (SELECT n.conv, n.d, p.conv AS parent, n_convs, bytes FROM nodes n LEFT JOIN places p ON p.c = n.conv AND p.d = n.d - 1),
    kids AS (SELECT parent AS conv, d - 1 AS d, count(*) AS n_children FROM tree WHERE d > 0 GROUP BY ALL),
    sums AS (SELECT a.conv, a.d, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens
             FROM tree t LEFT JOIN kids USING (conv, d) JOIN places a ON a.c = t.conv AND a.d <= t.d GROUP BY ALL),
    last AS (SELECT conv, d, string_agg(c::VARCHAR, ',' ORDER BY c) AS members FROM places WHERE ends GROUP BY ALL)
    SELECT conv AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(members, '')) AS ends_sha256
    FROM tree JOIN sums USING (conv, d) LEFT JOIN kids USING (conv, d) LEFT JOIN last USING (conv, d)"""
