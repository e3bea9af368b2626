"""Sharding by histogram sort.

Rows are ordered by (hash of the text, id). The job counts, exactly, the bytes and rows below candidate key
boundaries over all partitions, halves in on the boundaries that split the corpus evenly, and only then moves the
rows, once. Copies of a text have one hash, so they stay together unless a boundary can meet its tolerance only by
cutting through their group; it then cuts by id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, staged

LOW = -(2**63)
SPAN = 2**64


def _pack(h: int, i: int) -> int:
    return ((h - LOW) << 64) | (i - LOW)


def _unpack(k: int) -> tuple[int, int]:
    return (k >> 64) + LOW, (k & (SPAN - 1)) + LOW


def below(h: np.ndarray, i: np.ndarray, ph: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """For each row (h, i), how many of the sorted boundaries (ph, pi) are at or below it."""
    left, right = np.searchsorted(ph, h, "left"), np.searchsorted(ph, h, "right")
    out = left.copy()
    tied = np.flatnonzero(right > left)
    if len(tied):
        for lo in np.unique(left[tied]):
            rows = tied[left[tied] == lo]
            hi = right[rows[0]]
            out[rows] = lo + np.searchsorted(pi[lo:hi], i[rows], "right")
    return out


def interval_of(ph: np.ndarray, pi: np.ndarray) -> Callable[..., Column]:
    """The function of (h, i) columns that gives the interval between sorted boundaries that a row falls in."""

    @F.pandas_udf("int")
    def interval(h: pd.Series, i: pd.Series) -> pd.Series:
        return pd.Series(below(h.to_numpy(np.int64), i.to_numpy(np.int64), ph, pi).astype(np.int32))

    return interval


@dataclass
class Boundary:
    """A splitter being refined: it lies above `lo` (with lo_bytes below it) and at most at `hi`."""

    target: float
    tolerance: float
    lo: int
    lo_bytes: int
    hi: int
    hi_bytes: int
    at: int | None = None


def find_splitters(weights: DataFrame, targets: list[tuple[float, float]], total: int, probes: int = 65_536) -> list[int]:
    """Composite keys that split `weights` (h, i, size) at the byte targets, each within its own tolerance.

    Each round sends at most `probes` candidate boundaries out and gets one row back per interval that holds data.
    An interval's least and largest keys narrow the bracket to keys that exist, so a round ends either with the
    tolerance met or with a bracket smaller by the number of probes; a bracket with one key in it can't be refined.
    """
    todo = [Boundary(t, tol, 0, 0, SPAN * SPAN, total) for t, tol in targets]
    done: list[Boundary] = []
    while todo:
        each = max(2, min(4096, probes // len(todo)))
        keys = sorted({b.lo + (b.hi - b.lo) * j // each for b in todo for j in range(1, each)} | {b.hi for b in todo if b.hi < SPAN * SPAN} | {b.lo for b in todo if b.lo})
        ph, pi = (np.array(x, np.int64) for x in zip(*map(_unpack, keys), strict=True))

        rows = (
            weights.groupBy(interval_of(ph, pi)("h", "i").alias("k"))
            .agg(F.sum("size").alias("size"), F.min(F.struct("h", "i")).alias("least"), F.max(F.struct("h", "i")).alias("most"))
            .collect()
        )
        size = np.zeros(len(keys) + 1, np.int64)
        least: list[int | None] = [None] * (len(keys) + 1)
        most: list[int | None] = [None] * (len(keys) + 1)
        for r in rows:
            size[r.k], least[r.k], most[r.k] = r.size, _pack(*r.least), _pack(*r.most)
        under = np.concatenate([[0], np.cumsum(size)])  # bytes below keys[j] are under[j + 1]
        again = []
        for b in todo:
            j = int(np.searchsorted(under[1:], b.target, "left"))  # the first interval whose end reaches the target
            j = min(j, len(keys))
            # The interval j runs from keys[j-1] to keys[j]; its rows lie in [least, most].
            options = [(under[j], keys[j - 1] if j else 0), (under[j + 1], keys[j] if j < len(keys) else SPAN * SPAN)]
            best = min(options, key=lambda o: abs(o[0] - b.target))
            if abs(best[0] - b.target) <= b.tolerance or least[j] is None:
                b.at = best[1]
            elif least[j] == most[j]:
                b.at = best[1] if best[1] not in (0, SPAN * SPAN) else (least[j] if best[1] == 0 else most[j] + 1)
            else:
                b.lo, b.lo_bytes, b.hi, b.hi_bytes = least[j], int(under[j]), most[j] + 1, int(under[j + 1])
                again.append(b)
                continue
            done.append(b)
        todo = again
    return sorted(b.at for b in done)


def shard_by_bytes(
    docs: DataFrame,
    shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 16,
    tolerance: float = 0.002,
    range_bytes: int = 64 << 20,
) -> DataFrame:
    """All columns of docs with `size`, `shard` (0 to shards-1) and `slot` (gapless from 0 in each shard).

    size: UTF-8 bytes of the text plus `overhead`. Shard sizes differ from the mean by at most `tolerance` of it on
    either side, or as little as single rows allow. Each shard is moved as ranges of about `range_bytes`, so no task
    has to take a whole shard of a large corpus, and the number of ranges grows with it.

    Ids are whole numbers. Nulls: a null text has no bytes, a null id sorts first. Rows equal in both text and id stay
    together and take slots in any order. Texts of any length count whole. An empty table gives an empty result. Columns of docs named size, shard, slot are replaced; others are passed on.
    """
    keep = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(overhead)).cast("long")
    h, i = F.xxhash64(text_col), F.coalesce(F.col(id_col).cast("long"), F.lit(LOW))
    weights = staged(docs.select(h.alias("h"), i.alias("i"), size.alias("size")))
    total = weights.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-total // (range_bytes * shards)))
    n = shards * parts
    even = total / shards
    targets = [(total * k / n, even * (tolerance if k % parts == 0 else 0.1 / parts)) for k in range(1, n)]
    splitters = find_splitters(weights, targets, total) if total else []
    ph, pi = (np.array(x, np.int64) for x in zip(*(_unpack(min(k, SPAN * SPAN - 1)) for k in splitters), strict=True)) if splitters else (np.zeros(0, np.int64),) * 2

    range_of = interval_of(ph, pi)
    counts = dict(weights.groupBy(range_of("h", "i").alias("r")).count().collect())
    start, bases = 0, []
    for r in range(n):
        start = 0 if r % parts == 0 else start
        bases.append(start)
        start += counts.get(r, 0)
    base = np.array(bases, np.int64)

    @F.pandas_udf("long")
    def base_of(r: pd.Series) -> pd.Series:
        return pd.Series(base[r.to_numpy()])

    placed = docs.select(*keep, size.alias("size"), h.alias("_vg_h"), i.alias("_vg_i")).withColumn("_vg_r", range_of("_vg_h", "_vg_i"))
    order = Window.partitionBy("_vg_r").orderBy("_vg_h", "_vg_i")
    return placed.withColumn("_vg_n", F.row_number().over(order)).select(
        *keep, "size", F.floor(F.col("_vg_r") / parts).cast("int").alias("shard"), (base_of("_vg_r") + F.col("_vg_n") - 1).alias("slot")
    )


def op3_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes."""
    out = shard_by_bytes(documents(spark, sf_dir).select("doc_id", "text"))
    crc = F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long")
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
