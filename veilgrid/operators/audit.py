"""Audit: how well can roots be reconstructed from repeated releases?"""

from __future__ import annotations

import hashlib
import itertools
import operator
from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import draws
from ..functions import mechanisms as N
from ..functions.dialect import SPARK
from ..plans.catalog import Template
from .release import release


def repeated(rows: DataFrame, mechanism: str, q: int, cached: bool, keys: tuple[str, ...] = ("template", "root", "patient_id"), paired: bool = False) -> DataFrame:
    """q + 1 releases of each row: independent draws, or the replay of one. paired: as in release."""
    draws = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(q))))
    return release(draws, mechanism, keys, None if cached else "draw", paired)


def lower_median(index: str = "idx") -> Column:
    """The most likely index under a symmetric law that falls from its centre, without prior and normaliser. Without any release, the query fails."""
    middle = F.element_at(F.array_sort(F.collect_list(index)), F.greatest(F.floor((F.count(index) + 1) / 2), F.lit(1)).cast("int"))
    return F.when(F.count(index) == 0, F.raise_error(F.lit("an estimate needs a release")).cast("long")).otherwise(middle)


def uniforms(key: pa.Array, n: int, cached: bool) -> np.ndarray:
    """(rows, n): the uniforms of a row's draws from its text, which a draw's number follows; cached: one, from the text alone."""
    return uniforms_of(key, [""] if cached else [f":{d}" for d in range(n)])


def uniforms_of(key: pa.Array | pa.ChunkedArray, ends: Sequence[str]) -> np.ndarray:
    """(rows, ends): the uniforms of a row's text with each of `ends` behind it."""
    texts, behind = key.to_pylist(), [end.encode() for end in ends]
    new = [True, *map(operator.ne, texts[1:], texts)][: len(texts)]  # rows of one text follow each other
    digests = b"".join([hashlib.sha256(text + end).digest() for text in map(str.encode, itertools.compress(texts, new)) for end in behind])
    of = (np.frombuffer(digests, ">u8").reshape(-1, len(ends), 4)[:, :, 0] >> np.uint64(12)) / 2**52  # 13 hexadecimal digits
    return of if all(new) else of[np.cumsum(new) - 1]


def drawn_at(mechanism: str, t: np.ndarray, eps: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The grid indices of each row's uniforms, at its position and budget."""
    idx = np.empty_like(u)
    for e in np.unique(eps):
        at = eps == e
        idx[at] = draws.drawn(mechanism, t[at, None], float(e), u[at])
    return idx


def together(mechanism: str, q: int, cached: bool, key: Column, value: str = "value", lo: str = "lo", hi: str = "hi", eps: str = "eps_root") -> Column:
    """The indices of a row's q + 1 releases by draw, as one array: independent draws, or the replay of one.

    The same as those of repeated, from the text of the key; as they are in the row's own task, what needs all of them
    shuffles nothing and holds no groups.
    """

    @F.arrow_udf("array<bigint>")
    def draw(key: pa.Array, t: pa.Array, eps: pa.Array) -> pa.Array:
        t, eps = (x.to_numpy(zero_copy_only=False) for x in (t, eps))
        idx = drawn_at(mechanism, t, eps, uniforms(key, 1 if cached else q + 1, cached))
        idx = pa.array((np.repeat(idx, q + 1, axis=1) if cached else idx).ravel(), from_pandas=True).cast(pa.int64())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1, dtype=np.int32) * (q + 1)), idx)

    drawn_once = draw.asNondeterministic()  # a filter on what comes of the draws would else draw them again
    return drawn_once(key, F.expr(N.grid_position(SPARK, value, lo, hi)).cast("double"), F.col(eps).cast("double"))


def reconstructed(rows: DataFrame, mechanism: str, qs: Sequence[int], cached: bool, key: Column, carried: Sequence[str]) -> DataFrame:
    """(carried, q, value, naive, map) for each q: how far the mean of q + 1 releases and the most likely value without prior are off.

    rows: one per root (carried, value, lo, hi, eps_root). Its releases are drawn in numpy from the text `key`, which a draw's
    number follows, or are the replay of one; they are all in the row's own task, so nothing is shuffled.
    """
    grid = F.expr(N.grid_position(SPARK, "value", "lo", "hi"))
    few = rows.select(*carried, F.col("value").cast("double").alias("value"), grid.alias("_vg_t"), F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), "eps_root", key.alias("_vg_key"))
    draws_ = 1 if cached else max(qs) + 1

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, t, lo, hi, eps = (batch.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("value", "_vg_t", "lo", "hi", "eps_root"))
            idx = drawn_at(mechanism, t[:, 0], eps[:, 0], uniforms(batch.column("_vg_key"), draws_, cached))
            released = lo + idx * (hi - lo) / (N.M - 1)
            for q in qs:
                n = 1 if cached else q + 1
                middle = np.sort(idx[:, :n], axis=1)[:, (n + 1) // 2 - 1 : (n + 1) // 2]
                naive, found = np.abs(released[:, :n].mean(axis=1, keepdims=True) - value), np.abs(lo + middle * (hi - lo) / (N.M - 1) - value)
                columns = [pa.array(np.full(len(batch), q, np.int32)), *(pa.array(x[:, 0], from_pandas=True) for x in (value, naive, found))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *columns], names=[*carried, "q", "value", "naive", "map"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried)
    return few.mapInArrow(estimate, f"{kinds}, q int, value double, naive double, map double")


def lower_medians(idx: np.ndarray, sizes: Sequence[int]) -> dict[int, np.ndarray]:
    """Of idx (draws, rows), by size: the lower median of the first so many draws. Each draw is put in its place among those before it, in all rows at once."""
    ordered: list[np.ndarray] = []
    found = {}
    for n, x in enumerate(idx, 1):
        for k, y in enumerate(ordered):
            ordered[k], x = np.minimum(x, y), np.maximum(x, y)
        ordered.append(x)
        if n in sizes:
            found[n] = ordered[(n - 1) // 2]
    return found


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 15) -> Iterator[pa.Table]:
    """Batches taken together until they have so many rows, as a numpy step costs the same for few."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


#: A cell of a sweep that is reconstructed: the law, the config, its eps and the root's own; cached: its one release is replayed.
Cell = tuple[str, str, float, float, bool]


def reconstructed_totals(rows: DataFrame, cells: Mapping[tuple[str, str], Sequence[Cell]], qs: Sequence[int], key: Column) -> DataFrame:
    """(template, root, mechanism, config, eps, q, value, naive, map): the errors of reconstructed, and what they are relative to, summed over the rows.

    rows: one per patient and root (template, root, value, lo, hi). cells, by template and root: all that is released of it. A
    root's uniforms are worked out once and serve the releases of every cell; a task adds its own rows up and returns one row
    for each cell and q, to be added to those of the other tasks. Rows without a value count for nothing.
    """
    names = sorted(cells)
    numbers = rows.sparkSession.createDataFrame([(*k, i) for i, k in enumerate(names)], "template string, root string, _vg_k int")
    grid = F.expr(N.grid_position(SPARK, "value", "lo", "hi"))
    few = rows.join(F.broadcast(numbers), ["template", "root"]).select("_vg_k", F.col("value").cast("double").alias("value"), grid.cast("double").alias("_vg_t"), F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), key.alias("_vg_key"))
    sizes = {q: q + 1 for q in qs}
    ends = ["", *(f":{d}" for d in range(max(sizes.values())))]  # of the release that is replayed, and of each draw

    def errors(idx: np.ndarray, value: np.ndarray, lo: np.ndarray, width: np.ndarray, wanted: Mapping[int, int]) -> dict[int, tuple[float, float]]:
        middle = lower_medians(idx.astype(np.int16), tuple(wanted.values()))
        found, total, n = {}, np.zeros(len(value)), 0
        for q, size in sorted(wanted.items(), key=lambda w: w[1]):
            total, n = total + (lo + idx[n:size] * width / (N.M - 1)).sum(axis=0), size
            found[q] = float(np.abs(total / size - value).sum()), float(np.abs(lo + middle[size] * width / (N.M - 1) - value).sum())
        return found

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = defaultdict(lambda: np.zeros(3))
        for batch in gathered(batches):
            number, value, t, lo, hi = (batch.column(c).to_numpy() for c in ("_vg_k", "value", "_vg_t", "lo", "hi"))
            drawn_with = uniforms_of(batch.column("_vg_key"), ends)
            for k in np.unique(number):
                at = np.flatnonzero((number == k) & ~np.isnan(value))
                if not len(at):
                    continue
                v, low, width, truth = value[at], lo[at], hi[at] - lo[at], float(np.abs(value[at]).sum())
                own_u = np.ascontiguousarray(drawn_with[at].T)
                u = {True: own_u[:1], False: own_u[1:]}
                tails = {cached: draws.tail(x) for cached, x in u.items()}
                known: dict[tuple, dict] = {}
                for mechanism, config, eps, own, cached in cells[names[k]]:
                    if (mechanism, own, cached) not in known:
                        idx = draws.drawn(mechanism, t[at], own, u[cached], tails=tails[cached])
                        known[mechanism, own, cached] = errors(idx, v, low, width, dict.fromkeys(qs, 1) if cached else sizes)
                    for q, (naive, found) in known[mechanism, own, cached].items():
                        sums[*names[k], mechanism, config, eps, q] += (truth, naive, found)
        if sums:
            columns = [*zip(*sums, strict=True), *np.stack([*sums.values()]).T]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=columns_)

    columns_ = ["template", "root", "mechanism", "config", "eps", "q", "value", "naive", "map"]
    kinds = [pa.string()] * 4 + [pa.float64(), pa.int32()] + [pa.float64()] * 3
    return few.mapInArrow(estimate, "template string, root string, mechanism string, config string, eps double, q int, value double, naive double, map double")


def released_by_draw(wide: DataFrame, template: Template, mechanism: str, q: int, eps: Mapping[str, float], keys: Mapping[str, Column]) -> DataFrame:
    """(patient_id, draw, _r_<root>..) of wide (patient_id, root..): q + 1 rows in a row for each of its rows, with a release of every root.

    eps and keys, by root: its budget, and the text that its draws are keyed with, which the draw's number follows.
    """
    roots = template.roots
    grid = [F.expr(N.grid_position(SPARK, SPARK.quote(r), *map(SPARK.num, template.domains[r]))).cast("double").alias(f"t_{r}") for r in roots]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, columns = len(batch), []
            for r in roots:
                lo, hi = template.domains[r]
                t, e = batch.column(f"t_{r}").to_numpy(zero_copy_only=False), np.full(n, eps[r])
                idx = drawn_at(mechanism, t, e, uniforms(batch.column(f"key_{r}"), q + 1, False))
                columns.append(pa.array((lo + idx * (hi - lo) / (N.M - 1)).ravel(), from_pandas=True))
            patient = batch.column("patient_id").take(pa.array(np.repeat(np.arange(n), q + 1)))
            yield pa.RecordBatch.from_arrays([patient, pa.array(np.tile(np.arange(q + 1, dtype=np.int32), n)), *columns], names=["patient_id", "draw", *(f"_r_{r}" for r in roots)])

    schema = f"patient_id {wide.schema['patient_id'].dataType.simpleString()}, draw int, " + ", ".join(f"`_r_{r}` double" for r in roots)
    return wide.select("patient_id", *grid, *(keys[r].alias(f"key_{r}") for r in roots)).mapInArrow(draw, schema)


def estimated_targets(rows: DataFrame, q: int) -> DataFrame:
    """(patient_id, med, last, last_class) of rows (patient_id, draw, target, target_class) as released_by_draw orders them.

    The median and the last of the targets that aren't null; no row where all are. A patient's rows follow each other, so
    they are taken together as they come and nothing is shuffled.
    """
    names = ["patient_id", "draw", "target", "target_class"]

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            whole = len(table) // (q + 1) * (q + 1)
            rest = table.slice(whole).combine_chunks().to_batches()
            rest = rest[0] if rest else None
            if not whole:
                continue
            table = table.slice(0, whole)
            x = table.column("target").to_numpy().astype(float).reshape(-1, q + 1)
            kind = table.column("target_class").to_numpy().astype(float).reshape(-1, q + 1)
            if not (table.column("draw").to_numpy().reshape(-1, q + 1) == np.arange(q + 1)).all():
                raise ValueError("a patient's draws don't follow each other")
            some = np.flatnonzero(~np.isnan(x).all(axis=1))
            x, kind = x[some], kind[some]
            last = q - np.argmax(~np.isnan(x[:, ::-1]), axis=1)
            at = np.arange(len(some))
            patient = table.column("patient_id").combine_chunks().take(pa.array(some * (q + 1)))
            med = np.nanmedian(x, axis=1) if len(x) else np.zeros(0)
            columns = [pa.array(med), pa.array(x[at, last]), pa.array(kind[at, last], from_pandas=True).cast(pa.int32())]
            yield pa.RecordBatch.from_arrays([patient, *columns], names=["patient_id", "med", "last", "last_class"])
        if rest is not None:
            raise ValueError("a patient's draws don't follow each other")

    key = rows.schema["patient_id"].dataType.simpleString()
    return rows.select(*names).mapInArrow(estimate, f"patient_id {key}, med double, last double, last_class int")


#: Halvings that find one of up to 2**11 grid points.
HALVINGS = 11
RATES = {"exp": 0.5, "blap": 1.0, "stair": 1.0}


def with_best_index(rows: DataFrame, mechanism: str, m: int = 1000, eps: str = "eps") -> DataFrame:
    """rows (obs, eps, mean, std, ..) with `map_idx`: the most likely index given the array obs of releases at eps, under a
    Gaussian prior on the grid (std null or not positive: none). The first of equal maxima wins; without any release, m // 2.

    The log probability of index o at true index s is -f |s - o| - ln Z(s), f the law's rate times eps, with Z the sum over
    the grid: of the staircase all whole distances lie in the first part of a step, whose weight cancels. Summed over the
    releases and with the prior, it is piecewise smooth in s. Z falls towards the ends of the grid, which bends the sum
    upwards there; the prior bends it down, everywhere alike. So there is one stretch, the same distance from either end,
    in which the sum is concave, and a search by halves finds its best index there; outside, the best one is an end or a
    release, as between those the sum is convex. These few candidates are compared in full, in numpy for a batch of rows.
    """
    rate = RATES[mechanism]

    @F.arrow_udf("bigint")
    def found(obs: pa.Array, eps: pa.Array, mean: pa.Array, std: pa.Array) -> pa.Array:
        eps, mean, std = (x.to_numpy(zero_copy_only=False).astype(float) for x in (eps, mean, std))
        values = obs.flatten().to_numpy(zero_copy_only=False)
        n = obs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, best = np.cumsum(n) - n, np.full(len(n), m // 2, np.int64)
        for size in np.unique(n[n > 0]):  # rows with as many releases are a matrix
            at = np.flatnonzero(n == size)
            best[at] = best_index(values[start[at, None] + np.arange(size)], rate * eps[at], mean[at], std[at], m)
        return pa.array(best)

    return rows.withColumn("map_idx", found("obs", F.col(eps).cast("double"), F.col("mean").cast("double"), F.col("std").cast("double")))


def best_index(obs: np.ndarray, f: np.ndarray, mean: np.ndarray, std: np.ndarray, m: int) -> np.ndarray:
    """with_best_index of the rows of a matrix of releases; NaN is null."""
    n = obs.shape[1]
    with np.errstate(all="ignore"):
        prior = np.where(std > 0, 1 / (std * std), np.nan)
        log_z = lambda s: np.log(1 + np.exp(-f) - np.exp(-f * (s + 1)) - np.exp(-f * (m - s)))  # noqa: E731  but for a constant
        bend = lambda s: -n * (log_z(s + 1) - 2 * log_z(s) + log_z(s - 1))
        gain = lambda s: f * (n - 2 * (obs <= s[:, None]).sum(axis=1)) - n * (log_z(s + 1) - log_z(s)) - (s + 0.5 - mean) * prior
        first = halved(np.ones(len(f), np.int64), np.full(len(f), m // 2), lambda s: bend(s) <= prior)
        concave = bend(first) <= prior
        inner = halved(first, m - 1 - first, lambda s: gain(s) <= 0)
        ends = [np.zeros_like(first), np.full_like(first, m - 1), np.where(concave, inner, 0), np.where(concave, inner - 1, 0)]
        outer = [np.where(~concave | (o < first) | (o > m - 1 - first), o, 0) for o in obs.T]
        most, best = np.full(len(f), -np.inf), np.full(len(f), m, np.int64)
        for s in ends + [o for o in outer if o.any()]:
            off = np.where(np.isnan(prior) | np.isnan(mean), 0, (s - mean) * (s - mean) * prior / 2)
            score = np.round(-f * np.abs(obs - s[:, None]).sum(axis=1) - n * log_z(s) - off, 9)
            better = (score > most) | ((score == most) & (s < best))
            most, best = np.where(better, score, most), np.where(better, s, best)
    return best


def halved(low: np.ndarray, high: np.ndarray, holds: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The least whole number from low to high - 1 for which `holds` does, if it holds for all after one for which it does; else high."""
    for _ in range(HALVINGS):
        middle, left = (low + high) // 2, low < high
        yes = holds(middle)
        low, high = np.where(left & ~yes, middle + 1, low), np.where(left & yes, middle, high)
    return low


def map_index(observations: DataFrame, mechanism: str, m: int = 1000, by: tuple[str, ...] = ("template", "patient_id", "root")) -> DataFrame:
    """(by, map_idx): with_best_index of all releases `idx` at `eps_root`, of which a root's come together as an array.

    observations: (by, idx, eps_root, prior_mean, prior_std), the prior in grid units, null for none; idx null for no release.
    """
    grouped = observations.groupBy(*by).agg(F.collect_list("idx").alias("obs"), F.first("eps_root").alias("eps"), F.first("prior_mean").alias("mean"), F.first("prior_std").alias("std"))
    return with_best_index(grouped, mechanism, m).select(*by, "map_idx")


def population_statistics(rows: DataFrame, ridge: float = 1e-6) -> dict[str, tuple[list[str], np.ndarray, np.ndarray]]:
    """Per template (roots, means, inverse of the covariance plus ridge on its diagonal) of rows (template, patient_id, root, value).

    Covariances are one aggregate in Spark; a row per pair of roots comes to the driver, where matrices of a few roots
    are inverted.
    """
    other = rows.select("template", "patient_id", F.col("root").alias("other"), F.col("value").alias("_vg_v"))
    pairs = rows.join(other, ["template", "patient_id"]).groupBy("template", "root", "other").agg(F.avg("value").alias("mean"), F.covar_pop("value", "_vg_v").alias("cov")).collect()
    return {t: regularised([(r.root, r.other, r.mean, r.cov) for r in pairs if r.template == t], ridge) for t in sorted({r.template for r in pairs})}


def regularised(pairs: list[tuple[str, str, float, float]], ridge: float = 1e-6) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(roots, means, inverse of covariance + ridge) from (root, other, mean, cov)."""
    roots = sorted({p[0] for p in pairs})
    cov, mean = np.zeros((len(roots), len(roots))), np.zeros(len(roots))
    for a, b, m, c in pairs:
        cov[roots.index(a), roots.index(b)], mean[roots.index(a)] = c, m
    return roots, mean, np.linalg.inv(cov + ridge * np.eye(len(roots)))


def joint_log_prior(rows: DataFrame, statistics: dict[str, tuple[list[str], np.ndarray, np.ndarray]]) -> DataFrame:
    """(template, patient_id, lp): the joint Gaussian log prior, without its constant, of any number of roots.

    rows: (template, patient_id, root, value). The differences of an entity come together in one aggregate and are
    multiplied with the template's inverse, which is broadcast.
    """
    spark = rows.sparkSession
    centre = spark.createDataFrame([(t, r, float(m)) for t, (roots, mean, _) in statistics.items() for r, m in zip(roots, mean, strict=True)], "template string, root string, _vg_m double")
    inverse = spark.createDataFrame([(t, [[float(x) for x in row] for row in inv]) for t, (_, _, inv) in statistics.items()], "template string, _vg_inv array<array<double>>")
    off = rows.join(F.broadcast(centre), ["template", "root"]).groupBy("template", "patient_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("root", (F.col("value") - F.col("_vg_m")).alias("x")))), lambda s: s["x"]).alias("d"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    product = F.transform("_vg_inv", lambda row: dot(row, F.col("d")))
    return off.join(F.broadcast(inverse), "template").select("template", "patient_id", (-0.5 * dot(product, F.col("d"))).alias("lp"))


def request_plan(sessions: DataFrame, roots: list[str]) -> DataFrame:
    """(session columns, turn, root): t - 1 turns that ask for one root each in turn, then one for all roots. A plan of under two turns (t) fails."""
    sessions = sessions.withColumn("t", F.when(F.col("t") >= 2, F.col("t")).otherwise(F.raise_error(F.lit("a plan has two turns at least")).cast(sessions.schema["t"].dataType)))
    names = F.array(*[F.lit(r) for r in roots])
    turns = sessions.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("t") - 2)))
    single = turns.withColumn("root", F.element_at(names, (F.col("turn") % len(roots) + 1).cast("int")))
    final = sessions.withColumn("turn", (F.col("t") - 1).cast("int")).withColumn("root", F.explode(names))
    return single.unionByName(final)


def match_calls(requests: DataFrame, calls: DataFrame, session: str = "session") -> DataFrame:
    """calls (session, value, released, ord) with `root`, the request that each one answers; null where no request has its value.

    requests: (session, root, value, pending, ord). Values alone can be ambiguous, as two roots may have the same. First,
    the n-th call of a session with a value answers the n-th pending request for it; calls that are left after that go
    to the first request with the value, pending or not.
    """
    first = Window.partitionBy(session, "value").orderBy("ord", "root")
    waiting = requests.where("pending").withColumn("n", F.row_number().over(first)).select(session, "value", "n", F.col("root").alias("_vg_p"))
    nth = calls.withColumn("n", F.row_number().over(Window.partitionBy(session, "value").orderBy("ord")))
    any_one = requests.groupBy(session, "value").agg(F.min_by("root", F.struct("ord", "root")).alias("_vg_a"))
    out = nth.join(waiting, [session, "value", "n"], "left").join(any_one, [session, "value"], "left")
    return out.withColumn("root", F.coalesce("_vg_p", "_vg_a")).drop("n", "_vg_p", "_vg_a")
