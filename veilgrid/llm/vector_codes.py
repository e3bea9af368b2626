"""Product codes of vectors, with codebooks refined by nearest-entry search over LAESA pivots.

Components are scaled to whole numbers and a vector is cut into equal parts. Each part position has a codebook of at
most 256 entries. A few entries of the first codebook are the position's pivots, for good: the distances of every part
to them are computed once and kept beside the vectors. In each round, the distances of the (moved) entries to the same
pivots are all that is needed for a lower bound of each part's distance to each entry, |d(part, pivot) - d(entry, pivot)|
at its largest; a part tries the entries in order of that bound and stops at the first whose bound is beyond the best
exact distance so far. Exact distances are sums of squared whole numbers, so ties are ties.

Only sums and counts per entry come to the driver, as many whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, staged

PARTS, ENTRIES, SCALE = 4, 256, 1024
PIVOTS = 8
#: Entries that a part tries at once, in order of their bounds.
TRIED = 8
#: Rows of a label are dealt to so many groups when the label's sum is joined.
SALTS = 32


@dataclass
class Codebooks:
    """entries (parts, entries, width) of whole numbers, the pivots (parts, pivots, width), and the scale of components."""

    entries: np.ndarray
    pivots: np.ndarray
    scale: int = SCALE

    @property
    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> list[float]:
        """The vector that a code stands for: the middles of its entries' cells, unscaled."""
        picked = [self.entries[p, int(code[2 * p : 2 * p + 2], 16)] for p in range(len(self.entries))]
        return ((np.concatenate(picked) + 0.5) / self.scale).tolist()


def kept_vectors(rows: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The rows whose vector isn't null and has neither null nor non-finite components."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    return rows.where(x.isNotNull() & F.coalesce(finite, F.lit(False)))


def whole_parts(vectors: pa.Array, width: int, parts: int = PARTS, scale: int = SCALE) -> np.ndarray:
    """(rows, parts, width) whole numbers floor(scale * x) of a list array of vectors of parts * width components."""
    if any(n != parts * width for n in np.unique(vectors.value_lengths().to_numpy(zero_copy_only=False))):
        raise ValueError(f"all vectors must have the {parts * width} components that the first has")
    x = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if x.size and np.abs(x).max() >= reach(width):
        raise ValueError(f"components of {reach(width) / scale} and more have squared distances beyond 64 bits")
    return x.astype(np.int64).reshape(len(vectors), parts, width)


def reach(width: int) -> float:
    """Below it, a squared distance of parts of this width, times the number of entries, is under 2**63."""
    return 2.0 ** ((62 - math.log2(ENTRIES) - math.log2(max(1, width))) / 2 - 1)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return (d * d).sum(axis=-1)


def choose_pivots(book: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Up to `most` entries that are far from each other: the first one, then always the farthest from those chosen."""
    chosen = [0]
    nearest = squared(book, book[0])
    while len(chosen) < min(most, len(book)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squared(book, book[chosen[-1]]))
    return book[chosen]


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(rows, pivots) Euclidean distances of x (rows, width), rounded to 32 bits."""
    return np.sqrt(squared(x[:, None, :], pivots[None, :, :]).astype(np.float64)).astype(np.float32)


def nearest_entries(x: np.ndarray, to_pivots: np.ndarray, book: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of the nearest entry for each row of x, ties to the lower index; and the exact distances computed.

    to_pivots: pivot_distances(x, pivots). No entry is left out whose distance could be the least or tie with it.
    """
    n, m = len(x), len(book)
    entry_to_pivots = pivot_distances(book, pivots)
    bound = np.zeros((n, m), np.float32)
    for p in range(pivots.shape[0]):
        np.maximum(bound, np.abs(to_pivots[:, p, None] - entry_to_pivots[None, :, p]), out=bound)
    # Each distance is off by its last bit at most, from rounding; that much is taken from the bounds.
    slack = float(max(to_pivots.max(initial=0), entry_to_pivots.max(initial=0))) * 2.0**-21
    bound = np.maximum(bound.astype(np.float64) - slack, 0) ** 2
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full(n, np.iinfo(np.int64).max)
    live, computed = np.arange(n), 0
    for at in range(0, m, TRIED):
        tried = order[live, at : at + TRIED]
        # Beyond the best distance so far nothing is left to try, in this order.
        live_now = bound[live, tried[:, 0]] <= best[live] // ENTRIES
        live, tried = live[live_now], tried[live_now]
        if not len(live):
            break
        key = squared(x[live, None, :], book[tried]) * ENTRIES + tried
        best[live] = np.minimum(best[live], key.min(axis=1))
        computed += tried.size
    return best % ENTRIES, best // ENTRIES, computed


def prepared(rows: DataFrame, pivots: np.ndarray, scale: int = SCALE) -> DataFrame:
    """rows (id, label, vector) with `near`, the distances of all parts to their pivots, 32-bit floats by part and pivot."""
    parts, _, width = pivots.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_parts(batch.column(2), width, parts, scale)
            near = np.stack([pivot_distances(x[:, p], pivots[p]) for p in range(parts)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in near], pa.binary())], ["id", "label", "vector", "near"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, near binary")


def assigned(batch: pa.RecordBatch, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch (.., vector, near): its whole parts, the index of each part's nearest entry, and the squared distance."""
    parts, pivots, width = books.pivots.shape
    x = whole_parts(batch.column("vector"), width, parts, books.scale)
    near = np.frombuffer(b"".join(batch.column("near").to_pylist()), np.float32).reshape(len(x), parts, pivots)
    found = [nearest_entries(x[:, p], near[:, p], books.entries[p], books.pivots[p])[:2] for p in range(parts)]
    return x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round over prepared rows: each entry that is some part's nearest becomes floor(mean) of those parts."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One column more than components: the count.
        total = np.zeros((parts * entries, width + 1), np.int64)
        for batch in batches:
            x, index, _ = assigned(batch, books)
            slot = (index + np.arange(parts) * entries).ravel()
            np.add.at(total, slot, np.concatenate([x.reshape(-1, width), np.ones((len(slot), 1), np.int64)], axis=1))
        used = np.flatnonzero(total[:, width])
        cell = (used[:, None] * (width + 1) + np.arange(width + 1)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[used].ravel())], ["cell", "x"])

    sums = rows.select("vector", "near").mapInArrow(run, "cell long, x long").groupBy("cell").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(parts * entries * (width + 1), np.int64)
    total[[r.cell for r in sums]] = [r.x for r in sums]
    total = total.reshape(parts, entries, width + 1)
    count = total[:, :, width :]
    mean = total[:, :, :width] // np.maximum(count, 1)
    return Codebooks(np.where(count > 0, mean, books.entries), books.pivots, books.scale)


def fit_codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = 4, parts: int = PARTS, entries: int = ENTRIES) -> tuple[DataFrame, Codebooks]:
    """The kept rows as a table (id, label, vector, near), and the codebooks after all rounds over all of them.

    The first codebooks are the parts of the rows with the smallest ids (null ids last; of equal ids, the smaller
    vector first; up to `entries` <= 256 of them). Rows are left out as kept_vectors says. Null ids and labels are passed on,
    repeated rows count each. All vectors must have the same number of components, a multiple of `parts`; others fail
    the job with that message. Without any row kept, the codebooks are empty. Other columns aren't used.
    """
    kept = kept_vectors(in_batches(rows), vector_col).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    first = kept.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).select("vector").collect()
    if not first:
        return kept.withColumn("near", F.lit(None).cast("binary")), Codebooks(np.zeros((parts, 0, 0), np.int64), np.zeros((parts, 0, 0), np.int64))
    width, rest = divmod(len(first[0].vector), parts)
    if rest:
        raise ValueError(f"{len(first[0].vector)} components can't be cut into {parts} equal parts")
    book = whole_parts(pa.array([r.vector for r in first], pa.list_(pa.float64())), width, parts).transpose(1, 0, 2)
    books = Codebooks(book, np.stack([choose_pivots(b) for b in book]))
    table = staged(prepared(kept, books.pivots))
    for _ in range(rounds):
        books = moved(table, books)
    return table, books


def encode_vectors(table: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error) of prepared rows: two hex digits per part, and the squared distances summed over the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, index, error = assigned(batch, books)
            code = [x.tobytes().hex() for x in index.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error.sum(axis=1))], ["id", "label", "code", "error"])

    kinds = ", ".join(f"{c} {table.schema[c].dataType.simpleString()}" for c in ("id", "label"))
    return table.mapInArrow(run, f"{kinds}, code string, error long")


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes (id, label, code, error) with `label_error`, the errors summed over equal labels (nulls together).

    A label's rows are dealt to SALTS groups, so that one that holds a large share of all rows isn't one task's.
    """
    codes = staged(codes)
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    each = sums.select(F.col("label").alias("_vg_l"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_vg_t"))
    dealt = codes.withColumn("_vg_s", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    return dealt.join(each, F.col("label").eqNullSafe(F.col("_vg_l")) & (F.col("_vg_s") == F.col("_vg_t"))).drop("_vg_l", "_vg_s", "_vg_t")


def op11_laesa_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's code after four rounds, its error, and its label's."""
    table, books = fit_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    out = with_label_error(encode_vectors(table, books))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def _op11_sql(rounds: int = 4) -> str:
    def assign(books: str) -> str:
        distance = "(list_inner_product(x, x) - 2 * list_inner_product(x, e) + list_inner_product(e, e))::BIGINT"
        return f"SELECT row, part, any_value(x) AS x, min({distance} * 256 + entry) AS best FROM parts JOIN {books} USING (part) GROUP BY row, part"

    ctes = [
        "kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "parts AS MATERIALIZED (SELECT row, p AS part, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM kept CROSS JOIN range(4) t(p))",
        "book0 AS MATERIALIZED (SELECT part, row - 1 AS entry, x AS e FROM parts WHERE row <= 256)",
    ]
    for k in range(1, rounds + 1):
        ctes += [
            f"near{k} AS MATERIALIZED ({assign(f'book{k - 1}')})",
            f"mean{k} AS (SELECT part, entry, list(m ORDER BY position) AS e FROM (SELECT part, best % 256 AS entry, position, floor(sum(x) / count(*)) AS m"
            f" FROM (SELECT part, best, unnest(x) AS x, generate_subscripts(x, 1) AS position FROM near{k}) GROUP BY ALL) GROUP BY ALL)",
            f"book{k} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM book{k - 1} b LEFT JOIN mean{k} m USING (part, entry))",
        ]
    return f"""WITH {", ".join(ctes)},
    last AS ({assign(f"book{rounds}")}),
    codes AS (SELECT row, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM last GROUP BY row),
    hashed AS (SELECT sha256(string_agg(c, ',' ORDER BY part, entry)) AS codebooks_sha256 FROM (SELECT part, entry, array_to_string(list_transform(e, lambda x: x::BIGINT), ',') AS c FROM book{rounds}))
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN codes USING (row) CROSS JOIN hashed"""


OP11_SQL = _op11_sql()
