"""I-Match fingerprints: hashes of a document's distinct terms of middling document frequency.

Terms whose document frequency lies in a band make up the lexicon. A fingerprint has one hash for each of several
random subsets of the lexicon: of the sorted distinct terms of the text that are in that subset. Subsets differ in how
many terms they keep: with many terms a hash stands for the whole text, with few it survives edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, in_batches, texts_of
from .words import blocks, distinct, mix, word_hashes

#: How many subsets keep one term in how many.
SUBSETS = ((8, 8), (16, 32), (24, 128))
EMPTY = np.uint64(0)
LOW = -(2**63)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term long, n): in how many texts each term is; a block of texts is counted before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, run in blocks(texts_of(batch)):
                parts.append(distinct(run, *word_hashes(run))[0])
            terms, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])

    return in_batches(docs).select(F.col(text_col).alias("text")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, text_col: str = "text", least: float = 0.001, most: float = 0.05) -> np.ndarray:
    """The sorted terms that are in a share of `least` to `most` of the texts, and in two at least.

    A text has d distinct terms on average, so at most d / least terms can be in the band: what comes to the driver
    and goes to the tasks has that bound whatever the number of texts.
    """
    n = docs.count()
    band = document_frequencies(docs, text_col).where((F.col("n") >= max(2, least * n)) & (F.col("n") <= max(2, most * n)))
    return np.sort(np.array([r.term for r in band.select("term").toLocalIterator()], np.int64).view(np.uint64))


class Fingerprinter:
    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.keys = mix(np.arange(1, sum(n for n, _ in SUBSETS) + 1, dtype=np.uint64))
        self.rates = np.array([r for n, r in SUBSETS for _ in range(n)], np.uint64)

    def prints(self, texts: list[str]) -> np.ndarray:
        """One row of 64-bit hashes for each text, 0 where the text has no term of that subset.

        A hash is of the sorted list of the text's distinct terms in the subset.

        A text without a lexicon term is printed over all its terms; one without terms has zeros only.
        """
        out = np.zeros((len(texts), len(self.keys)), np.uint64)
        for first, run in blocks(texts):
            h, at, _ = distinct(run, *word_hashes(run))
            doc = np.repeat(np.arange(len(run)), np.diff(at))
            if len(self.terms):
                known = self.terms[np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)] == h
            else:
                known = np.zeros(len(h), bool)
            has = np.bincount(doc[known], minlength=len(run)) > 0
            use = known | ~has[doc]
            h, doc = h[use], doc[use]
            for k, (key, rate) in enumerate(zip(self.keys, self.rates, strict=True)):
                inside = mix(h ^ key) % rate == 0
                raw, ends = h[inside].tobytes(), 8 * np.searchsorted(doc[inside], np.arange(len(run) + 1))
                some = np.flatnonzero(ends[1:] > ends[:-1])
                prints = [hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(ends[some].tolist(), ends[some + 1].tolist(), strict=True)]
                out[first + some, k] = np.maximum(np.frombuffer(b"".join(prints), "<u8"), 1)
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal hashes among the subsets of which either text has a term; 1 if neither has any."""
    some = (a != EMPTY) | (b != EMPTY)
    n = some.sum(axis=1)
    return np.where(n > 0, ((a == b) & some).sum(axis=1) / np.maximum(n, 1), 1.0)


def hexed(prints: np.ndarray) -> list[str]:
    return [r.astype(">u8").tobytes().hex() for r in prints]


def with_successors(docs: DataFrame, id_col: str, text_col: str, range_rows: int = 8192) -> DataFrame:
    """(r, last, id, text): rows dealt to ranges of ids; each range also gets the next one's first row, with last = 1.

    Ids are numbers. Only range limits and first ids come to the driver. The last range gets the first row of all. Of
    rows that share a range's first id (null ids all do) a batch sends on the one with the least text, null before all.
    """
    rows = in_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    m = max(1, rows.count() // range_rows)
    limits = rows.agg(F.percentile_approx("id", [k / m for k in range(1, m)], 100 * m)).first()[0] if m > 1 else None
    cuts = np.array(sorted(set(limits or [])), np.int64)

    @F.pandas_udf("int")
    def r_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(np.int64), "right").astype(np.int32))

    ids = rows.select("id").withColumn("r", r_of(F.coalesce("id", F.lit(LOW))))
    found = ids.groupBy("r").agg(F.min(F.coalesce("id", F.lit(LOW))).alias("first")).collect()
    first = {x.r: x.first for x in found}
    order = sorted(first)
    to = {k: order[j - 1] for j, k in enumerate(order)}  # the range that a range's first row is also sent to

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.full(len(cuts) + 1, LOW, np.int64)
        targets = np.zeros(len(cuts) + 1, np.int32)
        for k in order:
            starts[k], targets[k] = first[k], to[k]
        for batch in batches:
            value = pc.fill_null(batch.column("id"), LOW).to_numpy(zero_copy_only=False)
            r = np.searchsorted(cuts, value, "right").astype(np.int32)
            least: dict[int, tuple] = {}
            for k in np.flatnonzero(value == starts[r]).tolist():
                text = batch.column("text")[k].as_py()
                key = (text is not None, text or "", k)
                if r[k] not in least or key < least[r[k]]:
                    least[r[k]] = key
            sent = np.array([key[2] for key in least.values()], np.int64)
            take = np.concatenate([np.arange(len(r)), sent])
            last = np.concatenate([np.zeros(len(r), np.int32), np.ones(len(sent), np.int32)])
            moved = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([r, targets[r[sent]]])), pa.array(last), moved.column("id"), moved.column("text")], ["r", "last", "id", "text"])

    return rows.mapInArrow(deal, "r int, last int, id long, text string").repartitionById(m, F.col("r")).sortWithinPartitions("r", "last", "id", "text")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.001, most: float = 0.05) -> DataFrame:
    """id, n_chars, edited (the text whose last half is the next document's beginning), fingerprint,
    edited_fingerprint, near_edited, near_next.

    Documents follow one another by id, equal ids by text, null ids first; the last is followed by the first. A null
    text counts as empty. A text without words has a fingerprint of zeros. Texts count whole, of any length; repeated
    rows give repeated rows; an empty table gives an empty result. Other columns aren't used, so names can't clash.
    """
    terms = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text_col, least, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer, held = Fingerprinter(terms.value), []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            """rows are followed by one more, the next of the last."""
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1] and a[0] == b[0]]
            texts = [a[3] for a, _ in pairs]
            nexts = [b[3] for _, b in pairs]
            edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, nexts, strict=True)]
            every = printer.prints([r[3] for r in rows])
            own = [k for k, (a, b) in enumerate(zip(rows, rows[1:], strict=False)) if not a[1] and a[0] == b[0]]
            p, q, u = every[own], printer.prints(edited), every[[k + 1 for k in own]]
            columns = [
                pa.array([a[2] for a, _ in pairs], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array(edited, pa.string()),
                pa.array(hexed(p), pa.string()),
                pa.array(hexed(q), pa.string()),
                pa.array(likeness(p, q)),
                pa.array(likeness(p, u)),
            ]
            return pa.RecordBatch.from_arrays(columns, ["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("r", "last", "id")), texts_of(batch), strict=True)
            if len(held) > 1:
                yield out(held)
                held = held[-1:]

    return with_successors(docs, id_col, text_col).mapInArrow(
        run, "id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, and its likeness to an edit and to the next document."""
    out = fingerprint_documents(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
