"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's features are its byte 2- to 4-grams (lower case, what isn't a letter counts as space), hashed to a fixed
number of buckets; a text is the mean of its features' embeddings. Embeddings and softmax are trained in numpy by
stochastic gradient descent on a bounded sample of labelled rows. As the model is linear after the mean, prediction
needs one small table: each bucket's logits. The softmax says which of the learned languages is likeliest, not whether
the text is in any of them; for that, the mean logarithm of the frequencies that the text's grams have in the language
is compared with what texts of the language have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, in_batches, texts_of
from .words import blocks, mix

ORDERS = (2, 3, 4)
LETTER = np.zeros(256, np.uint8)
LETTER[:] = 32
for _c in range(97, 123):
    LETTER[_c] = LETTER[_c - 32] = _c
LETTER[128:] = np.arange(128, 256)
HAS_LETTER = r"\p{L}"


def gram_buckets(run: list[bytes], buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order, the bucket of the gram that begins at each byte; and where each text begins (with its leading space)."""
    data = LETTER[np.frombuffer(b" " + b"   ".join(run) + b"     ", np.uint8)].astype(np.uint64)
    at = np.concatenate([[0], np.cumsum([len(b) + 3 for b in run])])
    n = int(at[-1])
    out = []
    for k in ORDERS:
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = (h << np.uint64(8)) | data[j : n + j]
        out.append((mix(h + np.uint64(k << 40)) % np.uint64(buckets)).astype(np.int64))
    return out, at


@dataclass
class LanguageModel:
    languages: list[str]
    logits: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float
    reject_below: float
    held_out_accuracy: float
    usual: np.ndarray  # buckets x languages: logarithms of the grams' frequencies in the language
    spread: np.ndarray  # per language: mean of a text's mean in `usual`, its variance in long texts, and by gram
    strange_above: float

    def scores(self, run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities and strangeness, both texts x languages."""
        grams, at = gram_buckets(run, len(self.logits))
        both = np.hstack([self.logits, self.usual])
        total = np.zeros((len(run), both.shape[1]))
        for g in grams:
            total += np.add.reduceat(both[g], at[:-1], axis=0)
        n = len(ORDERS) * np.diff(at)
        total /= n[:, None]
        k = len(self.languages)
        return softmax((total[:, :k] + self.bias) / self.temperature), strangeness(total[:, k:], n, self.spread)


def strangeness(mean: np.ndarray, n: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """By how many deviations of a text of n grams the means (texts x languages) are below the languages' own."""
    return (spread[0] - mean) / np.sqrt(spread[1] + spread[2] / np.asarray(n, float)[:, None])


#: First letter and number of letters of alphabets, for random text that is in no language.
ALPHABETS = ((97, 26), (0x3B1, 25), (0x430, 32), (0x5D0, 27), (0x627, 36), (0x905, 53), (0x4E00, 20000))


def random_text(rng: np.random.Generator, size: int) -> bytes:
    """Random letters of a random alphabet as words of 1 to 9, of about size bytes."""
    first, many = ALPHABETS[rng.integers(len(ALPHABETS))]
    letters = first + rng.integers(0, many, max(4, size))
    letters[np.cumsum(rng.integers(2, 11, len(letters))) % len(letters)] = 32
    return "".join(map(chr, letters)).encode()[: max(4, size)]


def rejection(table: np.ndarray, aside: list[tuple[np.ndarray, np.ndarray, int]], y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """The spread of each language's texts and the strangeness above which a text is in none.

    Calibrated on texts kept aside as they are, against the same texts with their own language left out (each one in
    turn) and random text of the same sizes: the cut with the least error, where losing a text of a known language
    counts ten times.
    """
    languages = table.shape[1]
    spread = np.array([np.zeros(languages), np.ones(languages), np.zeros(languages)])
    if not len(y):
        return spread, float("inf")
    mean, n = np.array([f[1] @ table[f[0]] for f in aside]), np.array([f[2] for f in aside])
    for k in range(languages):
        own, size = mean[y == k, k], n[y == k]
        if not len(own):
            own, size = mean[np.arange(len(y)), y], n
        middle = np.average(own, weights=np.minimum(size, 3000))
        off = (own - middle) ** 2
        by_gram = np.median(off * size) / 0.455
        spread[:, k] = middle, max(1e-3, np.median(off[size >= np.median(size)]) / 0.455), by_gram
    z = strangeness(mean, n, spread)
    known = z[np.arange(len(y)), y].copy()
    others = z.copy()
    others[np.arange(len(y)), y] = np.inf
    foreign = others.min(axis=1)[np.isfinite(others.min(axis=1))]
    noise = [random_text(rng, min(2000, max(4, size // len(ORDERS) - 3))) for size in n]
    grams, at = gram_buckets(noise, len(table))
    total = sum(np.add.reduceat(table[g], at[:-1], axis=0) for g in grams)
    m = len(ORDERS) * np.diff(at)
    foreign = np.concatenate([foreign, strangeness(total / m[:, None], m, spread).min(axis=1)])
    cuts = np.unique(np.concatenate([known, foreign]))
    cuts = np.append((cuts[1:] + cuts[:-1]) / 2, cuts[-1] + 1)
    lost = 1 - np.searchsorted(np.sort(known), cuts, "right") / len(known)
    kept = np.searchsorted(np.sort(foreign), cuts, "right") / len(foreign)
    cost = 10 * lost + kept
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    return spread, float(cuts[best[len(best) // 2]])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(features: list[tuple[np.ndarray, np.ndarray, int]], labels: list[int], languages: list[str], buckets: int, dim: int = 16, epochs: int = 8, rate: float = 2.0, seed: int = 7) -> LanguageModel:
    """features: per text (buckets, frequencies that sum to 1, number of grams). A fifth of the texts is kept aside to calibrate."""
    if not languages:
        return LanguageModel([], np.zeros((buckets, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.5, float("nan"), np.zeros((buckets, 0), np.float32), np.zeros((3, 0)), float("inf"))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.5 / dim, (buckets, dim)).astype(np.float32)
    out = np.zeros((dim, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    order = rng.permutation(len(features))
    aside, rest = order[: len(order) // 5], order[len(order) // 5 :]
    steps, step = max(1, epochs * len(rest)), 0
    for _ in range(epochs):
        for k in rng.permutation(rest):
            idx, freq, _ = features[k]
            lr = rate * (1 - step / steps)
            step += 1
            mean = freq @ emb[idx]
            g = softmax(mean @ out + bias)
            g[labels[k]] -= 1
            # A step moves the logits by lr * (|mean|^2 + 0.1 + |freq| * out' out) times g. Beyond twice g it would raise
            # the text's loss, and steps that do so feed each other until the weights overflow.
            norm = float(np.sqrt(freq @ freq))
            lr = min(lr, 2 / (float(mean @ mean) + 0.1 + norm * float((out * out).sum())))
            back = out @ g
            out -= lr * np.outer(mean, g)
            bias -= 0.1 * lr * g
            emb[idx] -= (lr / norm * freq)[:, None] * back
    table = emb @ out
    y = np.array([labels[k] for k in aside])
    z = np.array([features[k][1] @ table[features[k][0]] + bias for k in aside]) if len(aside) else np.zeros((0, len(languages)))
    grid = np.geomspace(1e-4, 20, 241)
    # As if one text more had been wrong: where all are right, no temperature would be low enough.
    wrong = 1 / (len(y) + 2)
    hit = np.eye(len(languages))[y] * (1 - 2 * wrong) + wrong if len(y) else None
    loss = [-(hit * np.log(np.maximum(softmax(z / t), 1e-300))).sum(axis=1).mean() if len(y) else 0 for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / temperature) if len(y) else np.zeros((0, len(languages)))
    right = p.argmax(axis=1) == y if len(y) else np.zeros(0, bool)
    # Reject only what is less sure than nearly all right answers on the texts kept aside, and never above one half.
    low = float(np.quantile(p.max(axis=1)[right], 0.001)) if right.any() else 0.0
    mass, texts = np.full((buckets, len(languages)), 0.05 / buckets), np.full(len(languages), 0.05)
    for k in rest:
        mass[features[k][0], labels[k]] += features[k][1]
        texts[labels[k]] += 1
    usual = np.log(mass / texts).astype(np.float32)
    spread, strange = rejection(usual, [features[k] for k in aside], y, rng)
    return LanguageModel(languages, table.astype(np.float32), bias, temperature, min(0.5, low), float(right.mean()) if len(y) else float("nan"), usual, spread, strange)


def bucket_type(buckets: int) -> str:
    """The type that features keep their buckets in."""
    return "<u2" if buckets <= 1 << 16 else "<u4"


def labelled_features(rows: DataFrame, buckets: int) -> DataFrame:
    """(lang, h, idx, freq, n) of rows (lang, h, text): each whole text's features, as packed buckets and 32-bit frequencies, and its grams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, freq, size = [], [], []
            for _, run in blocks(texts_of(batch)):
                grams, at = gram_buckets(run, buckets)
                for k in range(len(run)):
                    u, n = np.unique(np.concatenate([g[at[k] : at[k + 1]] for g in grams]), return_counts=True)
                    idx.append(u.astype(bucket_type(buckets)).tobytes())
                    freq.append((n / n.sum()).astype("<f4").tobytes())
                    size.append(int(n.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(idx, pa.binary()), pa.array(freq, pa.binary()), pa.array(size, pa.int64())], ["lang", "h", "idx", "freq", "n"])

    return in_batches(rows).select("lang", "h", "text").mapInArrow(count, "lang string, h long, idx binary, freq binary, n long")


def train_languages(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", per_language: int = 800, buckets: int = 1 << 16) -> LanguageModel:
    """A model of the languages in `labelled`, from at most per_language distinct texts of each, those with the least hashes.

    Rows with a null language, or with a text that is null or has no letter, aren't used; repeated rows count once.
    Without any row left (all unlabelled, or an empty table) the model knows no language: everything is `und`, with
    score 0, and rejected. A language with a single text is learned from it.
    """
    good = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(HAS_LETTER)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # Where a text's hash lies from 0 to 1. A language's cut is set from its number of distinct texts, so that some more
    # than per_language lie below it; no rows are ranked in Spark, and texts move only once they are below the cut.
    hashed = good.select("lang", "text", F.xxhash64("text").alias("h")).withColumn("at", F.col("h") / 2.0**64 + 0.5)
    counts = hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()
    within = F.lit(False)
    for c in counts:
        within = within | ((F.col("lang") == c.lang) & (F.col("at") <= min(1.0, 1.1 * (per_language + 4 * per_language**0.5) / c.n)))
    picks = hashed.where(within).dropDuplicates(["lang", "h"])
    # The features stay in the Arrow buffers that they come in; only their places are put in order.
    table = labelled_features(picks, buckets).toArrow()
    order = pc.sort_indices(table.select(["lang", "h"]), [("lang", "ascending"), ("h", "ascending")]).to_pylist()
    langs, sizes = table.column("lang").to_pylist(), table.column("n").to_pylist()
    languages, taken = sorted(set(langs)), dict.fromkeys(langs, 0)
    features, labels = [], []
    for at in order:
        if taken[langs[at]] < per_language:
            taken[langs[at]] += 1
            idx, freq = (np.frombuffer(table.column(c)[at].as_buffer(), kind) for c, kind in (("idx", bucket_type(buckets)), ("freq", "<f4")))
            features.append((idx, freq, sizes[at]))
            labels.append(languages.index(langs[at]))
    return train(features, labels, languages, buckets)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `lang_pred`, `score` and `rejected`; columns of those names are replaced.

    lang_pred is `und` with score 0 where the text is null, empty or has no letter, or the model has no language. Of
    equally likely languages the first by name is told. Texts of any length count whole. A null id passes through;
    repeated rows give repeated rows; an empty table gives an empty result. rejected: `und`, or the calibrated
    probability of the likeliest language is below the model's threshold, or the text is too strange for that language.
    """
    shared = in_batches(docs).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,score:double,strange:boolean>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        names, scores, strange = [], [], []
        for _, run in blocks([t or "" for t in texts]):
            if not m.languages:
                names += ["und"] * len(run)
                scores += [0.0] * len(run)
                strange += [True] * len(run)
                continue
            p, z = m.scores(run)
            best = p.argmax(axis=1)
            names += [m.languages[b] for b in best]
            scores += p[np.arange(len(run)), best].tolist()
            strange += (z[np.arange(len(run)), best] > m.strange_above).tolist()
        return pd.DataFrame({"lang_pred": names, "score": scores, "strange": strange})

    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    lettered = F.coalesce(F.col(text_col).rlike(HAS_LETTER), F.lit(False))
    out = docs.select(*keep, predict(text_col).alias("_vg_p"), lettered.alias("_vg_lettered"))
    lang = F.when(F.col("_vg_lettered"), F.col("_vg_p.lang_pred")).otherwise("und")
    score = F.when(F.col("_vg_lettered"), F.col("_vg_p.score")).otherwise(0.0)
    return out.select(*keep, lang.alias("lang_pred"), score.alias("score"), (~F.col("_vg_lettered") | (score < model.reject_below) | F.col("_vg_p.strange")).alias("rejected"))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op7_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = train_languages(docs.where(~F.col("held_out")))
    return identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
