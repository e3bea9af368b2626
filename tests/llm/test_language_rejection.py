"""op7 rejects what is in none of the learned languages, and keeps the rest."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgrid.llm.language import identify, train, train_languages

FOREIGN = [
    "Съешь же ещё этих мягких французских булок, да выпей чаю.",
    "我能吞下玻璃而不伤身体。今天天气很好。",
    "Zażółć gęślą jaźń, w Szczebrzeszynie chrząszcz brzmi w trzcinie i Szczebrzeszyn z tego słynie.",
    "xqzj vbkwq pjfhz qkkxv zzwpq jvxbq fgkdp wqxzj",
]


@pytest.fixture(scope="module")
def model_and_held(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return train_languages(docs.where(~held)), docs.where(held & F.col("text").rlike(r"\p{L}"))


def test_foreign_text_is_rejected(spark, model_and_held):
    rng = np.random.default_rng(1)
    noise = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 200)) for _ in range(20)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(FOREIGN + noise)], "doc_id long, text string")
    assert identify(rows, model_and_held[0]).where("NOT rejected").count() == 0


def test_held_out_text_stays(model_and_held):
    model, held = model_and_held
    got = identify(held, model)
    assert got.where("rejected").count() <= 0.02 * got.count()
    assert 1e-3 < model.temperature


def test_training_stays_finite():
    """Texts of few grams, whose steps are long, among which labels are noisy: the loss stays below that of a guess."""
    rng = np.random.default_rng(3)
    features, labels = [], []
    for k in range(800):
        lang, size = k % 4, int(rng.integers(1, 4))
        buckets = np.unique(rng.integers(0, 12, size) + 12 * lang)
        freq = rng.dirichlet(np.full(len(buckets), 0.3)).astype("<f4")
        features.append((buckets, freq, size))
        labels.append(lang if rng.random() < 0.8 else int(rng.integers(4)))
    model = train(features, labels, list("abcd"), 64)
    assert np.isfinite(model.logits).all() and np.isfinite(model.bias).all()
    assert model.held_out_accuracy > 0.7
