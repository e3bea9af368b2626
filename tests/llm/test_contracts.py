"""The registered queries' own columns against brute force on the smallest tables, and texts built to break them."""

import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgrid.llm import components, jaccard, language, suffix_dedup, words
from veilgrid.llm.fingerprints import SUBSETS, Fingerprinter, likeness
from veilgrid.llm.queries import QUERIES

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, sf_dir, name):
    return {r.doc_id: r for r in QUERIES[name](spark, sf_dir).collect()}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op1(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = rows(spark, sf_dir, "op1_transducer_bpe")
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(decoded.encode()))


def test_op2(spark, sf_dir, texts):
    got = rows(spark, sf_dir, "op2_png_columns")
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        raw = t.encode()
        payload = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
    by = {}
    for d, t in texts.items():
        assert by.setdefault(t, (got[d].media_sha256, got[d].media_bytes, got[d].feature)) == (got[d].media_sha256, got[d].media_bytes, got[d].feature)


def test_op3(spark, sf_dir, texts):
    got = rows(spark, sf_dir, "op3_histogram_sort")
    assert got.keys() == texts.keys()
    total, slots = Counter(), {}
    for d, t in texts.items():
        r = got[d]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t.encode()) + 16, zlib.crc32(t.encode()), "bytes", None) and 0 <= r.shard < 40
        total[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(total.values()) <= sum(total.values()) / 40 + max(len(t.encode()) + 16 for t in texts.values())


def removed(raws, span):
    seen = Counter(b[s : s + span] for b in raws for s in range(len(b) - span + 1))
    for b in raws:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - span + 1):
            if seen[b[s : s + span]] > 1:
                gone[s : s + span] = True
        yield len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone])


def test_op5(spark, sf_dir, texts):
    got = rows(spark, sf_dir, "op5_induced_sorting")
    want = dict(zip(texts, removed([t.encode() for t in texts.values()], 400), strict=True))
    assert {d: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for d, r in got.items()} == {d: (*w[:3], sha(w[3])) for d, w in want.items()}


def test_op7(spark, sf_dir, texts):
    got = rows(spark, sf_dir, "op7_subword_language")
    known = {r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang").distinct().collect()}
    for d, t in texts.items():
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= got[d].score <= 1
        assert got[d].lang_pred in known if any(c.isalpha() for c in t) else got[d].lang_pred == "und"


def test_op8(spark, sf_dir, texts):
    """Words, document frequencies, band, subsets and likeness, one text and one term at a time."""
    got = rows(spark, sf_dir, "op8_imatch")
    order = sorted(texts)
    term = lambda w: int(words.word_hashes([w])[0][0])
    hashes = {}

    def terms(t):
        lower = bytes(words.LOWER[np.frombuffer(t.encode(), np.uint8)])
        out = set()
        for w in lower.translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" "):
            if w:
                out.add(hashes.setdefault(w, term(w) if w not in hashes else hashes[w]))
        return out

    own = {d: terms(texts[d]) for d in order}
    df = Counter(h for s in own.values() for h in s)
    n = len(order)
    band = {h for h, c in df.items() if max(2, 0.001 * n) <= c <= max(2, 0.05 * n)}
    keys = [int(k) for k in words.mix(np.arange(1, sum(m for m, _ in SUBSETS) + 1, dtype=np.uint64))]
    rates = [r for m, r in SUBSETS for _ in range(m)]

    def prints(s):
        use = sorted(s & band or s)
        out = []
        for key, rate in zip(keys, rates, strict=True):
            inside = [h for h in use if int(words.mix(np.array([h ^ key], np.uint64))[0]) % rate == 0]
            digest = hashlib.blake2b(struct.pack(f"<{len(inside)}Q", *inside), digest_size=8).digest()
            out.append(max(1, int.from_bytes(digest, "little")) if inside else 0)
        return out

    def like(a, b):
        some = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
        return sum(x == y for x, y in some) / len(some) if some else 1.0

    for k in range(0, n, 9):
        d, e = order[k], order[(k + 1) % n]
        half = len(texts[d]) // 2
        edited = texts[d][: len(texts[d]) - half] + texts[e][:half]
        p, q, u = prints(own[d]), prints(terms(edited)), prints(own[e])
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(texts[d]), sha(edited.encode()))
        assert r.fingerprint == "".join(f"{x:016x}" for x in p) and r.edited_fingerprint == "".join(f"{x:016x}" for x in q)
        assert r.near_edited == pytest.approx(like(p, q)) and r.near_next == pytest.approx(like(p, u))


def test_op8_same_terms_in_other_order():
    printer = Fingerprinter(np.zeros(0, np.uint64))
    a, b, c = printer.prints(["one two three", "three  one two two", ""])
    assert (a == b).all() and not c.any() and likeness(c[None], c[None])[0] == 1


def shingle_sets(texts):
    out = []
    for t in texts:
        w = bytes(words.LOWER[np.frombuffer(t.encode(), np.uint8)]).split() if t else []
        out.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    return out


def test_op10(spark, sf_dir, texts):
    got = rows(spark, sf_dir, "op10_divide_skip")
    ids, sets = list(texts), shingle_sets(texts.values())
    least = {d: d for d in ids}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(ids[i]), find(ids[j])))
                least[y] = x
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == {d: (len(s), find(d)) for d, s in zip(ids, sets, strict=True)}


def thue_morse(n, a, b):
    w, v = a, b
    while len(w) < n:
        w, v = w + v, v + w
    return w


@pytest.mark.parametrize("size", [512, 1024, 2048, 4096])
def test_thue_morse_words_differ(size):
    w, v = thue_morse(size, "a", "b"), thue_morse(size, "b", "a")
    for run in ([w.encode()], [(w + " x").encode()]):
        other = [r.replace(b"a", b"#").replace(b"b", b"a").replace(b"#", b"b") for r in run]
        assert words.word_hashes(run)[0][0] != words.word_hashes(other)[0][0]
        assert set(words.shingle_hashes(run)[0]) != set(words.shingle_hashes(other)[0])
    x, y = (np.frombuffer(s.encode(), np.uint8) for s in (w, v))
    assert suffix_dedup.gram_hashes(x, 400)[0] != suffix_dedup.gram_hashes(y, 400)[0]


def test_long_words_hash_by_all_their_bytes():
    long = [b"x" * 5000 + c for c in (b"a", b"b")] + [b"y" + b"x" * 5000]
    assert len({int(words.word_hashes([w])[0][0]) for w in long}) == 3
    alone, among = words.word_hashes([b"short " + long[0] + b" end"])[0], words.word_hashes([b"q", b"short " + long[0] + b" end"])[0]
    assert (alone == among[1:]).all()


def test_thue_morse_documents_do_not_link(spark):
    df = spark.createDataFrame([(1, thue_morse(1024, "a", "b")), (2, thue_morse(1024, "b", "a"))], "doc_id long, text string")
    assert {r.component_id for r in jaccard.similar_documents(df).collect()} == {1, 2}


def test_no_language_to_learn(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, None), (3, "", None)], "doc_id long, text string, lang string")
    out = language.identify(df, language.train_languages(df)).collect()
    assert [(r.lang_pred, r.score, r.rejected) for r in out] == [("und", 0.0, True)] * 3


def test_unfinished_components_fail(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(300)], "u long, v long")
    with pytest.raises(RuntimeError, match="unfinished"):
        components.connected_components(chain, rounds=1)


def test_a_round_of_components_is_two_exchanges(spark, monkeypatch):
    plans, write = [], components.staged
    monkeypatch.setattr(components, "staged", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df))[1])
    edges = [(k, k + 1) for k in range(40)] + [(k, 41) for k in range(50, 90)] * 2
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in range(50, 90)} == {got[41]} == {41}
    assert len(plans) > 2 and {p.count("Exchange hashpartitioning") for p in plans[1:]} == {2}


def test_very_long_texts(spark):
    """One byte repeated, and a text of many pieces with a passage of another: memory is bounded by pieces, not by contexts times texts."""
    rng = np.random.default_rng(1)
    long = " ".join(f"{x:x}" for x in rng.integers(0, 2**40, 300_000))
    passage = long[1_048_000:1_049_500]
    df = spark.createDataFrame([(1, "a" * 5_000_000), (2, long), (3, "before " + passage + " after"), (4, "a" * 399)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()}
    assert got[1] == (5_000_000, 5_000_000, 1) and got[4] == (399, 0, 0)
    assert got[2][1:] == (1500, 1) and got[3][1:] == (1500, 1)
    assert df.count() == len(got)


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "same words in this text", "en", None, 1), (4, "same words in this text", "en", "s", 1), (4, "same words in this text", "en", "s", 1), (5, "x" * 3000, None, "s", 2), (6, "caf\u00e9 \u4f60\u597d", "fr", "t", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for data in (odd, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            kept = out.collect()
            if name != "packing":
                assert out.columns == docs.columns and len(kept) <= len(data)
            else:
                assert sum(r.piece == 0 for r in kept) == len(data)
    same = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(odd, schema), "").where(F.col("text").startswith("same")).collect()}
    assert same == {4}
