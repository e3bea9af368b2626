"""The corpus operators against brute force, libraries and exact round trips, on small and on awkward tables."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgrid.llm import bpe, induced, media, packing, words
from veilgrid.llm.components import connected_components
from veilgrid.llm.fingerprints import fingerprint_documents
from veilgrid.llm.jaccard import divide_skip, one_of_each, similar_documents
from veilgrid.llm.language import identify, train_languages
from veilgrid.llm.line_dedup import drop_boilerplate
from veilgrid.llm.quality import judge
from veilgrid.llm.sharding import shard_by_bytes
from veilgrid.llm.suffix_dedup import remove_repeats

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, id string"
LONG = " ".join(f"word{i % 977} run{i}" for i in range(6000))
ODD = [
    (1, None, None, None, None, 1, "x", "a"),
    (2, "", "en", "s", 0, 2, None, "b"),
    (2, "", "en", "s", 0, 2, None, "b"),
    (None, "the same words again and again", "en", None, 1, None, "y", None),
    (4, "the same words again and again", "en", "s", 1, None, "y", None),
    (4, "the same words again and again", "en", "s", 1, None, "y", None),
    (5, LONG, "fr", "s", 1, None, "y", None),
    (6, LONG + " one more", "fr", "s", 1, None, "y", None),
    (7, "é ß 你好 <|endoftext|>   x", "de", "t", 1, None, "y", None),
]
TEXTS = ["", " ", "a  b\n\n c <|endoftext|> x<|startoftext|>y", "ΑΣ Σ İ ß ẞ", "don't we'LL 123 ½ 你好，世界 😀", "x" * 300 + "ab" * 200, "a.\nB c\nd", "\x1c z\x85 \x00", "é́ ́e"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def local(docs):
    return sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())


def transducer(folder, ws, ids):
    path = folder / "lexicon"
    path.write_bytes(bpe.build_transducer(ws, ids))
    return bpe.Transducer(str(path))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_equals_the_library(name, local, tmp_path):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(P.path(name)), bpe.Bpe(P.path(name))
    texts = TEXTS + [t for _, t in local[:40]]
    top = sorted({w for t in texts[::2] for special, part in own.pieces(t) if not special for w in own.split(part)})
    pairs = sorted((w.encode("utf-8", "surrogateescape"), own.merge(w)) for w in top)
    lexicon = transducer(tmp_path, [w for w, _ in pairs], [i for _, i in pairs])
    assert (lexicon.ranks([w for w, _ in pairs]) == np.arange(len(pairs))).all()
    assert (lexicon.ranks([w + b"\xff" for w, _ in pairs]) == -1).all()
    encoders = [bpe.Encoder(own, lexicon)] + ([packing.RankEncoder(own)] if "byte" in name else [])
    decoder = bpe.Decoder(own)
    for encoder in encoders:
        for text, ids in zip(texts, encoder.encode_batch(texts), strict=True):
            expected = lib.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == expected
            assert decoder.decode(ids) == lib.decode(expected, skip_special_tokens=False)


def test_transducer_shares_suffixes(tmp_path):
    ws = [b"nation", b"ration", b"station", b"stations"]
    t = transducer(tmp_path, ws, [[k] for k in range(4)])
    assert len(t.ends) < sum(map(len, ws)) / 1.5 and t.encoded_many(t.ranks(ws)) == [np.array([k], "<u4").tobytes() for k in range(4)]
    assert transducer(tmp_path, [], []).ranks([b"x"]).tolist() == [-1]


def test_bpe_on_odd_tables(odd, empty):
    assert bpe.encode_documents(odd, P.path("word_bpe_49k.json"), 50).count() == len(ODD)
    assert bpe.encode_documents(empty, P.path("word_bpe_49k.json"), 50).count() == 0


def test_png_round_trip():
    rng = np.random.default_rng(0)
    for shape in ((1, 64), (40, 7), (33, 21, 3), (5, 5, 4)):
        for image in (rng.integers(0, 256, shape).astype(np.uint8), np.cumsum(np.ones(shape), axis=0).astype(np.uint8)):
            assert (media.decode_png(media.encode_png(image)) == image).all()
    good = media.encode_png(rng.integers(0, 256, (8, 8)).astype(np.uint8))
    for k in (3, 20, len(good) - 30):
        with pytest.raises(ValueError):
            media.decode_png(good[:k] + bytes([good[k] ^ 1]) + good[k + 1 :])


def test_png_filters_by_definition():
    """All five row filters, undone pixel by pixel."""
    rng = np.random.default_rng(1)
    lines, kinds = rng.integers(0, 256, (12, 9)).astype(np.uint8), np.array([0, 1, 2, 3, 4, 4, 3, 2, 1, 0, 2, 4], np.uint8)
    out = np.zeros((13, 12), int)
    for y in range(12):
        for x in range(9):
            a, b, c = out[y + 1, x + 2 - 2] if x >= 3 else 0, out[y, x + 3], out[y, x] if x >= 3 else 0
            a = out[y + 1, x] if x >= 3 else 0
            p = a + b - c
            paeth = min(((abs(p - v), k, v) for k, v in enumerate((a, b, c))))[2]
            out[y + 1, x + 3] = (int(lines[y, x]) + (0, a, b, (a + b) // 2, paeth)[kinds[y]]) % 256
    assert (media.unfilter(lines, kinds, 3) == out[1:, 3:]).all()


def test_media_on_odd_tables(odd, empty):
    got = media.read_media(media.store_texts(odd)).collect()
    by = defaultdict(set)
    for r in got:
        by[r.n_bytes, bytes(r.pixels)].add((bytes(r.media), r.feature))
    assert len(got) == len(ODD) and all(len(v) == 1 for v in by.values())
    assert media.read_media(media.store_texts(empty)).count() == 0


def test_sharding(docs, odd, empty):
    rows = shard_by_bytes(docs, 8).collect()
    size = Counter()
    slots = defaultdict(list)
    for r in rows:
        assert r.size == len((r.text or "").encode()) + 16
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    longest = max(r.size for r in rows)
    assert len(rows) == docs.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) <= 2 * longest
    got = shard_by_bytes(odd, 3).collect()
    assert len(got) == len(ODD) and "kept" in got[0].asDict()
    assert shard_by_bytes(empty, 3).count() == 0


def test_one_hot_text_is_split_by_id(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("copy " * 20).alias("text"))
    n = [r["count"] for r in shard_by_bytes(df, 4).groupBy("shard").count().collect()]
    assert max(n) - min(n) <= 30


def test_lines(spark, odd, empty):
    rows = [(k, "menu\nbody %d\n\nmenu" % k, "a") for k in range(10)] + [(90, "menu\nx", "b"), (91, None, "a"), (92, "", None)]
    out = {r.doc_id: r for r in drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_percent=50).collect()}
    assert out[3].text == "body 3\n" and (out[3].n_lines, out[3].n_dropped) == (4, 2)
    assert out[90].text == "menu\nx" and out[91].text is None and out[92].text == ""
    assert drop_boilerplate(odd).count() == len(ODD) and drop_boilerplate(empty).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(2)
    for k in range(150):
        t = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(1, 150))).astype(np.uint8)
        order = induced.suffix_order(t, 400, memory=int(rng.choice([64, 1 << 20])))
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tobytes())


def removed(texts, span):
    raw = [t.encode() for t in texts]
    seen = Counter(b[s : s + span] for b in raw for s in range(len(b) - span + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - span + 1):
            if seen[b[s : s + span]] > 1:
                gone[s : s + span] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def test_suffix_dedup(spark, local):
    body = LONG[:3000]
    texts = [t for _, t in local[:60]] + [body[:900], "x" + body[100:700] + "y", body[:399], "ab" * 700, "é" * 500, "", body[:900]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(df).collect()}
    assert [got[k] for k in range(len(texts))] == removed(texts, 400)


def test_passages_of_over_fifty_words_go(spark, local):
    """Of 51 short words there are under 400 bytes."""
    import corpus_pipeline

    words = "the law of the sea was old and few who had met it did so twice for the men that ran it saw to that and kept the old ways in a book so big that none of them could lift it with one hand or read it by the light of day".split()
    passage = " ".join(words[:51])
    texts = [f"{t} {passage} {t[::-1]}" if k < 2 else t for k, (_, t) in enumerate(local[:12])]
    assert len(words) >= 51 and 200 <= len(passage) < 250 and all(passage not in t for t in texts[2:])
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.passages(spark, df, "").collect()}
    expected = [kept.decode("utf-8", "ignore") for *_, kept in removed(texts, 200)]
    assert [got[k] for k in range(len(texts))] == expected
    assert all(passage[5:-5] not in t for t in got.values())


def test_wide_anchor_by_windows(spark):
    from veilgrid.llm.suffix_dedup import repeated_spans

    shared = LONG[:300]
    texts = [f"{LONG[400 + 7 * k : 700 + 7 * k]}{shared}{LONG[9000 + 11 * k : 9300 + 11 * k]}" for k in range(30)] * 1 + [LONG[400:700] + shared + "zzz" * 50]
    df = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "id long, tk long, text string")

    def covered(**how):
        out = defaultdict(set)
        for r in repeated_spans(df, 400, 100, **how).collect():
            out[r.id] |= set(range(r.begin, r.end))
        return dict(out)

    assert covered() == covered(shard_contents=2)


def test_suffix_dedup_on_odd_tables(odd, empty):
    got = remove_repeats(odd).collect()
    assert len(got) == len(ODD) and sum(r.n_removed for r in got) > 2 * 0.9 * len(LONG)
    assert remove_repeats(empty).count() == 0


def test_best_fit():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 101, 500)
    bins = packing.best_fit(sizes, 100)
    fill = np.bincount(bins, weights=sizes)
    assert fill.max() <= 100 and len(fill) <= sizes.sum() / 100 * 1.05 + 2


def test_packing(docs, odd, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = packing.pack_documents(docs.limit(60), P.path("byte_bpe_50k.json"), group_items=40).toPandas()
    texts = {r.doc_id: r.text for r in docs.limit(60).collect()}
    for d, g in out.sort_values("piece").groupby("doc_id"):
        ids = np.array([*lib.encode(texts[d], add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert sum(g["length"]) * 4 == len(ids) and [zlib.crc32(ids[4 * a : 4 * (a + n)]) for a, n in zip(g["start"], g["length"], strict=True)] == g["ids_crc32"].tolist()
    s = out.sort_values(["sequence_id", "offset"])
    assert ((s.groupby("sequence_id")["length"].cumsum() - s["length"]) == s["offset"]).all() and s.groupby("sequence_id")["length"].sum().max() <= 2048
    assert packing.pack_documents(odd, P.path("byte_bpe_50k.json")).where("piece = 0").count() == len(ODD)
    assert packing.pack_documents(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_languages(docs, odd, empty):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = train_languages(docs.where(~held))
    got = identify(docs, model).where(held)
    assert got.where("lang = lang_pred").count() >= 0.9 * got.count()
    got = identify(odd, model).collect()
    assert len(got) == len(ODD) and [r.lang_pred for r in got][:3] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got)
    assert identify(empty, model).count() == 0


def test_fingerprints(docs, local, odd, empty):
    out = sorted(fingerprint_documents(docs).collect(), key=lambda r: r.id)
    texts = [t for _, t in local]
    for r, a, b in zip(out, texts, texts[1:] + texts[:1], strict=True):
        assert r.edited == a[: len(a) - len(a) // 2] + b[: len(a) // 2] and r.n_chars == len(a)
    by = defaultdict(set)
    for r, t in zip(out, texts, strict=True):
        by[t].add(r.fingerprint)
    assert all(len(v) == 1 for v in by.values())
    assert np.mean([r.near_edited for r in out]) > 5 * np.mean([r.near_next for r in out])
    assert fingerprint_documents(odd).count() == len(ODD) and fingerprint_documents(empty).count() == 0


def test_quality(spark, sf_dir, docs, odd, empty):
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND toxic = 0").select("doc_id")
    out = judge(docs, trusted).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    assert out.where("quality = 1 AND toxic = 0 AND NOT keep").count() <= 0.05 * out.count()
    assert judge(odd, odd.select("doc_id").limit(6)).count() == len(ODD)
    assert judge(empty, empty.select("doc_id")).count() == 0


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def components(texts):
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return [(len(s), find(k)) for k, s in enumerate(sets)]


def test_shingles():
    texts = ["a b", "", "A b c D e", "x y z w v u", "  ", "a b c d e a b c d e"]
    for first, run in words.blocks(texts):
        h, at, _ = words.shingle_hashes(run)
        assert np.diff(at).tolist() == [len(shingles(t)) for t in texts[first : first + len(run)]]


def test_jaccard_join(spark, local):
    rng = np.random.default_rng(4)
    texts = [t for _, t in local[:120]]
    base = [f"w{k}" for k in range(120)]
    for k in range(40):
        own = list(base)
        for j in rng.integers(0, 120, int(rng.integers(0, 6))):
            own[j] = f"new{k}x{j}"
        texts.append(" ".join(own))
    texts += ["short one", "Short ONE", "", "one two three four five six"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (4096, 8):
        got = {r.id: (r.n_shingles, r.component_id) for r in similar_documents(df, chunk=chunk).collect()}
        assert [got[k] for k in range(len(texts))] == components(texts)


def test_divide_skip_finds_all_links():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(1, 60))).astype(np.uint64)) for _ in range(80)]
    sets += [np.unique(np.concatenate([s[: max(1, len(s) * 9 // 10)], [np.uint64(99)]])) for s in sets]
    every = np.arange(len(sets))
    links = divide_skip(sets, every, every, 80)

    def connected(pairs):
        up = {k: k for k in range(len(sets))}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[find(a)] = find(b)
        groups = defaultdict(set)
        for k in up:
            groups[find(k)].add(k)
        return sorted(map(sorted, groups.values()))

    full = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * (o := len(np.intersect1d(sets[a], sets[b]))) >= 80 * (len(sets[a]) + len(sets[b]) - o)]
    assert connected(links) == connected(full)


def test_jaccard_on_odd_tables(odd, empty):
    got = similar_documents(odd).collect()
    assert len(got) == len(ODD) and {r.n_shingles for r in got if r.id == 2} == {0}
    assert one_of_each(odd).where("doc_id = 4").count() == 1 and one_of_each(empty).count() == 0
    assert similar_documents(empty).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (7, 7), (200, 200), (300, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[100], got[101], got[103]} == {100} and got[200] == 200


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "passages", "packing"]
    for _, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
    ids = {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()}
    every = docs.count()
    assert 0.7 * every < len(ids) <= every


def test_a_document_without_id_hides_no_other_of_its_set(spark):
    same = "one two three four five six"
    df = spark.createDataFrame([(None, same), (7, same), (None, same + "  "), (9, "a b c d e f g"), (None, "h i j k l m n")], "doc_id long, text string")
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in similar_documents(df).collect()), key=str)
    assert got == sorted([(None, 2, 7), (7, 2, 7), (None, 2, 7), (9, 3, 9), (None, 3, None)], key=str)
    kept = [r.doc_id for r in one_of_each(df).collect()]
    assert sorted(map(str, kept)) == ["7", "9", "None"]
