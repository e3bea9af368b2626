"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The corpus's most frequent words are merged once and compiled into a minimal acyclic automaton: words that end alike
share states. Each transition adds a number; the sum along a word is its rank, and ranks index the table of ids. The
file of the automaton lies once on each executor and its workers map it; a batch's distinct words walk it together.
Words that it doesn't hold go through the merges themselves, so the result is exact whatever the lexicon has.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import mmap
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, in_batches, sliced, staged, texts_of

SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Beyond Latin letters and general punctuation, Unicode versions may differ on what is a letter: the library splits there.
RARE = re.compile("[^\\x00-\\u024f\\u2000-\\u2027\\u202f-\\u2060\\u20ac]")
#: Texts with these, or RARE, are split as a whole: white space other than space and line end, control characters.
UNUSUAL = re.compile("[^\\n\\x20-\\x7e\\xa1-\\u024f\\u2010-\\u2027\\u20ac]|İ")
MEMO = 200_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else the next free from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Bpe:
    """The vocabulary and merges of a tokenizer file, with the splitting rules of its two public kinds."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.merges = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.lower = spec.get("normalizer") is not None
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.letters = byte_letters()
        self.library = Tokenizer.from_file(path)
        self._tables: tuple | None = None
        space = f"[{SPACE}]"
        if self.lower:
            self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        else:
            self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|{space}+(?=$|{space})|{space}+")

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """The special tokens' strings (True) and what lies between them."""
        if self.specials is None or "<|" not in text:
            yield False, text
            return
        for k, part in enumerate(self.specials.split(text)):
            if part:
                yield bool(k % 2), part

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens, as they stand in it (lower-case for the lower-case kind)."""
        if RARE.search(text) or (self.lower and ("İ" in text or "̀" <= max(text, default="") <= "ͯ")):
            if self.lower:
                text = self.library.normalizer.normalize_str(text)
            back = {c: b for b, c in enumerate(self.letters)}
            return [bytes(back[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.words.findall(text.lower() if self.lower else text)

    def chunks(self, text: str) -> list[str] | None:
        """Strings between which no word runs on, so that each can be encoded by itself; None if that can't be told cheaply.

        The lower-case kind drops white space: its chunks are what white space sets apart. The other keeps it: a chunk
        takes the one space before it, and single line ends stand alone.
        """
        if not text or UNUSUAL.search(text):
            return None if text else []
        if self.lower:
            return text.lower().split()
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n":
            return None
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def merge(self, word: str) -> list[int]:
        """The ids of one word by the merges: the lowest-ranked neighbouring pair first, the leftmost of equals."""
        parts = [self.letters[b] for b in word.encode("utf-8", "surrogateescape")]
        if not parts:
            return []
        parts[-1] += self.suffix
        n = len(parts)
        if n < 40:
            get, never = self.merges.get, 1 << 40
            ranks = [get(p, never) for p in zip(parts, parts[1:], strict=False)]
            while ranks and (least := min(ranks)) < never:
                j = ranks.index(least)
                parts[j : j + 2] = [parts[j] + parts[j + 1]]
                del ranks[j]
                if j:
                    ranks[j - 1] = get((parts[j - 1], parts[j]), never)
                if j < len(ranks):
                    ranks[j] = get((parts[j], parts[j + 1]), never)
            return [self.vocab[p] for p in parts if p in self.vocab]
        # Long words: a heap of pairs over a linked list, in n log n.
        right, left = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, j, parts[j], parts[j + 1]) for j in range(n - 1) if (r := self.merges.get((parts[j], parts[j + 1]))) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, j, a, b = heapq.heappop(heap)
            k = right[j]
            if not alive[j] or k < 0 or parts[j] != a or parts[k] != b:
                continue
            parts[j] += parts[k]
            alive[k] = False
            right[j] = right[k]
            if right[k] >= 0:
                left[right[k]] = j
            for x, y in ((left[j], j), (j, right[j])):
                if x >= 0 and y >= 0 and (r := self.merges.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [self.vocab[p] for p, a in zip(parts, alive, strict=True) if a and p in self.vocab]

    def tables(self) -> tuple[np.ndarray, ...]:
        """For merging many words at once: each byte's id inside and at the end of a word; the sorted pairs of ids that merge, their ranks and results."""
        if self._tables is None:
            inside = np.array([self.vocab.get(c, -1) for c in self.letters], np.int64)
            ending = np.array([self.vocab.get(c + self.suffix, -1) for c in self.letters], np.int64)
            rows = sorted((self.vocab[a] << 32 | self.vocab[b], k, self.vocab[a + b]) for (a, b), k in self.merges.items() if a in self.vocab and b in self.vocab and a + b in self.vocab)
            self._tables = inside, ending, *(np.array(x, np.int64) for x in zip(*rows, strict=True))
        return self._tables

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as bytes. Words of like length are merged in step: one merge of each in every round."""
        inside, ending, pairs, ranks, results = self.tables()
        never = np.int64(1 << 40)
        out: list[bytes] = [b""] * len(words)

        def rank_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            key = (a << 32) | b
            at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
            ok = (pairs[at] == key) & (a >= 0) & (b >= 0)
            return np.where(ok, ranks[at], never), at

        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for k in np.flatnonzero(sizes > 32).tolist():
            out[k] = np.array(self.merge(words[k].decode("utf-8", "surrogateescape")), "<u4").tobytes()
        for low, width in ((0, 6), (6, 10), (10, 16), (16, 32)):
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            if not len(rows):
                continue
            n = sizes[rows].copy()
            raw = np.frombuffer(b"".join(words[k].ljust(width, b"\0") for k in rows.tolist()), np.uint8).reshape(-1, width)
            tokens = np.full((len(rows), width + 2), -1, np.int64)
            cols = np.arange(width)
            tokens[:, :width] = np.where(cols < n[:, None], inside[raw], -1)
            tokens[np.arange(len(rows)), n - 1] = ending[raw[np.arange(len(rows)), n - 1]]
            rank = np.full((len(rows), width + 2), never, np.int64)
            rank[:, :width], _ = rank_of(tokens[:, :width], tokens[:, 1 : width + 1])
            live = np.arange(len(rows))
            shift = np.arange(width + 1)
            while len(live):
                j = rank[live].argmin(axis=1)
                ok = rank[live, j] < never
                live, j = live[ok], j[ok]
                if not len(live):
                    break
                _, at = rank_of(tokens[live, j], tokens[live, j + 1])
                src = shift + (shift > j[:, None])
                t = np.take_along_axis(tokens[live], src, axis=1)
                t[np.arange(len(live)), j] = results[at]
                r = np.take_along_axis(rank[live], src, axis=1)
                r[np.arange(len(live)), j] = rank_of(t[np.arange(len(live)), j], t[np.arange(len(live)), j + 1])[0]
                left = np.flatnonzero(j > 0)
                r[left, j[left] - 1] = rank_of(t[left, j[left] - 1], t[left, j[left]])[0]
                tokens[live, : width + 1], rank[live, : width + 1] = t, r
                n[live] -= 1
            packed = tokens.astype("<u4")
            for k, row, m in zip(rows.tolist(), packed, n.tolist(), strict=True):
                out[k] = row[:m].tobytes()
        return out

    def decode_table(self) -> dict[int, bytes]:
        """What each id adds to a decoded text: its bytes, or its token where tokens are set apart by spaces."""
        if not self.byte_decoder:
            return {i: t.encode() for i, t in self.names.items()}
        back = {c: b for b, c in enumerate(self.letters)}
        return {i: t.encode() if i in self.special.values() else bytes(back[c] for c in t) for i, t in self.names.items()}


def build_transducer(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The minimal acyclic transducer of sorted, distinct words, with the ids of each, as one block of bytes.

    Words are added in order; when a word leaves the path of the one before, the states that it can no longer reach
    are replaced by an equal registered state, or registered. Layout: eight counts, then the sorted transition keys
    (state * 256 + byte), their targets and their additions, the final flags, the ids' offsets, the ids.
    """
    trans: list[dict[int, int]] = [{}]
    final: list[bool] = [False]
    register: dict[tuple, int] = {}
    path: list[int] = [0]
    last = b""

    def settle(depth: int) -> None:
        for d in range(len(path) - 1, depth, -1):
            s = path[d]
            key = (final[s], tuple(trans[s].items()))
            if (same := register.get(key)) is not None:
                trans[path[d - 1]][last[d - 1]] = same
            else:
                register[key] = s
        del path[depth + 1 :]

    for w in words:
        common = next((k for k, (a, b) in enumerate(zip(w, last, strict=False)) if a != b), min(len(w), len(last)))
        settle(common)
        for c in w[common:]:
            trans.append({})
            final.append(False)
            trans[path[-1]][c] = len(trans) - 1
            path.append(len(trans) - 1)
        final[path[-1]] = True
        last = w
    settle(0)

    number, stack = {0: 0}, [0]
    while stack:
        for t in trans[stack.pop()].values():
            if t not in number:
                number[t] = len(number)
                stack.append(t)
    memo: dict[int, int] = {}

    def reach(s: int) -> int:
        todo = [s]
        while todo:
            x = todo[-1]
            if x in memo:
                todo.pop()
            elif missing := [t for t in trans[x].values() if t not in memo]:
                todo += missing
            else:
                memo[x] = final[x] + sum(memo[t] for t in trans[x].values())
                todo.pop()
        return memo[s]

    reach(0)
    rows = []
    for s, k in number.items():
        add = int(final[s])
        for c, t in sorted(trans[s].items()):
            rows.append((k * 256 + c, number[t], add))
            add += memo[t]
    rows.sort()
    keys, to, plus = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
    ends = np.zeros(len(number), np.int64)
    for s, k in number.items():
        ends[k] = final[s]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int64)
    flat = np.array([i for x in ids for i in x], np.int64)
    head = np.array([len(keys), len(ends), len(words), len(flat), 0, 0, 0, 0], np.int64)
    return b"".join(x.tobytes() for x in (head, keys, to, plus, ends, offsets, flat))


class Transducer:
    """A memory-mapped transducer: looks up many words at once."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        a = np.frombuffer(self.map, np.int64)
        t, s, w, n = (int(x) for x in a[:4])
        at, cut = 8, []
        for size in (t, t, t, s, w + 1, n):
            cut.append(a[at : at + size])
            at += size
        self.keys, self.to, self.plus, self.ends, self.offsets, self.ids = cut
        self.size = w

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 for those that the lexicon doesn't hold."""
        n = len(words)
        if not n or not len(self.keys):
            return np.full(n, -1, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, n)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        flat = np.frombuffer(b"".join(words) or b"\0", np.uint8)
        state, rank = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live, step = np.flatnonzero(lengths > 0), 0
        rank[lengths == 0] = -1
        while len(live):
            key = state[live] * 256 + flat[starts[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            rank[live[~ok]] = -1
            live, at = live[ok], at[ok]
            state[live] = self.to[at]
            rank[live] += self.plus[at]
            step += 1
            over = lengths[live] == step
            ended = live[over]
            rank[ended[self.ends[state[ended]] == 0]] = -1
            live = live[~over]
        return rank

    def encoded_many(self, ranks: np.ndarray) -> list[bytes]:
        """The ids of words by rank, as bytes."""
        lo, n = self.offsets[ranks], self.offsets[ranks + 1] - self.offsets[ranks]
        ends = np.cumsum(n)
        flat = self.ids[np.repeat(lo - ends + n, n) + np.arange(int(n.sum()))].astype("<u4").tobytes()
        return [flat[4 * (b - k) : 4 * b] for b, k in zip(ends.tolist(), n.tolist(), strict=True)]


class Memo:
    """A map of bounded size in two generations: when the young one is full it becomes the old one, and the old one goes."""

    def __init__(self, most: int = MEMO):
        self.most = most // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def find(self, keys: Iterable[str]) -> dict[str, bytes]:
        young, old = self.young.get, self.old.get
        return {k: v for k in keys if (v := young(k) or old(k)) is not None}

    def add(self, values: dict[str, bytes]) -> None:
        if len(self.young) + len(values) > self.most:
            self.old, self.young = self.young, {}
        self.young.update(values)


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit bytes, over a memo of the chunks met lately."""

    def __init__(self, bpe: Bpe, lexicon: Transducer | None = None):
        self.bpe, self.lexicon = bpe, lexicon
        self.memo = Memo()
        self.special = {t: int(i).to_bytes(4, "little") for t, i in bpe.special.items()}

    def words_ids(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of distinct words: the lexicon walks them all at once, the merges do those that it doesn't hold."""
        new = list(set(words))
        raw = [w.encode("utf-8", "surrogateescape") for w in new]
        ranks = self.lexicon.ranks(raw) if self.lexicon else np.full(len(new), -1)
        unknown = np.flatnonzero(ranks < 0).tolist()
        out = dict(zip([new[k] for k in unknown], self.bpe.merge_many([raw[k] for k in unknown]), strict=True))
        known = np.flatnonzero(ranks >= 0)
        if len(known):
            out |= zip([new[k] for k in known.tolist()], self.lexicon.encoded_many(ranks[known]), strict=True)
        return out

    def chunk_ids(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids of each chunk. Those that the memo doesn't hold are split into words, and all their words done together."""
        out = self.memo.find(chunks)
        new = chunks.difference(out)
        words = {c for c in new if c.isascii() and c.isalpha()}
        parts = [(c, self.bpe.words.findall(c)) for c in new.difference(words)]
        ids_of = self.words_ids(words.union(*(ws for _, ws in parts)))
        fresh = {c: ids_of[c] for c in words}
        get = ids_of.__getitem__
        fresh |= {c: b"".join(map(get, ws)) for c, ws in parts}
        self.memo.add({c: ids for c, ids in fresh.items() if len(c) <= 32})
        out |= fresh
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        cut = [None if "<|" in t else self.bpe.chunks(t) for t in texts]
        get = self.chunk_ids(set().union(*(chunks for chunks in cut if chunks))).__getitem__
        return [self.encode(t) if chunks is None else b"".join(map(get, chunks)) for t, chunks in zip(texts, cut, strict=True)]

    def encode(self, text: str) -> bytes:
        """The ids of any text, word by word."""
        out = []
        for special, part in self.bpe.pieces(text):
            if special:
                out.append(self.special[part])
            else:
                words = self.bpe.split(part)
                ids = self.words_ids(words)
                out += map(ids.__getitem__, words)
        return b"".join(out)


class Decoder:
    def __init__(self, bpe: Bpe):
        table = bpe.decode_table()
        self.pieces = np.empty(max(table) + 1, object)
        self.pieces[:] = b""
        for i, t in table.items():
            self.pieces[i] = t
        self.glue = b"" if bpe.byte_decoder else b" "

    def decode(self, ids: bytes) -> str:
        return self.glue.join(self.pieces[np.frombuffer(ids, "<u4")].tolist()).decode("utf-8", "replace")


@functools.lru_cache(2)
def load(path: str) -> Bpe:
    """A worker reads a tokenizer file once."""
    return Bpe(path)


_coders: dict[str, tuple[Encoder, Decoder]] = {}


def coders(tokenizer: str, lexicon: str) -> tuple[Encoder, Decoder]:
    """The worker's encoder, with what it has learned in earlier tasks, and decoder. lexicon: the name of a distributed file."""
    key = f"{tokenizer}/{lexicon}"
    if key not in _coders:
        _coders.clear()
        _coders[key] = Encoder(load(tokenizer), Transducer(SparkFiles.get(lexicon))), Decoder(load(tokenizer))
    return _coders[key]


def distribute(spark: SparkSession, block: bytes) -> str:
    """Hand a file to all executors by Spark's own file distribution: each holds it once, and its workers map the same pages."""
    name = f"lexicon-{hashlib.sha256(block).hexdigest()[:32]}.bin"
    path = os.path.join(SparkFiles.getRootDirectory(), name)
    if not os.path.exists(path):
        with open(path, "wb") as f:
            f.write(block)
        spark.sparkContext.addFile(path)
    return name


def word_counts(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts as the tokenizer splits them; each batch is counted before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, words, chunks = load(tokenizer), Counter(), Counter()

        def flush() -> pa.RecordBatch:
            for c, n in chunks.items():
                for w in bpe.words.findall(c):
                    words[w] += n
            return pa.RecordBatch.from_pydict({"word": pa.array(list(words), pa.string()), "n": pa.array(list(words.values()), pa.int64())})

        for batch in batches:
            for text in texts_of(batch, text_col):
                if "<|" not in text and (cut := bpe.chunks(text)) is not None:
                    chunks.update(cut)
                else:
                    for special, part in bpe.pieces(text):
                        if not special:
                            words.update(bpe.split(part))
            if len(words) + len(chunks) > MEMO:
                yield flush()
                words, chunks = Counter(), Counter()
        yield flush()

    return in_batches(docs).select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, tokenizer: str, words: int = 50_000, text_col: str = "text") -> bytes:
    """The transducer of the most frequent words of docs: all that occur at least n times, with the least n that gives `words` at most.

    Only a histogram of the counts (at most about 1,400 rows: exact up to 1,024, then an eighth of a power of two wide)
    and then those words come to the driver.
    """
    counts = staged(word_counts(docs, tokenizer, text_col).where(F.length("word") <= 64))
    group = F.when(F.col("n") <= 1024, F.col("n")).otherwise(1024 + F.floor(8 * F.log2("n") - 80).cast("long"))
    total, least = 0, None
    for r in sorted(counts.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n")).collect(), key=lambda r: -r.g):
        total += r.c
        if total > words:
            break
        least = r.n
    top = [] if least is None else counts.where(F.col("n") >= least).select("word").collect()
    bpe = load(tokenizer)
    pairs = sorted((r.word.encode(), bpe.merge(r.word)) for r in top)
    return build_transducer([w for w, _ in pairs], [i for _, i in pairs])


def encode_documents(docs: DataFrame, tokenizer: str, lexicon_words: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary: little-endian unsigned 32-bit, decoded string) of every whole text.

    A null text counts as empty and has no ids; a null id is passed on; repeated rows give repeated rows; an empty
    table gives an empty result; other columns are not looked at, so their names can't clash. A text of any length is
    encoded whole; it is held by one worker, with its ids. The lexicon is a file of at most `lexicon_words` words of at
    most 64 characters, which each executor holds once.
    """
    lexicon = distribute(docs.sparkSession, compile_lexicon(docs, tokenizer, lexicon_words, text_col))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coders(tokenizer, lexicon)
        for whole in batches:
            for batch in sliced(whole):
                ids = encoder.encode_batch(texts_of(batch))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([decoder.decode(x) for x in ids], pa.string())], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(encode, f"id {kind}, ids binary, decoded string")


def op1_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the word-level vocabulary."""
    import public_tokenizers

    out = encode_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
